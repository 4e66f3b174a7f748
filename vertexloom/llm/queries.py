"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vertexloom.llm import html_extract, media, order_minhash, packing, piece_lattice, prob_minhash, quality_crf, secrets, sharding, toxicity_chain
from vertexloom.llm.common import table


def op1_piece_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four best segmentations of every text."""
    import public_tokenizers

    return piece_lattice.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), with_ids=False)


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as PGM, read back, area-resized and hashed."""
    made = media.media_columns(table(spark, sf_dir, "documents"), with_media=False)
    return made.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", F.col("dhash").alias("feature"), "height", "tile_sha256")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forty shards of near equal bytes."""
    made = sharding.shard_by_bytes(table(spark, sf_dir, "documents"))
    return made.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's chances of three categories, and whether it is toxic."""
    docs = table(spark, sf_dir, "documents")
    return toxicity_chain.score(docs, toxicity_chain.fit(docs, table(spark, sf_dir, "labels")))


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base secrets and random strings of every text."""
    spans = F.col("secret_spans")
    base = F.filter(spans, lambda s: s["kind_order"] < 3)
    count = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    made = secrets.scan(table(spark, sf_dir, "documents"))
    return made.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(secrets.listed(base), 256).alias("base_sha256"), secrets.listed(spans).alias("spans"), count("random"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's main text."""
    return html_extract.extract_pages(table(spark, sf_dir, "pages"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as pieces of binary lengths."""
    import public_tokenizers

    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), with_ids=False)


def op8_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and of its edited form, and their likeness."""
    pairs = order_minhash.edited_pairs(table(spark, sf_dir, "documents"))
    made = order_minhash.add_signature(pairs, F.col("edited"), "edited_signature")
    return made.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        order_minhash.written(F.col("signature")).alias("fingerprint"), order_minhash.written(F.col("edited_signature")).alias("edited_fingerprint"),
        order_minhash.likeness(F.col("signature"), F.col("edited_signature")).alias("near_edited"), order_minhash.likeness(F.col("signature"), F.col("next_signature")).alias("near_next"),
    )


def op9_prob_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's class of near-duplicates."""
    return prob_minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality from its lines."""
    docs = table(spark, sf_dir, "documents")
    return quality_crf.score(docs, quality_crf.fit(docs, table(spark, sf_dir, "labels")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_piece_lattice": op1_piece_lattice,
    "op2_media_columns": op2_media_columns,
    "op3_sharding": op3_sharding,
    "op4_toxicity_chain": op4_toxicity_chain,
    "op5_secret_scans": op5_secret_scans,
    "op6_html_extraction": op6_html_extraction,
    "op7_packing": op7_packing,
    "op8_order_minhash": op8_order_minhash,
    "op9_prob_minhash": op9_prob_minhash,
    "op10_quality_crf": op10_quality_crf,
}

ORACLES: dict[str, str] = {}
