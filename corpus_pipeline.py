"""A training corpus from ``documents``, in five stages: quality, toxicity, near-duplicates, secrets, packing.

Each stage works on all rows that the stage before kept; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vertexloom.llm import packing, prob_minhash, quality_crf, secrets, toxicity_chain
from vertexloom.llm.common import table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose lines score well enough stay (operator 10). A null text is an empty line; repeated rows stay or go together; without labels of both kinds all stay."""
    return quality_crf.keep_good(docs, quality_crf.fit(docs, table(spark, sf_dir, "labels")))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain doesn't call toxic stay (operator 4). A null text counts as empty; repeated rows stay or go together; without labels of both kinds all stay."""
    return toxicity_chain.keep_clean(docs, toxicity_chain.fit(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays, the one with the least id (operator 9); rows without an id all stay.

    Of rows that share an id and a text, one stays; rows that share an id but not the text stay or go together, as one document.
    Null texts count as empty, and empty texts are one class. An empty table gives no rows; all columns are kept.
    """
    classes = prob_minhash.near_duplicates(docs.select("doc_id", "text"))
    stay = classes.filter("doc_id = class_id").select("doc_id").distinct()
    equal = F.sha2(F.coalesce("text", F.lit("")), 256)
    named = docs.filter(F.col("doc_id").isNotNull()).join(stay, "doc_id", "left_semi").withColumn("hash of equal rows", equal)
    order = Window.partitionBy("doc_id", "hash of equal rows").orderBy(*(F.xxhash64(c) for c in docs.columns))
    named = named.withColumn("rank of equal rows", F.row_number().over(order)).filter(F.col("rank of equal rows") == 1).select(*docs.columns)
    return named.unionByName(docs.filter(F.col("doc_id").isNull()))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; secrets in them are replaced by a mark, and ``n_chars`` follows (operator 5). A null or empty text stays as it is."""
    found = secrets.scan(docs)
    clean = secrets.redacted(F.col("text"), F.col("secret_spans"))
    length = F.when(F.size("secret_spans") > 0, F.char_length(clean).cast("long")).otherwise(F.col("n_chars"))
    return found.select(*(clean.alias(c) if c == "text" else length.alias(c) if c == "n_chars" else F.col(c) for c in docs.columns))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as pieces of binary lengths, with their token ids (operator 7). A null or empty text is the end id alone; repeated rows give repeated pieces."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [("quality", quality), ("toxicity", toxicity), ("near_duplicates", near_duplicates), ("secret_scans", secret_scans), ("packing", packed)]

#: SQL can't express the models, the sketches or the tokenizer; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs)
    return docs
