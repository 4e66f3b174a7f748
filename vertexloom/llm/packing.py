"""Packing by power-of-two decomposition.

A document of n tokens is cut at the ones of n's binary form: first pieces of the full context, then pieces of falling
powers of two. Pieces of one length form a bucket, each piece is a whole sequence, so that no sequence crosses documents
and none is padded.
"""

from __future__ import annotations

import functools
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vertexloom.llm.common import map_texts

CONTEXT = 1024
#: The id that ends each document.
END = 0
#: Sequences are numbered within so many groups of documents, each of which one task can hold in external memory.
GROUPS = 4096


def decompose(n: int, limit: int = CONTEXT) -> list[int]:
    """Lengths whose sum is ``n``: powers of two, at most ``limit`` (itself one), longest first."""
    full, rest = divmod(n, limit)
    return [limit] * full + [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1]


@functools.cache
def encoder(json_path: str, rank_path: str | None):
    """A function from text to ids as ``tokenizers`` gives them for the vocabulary in ``json_path``.

    With ``rank_path``, the same vocabulary as ranks, the ids come from ``tiktoken``, which gives equal ids in a quarter of the
    time; texts that hold a special token's string, which only ``tokenizers`` knows, still go there, as does what the other
    library can't take.
    """

    @functools.cache
    def slow():
        from tokenizers import Tokenizer

        return Tokenizer.from_file(json_path)

    by_book = lambda text: slow().encode(text, add_special_tokens=False).ids
    if rank_path is None:
        return by_book
    import base64
    import json

    import public_tokenizers
    import tiktoken

    with open(rank_path, "rb") as lines:
        ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    with open(json_path) as book:
        special = [token["content"] for token in json.load(book)["added_tokens"]]

    def encode(text: str) -> list[int]:
        if any(token in text for token in special):
            return by_book(text)
        try:
            return fast.encode_ordinary(text)
        except (ValueError, RuntimeError):
            return by_book(text)
        except BaseException as error:  # its panics, as over a million spaces, aren't of class Exception
            if type(error).__name__ != "PanicException":
                raise
            return by_book(text)

    return encode


def pack(df: DataFrame, json_path: str, rank_path: str | None = None, *, id_col: str = "doc_id", text_col: str = "text", limit: int = CONTEXT, with_ids: bool = True) -> DataFrame:
    """Pieces of all documents, one row each: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` and, if asked for, ``ids``.

    A null or empty text is the end id alone. Repeated rows give repeated pieces, each with a sequence of its own. An empty table
    gives no rows; other columns of ``df`` are left out. ``sequence_id`` is unique: its remainder by the number of buckets tells
    the piece's length, the rest numbers the bucket's sequences.
    """
    if limit & (limit - 1) or limit < 1:
        raise ValueError("limit must be a power of two")

    def pieces(rows: pa.RecordBatch) -> dict:
        encode = encoder(json_path, rank_path)
        out = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids")}
        for doc, text in zip(rows.column("doc_id").to_pylist(), rows.column("text").to_pylist(), strict=True):
            ids = np.array([*encode(text or ""), END], dtype="<u4")
            lengths, at = decompose(len(ids), limit), 0
            for length in lengths:
                part = ids[at : at + length]
                out["start"].append(at)
                out["ids_crc32"].append(zlib.crc32(part))
                out["ids"].append(part.astype("i4") if with_ids else None)
                at += length
            out["doc_id"] += [doc] * len(lengths)
            out["doc_tokens"] += [len(ids)] * len(lengths)
            out["length"] += lengths
        return out

    kind = dict(df.dtypes)[id_col]
    cut = map_texts(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), pieces, f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint" + ", ids array<int>" * with_ids, "text")
    # The row's number in its task keeps pieces of rows that share an id, or have none, out of one group.
    group = F.pmod(F.xxhash64("doc_id", "start", F.monotonically_increasing_id()), F.lit(GROUPS))
    bucket = F.log2(F.col("length")).cast("long")
    order = Window.partitionBy("length", "pack_group").orderBy("doc_id", "start", "ids_crc32")
    number = (F.row_number().over(order).cast("long") - 1) * GROUPS + F.col("pack_group")
    return (
        cut.withColumn("pack_group", group)
        .withColumn("sequence_id", number * (limit.bit_length()) + bucket)
        .withColumn("offset", F.lit(0).cast("long"))
        .select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids)
    )
