"""Sharding by sampled splitters.

Records are ordered by a hash of their text and then of their id. A sample of keys, drawn in proportion to record size, gives
splitters; the ranges between them are measured over all records, and an overfull one is sampled and split again. Sizes of the
ranges are then summed up on the driver (their number is bounded), and running sums inside each range place every record at an
exact offset in the total, which decides its shard.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vertexloom.llm.common import cut

SHARDS = 40
#: Keys sampled for a wanted range, ranges wanted at least, and bytes of a range beyond which there are more.
SAMPLED = 13
RANGES = 640
RANGE_BYTES = 16 << 30
#: A range over so many times its fair share is split again, until none is or a round finds no new boundary.
OVERFULL = 2.0
#: Keys that rows with equal texts and ids are spread over.
SPREAD = 4096


def weighted_sample(keys: DataFrame, k: int, total: int) -> list[tuple[int, int]]:
    """``k`` keys at most, drawn without replacement in proportion to ``size``, which sums to ``total``: those with the least exponential times.

    A threshold on the times leaves a few more than ``k``, so that tasks send no more than these.
    """
    unit = (F.pmod(F.xxhash64("k1", "k2", F.lit("sample")), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    timed = keys.select("k1", "k2", (-F.log(unit) / F.col("size")).alias("t")).filter(F.col("t") <= (k + 6 * k**0.5 + 10) / max(1, total) * 1.05)
    drawn = timed.orderBy("t").limit(k).collect()
    return sorted((r.k1, r.k2) for r in drawn)


def quantiles(sample: list[tuple[int, int]], parts: int) -> list[tuple[int, int]]:
    """Up to ``parts - 1`` distinct boundaries that cut the sorted sample evenly."""
    return sorted({sample[len(sample) * i // parts] for i in range(1, parts)}) if sample else []


def range_of(splitters: list[tuple[int, int]]):
    """A column function of (k1, k2): how many splitters are not greater."""
    first, second = (np.array([s[i] for s in splitters], dtype=np.int64) for i in (0, 1))

    @F.pandas_udf("int")
    def number(k1: pd.Series, k2: pd.Series) -> pd.Series:
        a, b = k1.to_numpy(), k2.to_numpy()
        low, high = np.searchsorted(first, a, "left"), np.searchsorted(first, a, "right")
        out = low.copy()
        tied = np.flatnonzero(low < high)
        for start in np.unique(low[tied]):
            rows = tied[low[tied] == start]
            out[rows] = start + np.searchsorted(second[start : high[rows[0]]], b[rows], "right")
        return pd.Series(out.astype(np.int32))

    return number


def shard_by_bytes(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, overhead: int = 16, ranges: int = RANGES, range_bytes: int = RANGE_BYTES, sample: int | None = None) -> DataFrame:
    """Places each record in a shard so that the shards' bytes are equal to within a record.

    Gives ``doc_id, size, text_crc32, shard, slot``: size is the text's UTF-8 bytes plus ``overhead``, a null text counting none
    (its checksum is 0); slot numbers a shard's records from 0 without gaps. Equal texts stand next to each other, and a group
    of copies larger than a range is split by its ids, and rows that repeat id and text by their places in the tasks that read
    them. An empty table gives no rows; other columns of ``df`` are left out. The driver holds a row for each range.
    """
    keys = cut(
        df.select(
            F.col(id_col).alias("doc_id"),
            (F.coalesce(F.octet_length(text_col), F.lit(0)) + overhead).cast("long").alias("size"),
            F.coalesce(F.crc32(F.col(text_col).cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
            F.xxhash64(text_col).alias("k1"),
            F.xxhash64(F.col(id_col), F.lit("id")).bitwiseAND(F.lit(-SPREAD)).bitwiseOR(F.pmod(F.monotonically_increasing_id(), F.lit(SPREAD))).alias("k2"),
        )
    )
    total = keys.agg(F.sum("size")).first()[0] or 0
    ranges = max(ranges, -(-total // range_bytes))
    sample = sample or SAMPLED * ranges
    splitters = quantiles(weighted_sample(keys, sample, total), ranges)
    while True:
        ranged = keys.withColumn("range", range_of(splitters)("k1", "k2")) if splitters else keys.withColumn("range", F.lit(0))
        sizes = {r["range"]: (r.bytes, r.rows, r.keys) for r in ranged.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"), F.max(F.struct("k1", "k2")).alias("most"), F.min(F.struct("k1", "k2")).alias("least")).select("range", "bytes", "rows", (F.col("most") != F.col("least")).alias("keys")).collect()}
        fair = sum(b for b, *_ in sizes.values()) / max(1, ranges)
        over = [r for r, (b, _, several) in sizes.items() if several and b > OVERFULL * fair]
        if not over:
            break
        full = sum(sizes[r][0] for r in over)
        drawn = weighted_sample(ranged.filter(F.col("range").isin(over)), sample, full)
        more = sorted({*splitters, *quantiles(drawn, max(2, round(full / fair * 2)))})
        if more == splitters:
            break
        splitters = more
    starts, at, row = [], 0, 0
    for r in sorted(sizes):
        starts.append((r, at, row))
        at, row = at + sizes[r][0], row + sizes[r][1]
    spark = df.sparkSession
    starts_df = F.broadcast(spark.createDataFrame(starts, "range int, start_bytes long, start_rows long"))  # a row for each range
    order = Window.partitionBy("range").orderBy("k1", "k2", "doc_id", "text_crc32", "size")
    placed = cut(
        ranged.join(starts_df, "range")
        .withColumn("before", F.col("start_bytes") + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
        .withColumn("rank", F.col("start_rows") + F.row_number().over(order) - 1)
        .withColumn("shard", F.least(F.lit(shards - 1), F.floor((F.col("before") + F.col("size") / 2) * shards / F.lit(max(1, at)))).cast("int"))
        .select("doc_id", "size", "text_crc32", "shard", "rank")
    )
    firsts = F.broadcast(placed.groupBy("shard").agg(F.min("rank").alias("first")))  # a row for each shard
    return placed.join(firsts, "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("rank") - F.col("first")).cast("long").alias("slot"))
