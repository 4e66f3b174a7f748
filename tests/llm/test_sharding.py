import zlib

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from vertexloom.llm import sharding


def check(df, shards, made):
    got = made.toPandas()
    want = df.toPandas()
    size = want.text.map(lambda t: len((t or "").encode()) + 16)
    assert sorted(got["size"]) == sorted(size) and sorted(got.text_crc32) == sorted(want.text.map(lambda t: zlib.crc32((t or "").encode())))
    assert set(got.shard) <= set(range(shards))
    for _, group in got.groupby("shard"):
        assert sorted(group.slot) == list(range(len(group)))
    return got


def test_odd_texts(odd, none):
    check(odd, 3, sharding.shard_by_bytes(odd, shards=3))
    assert sharding.shard_by_bytes(none).count() == 0


def test_a_hot_text_is_split(spark):
    df = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, F.lit("copy of one text " * 4)).otherwise(F.concat(F.lit("text "), F.repeat(F.lit("x"), (F.col("id") % 50).cast("int")))).alias("text"))
    got = check(df, 40, sharding.shard_by_bytes(df, sample=512, ranges=64))
    per = got.groupby("shard")["size"].sum()
    assert len(per) == 40 and per.max() - per.min() <= 2 * got["size"].max()


def test_shards_follow_the_order_of_keys(spark):
    """Against running sums over one sorted list."""
    df = spark.range(2000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("ab"), (F.col("id") % 97).cast("int")).alias("text"))
    keys = df.select("doc_id", (F.octet_length("text") + 16).alias("size"), F.xxhash64("text").alias("k1"), F.xxhash64("doc_id", F.lit("id")).alias("k2")).toPandas().sort_values(["k1", "k2", "doc_id"])
    before = keys["size"].cumsum() - keys["size"]
    want = dict(zip(keys.doc_id, np.minimum(39, ((before + keys["size"] / 2) * 40 / keys["size"].sum()).astype(int)), strict=True))
    got = sharding.shard_by_bytes(df, sample=300, ranges=50).toPandas()
    assert dict(zip(got.doc_id, got.shard, strict=True)) == want


def test_splitters():
    assert sharding.quantiles([], 4) == [] and sharding.quantiles([(i, 0) for i in range(8)], 4) == [(2, 0), (4, 0), (6, 0)]
    number = sharding.range_of([(1, 5), (1, 9), (3, 0)]).func
    assert number(pd.Series([0, 1, 1, 1, 2, 3, 9]), pd.Series([7, 4, 5, 9, 0, -1, 0])).tolist() == [0, 0, 1, 2, 2, 2, 3]


def test_equal_rows_are_split(spark):
    """Rows that share id and text, or text and no id, don't stay in one range."""
    for i in (7, None):
        df = spark.createDataFrame([(i, "one text of some length")] * 4000 + [(j, f"text {j}") for j in range(2000)], "doc_id long, text string")
        got = check(df, 40, sharding.shard_by_bytes(df, ranges=64))
        per = got.groupby("shard")["size"].sum()
        assert len(per) == 40 and per.max() - per.min() <= 2 * got["size"].max()


def test_the_sample_is_the_least_times_and_few_rows_are_sent(spark):
    keys = spark.range(20000).select(F.xxhash64("id").alias("k1"), F.col("id").alias("k2"), (F.col("id") % 90 + 10).alias("size"))
    total = keys.agg(F.sum("size")).first()[0]
    unit = (F.pmod(F.xxhash64("k1", "k2", F.lit("sample")), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    want = sorted((r.k1, r.k2) for r in keys.orderBy(-F.log(unit) / F.col("size")).limit(500).collect())
    assert sharding.weighted_sample(keys, 500, total) == want
