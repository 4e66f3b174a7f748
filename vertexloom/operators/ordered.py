"""Running totals, ranks and successors in a global order without a window over the whole table.

Keys are cut into blocks. Inside a block a window does the work; what comes before or after a block is found from one row for
each block. Blocks are cut into groups in turn, so that no window has more than 2**24 rows, whatever gaps the keys have.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1 << 16
GROUP = 1 << 24


def running_total(df: DataFrame, key: str, value: str, out: str, block: int = BLOCK, group: int = GROUP) -> DataFrame:
    """``df`` and ``out``: the sum of ``value`` over all rows with a smaller long ``key``. Keys are distinct."""
    blocked = df.withColumn("_block", F.floor(F.col(key) / block))
    sums = blocked.groupBy("_block").agg(F.sum(value).alias("_sum")).withColumn("_group", F.floor(F.col("_block") / group))
    groups = sums.groupBy("_group").agg(F.sum("_sum").alias("_sum"))
    groups = groups.select("_group", (F.sum("_sum").over(Window.orderBy("_group")) - F.col("_sum")).alias("_outer"))
    blocks = sums.withColumn("_before", F.sum("_sum").over(Window.partitionBy("_group").orderBy("_block")) - F.col("_sum")).join(groups, "_group").select("_block", (F.col("_outer") + F.col("_before")).alias("_before"))
    inside = F.sum(value).over(Window.partitionBy("_block").orderBy(key)) - F.col(value)
    return blocked.withColumn("_inside", inside).join(blocks, "_block").withColumn(out, F.col("_before") + F.col("_inside")).drop("_block", "_inside", "_before")


def ranked(ids: DataFrame, key: str, out: str, block: int = BLOCK) -> DataFrame:
    """Distinct long ``ids`` numbered from 0 in ascending order."""
    return running_total(ids.withColumn("_one", F.lit(1).cast("long")), key, "_one", out, block).drop("_one")


def ranked_within(df: DataFrame, owner: str, key: str, out: str, block: int = BLOCK) -> DataFrame:
    """``df`` and ``out``: the place of a row among those of its ``owner`` by ascending long ``key``, from 0. Keys of one owner are distinct.

    The rows of an owner that has very many are ranked by blocks of keys in tasks of their own.
    """
    blocked = df.withColumn("_block", F.floor(F.col(key) / block))
    sizes = blocked.groupBy(owner, "_block").agg(F.count("*").alias("_n"))
    ahead = sizes.select(owner, "_block", (F.sum("_n").over(Window.partitionBy(owner).orderBy("_block")) - F.col("_n")).alias("_ahead"))
    inner = F.row_number().over(Window.partitionBy(owner, "_block").orderBy(key)) - 1
    return blocked.withColumn("_inner", inner).join(ahead, [owner, "_block"]).withColumn(out, (F.col("_ahead") + F.col("_inner")).cast("long")).drop("_block", "_inner", "_ahead")


def with_next(df: DataFrame, block: Column, order: list[str], value: str, out: str) -> DataFrame:
    """``df`` and ``out``: ``value`` of the next row by ``order``, null for the last. ``block`` must rise with the order."""
    blocked = df.withColumn("_block", block)
    heads = blocked.groupBy("_block").agg(F.min(F.struct(*order, F.col(value).alias("_value"))).alias("_head"))
    after = heads.select("_block", F.lead("_head._value").over(Window.orderBy("_block")).alias("_after"))
    inner = blocked.withColumn("_inner", F.lead(value).over(Window.partitionBy("_block").orderBy(*order)))
    return inner.join(after, "_block").withColumn(out, F.coalesce("_inner", "_after")).drop("_block", "_inner", "_after")
