"""Text formats: meta, edges, features, labels, partitions, raw edge lists; fields are parted by white space, line ends may be CRLF."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _fields(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path).select(F.trim(F.regexp_replace("value", r"[\r\t]", " ")).alias("line")).filter("line <> ''")
    return lines.select(F.split("line", r"\s+").alias("f"))


def _vector(width: int | None) -> Column:
    last = F.size("f") - 1 if width is None else F.lit(width)
    return F.transform(F.slice("f", F.lit(2), last), lambda x: x.cast("double"))


def read_meta(spark: SparkSession, path: str) -> DataFrame:
    names = ("num_vertices", "num_edges", "num_features", "num_labels")
    return _fields(spark, path).select(*(F.get("f", F.lit(i)).cast("long").alias(n) for i, n in enumerate(names)))


def read_edges(spark: SparkSession, path: str, copies: int = 2) -> DataFrame:
    """``src, dst``. A file lists each edge ``copies`` times, once for each order it is sorted in; a third column is left out.

    Copies are told apart by counting equal lines, so that the order of lines, which distributed readers don't keep, isn't needed;
    a file whose counts don't divide by ``copies`` raises when it is read.
    """
    pairs = _fields(spark, path).select(F.get("f", F.lit(0)).cast("long").alias("src"), F.get("f", F.lit(1)).cast("long").alias("dst"))
    if copies == 1:
        return pairs
    counted = pairs.groupBy("src", "dst").agg(F.count("*").alias("n"))
    whole = F.when(F.col("n") % copies == 0, (F.col("n") / copies).cast("int")).otherwise(F.raise_error(F.lit(f"edges aren't listed {copies} times each")).cast("int"))
    return counted.withColumn("n", whole).select("src", "dst", F.explode(F.array_repeat(F.lit(1), F.col("n"))).alias("_")).drop("_")


def read_vectors(spark: SparkSession, path: str, name: str = "h", width: int | None = None) -> DataFrame:
    """``v`` and the array ``name``: features or labels. With ``width``, a row of another width or with NaN raises when it is read."""
    rows = _fields(spark, path).select(F.get("f", F.lit(0)).cast("long").alias("v"), _vector(None).alias(name))
    if width is None:
        return rows
    good = (F.size(name) == width) & ~F.exists(name, lambda x: F.isnan(x))
    return rows.select("v", F.when(good, F.col(name)).otherwise(F.raise_error(F.concat(F.lit("bad row for vertex "), F.col("v"))).cast("array<double>")).alias(name))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``i, f``: the fields of each line that isn't blank, and its number from 0. ``path`` is one file, which is read in splits.

    Lines are numbered within their split; the lines of earlier splits, one count for each split, are added.
    """
    raw = spark.read.text(path).select(F.trim(F.regexp_replace("value", r"[\r\t]", " ")).alias("line"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"))
    lines = raw.filter("line <> ''")
    counts = lines.groupBy("split").agg(F.count("*").alias("n"))
    before = counts.select("split", (F.sum("n").over(Window.orderBy("split")) - F.col("n")).alias("before"))
    inside = lines.withColumn("inside", F.row_number().over(Window.partitionBy("split").orderBy("at")) - 1)
    return inside.join(before, "split").select((F.col("before") + F.col("inside")).cast("long").alias("i"), F.split("line", r"\s+").alias("f"))


def read_partition(spark: SparkSession, path: str, vertices: int) -> tuple[DataFrame, DataFrame]:
    """``v, part`` and ``part, n_vertices, n_edges``. The file has a line for each vertex, then one for each part, both as two integers; a line's number tells which it is."""
    lines = numbered_lines(spark, path)
    at = lambda k: F.get("f", F.lit(k))
    first = lines.filter(F.col("i") < vertices).select(at(0).cast("long").alias("v"), at(1).cast("int").alias("part"))
    second = lines.filter(F.col("i") >= vertices).select((F.col("i") - vertices).cast("int").alias("part"), at(0).cast("long").alias("n_vertices"), at(1).cast("long").alias("n_edges"))
    return first, second


def read_part_vector(spark: SparkSession, path: str) -> DataFrame:
    """``v, part`` from a file whose i-th line is the part of vertex i."""
    return numbered_lines(spark, path).select(F.col("i").alias("v"), F.get("f", F.lit(0)).cast("int").alias("part"))


def read_mapping(spark: SparkSession, path: str) -> DataFrame:
    """``old, new`` from lines of two integers."""
    return _fields(spark, path).select(F.get("f", F.lit(0)).cast("long").alias("old"), F.get("f", F.lit(1)).cast("long").alias("new"))


def read_raw_edges(spark: SparkSession, path: str) -> DataFrame:
    """``src, dst`` from lines of two integers, with comments after ``#``."""
    lines = spark.read.text(path).filter(~F.col("value").startswith("#") & (F.trim("value") != ""))
    f = lines.select(F.split(F.trim("value"), r"\s+").alias("f"))
    return f.select(F.get("f", F.lit(0)).cast("long").alias("src"), F.get("f", F.lit(1)).cast("long").alias("dst"))


def owned_rows(rows: DataFrame, partition: DataFrame, part: int) -> DataFrame:
    """The rows of vertices that ``part`` owns."""
    return rows.join(partition.filter(F.col("part") == part).select("v"), "v", "left_semi")
