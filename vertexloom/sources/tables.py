"""Graphs derived from relational tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vertexloom.functions.arrays import one_hot
from vertexloom.operators.graph import Graph
from vertexloom.operators.ordered import with_next

FEATURES, CLASSES = 64, 10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def supply(spark: SparkSession, sf_dir: str) -> Graph:
    """Suppliers, then parts; an edge from a supplier to each part that it has delivered. Vertices carry a scalar ``x``."""
    suppliers, parts = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "part")
    s = suppliers.count()
    vertices = suppliers.select(F.col("s_suppkey").cast("long").alias("v"), F.col("s_acctbal").alias("x")).unionAll(parts.select(F.col("p_partkey") + s, "p_retailprice"))
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("long").alias("src"), (F.col("l_partkey") + s).cast("long").alias("dst")).distinct()
    return Graph(vertices, edges)


def vectors(spark: SparkSession, sf_dir: str) -> tuple[Graph, int]:
    """Embeddings with three edges each by a rule; vertices carry features ``h`` and a one-hot label ``y``. Also their number."""
    rows = table(spark, sf_dir, "embeddings")
    n = rows.count()
    v = F.col("vec_id").cast("long")
    vertices = rows.select(v.alias("v"), F.col("embedding").cast("array<double>").alias("h"), one_hot(F.col("label"), CLASSES).alias("y"), F.col("label").cast("long").alias("label"))
    ends = F.explode(F.array(*((a * v + b) % n for a, b in ((7, 1), (13, 5), (31, 11)))))
    edges = rows.select(v.alias("src"), ends.alias("dst")).filter("src <> dst").distinct()
    return Graph(vertices, edges), n


def market(spark: SparkSession, sf_dir: str) -> Graph:
    """Customers, then suppliers; an edge from a customer to each supplier in its orders."""
    customers, suppliers = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    c = customers.count()
    vertices = customers.select(F.col("c_custkey").cast("long").alias("v"), F.col("c_acctbal").alias("x")).unionAll(suppliers.select(F.col("s_suppkey").cast("long") + c, "s_acctbal"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    edges = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").cast("long").alias("src"), (F.col("l_suppkey") + c).cast("long").alias("dst")).distinct()
    return Graph(vertices, edges)


def sessions(spark: SparkSession, sf_dir: str) -> Graph:
    """Users; an edge from each event's user to the next event's, with repeats and self loops."""
    events = table(spark, sf_dir, "events").select("ts", "event_id", F.col("user_id").cast("long").alias("user_id"))
    minute = F.floor(F.unix_timestamp("ts") / 60)
    edges = with_next(events, minute, ["ts", "event_id"], "user_id", "dst").filter("dst is not null").select(F.col("user_id").alias("src"), "dst")
    return Graph(events.select(F.col("user_id").alias("v")).distinct(), edges)


def scratch(spark: SparkSession) -> str:
    """A path for files of one query, in the folder that the session names in ``spark.checkpoint.dir``; where it names none, on one machine, in a temporary folder."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or tempfile.mkdtemp(prefix="vertexloom-")
    return f"{folder}/{uuid.uuid4().hex}"


def sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supply edges with all ids times three, so that there are gaps."""
    s = table(spark, sf_dir, "supplier").count()
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey").distinct()
    return lines.select((F.col("l_suppkey").cast("long") * 3).alias("src"), ((F.col("l_partkey") + s) * 3).cast("long").alias("dst"))
