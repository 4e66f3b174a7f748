"""Losses, their gradients, and metrics, over ``o`` and ``s`` joined into ``(v, o, s)``; sums are divided by a number of vertices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vertexloom.functions import arrays as A

#: Added to a chance before its logarithm: the usual value, and that of the first generation of device kernels.
EPSILON, DEVICE_EPSILON = 1e-8, 1e-12


def paired(output: DataFrame, truth: DataFrame) -> DataFrame:
    return output.select("v", F.col("h").alias("o")).join(truth.select("v", F.col("y").alias("s")), "v")


def square_error() -> Column:
    return A.total(F.zip_with("o", "s", lambda o, s: (o - s) * (o - s)))


def cross_entropy(epsilon: float = EPSILON) -> Column:
    return A.total(F.zip_with("o", "s", lambda o, s: -s * F.log(o + epsilon)))


def fused_cross_entropy() -> Column:
    """Of raw scores: minus the log softmax at the truth's greatest entry."""
    return F.log(A.total(F.transform(A.shifted(F.col("o")), lambda x: F.exp(x)))) - F.get(A.shifted(F.col("o")), A.argmax(F.col("s")).cast("int"))


def mean_loss(pairs: DataFrame, each: Column, vertices: int | None = None, mask: Column | None = None) -> DataFrame:
    """``loss``: the sum of ``each`` over ``vertices`` (all rows, if not given). Rows outside ``mask`` add nothing but still count below."""
    value = F.when(mask, each).otherwise(0.0) if mask is not None else each
    below = F.lit(float(vertices)) if vertices else F.count("*")
    return pairs.agg((F.sum(value) / below).alias("loss"))


def mse_gradient(pairs: DataFrame, vertices: int) -> DataFrame:
    return pairs.select("v", F.zip_with("o", "s", lambda o, s: 2 * (o - s) / vertices).alias("h"))


def cross_entropy_gradient(pairs: DataFrame, vertices: int, epsilon: float = EPSILON) -> DataFrame:
    return pairs.select("v", F.zip_with("o", "s", lambda o, s: -s / vertices / (o + epsilon)).alias("h"))


def fused_gradient(pairs: DataFrame, vertices: int) -> DataFrame:
    hot = F.transform("s", lambda s, i: F.when(i == A.argmax(F.col("s")), 1.0).otherwise(0.0))
    ready = pairs.select("v", A.softmax(F.col("o")).alias("p"), hot.alias("t"))
    return ready.select("v", F.zip_with("p", "t", lambda p, t: (p - t) / vertices).alias("h"))


def hit() -> Column:
    """Whether the truth at the output's greatest entry, the lowest of equals, is above 0.99."""
    return F.get(F.col("s"), A.argmax(F.col("o")).cast("int")) > 0.99


def accuracy(pairs: DataFrame) -> DataFrame:
    return pairs.agg(F.avg(F.when(hit(), 1.0).otherwise(0.0)).alias("accuracy"))


def confusion(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy(A.argmax(F.col("s")).cast("long").alias("truth"), A.argmax(F.col("o")).cast("long").alias("predicted")).agg(F.count("*").alias("n"))


def by_part(pairs: DataFrame, part: Column, each: Column) -> DataFrame:
    """``part, n, loss, accuracy`` with each part divided by its own number of vertices, as parts report them."""
    return pairs.groupBy(part.cast("long").alias("part")).agg(F.count("*").alias("n"), (F.sum(each) / F.count("*")).alias("loss"), F.avg(F.when(hit(), 1.0).otherwise(0.0)).alias("accuracy"))


def reduced(parts: DataFrame) -> DataFrame:
    """Parts' metrics put together: means weighted by their vertices."""
    mean = lambda c: (F.sum(F.col(c) * F.col("n")) / F.sum("n")).alias(c)
    return parts.agg(mean("loss"), mean("accuracy"))
