"""Forward and backward operators on vertex tensors ``(v, h array<double>)``."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vertexloom.functions import arrays as A

#: Up to so many products a row, a matrix product is unrolled into generated code; beyond, batches go through BLAS.
UNROLLED_PRODUCTS = 2048
POOLS = {"sum": F.sum, "mean": F.avg, "max": F.max, "min": F.min}


def row_range(x: DataFrame, left: int, right: int) -> DataFrame:
    """Vertices in [left, right), put below whatever follows."""
    return x.filter((F.col("v") >= left) & (F.col("v") < right))


def row_gradient(g: DataFrame, inside: Column) -> DataFrame:
    """The gradient with zeros for vertices that aren't ``inside``."""
    return g.select("v", F.when(inside, F.col("h")).otherwise(F.transform("h", lambda x: x * 0.0)).alias("h"))


def relu(x: DataFrame) -> DataFrame:
    return x.select("v", A.relu(F.col("h")).alias("h"))


def relu_gradient(x: DataFrame, dy: DataFrame) -> DataFrame:
    return x.join(dy.select("v", F.col("h").alias("g")), "v").select("v", A.relu_gradient(F.col("h"), F.col("g")).alias("h"))


def softmax(x: DataFrame) -> DataFrame:
    return x.select("v", A.softmax(F.col("h")).alias("h"))


def softmax_gradient(y: DataFrame, dy: DataFrame) -> DataFrame:
    """From the softmax's own output and the gradient at it."""
    return y.join(dy.select("v", F.col("h").alias("g")), "v").select("v", A.softmax_gradient(F.col("h"), F.col("g")).alias("h"))


def matmul(x: DataFrame, weights: np.ndarray, unroll: bool = True) -> DataFrame:
    """Each row times ``weights``, which the driver holds and every task gets.

    Weights that change from call to call are better not unrolled, for each change would be compiled anew.
    """
    if unroll and weights.size <= UNROLLED_PRODUCTS:
        return x.select("v", A.by_matrix(F.col("h"), weights.tolist()).alias("h"))
    width = weights.shape[1]

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("h").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, weights.shape[0])
            made = rows @ weights
            offsets = pa.array(np.arange(0, made.size + 1, width, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("v"), pa.ListArray.from_arrays(offsets, pa.array(made.ravel()))], names=["v", "h"])

    return x.select("v", "h").mapInArrow(product, "v long, h array<double>")


def matmul_input_gradient(dy: DataFrame, weights: np.ndarray, unroll: bool = True) -> DataFrame:
    return matmul(dy, weights.T, unroll)


def matmul_weight_gradient(x: DataFrame, dy: DataFrame, rows: int, columns: int) -> DataFrame:
    """``k, j, g``: sums over vertices of x_k dy_j. Each task sends the sum of its own rows."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((rows, columns))
        for batch in batches:
            a, b = (batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, w) for c, w in (("h", rows), ("g", columns)))
            total += a.T @ b
        k, j = np.divmod(np.arange(rows * columns), columns)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(j), pa.array(total.ravel())], names=["k", "j", "g"])

    both = x.join(dy.select("v", F.col("h").alias("g")), "v").select("h", "g")
    return both.mapInArrow(partial, "k long, j long, g double").groupBy("k", "j").agg(F.sum("g").alias("g"))


def aggregate(edges: DataFrame, x: DataFrame, width: int, kind: str = "norm_sum") -> DataFrame:
    """For each vertex the pooled rows of those with an edge to it.

    ``norm_sum`` adds w times the row over ``edges`` with weights and self edges. The others take ``edges`` as they are, and a vertex
    without any has no row; they are extensions. Rows are gathered by one join and one grouping with partial sums, so that a
    vertex with many edges costs a row from each task.
    """
    gathered = edges.join(x.select(F.col("v").alias("src"), "h"), "src")
    if kind != "norm_sum":
        return gathered.groupBy(F.col("dst").alias("v")).agg(A.pooled(POOLS[kind], F.col("h"), width).alias("h"))
    if width <= A.UNROLLED:
        return gathered.groupBy(F.col("dst").alias("v")).agg(F.array(*(F.sum(F.col("w") * F.col("h")[k]) for k in range(width))).alias("h"))
    # Wider rows are summed in slices, each of them unrolled, so that what is shuffled is a row for each task, vertex and slice.
    slices = F.array(*(F.slice("h", first + 1, A.UNROLLED) for first in range(0, width, A.UNROLLED)))
    summed = F.array(*(F.sum(F.col("w") * F.get("part", F.lit(k))) for k in range(A.UNROLLED)))
    parts = gathered.select("dst", "w", F.posexplode(slices).alias("slice", "part")).groupBy("dst", "slice").agg(summed.alias("part"))
    whole = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("slice", "part"))), lambda s: s["part"]))
    return parts.groupBy(F.col("dst").alias("v")).agg(F.slice(whole, 1, width).alias("h"))


def aggregate_gradient(edges: DataFrame, dy: DataFrame, width: int) -> DataFrame:
    """The transposed sum: along edges backwards."""
    return aggregate(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"), dy, width)


def accumulated(gradients: list[DataFrame], width: int) -> DataFrame:
    """The sum of the gradients that reach one tensor from all operators that use it."""
    first, *rest = gradients
    for g in rest:
        first = first.unionByName(g)
    return first.groupBy("v").agg(F.array(*(F.sum(F.col("h")[k]) for k in range(width))).alias("h")) if rest else first


def long(x: DataFrame, digits: int = 4) -> DataFrame:
    """``v, k, x``: a row for each entry, rounded, with no negative zero."""
    return x.select("v", F.posexplode("h").alias("k", "x")).select("v", F.col("k").cast("long").alias("k"), (F.round("x", digits) + 0.0).alias("x"))
