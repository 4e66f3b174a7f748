"""Structure of directed multigraphs: degrees, weights, neighbours, row offsets, sorting and renumbering.

A graph is a table of ``vertices (v)`` and one of ``edges (src, dst)``; repeated edges count as often as they occur.
"""

from __future__ import annotations

import dataclasses

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vertexloom.operators.ordered import ranked, ranked_within, running_total


@dataclasses.dataclass(frozen=True)
class Graph:
    vertices: DataFrame
    edges: DataFrame

    def checked(self) -> Graph:
        """Raises ``ValueError`` if an edge has an end that isn't a vertex."""
        known = self.vertices.select("v")
        ends = self.edges.select(F.col("src").alias("v")).unionAll(self.edges.select(F.col("dst").alias("v")))
        if not ends.join(known, "v", "left_anti").isEmpty():
            raise ValueError("an edge has an end that isn't a vertex")
        return self


def degrees(g: Graph) -> DataFrame:
    """``v, d_in, d_out``: one pass over the edges, both ends counted together."""
    ends = g.edges.select(F.explode(F.array(F.struct(F.col("dst").alias("v"), F.lit(1).alias("i")), F.struct(F.col("src").alias("v"), F.lit(0).alias("i")))).alias("x"))
    counted = ends.groupBy(F.col("x.v").alias("v")).agg(F.sum("x.i").alias("d_in"), F.sum(1 - F.col("x.i")).alias("d_out"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return g.vertices.select("v").join(counted, "v", "left").select("v", zero("d_in"), zero("d_out"))


def normalised_edges(g: Graph, degree: DataFrame | None = None) -> DataFrame:
    """``src, dst, w`` with w = 1 / (root of (1 + in-degree of src) times root of (1 + in-degree of dst))."""
    degree = degree if degree is not None else degrees(g)
    root = degree.select("v", F.sqrt(1.0 + F.col("d_in")).alias("r"))
    a, b = root.select(F.col("v").alias("src"), F.col("r").alias("ra")), root.select(F.col("v").alias("dst"), F.col("r").alias("rb"))
    return g.edges.select("src", "dst").join(a, "src").join(b, "dst").select("src", "dst", (1.0 / (F.col("ra") * F.col("rb"))).alias("w"))


def self_edges(degree: DataFrame) -> DataFrame:
    """An edge from each vertex to itself with weight 1 / (1 + in-degree), beside any that the graph has."""
    return degree.select(F.col("v").alias("src"), F.col("v").alias("dst"), (1.0 / (1.0 + F.col("d_in"))).alias("w"))


def augmented_edges(g: Graph) -> DataFrame:
    degree = degrees(g)
    return normalised_edges(g, degree).unionByName(self_edges(degree))


def is_local(v: Column, begin: int, end: int) -> Column:
    """Whether vertex ``v`` is one of the part that owns [begin, end)."""
    return (v >= begin) & (v < end)


def in_neighbours(edges: DataFrame, v: int) -> DataFrame:
    return edges.filter(F.col("dst") == v)


def out_neighbours(edges: DataFrame, v: int) -> DataFrame:
    return edges.filter(F.col("src") == v)


def row_offsets(g: Graph) -> DataFrame:
    """``v, out_offset, in_offset``: where each vertex's edges begin in the order by source and by destination."""
    total = running_total(degrees(g), "v", "d_out", "out_offset")
    return running_total(total, "v", "d_in", "in_offset").select("v", "out_offset", "in_offset")


def diagonal_rows(g: Graph) -> DataFrame:
    """``v, row_offset, nnz``: offsets by destination once each vertex has an edge to itself as well."""
    return running_total(degrees(g).select("v", (F.col("d_in") + 1).alias("nnz")), "v", "nnz", "row_offset").select("v", "row_offset", "nnz")


def slice_rows(edges: DataFrame, left: int, right: int, end: str = "dst") -> DataFrame:
    """Edges whose ``end`` lies in [left, right): a filter that reaches the scan."""
    return edges.filter((F.col(end) >= left) & (F.col(end) < right))


def weight_faults(g: Graph, weighted: DataFrame, tolerance: float = 1e-3) -> DataFrame:
    """Pairs ``src, dst`` whose weights aren't those of the formula, or whose number of edges in ``weighted`` isn't the graph's.

    Degrees are counted here from the edges alone, so that no fault of ``normalised_edges`` is shared.
    """
    into = g.edges.groupBy("dst").agg(F.count("*").alias("d"))
    a, b = into.select(F.col("dst").alias("src"), F.col("d").alias("da")), into.select("dst", F.col("d").alias("db"))
    expected = g.edges.groupBy("src", "dst").agg(F.count("*").alias("n")).join(a, "src", "left").join(b, "dst")
    expected = expected.select("src", "dst", "n", F.pow((1.0 + F.coalesce("da", F.lit(0))) * (1.0 + F.col("db")), F.lit(-0.5)).alias("expected"))
    found = weighted.groupBy("src", "dst").agg(F.count("w").alias("m"), F.min("w").alias("low"), F.max("w").alias("high"))
    right = (F.col("n") == F.col("m")) & (F.abs(F.col("low") - F.col("expected")) < tolerance) & (F.abs(F.col("high") - F.col("expected")) < tolerance)
    return expected.join(found, ["src", "dst"], "full").filter(~F.coalesce(right, F.lit(False)))


def densified(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges with vertices renumbered from 0 in ascending order of those that edges use, and the mapping ``old, new``."""
    used = edges.select(F.explode(F.array("src", "dst")).alias("old")).distinct()
    mapping = ranked(used, "old", "new")
    return renumbered(edges, mapping), mapping


def renumbered(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    a, b = mapping.select(F.col("old").alias("src"), F.col("new").alias("a")), mapping.select(F.col("old").alias("dst"), F.col("new").alias("b"))
    return edges.join(a, "src").join(b, "dst").select(F.col("a").alias("src"), F.col("b").alias("dst"))


def degree_order(g: Graph) -> DataFrame:
    """A mapping ``old, new`` that puts vertices of greater in-degree first, ties by id."""
    keyed = degrees(g).select(F.col("v").alias("old"), "d_in")
    sizes = running_total(keyed.groupBy("d_in").agg(F.count("*").alias("n")).withColumn("down", -F.col("d_in")), "down", "n", "first")
    placed = ranked_within(keyed, "d_in", "old", "place").join(sizes.select("d_in", "first"), "d_in")
    return placed.select("old", (F.col("first") + F.col("place")).cast("long").alias("new"))


def sorted_by(edges: DataFrame, end: str) -> DataFrame:
    other = "dst" if end == "src" else "src"
    return edges.orderBy(end, other)


def positions(edges: DataFrame) -> DataFrame:
    """``src, dst, by_src, by_dst``: places of distinct edges in the two sorted copies, without sorting the whole table, or all edges of a hub, in one task."""
    out = edges.select("src", "dst")
    for end, other in (("src", "dst"), ("dst", "src")):
        starts = running_total(edges.groupBy(F.col(end).alias("k")).agg(F.count("*").alias("n")), "k", "n", "start").select(F.col("k").alias(end), "start")
        out = ranked_within(out, end, other, "place").join(starts, end).withColumn(f"by_{end}", (F.col("start") + F.col("place")).cast("long")).drop("start", "place")
    return out.select("src", "dst", "by_src", "by_dst")


def synthetic(vertices: DataFrame, width: int, classes: int, seed: int = 1) -> DataFrame:
    """``v, h, y``: features in [0, 1), by a linear rule of period 10,007, and a one-hot class, by turns."""
    from vertexloom.functions.arrays import one_hot

    unit = lambda i: F.pmod(F.col("v") * 7919 + i * 104729 + seed * 15485863, F.lit(10007)) / 10007.0
    return vertices.select("v", F.transform(F.sequence(F.lit(0), F.lit(width - 1)), unit).alias("h"), one_hot(F.pmod(F.col("v") * 31 + seed, F.lit(classes)), classes).alias("y"))


def sampled(edges: DataFrame, n: int, seed: int = 1) -> DataFrame:
    """At most ``n`` edges, those with the least hash: the same ones each time, and in any engine that has MD5."""
    return edges.orderBy(F.md5(F.concat_ws("-", "src", "dst", F.lit(seed))), "src", "dst").limit(n)
