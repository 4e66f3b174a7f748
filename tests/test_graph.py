"""The tiny graph's golden values, and structure on odd graphs."""

import pytest
from pyspark.sql import functions as F

from vertexloom.operators import graph as G
from vertexloom.operators import tensor as X
from vertexloom.operators.ordered import ranked, ranked_within, running_total, with_next

EDGES = [(0, 1), (0, 2), (2, 1)]
ROWS = [(0, [1.0, 2.0]), (1, [3.0, 4.0]), (2, [5.0, 6.0]), (3, [7.0, 8.0])]


def graph(spark, edges, n):
    return G.Graph(spark.range(n).select(F.col("id").alias("v")), spark.createDataFrame(edges, "src long, dst long"))


def rows(df):
    return {r.v: list(r.h) for r in df.collect()}


def test_degrees_and_weights(spark):
    g = graph(spark, EDGES, 4)
    assert {r.v: (r.d_in, r.d_out) for r in G.degrees(g).collect()} == {0: (0, 2), 1: (2, 0), 2: (1, 1), 3: (0, 0)}
    w = {(r.src, r.dst): r.w for r in G.normalised_edges(g).collect()}
    assert w[0, 1] == pytest.approx(0.5773502692) and w[0, 2] == pytest.approx(0.7071067812) and w[2, 1] == pytest.approx(0.4082482905)
    assert G.weight_faults(g, G.normalised_edges(g)).isEmpty()
    assert {r.src for r in G.in_neighbours(g.edges, 1).collect()} == {0, 2} and G.out_neighbours(g.edges, 3).isEmpty()


def test_weight_faults_are_found(spark, monkeypatch):
    g = graph(spark, EDGES, 4)
    good, first = G.normalised_edges(g), F.struct("src", "dst") == F.struct(*(F.lit(x).cast("long") for x in EDGES[0]))
    assert G.weight_faults(g, good.filter(~first)).count() == 1
    assert G.weight_faults(g, good.unionAll(good.limit(1))).count() == 1
    assert G.weight_faults(g, good.withColumn("w", F.when(~first, F.col("w")))).count() == 1
    assert G.weight_faults(g, good.withColumn("dst", F.when(first, 99).otherwise(F.col("dst")))).count() == 2
    wrong = good.withColumn("w", F.col("w") * 2)
    monkeypatch.setattr(G, "normalised_edges", lambda *_: wrong)
    assert G.weight_faults(g, G.normalised_edges(g)).count() == len({*EDGES})


def test_neighbour_sums(spark):
    g = graph(spark, EDGES, 4)
    x = spark.createDataFrame(ROWS, "v long, h array<double>")
    aug = G.augmented_edges(g)
    y = X.aggregate(aug, x, 2)
    got = rows(y)
    assert got[1] == pytest.approx([3.6185917215, 4.9375236145]) and got[2] == pytest.approx([3.2071067812, 4.4142135624])
    assert got[0] == [1, 2] and got[3] == [7, 8]
    back = rows(X.aggregate_gradient(aug, y, 2))
    assert back[0] == pytest.approx([5.3569618575, 7.9720009315]) and back[1] == pytest.approx([1.2061972405, 1.6458412048]) and back[2] == pytest.approx([3.0808372748, 4.2228423559])


def test_self_loops_and_repeats(spark):
    loop = graph(spark, [(0, 0)], 2)
    x = spark.createDataFrame([(0, [1.0]), (1, [5.0])], "v long, h array<double>")
    assert rows(X.aggregate(G.augmented_edges(loop), x, 1)) == {0: [pytest.approx(1.0)], 1: [5.0]}  # 2 / (d + 1) with d = 1
    twice = graph(spark, [(0, 1), (0, 1)], 2)
    assert {r.v: r.d_in for r in G.degrees(twice).collect()} == {0: 0, 1: 2}
    assert rows(X.aggregate(G.augmented_edges(twice), x, 1))[1] == [pytest.approx(2 / 3**0.5 + 5 / 3)]


def test_no_edges_is_identity(spark):
    none = graph(spark, [], 4)
    x = spark.createDataFrame(ROWS, "v long, h array<double>")
    assert rows(X.aggregate(G.augmented_edges(none), x, 2)) == dict(ROWS)


def test_star_offsets(spark):
    star = graph(spark, [(i, 0) for i in range(1, 101)], 101)
    off = {r.v: (r.out_offset, r.in_offset) for r in G.row_offsets(star).collect()}
    assert off[0] == (0, 0) and off[1] == (0, 100) and off[100] == (99, 100)
    diag = {r.v: (r.row_offset, r.nnz) for r in G.diagonal_rows(star).collect()}
    assert diag[0] == (0, 101) and diag[100] == (200, 1)


def test_densify_and_reorder(spark):
    edges = spark.createDataFrame([(7, 3), (20, 7)], "src long, dst long")
    dense, mapping = G.densified(edges)
    assert {(r.old, r.new) for r in mapping.collect()} == {(3, 0), (7, 1), (20, 2)}
    assert {(r.src, r.dst) for r in dense.collect()} == {(1, 0), (2, 1)}
    order = {r.old: r.new for r in G.degree_order(graph(spark, EDGES, 4)).collect()}
    assert order == {1: 0, 2: 1, 0: 2, 3: 3}


def test_blocks_agree_with_one_window(spark):
    df = spark.range(500).select((F.col("id") * 37).alias("k"), (F.col("id") % 5).alias("x"))
    got = {r.k: r.s for r in running_total(df, "k", "x", "s", block=100).collect()}
    total = 0
    for i in range(500):
        assert got[i * 37] == total
        total += i % 5
    assert {r.k: r.r for r in ranked(df.select("k"), "k", "r", block=64).collect()} == {i * 37: i for i in range(500)}
    sparse = spark.createDataFrame([(k * 2**40 - 2**45, 1) for k in range(100)], "k long, x long")
    assert sorted((r.s, r.k) for r in running_total(sparse, "k", "x", "s", block=64, group=8).collect()) == [(k, k * 2**40 - 2**45) for k in range(100)]
    assert {(r.k, r.r) for r in ranked_within(df, "x", "k", "r", block=100).collect()} == {(i * 37, i // 5) for i in range(500)}
    nxt = {r.k: r.n for r in with_next(df, F.floor(F.col("k") / 1000), ["k"], "k", "n").collect()}
    assert nxt == {i * 37: ((i + 1) * 37 if i < 499 else None) for i in range(500)}


def test_unknown_vertex_is_refused(spark):
    with pytest.raises(ValueError):
        graph(spark, [(0, 9)], 2).checked()
