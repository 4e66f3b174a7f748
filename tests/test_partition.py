import pytest
from pyspark.sql import functions as F

from vertexloom.operators import partition as P
from vertexloom.plans.model import GCN

EDGES = [(0, 1), (0, 2), (2, 1)]


def ranges(spark, rows):
    return spark.createDataFrame(rows, "part long, vid_begin long, vid_end long, op_begin long, op_end long")


def test_mirrors(spark):
    edges = spark.createDataFrame(EDGES, "src long, dst long")
    halves = lambda v: F.floor(v / 2)
    assert {(r.part, r.v) for r in P.incoming_mirrors(edges, halves).collect()} == {(1, 0), (0, 2)}
    assert {(r.part, r.v) for r in P.outgoing_mirrors(edges, halves).collect()} == {(0, 2), (1, 1)}
    assert P.graph_volume(edges, halves, 2, 16, 8).first().megabytes == pytest.approx(2 * 4 * 24 * 2 / 2**20)


def test_coverage_fails_when_disturbed(spark):
    ops, _ = GCN(1, 4, 3, 5).tables(spark)
    good = ranges(spark, [(0, 0, 5, 0, 5), (1, 5, 10, 0, 5)])
    assert {r.valid for r in P.coverage(ops, good, 10).collect()} == {True}
    for bad in ([(0, 0, 6, 0, 5), (1, 5, 10, 0, 5)], [(0, 0, 4, 0, 5), (1, 5, 10, 0, 5)], [(0, 0, 5, 0, 5), (1, 5, 10, 0, 4)]):
        assert False in {r.valid for r in P.coverage(ops, ranges(spark, bad), 10).collect()}


def test_chunks_cover_all(spark):
    parts = ranges(spark, [(0, 0, 7, 0, 9), (1, 7, 30, 0, 4), (2, 7, 30, 4, 9)])
    got = sorted((r.begin, r.end) for r in P.chunks(parts, 5).collect())
    assert got == [(0, 5), (5, 7), (7, 12), (12, 17), (17, 22), (22, 27), (27, 30)]


def test_operators_are_dealt_evenly(spark):
    ops, edges = GCN(2, 4, 3, 5).tables(spark)
    placed = {r.op: r.part for r in P.placed_operators(ops, edges, 2).collect()}
    assert placed == {0: 0, 1: 0, 2: 0, 3: 0, 4: 0, 5: 1, 6: 1, 7: 1, 8: 1}
    with pytest.raises(ValueError):
        P.placed_operators(ops, edges, 9)


def test_splits_agree_with_counting(spark):
    pairs = [(i * 7 % 64, i * 13 % 64) for i in range(200)]
    got = {r.t: r.crossing for r in P.split_counts(spark.createDataFrame(pairs, "src long, dst long"), 64).collect()}
    assert got == {t: sum((a < t * 2) != (b < t * 2) for a, b in pairs) for t in range(1, 32)}
