"""Operators against numpy: values, finite differences and adjoints."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vertexloom.operators import graph as G
from vertexloom.operators import losses as L
from vertexloom.operators import tensor as X

RNG = np.random.default_rng(5)
A = RNG.normal(size=(12, 6))
B = RNG.normal(size=(12, 6))


def table(spark, m, name="h"):
    return spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(m)], f"v long, {name} array<double>")


def matrix(df):
    got = {r.v: r.h for r in df.collect()}
    return np.array([got[i] for i in range(len(got))])


def soft(x):
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def slope(f, x, g, h=1e-6):
    """Of the sum of g f(x) by each entry of x."""
    out = np.zeros_like(x)
    for i in np.ndindex(*x.shape):
        up, down = x.copy(), x.copy()
        up[i] += h
        down[i] -= h
        out[i] = ((f(up) - f(down)) * g).sum() / (2 * h)
    return out


def test_forward(spark):
    w = RNG.normal(size=(6, 4))
    assert np.allclose(matrix(X.relu(table(spark, A))), np.maximum(A, 0))
    assert np.allclose(matrix(X.softmax(table(spark, A))), soft(A))
    assert np.allclose(matrix(X.matmul(table(spark, A), w)), A @ w)
    assert np.allclose(matrix(X.matmul(table(spark, A), w, unroll=False)), A @ w)
    assert matrix(X.softmax(table(spark, [[1.0, 2.0]])))[0] == pytest.approx([0.2689414214, 0.7310585786])


def test_backward(spark):
    w = RNG.normal(size=(6, 4))
    g4 = RNG.normal(size=(12, 4))
    assert np.allclose(matrix(X.relu_gradient(table(spark, A), table(spark, B))), slope(lambda x: np.maximum(x, 0), A, B), atol=1e-5)
    assert np.allclose(matrix(X.softmax_gradient(X.softmax(table(spark, A)), table(spark, B))), slope(soft, A, B), atol=1e-5)
    assert np.allclose(matrix(X.matmul_input_gradient(table(spark, g4), w)), g4 @ w.T)
    got = np.zeros((6, 4))
    for r in X.matmul_weight_gradient(table(spark, A), table(spark, g4), 6, 4).collect():
        got[r.k, r.j] = r.g
    assert np.allclose(got, A.T @ g4)
    assert np.allclose(matrix(X.accumulated([table(spark, A), table(spark, B)], 6)), A + B)


def test_sums_along_edges_and_back_are_adjoint(spark):
    edges = [(int(a), int(b)) for a, b in RNG.integers(0, 12, size=(40, 2))]
    aug = G.augmented_edges(G.Graph(spark.range(12).select(F.col("id").alias("v")), spark.createDataFrame(edges, "src long, dst long"))).cache()
    y, x = matrix(X.aggregate(aug, table(spark, A), 6)), matrix(X.aggregate_gradient(aug, table(spark, B), 6))
    assert (y * B).sum() == pytest.approx((A * x).sum())
    w = RNG.normal(size=(6, 3))
    first = matrix(X.aggregate(aug, X.matmul(table(spark, A), w), 3))
    assert np.allclose(first, matrix(X.matmul(X.aggregate(aug, table(spark, A), 6), w)))


def test_wide_rows_go_the_long_way(spark, monkeypatch):
    edges = spark.createDataFrame([(0, 1, 0.5), (1, 1, 0.25)], "src long, dst long, w double")
    want = matrix(X.aggregate(edges, table(spark, A[:2]), 6).withColumn("v", F.lit(0).cast("long")))
    for unrolled in (2, 4):  # of six: whole slices, and a shorter last one
        monkeypatch.setattr(X.A, "UNROLLED", unrolled)
        assert np.allclose(matrix(X.aggregate(edges, table(spark, A[:2]), 6).withColumn("v", F.lit(0).cast("long"))), want)


def test_losses(spark):
    o, s = soft(A), np.eye(6)[RNG.integers(0, 6, 12)]
    pairs = L.paired(table(spark, o), table(spark, s, "y")).cache()
    value = lambda each, **k: L.mean_loss(pairs, each, **k).first().loss
    assert value(L.square_error()) == pytest.approx(((o - s) ** 2).sum() / 12)
    assert value(L.cross_entropy()) == pytest.approx(-(s * np.log(o + 1e-8)).sum() / 12)
    assert value(L.cross_entropy(), mask=F.col("v") < 3) == pytest.approx(-(s * np.log(o + 1e-8))[:3].sum() / 12)
    raw = L.paired(table(spark, A), table(spark, s, "y"))
    assert L.mean_loss(raw, L.fused_cross_entropy()).first().loss == pytest.approx(-(s * np.log(soft(A))).sum() / 12)
    assert np.allclose(matrix(L.mse_gradient(pairs, 12)), 2 * (o - s) / 12)
    assert np.allclose(matrix(L.cross_entropy_gradient(pairs, 12)), -s / 12 / (o + 1e-8))
    assert np.allclose(matrix(L.fused_gradient(raw, 12)), (o - s) / 12)
    assert L.accuracy(pairs).first().accuracy == pytest.approx((o.argmax(1) == s.argmax(1)).mean())
    parts = L.by_part(pairs, F.col("v") % 3, L.cross_entropy())
    assert L.reduced(parts).first().loss == pytest.approx(value(L.cross_entropy()))
    one = L.paired(table(spark, [[0.2689414214, 0.7310585786]]), table(spark, [[0.0, 1.0]], "y"))
    assert L.mean_loss(one, L.cross_entropy()).first().loss == pytest.approx(0.3132616738, abs=1e-7)


def test_lowest_place_wins_a_tie(spark):
    pairs = L.paired(table(spark, [[0.5, 0.5], [0.5, 0.5]]), table(spark, [[1.0, 0.0], [0.0, 1.0]], "y"))
    assert L.accuracy(pairs).first().accuracy == 0.5
    assert math.isclose(L.confusion(pairs).count(), 2)
