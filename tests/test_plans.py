"""Models, optimizers, and training against a plain numpy version."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vertexloom.functions.random import c_rand, glorot
from vertexloom.operators import graph as G
from vertexloom.operators.optim import SGD, Adam, PlateauRate, clipped
from vertexloom.plans.model import GCN, Model
from vertexloom.plans.train import train

EDGES = [(0, 1), (0, 2), (2, 1), (3, 0), (3, 4), (4, 2), (1, 3)]
N, D, C = 5, 6, 3


def test_generator():
    draws = c_rand(23)
    assert [next(draws) for _ in range(6)] == [1562469902, 1039845534, 2025653534, 739593874, 994290584, 1198075102]
    assert glorot(2, 2).ravel() == pytest.approx([0.5574591532, -0.0386632110, 1.0857814792, -0.3811400268])
    assert (glorot(2, 2) == glorot(2, 2)).all()


def test_shapes():
    m = GCN(2, 4, C, D)
    assert [o.kind for o in m.operators] == ["INPUT", "WEIGHT", "MATMUL", "AGGREGATION", "RELU", "WEIGHT", "MATMUL", "AGGREGATION", "SOFTMAX"]
    assert m.output.shape == (-1, C) and m.needs_gradient() == [False] + [True] * 8
    for bad in (lambda: GCN(0, 1, 1, 1), lambda: m.fc(m.output, 2, "tanh"), lambda: m.matmul(m.output, m.weight(9, 2)), lambda: m.relu(m.weight(2, 2)), lambda: m.aggregation(m.output, "median")):
        with pytest.raises(ValueError):
            bad()


def test_narrow_side_is_summed():
    class Late(Model):
        def forward(self, t):
            return self.softmax(self.fc(self.aggregation(t), 2))

    assert [o.kind for o in Late(6).plan()] == ["WEIGHT", "INPUT", "MATMUL", "AGGREGATION", "SOFTMAX"]
    assert [o.output.width for o in Late(6).plan()[2:4]] == [2, 2]
    kinds = [o.kind for o in GCN(1, 4, 9, 6).plan()]
    assert kinds.index("AGGREGATION") < kinds.index("MATMUL")


def dense_graph():
    d = np.zeros(N)
    for _, b in EDGES:
        d[b] += 1
    a = np.diag(1 / (1 + d))
    for u, v in EDGES:
        a[v, u] += 1 / np.sqrt((1 + d[u]) * (1 + d[v]))
    return a


def plain(x, y, epochs, optimizer, hidden=4, staleness=0, rows=None, clip=None):
    """Two layers by hand. Both passes use the weights of ``staleness`` epochs ago; ``rows`` alone give the gradient, which ``clip`` bounds."""
    a, newest = dense_graph(), [glorot(D, hidden), glorot(hidden, C)]
    losses, versions = [], [newest]
    for _ in range(epochs):
        w = versions[max(0, len(versions) - 1 - staleness)]
        h = np.maximum(a @ x @ w[0], 0)
        z = a @ h @ w[1]
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        losses.append(-(y * np.log(p + 1e-8)).sum() / N)
        g = -y / N / (p + 1e-8)
        if rows is not None:
            g = g * np.isin(np.arange(N), rows)[:, None]
        g = p * (g - (g * p).sum(1, keepdims=True))
        g = a.T @ g
        g1, back = h.T @ g, g @ w[1].T
        g0 = x.T @ (a.T @ (back * (h > 0)))
        g0, g1 = (m if clip is None else np.clip(m, -clip, clip) for m in (g0, g1))
        newest = [optimizer.step("0", newest[0], g0), optimizer.step("1", newest[1], g1)]
        versions.append(newest)
    return newest, losses


def data(spark):
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(N, D)), np.eye(C)[[0, 1, 2, 0, 1]]
    table = lambda m, k: spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(m)], f"v long, {k} array<double>")
    g = G.Graph(spark.range(N).select(F.col("id").alias("v")), spark.createDataFrame(EDGES, "src long, dst long"))
    return x, y, G.augmented_edges(g), table(x, "h"), table(y, "y")


@pytest.mark.parametrize("make", [lambda: SGD(0.3), lambda: Adam(0.01)])
def test_training_agrees_with_numpy(spark, make):
    x, y, edges, features, labels = data(spark)
    run = train(GCN(2, 4, C, D), edges, features, labels, make(), 2)
    w, losses = plain(x, y, 2, make())
    assert [loss for _, loss, *_ in run.metrics] == pytest.approx(losses, abs=1e-9)
    for got, want in zip([run.weights[k] for k in sorted(run.weights)], w, strict=True):
        assert np.allclose(got, want, atol=1e-9)


def test_schedules(spark):
    x, y, edges, features, labels = data(spark)
    whole = train(GCN(1, 4, C, D), edges, features, labels, SGD(0.3), 1)
    once = train(GCN(1, 4, C, D), edges, features, labels, SGD(0.3), 1, update="chunk", chunks=1)
    assert all(np.allclose(whole.weights[k], once.weights[k]) for k in whole.weights)
    last = train(GCN(2, 4, C, D), edges, features, labels, SGD(0.3), 2, update="last_chunk", chunks=5)
    w, _ = plain(x, y, 2, SGD(0.3), rows=[N - 1], clip=2.0)
    assert all(np.allclose(last.weights[k], v, atol=1e-9) for k, v in zip(sorted(last.weights), w, strict=True))
    stale = train(GCN(2, 4, C, D), edges, features, labels, SGD(0.3), 3, staleness=1)
    w, losses = plain(x, y, 3, SGD(0.3), staleness=1)
    assert [loss for _, loss, *_ in stale.metrics] == pytest.approx(losses, abs=1e-9)
    assert all(np.allclose(stale.weights[k], v, atol=1e-9) for k, v in zip(sorted(stale.weights), w, strict=True))
    with pytest.raises(ValueError):
        train(GCN(1, 4, C, D), edges, features, labels, SGD(0.3), 1, update="never")


def test_optimizers():
    w, g = np.ones((1, 1)), np.full((1, 1), 0.5)
    frozen, standard = Adam(0.1), Adam(0.1, bias_correction="standard")
    assert frozen.step("a", w, g) == pytest.approx(standard.step("a", w, g))
    assert frozen.step("a", w, g)[0, 0] != pytest.approx(standard.step("a", w, g)[0, 0])
    assert clipped(np.array([-5.0, 0.5, 3.0])).tolist() == [-2, 0.5, 2]
    with pytest.raises(ValueError):
        SGD(0)
    s = PlateauRate(1.0, 0.1, 0.5, 1e-8, 1, 1)
    assert [s.step(x) for x in (3, 2, 2, 2, 2, 2, 2)] == [1, 1, 1, 0.5, 0.5, 0.5, 0.25]
