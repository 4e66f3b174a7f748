"""Full-batch training.

Activations are DataFrames that stay on the executors; weights live on the driver and are sent with the tasks. An epoch runs the
plan forward, takes loss and accuracy, and runs it backward; each weight's gradient is summed by tasks before it reaches the
driver. Activations that both passes read are kept by ``persist`` for the epoch, which an executor's loss only makes Spark compute
again.

``update`` tells when weights change: after each epoch by the whole gradient (``"epoch"``), after each chunk of vertices by that
chunk's (``"chunk"``), or after each epoch by the last chunk's gradient alone, clipped (``"last_chunk"``). ``staleness`` makes both
passes of an epoch use one snapshot of the weights, that of so many epochs ago, while the newest are updated: a backward pass
sees the weights of its forward pass. The last three simulate asynchronous schedules,
one step after another, and make no claim to any other order.
"""

from __future__ import annotations

import dataclasses
import functools
import time
from collections.abc import Callable

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vertexloom.functions.random import glorot
from vertexloom.operators import losses as L
from vertexloom.operators import tensor as X
from vertexloom.operators.optim import CLIP, PlateauRate, clipped
from vertexloom.operators.partition import equal_chunk
from vertexloom.plans.model import Model, Operator

WARM_UP = 5
LOSSES = {
    "cross_entropy": (L.cross_entropy, L.cross_entropy_gradient),
    "mse": (L.square_error, L.mse_gradient),
    "fused_cross_entropy": (L.fused_cross_entropy, L.fused_gradient),
}


@dataclasses.dataclass
class Run:
    weights: dict[int, np.ndarray]
    metrics: list[tuple[int, float, float, float]]

    def mean_seconds(self, warm_up: int = WARM_UP) -> float:
        """Mean seconds of an epoch after the first ``warm_up``."""
        late = [s for epoch, *_, s in self.metrics if epoch >= warm_up]
        return sum(late) / len(late) if late else float("nan")


def initial_weights(model: Model) -> dict[int, np.ndarray]:
    return {o.output.op: glorot(*(o.output.shape if len(o.output.shape) == 2 else (1, *o.output.shape))) for o in model.operators if o.kind == "WEIGHT"}


def forward(plan: list[Operator], edges: DataFrame, features: DataFrame, weights: dict[int, np.ndarray], keep: Callable[[DataFrame], DataFrame] = lambda d: d) -> dict[int, DataFrame]:
    """The output of each vertex operator, lazily. ``keep`` is applied to neighbour sums, the only ones that shuffle."""
    made: dict[int, DataFrame] = {}
    for o in plan:
        if o.kind == "INPUT":
            made[o.output.op] = features.select("v", "h")
        elif o.kind == "MATMUL":
            made[o.output.op] = X.matmul(made[o.inputs[0].op], weights[o.inputs[1].op], unroll=False)
        elif o.kind == "AGGREGATION":
            made[o.output.op] = keep(X.aggregate(edges, made[o.inputs[0].op], o.output.width, o.detail or "norm_sum"))
        elif o.kind in ("RELU", "SOFTMAX"):
            made[o.output.op] = {"RELU": X.relu, "SOFTMAX": X.softmax}[o.kind](made[o.inputs[0].op])
    return made


def backward(plan: list[Operator], edges: DataFrame, made: dict[int, DataFrame], weights: dict[int, np.ndarray], start: DataFrame, keep: Callable[[DataFrame], DataFrame] = lambda d: d) -> dict[int, DataFrame]:
    """``k, j, g`` tables of the weights' gradients from the gradient ``start`` at the plan's last output."""
    needed: dict[int, bool] = {}
    for o in plan:
        needed[o.output.op] = o.kind == "WEIGHT" or any(needed[t.op] for t in o.inputs)
    reached: dict[int, list[DataFrame]] = {plan[-1].output.op: [start]}
    out: dict[int, DataFrame] = {}
    for o in reversed(plan):
        if o.kind in ("INPUT", "WEIGHT") or o.output.op not in reached:
            continue
        g = X.accumulated(reached[o.output.op], o.output.width)
        source = o.inputs[0].op
        if o.kind == "MATMUL":
            w = o.inputs[1].op
            part = X.matmul_weight_gradient(made[source], g, *weights[w].shape)
            out[w] = out[w].unionByName(part).groupBy("k", "j").agg(F.sum("g").alias("g")) if w in out else part
        if not needed[source]:
            continue
        if o.kind == "MATMUL":
            back = X.matmul_input_gradient(g, weights[o.inputs[1].op], unroll=False)
        elif o.kind == "AGGREGATION":
            if (o.detail or "norm_sum") != "norm_sum":
                raise ValueError("only norm_sum can be trained through")
            back = keep(X.aggregate_gradient(edges, g, o.output.width))
        elif o.kind == "RELU":
            back = X.relu_gradient(made[source], g)
        else:
            back = X.softmax_gradient(made[o.output.op], g)
        reached.setdefault(source, []).append(back)
    return out


def dense(gradients: dict[int, DataFrame], weights: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """The matrices of all ``k, j, g`` tables, from one job; their size is that of the weights."""
    tables = [g.select(F.lit(w).alias("w"), "k", "j", "g") for w, g in gradients.items()]
    out = {w: np.zeros(weights[w].shape) for w in gradients}
    for r in functools.reduce(DataFrame.unionAll, tables).collect() if tables else []:
        out[r.w][r.k, r.j] = r.g
    return out


def train(model: Model, edges: DataFrame, features: DataFrame, labels: DataFrame, optimizer, epochs: int, *, loss: str = "cross_entropy", scheduler: PlateauRate | None = None, update: str = "epoch", chunks: int = 4, staleness: int = 0, weights: dict[int, np.ndarray] | None = None, vertices: int | None = None) -> Run:
    """Trains ``model`` on augmented ``edges (src, dst, w)``, ``features (v, h)`` and one-hot ``labels (v, y)``.

    ``vertices`` replaces the number that losses are divided by, as where parts divide by their own.
    """
    if update not in ("epoch", "chunk", "last_chunk"):
        raise ValueError(f"unknown update {update}")
    each, gradient_of = LOSSES[loss]
    plan, weights = model.plan(), dict(weights or initial_weights(model))
    kept: list[DataFrame] = []

    def keep(d: DataFrame) -> DataFrame:
        kept.append(d.persist(StorageLevel.MEMORY_AND_DISK))
        return kept[-1]

    # Kept by either end, so that only activations and gradients, not edges, are shuffled in an epoch.
    by_src, by_dst = (edges.repartition(end).persist(StorageLevel.MEMORY_AND_DISK) for end in ("src", "dst"))
    n = features.count()
    below = vertices or n
    metrics, stash = [], [dict(weights)]
    for epoch in range(epochs):
        began = time.perf_counter()
        used = stash[max(0, len(stash) - 1 - staleness)]
        made = forward(plan, by_src, features, used, keep)
        pairs = L.paired(made[model.output.op], labels)
        row = pairs.agg((F.sum(each()) / float(below)).alias("loss"), F.avg(F.when(L.hit(), 1.0).otherwise(0.0)).alias("accuracy")).first()
        if scheduler is not None:
            optimizer.rate = scheduler.step(row.loss)
        whole = gradient_of(pairs, below)
        parts = [whole] if update == "epoch" else [X.row_gradient(whole, equal_chunk(F.col("v"), n, chunks) == c) for c in range(chunks)]
        for c, start in enumerate(parts):
            if update == "last_chunk" and c < chunks - 1:
                continue
            if update == "chunk" and c:
                made = forward(plan, by_src, features, weights, keep)
                start = X.row_gradient(gradient_of(L.paired(made[model.output.op], labels), below), equal_chunk(F.col("v"), n, chunks) == c)
                used = weights
            found = dense(backward(plan, by_dst, made, used, start, keep), weights)
            for w, g in found.items():
                weights[w] = optimizer.step(str(w), weights[w], clipped(g, CLIP) if update == "last_chunk" else g)
        stash = [*stash, dict(weights)][-(staleness + 1) :]
        for d in kept:
            d.unpersist()
        kept.clear()
        metrics.append((epoch, float(row.loss), float(row.accuracy), time.perf_counter() - began))
    by_src.unpersist()
    by_dst.unpersist()
    return Run(weights, metrics)
