"""Models as graphs of symbolic operators with shapes known in advance.

A user subclasses ``Model`` and writes ``forward``. Operators are numbered in the order they are made, which is an order of
evaluation. ``reordered`` moves neighbour sums to the narrower side of a matrix product, since what is shuffled grows with width.
"""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame, SparkSession

ACTIVATIONS = ("None", "relu", "softmax")
POOL_KINDS = ("norm_sum", "sum", "mean", "max", "min")


@dataclasses.dataclass(frozen=True)
class Tensor:
    """The output of operator ``op``. A vertex tensor has a row of ``shape[1]`` numbers for each vertex; shape[0] is -1."""

    op: int
    shape: tuple[int, ...]

    @property
    def of_vertices(self) -> bool:
        return self.shape[0] == -1

    @property
    def width(self) -> int:
        return self.shape[-1]


@dataclasses.dataclass(frozen=True)
class Operator:
    kind: str
    inputs: tuple[Tensor, ...]
    output: Tensor
    detail: str = ""


class Model:
    """Subclasses implement ``forward``; ``features`` is the width of the input."""

    def __init__(self, features: int) -> None:
        if features < 1:
            raise ValueError("features must be positive")
        self.operators: list[Operator] = []
        self.input = self._add("INPUT", (), (-1, features))
        self.output = self.forward(self.input)

    def forward(self, input_: Tensor) -> Tensor:
        raise NotImplementedError

    def _add(self, kind: str, inputs: tuple[Tensor, ...], shape: tuple[int, ...], detail: str = "") -> Tensor:
        out = Tensor(len(self.operators), shape)
        self.operators.append(Operator(kind, inputs, out, detail))
        return out

    @staticmethod
    def _rows(t: Tensor) -> None:
        if not t.of_vertices or len(t.shape) != 2 or t.width < 1:
            raise ValueError(f"a vertex tensor is needed, not {t.shape}")

    def weight(self, *shape: int) -> Tensor:
        if not 1 <= len(shape) <= 2 or min(shape) < 1:
            raise ValueError(f"weights have one or two positive dimensions, not {shape}")
        return self._add("WEIGHT", (), shape)

    def relu(self, t: Tensor) -> Tensor:
        self._rows(t)
        return self._add("RELU", (t,), t.shape)

    def softmax(self, t: Tensor) -> Tensor:
        self._rows(t)
        return self._add("SOFTMAX", (t,), t.shape)

    def aggregation(self, t: Tensor, kind: str = "norm_sum") -> Tensor:
        self._rows(t)
        if kind not in POOL_KINDS:
            raise ValueError(f"unknown aggregation {kind}")
        return self._add("AGGREGATION", (t,), t.shape, kind)

    def matmul(self, a: Tensor, b: Tensor) -> Tensor:
        self._rows(a)
        if b.of_vertices or len(b.shape) != 2 or b.shape[0] != a.width:
            raise ValueError(f"shapes {a.shape} and {b.shape} don't fit")
        return self._add("MATMUL", (a, b), (-1, b.shape[1]))

    def fc(self, t: Tensor, width: int, activation: str = "None") -> Tensor:
        """A matrix product with new weights, no offset, and an activation."""
        if activation not in ACTIVATIONS:
            raise ValueError(f"unknown activation {activation}")
        made = self.matmul(t, self.weight(t.width, width))
        return {"None": lambda x: x, "relu": self.relu, "softmax": self.softmax}[activation](made)

    def needs_gradient(self) -> list[bool]:
        """For each operator, whether it depends on a weight: the rest has no part in the backward pass."""
        out: list[bool] = []
        for op in self.operators:
            out.append(op.kind == "WEIGHT" or any(out[t.op] for t in op.inputs))
        return out

    def used(self) -> list[bool]:
        """For each operator, whether the output depends on it."""
        out = [False] * len(self.operators)
        out[self.output.op] = True
        for op in reversed(self.operators):
            if out[op.output.op]:
                for t in op.inputs:
                    out[t.op] = True
        return out

    def tables(self, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
        """``ops (op, kind)`` and ``op_edges (producer, consumer)``."""
        ops = spark.createDataFrame([(o.output.op, o.kind) for o in self.operators], "op long, kind string")
        edges = [(t.op, o.output.op) for o in self.operators for t in o.inputs]
        return ops, spark.createDataFrame(edges, "producer long, consumer long")

    def plan(self) -> list[Operator]:
        """Used operators in order, with a neighbour sum and the product after or before it swapped where that makes the sum narrower."""
        readers: dict[int, int] = {}
        for o in self.operators:
            for t in o.inputs:
                readers[t.op] = readers.get(t.op, 0) + 1
        by_op = {o.output.op: o for o in self.operators}
        for o in list(self.operators):
            o = by_op[o.output.op]
            source = by_op[o.inputs[0].op] if o.inputs else None
            if source is None or readers.get(source.output.op) != 1:
                continue
            pair = (source.kind, o.kind)
            if pair == ("AGGREGATION", "MATMUL") and source.detail == "norm_sum" and o.output.width < source.output.width:
                inner = Operator("MATMUL", (source.inputs[0], o.inputs[1]), Tensor(source.output.op, o.output.shape))
                by_op[source.output.op], by_op[o.output.op] = inner, Operator("AGGREGATION", (inner.output,), o.output, "norm_sum")
            elif pair == ("MATMUL", "AGGREGATION") and o.detail == "norm_sum" and source.inputs[0].width < o.output.width:
                first = Tensor(source.output.op, source.inputs[0].shape)
                by_op[source.output.op], by_op[o.output.op] = Operator("AGGREGATION", (source.inputs[0],), first, "norm_sum"), Operator("MATMUL", (first, source.inputs[1]), o.output)
        used = self.used()
        ordered: list[Operator] = [by_op[i] for i in sorted(by_op) if used[i]]
        place = {o.output.op: i for i, o in enumerate(ordered)}
        # A weight may be numbered after the product that moved in front of it.
        weights = [o for o in ordered if o.kind == "WEIGHT"]
        return [*weights, *(o for o in ordered if o.kind != "WEIGHT")] if any(place[t.op] > place[o.output.op] for o in ordered for t in o.inputs) else ordered


class GCN(Model):
    """Layers of product, neighbour sum and activation: ReLU, and softmax at the end."""

    def __init__(self, layers: int, hidden: int, classes: int, features: int) -> None:
        if min(layers, hidden, classes) < 1:
            raise ValueError("layers, hidden and classes must be positive")
        self.layers, self.hidden, self.classes = layers, hidden, classes
        super().__init__(features)

    def forward(self, input_: Tensor) -> Tensor:
        t = input_
        for i in range(self.layers):
            last = i == self.layers - 1
            t = self.aggregation(self.fc(t, self.classes if last else self.hidden))
            t = self.softmax(t) if last else self.relu(t)
        return t
