"""Expressions over ``array<double>`` columns: what a row of a vertex tensor is computed by."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Up to this width sums over rows are unrolled into one aggregate for each place; wider rows go the long way.
UNROLLED = 128


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def relu(h: Column) -> Column:
    return F.transform(h, lambda x: F.greatest(x, F.lit(0.0)))


def relu_gradient(h: Column, g: Column) -> Column:
    return F.zip_with(h, g, lambda x, y: F.when(x > 0, y).otherwise(F.lit(0.0)))


def shifted(h: Column) -> Column:
    """Less their maximum, which keeps exponentials bounded."""
    return F.zip_with(h, F.array_repeat(F.array_max(h), F.size(h)), lambda x, m: x - m)


def normalised(h: Column) -> Column:
    return F.zip_with(h, F.array_repeat(total(h), F.size(h)), lambda x, s: x / s)


def softmax(h: Column) -> Column:
    return normalised(F.transform(shifted(h), lambda x: F.exp(x)))


def softmax_gradient(p: Column, g: Column) -> Column:
    """p_j (g_j - sum of g_i p_i), which the full Jacobian comes to."""
    return F.zip_with(p, F.zip_with(g, F.array_repeat(dot(p, g), F.size(p)), lambda x, s: x - s), lambda x, y: x * y)


def argmax(h: Column) -> Column:
    """Place of the greatest entry from 0; the lowest place wins a tie."""
    return F.array_position(h, F.array_max(h)) - 1


def one_hot(label: Column, classes: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda c: F.when(c == label, F.lit(1.0)).otherwise(F.lit(0.0)))


def by_matrix(h: Column, weights: list[list[float]]) -> Column:
    """The row times a matrix of ``len(weights)`` rows, unrolled so that it stays in generated code."""
    columns = range(len(weights[0]))
    return F.array(*(sum((h[k] * F.lit(float(row[j])) for k, row in enumerate(weights)), F.lit(0.0)) for j in columns))


def pooled(pool: Callable[[Column], Column], h: Column, width: int) -> Column:
    """An aggregate place by place, as an array."""
    return F.array(*(pool(h[k]) for k in range(width)))
