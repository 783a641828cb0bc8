"""Forward passes of small networks as plain column expressions (R-20).

With fixed weights a forward pass is arithmetic, so it stays inside generated JVM code. Each layer is its own
projection: inlining a layer into the next would repeat every expression once per downstream unit.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfit.functions.activations import ACTIVATIONS, sigmoid

LOG_EPS = 1e-7  # fixed value: keeps the logarithm of a zero input finite


def dot(cols: list[Column], weights) -> Column:
    return reduce(lambda a, b: a + b, [c * F.lit(float(w)) for c, w in zip(cols, weights)])


def nalu_units(cols: list[Column], w_hat, m_hat, gate) -> list[Column]:
    """One neural-arithmetic layer; the weight matrices are indexed [input][unit]."""
    n_in, n_out = len(w_hat), len(w_hat[0])
    out = []
    for j in range(n_out):
        w = [
            math.tanh(w_hat[i][j]) / (1.0 + math.exp(-m_hat[i][j]))
            for i in range(n_in)
        ]
        add = dot(cols, w)
        mul = F.exp(dot([F.ln(F.abs(c) + F.lit(LOG_EPS)) for c in cols], w))
        g = sigmoid(dot(cols, [gate[i][j] for i in range(n_in)]))
        out.append(g * add + (F.lit(1.0) - g) * mul)
    return out


def nalu_forward(df: DataFrame, input_cols: list[str], layers, output: str = "prediction") -> DataFrame:
    """Apply stacked neural-arithmetic layers ``[(w_hat, m_hat, gate), ...]``; the last has one unit."""
    return _stacked(df, input_cols, layers, lambda cols, layer: nalu_units(cols, *layer), output)


def dense_forward(df: DataFrame, input_cols: list[str], layers, output: str = "prediction") -> DataFrame:
    """Apply stacked dense layers ``[(weights, bias, activation), ...]``; the last has one unit."""

    def units(cols, layer):
        weights, bias, activation = layer
        act = ACTIVATIONS[activation]
        return [
            act(dot(cols, [row[j] for row in weights]) + F.lit(float(bias[j])))
            for j in range(len(bias))
        ]

    return _stacked(df, input_cols, layers, units, output)


def _stacked(df, input_cols, layers, units, output):
    keep, names = df.columns, list(input_cols)
    for depth, layer in enumerate(layers):
        cols = units([F.col(c) for c in names], layer)
        names = [f"_h{depth}_{j}" for j in range(len(cols))]
        df = df.withColumns(dict(zip(names, cols)))
    return df.select(*keep, F.col(names[0]).alias(output))
