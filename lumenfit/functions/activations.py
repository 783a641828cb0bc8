"""Activation functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The scaled exponential linear unit's scale and alpha, and the leaky slope.
SELU_SCALE = 1.0507009873554804934193349852946
SELU_ALPHA = 1.6732632423543772848170429916717
LEAKY_SLOPE = 0.2


def relu(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0))


def leaky_relu(x: Column, slope: float = LEAKY_SLOPE) -> Column:
    return F.when(x >= 0, x).otherwise(x * F.lit(slope))


def elu(x: Column) -> Column:
    return F.when(x >= 0, x).otherwise(F.expm1(x))


def selu(x: Column) -> Column:
    return F.lit(SELU_SCALE) * F.when(x >= 0, x).otherwise(F.lit(SELU_ALPHA) * F.expm1(x))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def tanh(x: Column) -> Column:
    return F.tanh(x)


def identity(x: Column) -> Column:
    return x


ACTIVATIONS = {
    "relu": relu, "leaky_relu": leaky_relu, "elu": elu, "selu": selu,
    "sigmoid": sigmoid, "tanh": tanh, "identity": identity,
}
