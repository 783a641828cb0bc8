"""Forward and backward passes on one Arrow batch, and an Adam step. The helpers the trainer's tasks call.

A network is a flat weight vector plus a spec (a dict of plain values), so it travels as an array column. Training takes
several networks of one layout at once, each with a batch of its own: weights of shape (networks, weights) and inputs of shape
(networks, rows, features) go through stacked products, which change none of the numbers.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa

LOG_EPS = 1e-7  # fixed value, as in functions.networks
# Scaled exponential linear unit.
SELU_SCALE, SELU_ALPHA = 1.0507009873554805, 1.6732632423543772
LEAKY_SLOPE = 0.2
BN_EPS, BN_MOMENTUM = 1e-3, 0.9


CELLS = "pos long, v double"  # schema of a task's partial sums


def matrix(column: pa.Array):
    """An Arrow column of equally long lists as a two-dimensional array, without copying row by row."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def cells(values) -> pa.RecordBatch:
    """Partial sums as rows (position, value), for Spark to add up over tasks."""
    return pa.RecordBatch.from_arrays([pa.array(np.arange(len(values))), pa.array(values)], names=["pos", "v"])


def _sigmoid(x):
    return 0.5 * (1.0 + np.tanh(0.5 * x))


def activate(name: str, z):
    """Activation value and derivative."""
    if name == "relu":
        return np.maximum(z, 0.0), (z > 0).astype(z.dtype)
    if name == "leaky_relu":
        return np.where(z >= 0, z, LEAKY_SLOPE * z), np.where(z >= 0, 1.0, LEAKY_SLOPE)
    if name in ("elu", "selu"):
        scale, alpha = (SELU_SCALE, SELU_ALPHA) if name == "selu" else (1.0, 1.0)
        neg = alpha * np.expm1(np.minimum(z, 0.0))
        return scale * np.where(z >= 0, z, neg), scale * np.where(z >= 0, 1.0, neg + alpha)
    if name == "sigmoid":
        s = _sigmoid(z)
        return s, s * (1.0 - s)
    if name == "tanh":
        t = np.tanh(z)
        return t, 1.0 - t * t
    return z, np.ones_like(z)


def shapes(spec: dict) -> list[tuple[str, tuple[int, ...]]]:
    """Named parameter blocks in flat order."""
    sizes = [spec["n_in"], *spec["hidden"], 1]
    out = []
    if spec["kind"] == "nalu":
        for i, (a, b) in enumerate(zip(sizes, sizes[1:])):
            out += [(f"w{i}", (a, b)), (f"m{i}", (a, b)), (f"g{i}", (a, b))]
        return out
    for i, (a, b) in enumerate(zip(sizes, sizes[1:])):
        if spec["batch_norm"]:
            out += [(f"gamma{i}", (a,)), (f"beta{i}", (a,)), (f"mean{i}", (a,)), (f"var{i}", (a,))]
        out += [(f"w{i}", (a, b)), (f"b{i}", (b,))]
    return out


def unpack(spec: dict, flat) -> dict:
    out, at = {}, 0
    for name, shape in shapes(spec):
        n = math.prod(shape)
        out[name] = flat[..., at:at + n].reshape(*flat.shape[:-1], *shape)
        at += n
    return out


def pack(spec: dict, blocks: dict):
    flat = []
    for name, shape in shapes(spec):
        block = np.asarray(blocks[name], dtype=float)
        flat.append(block.reshape(*block.shape[:block.ndim - len(shape)], -1))
    return np.concatenate(flat, axis=-1)


def _per_row(v):
    """One value per unit, next to the rows of its network's batch."""
    return v[..., None, :]


def _uniform(rng, shape):
    """Draws for dropout; stacked networks draw from a generator each."""
    return np.stack([r.random(shape[1:]) for r in rng]) if isinstance(rng, list) else rng.random(shape)


def initial(spec: dict, seed: int):
    """Truncated normal for arithmetic units; variance-scaled normal for dense layers."""
    rng, blocks = np.random.default_rng(seed), {}

    def truncated(shape, std):
        x = rng.normal(size=shape)
        while (bad := np.abs(x) > 2.0).any():
            x[bad] = rng.normal(size=int(bad.sum()))
        return std * x

    for name, shape in shapes(spec):
        if spec["kind"] == "nalu":
            blocks[name] = truncated(shape, 0.02)
        elif name[0] == "w":
            blocks[name] = truncated(shape, np.sqrt(2.0 / shape[0]))
        else:
            blocks[name] = np.full(shape, 1.0 if name.startswith(("gamma", "var")) else 0.0)
    return pack(spec, blocks)


def forward(spec: dict, flat, x, train: bool = False, rng=None):
    """Predictions, and what :func:`backward` needs."""
    p, cache, h = unpack(spec, flat), [], x
    layers = len(spec["hidden"]) + 1
    for i in range(layers):
        if spec["kind"] == "nalu":
            t, s = np.tanh(p[f"w{i}"]), _sigmoid(p[f"m{i}"])
            logs = np.log(np.abs(h) + LOG_EPS)
            add, mul, gate = h @ (t * s), np.exp(logs @ (t * s)), _sigmoid(h @ p[f"g{i}"])
            cache.append((h, t, s, logs, add, mul, gate))
            h = gate * add + (1.0 - gate) * mul
            continue
        norm = drop = None
        if spec["batch_norm"]:
            if train:
                mean, var = h.mean(axis=-2), h.var(axis=-2)
            else:
                mean, var = p[f"mean{i}"], np.maximum(p[f"var{i}"], 0.0)
            inv = 1.0 / np.sqrt(var + BN_EPS)
            xhat = (h - _per_row(mean)) * _per_row(inv)
            norm = (xhat, inv, mean, var)
            h = xhat * _per_row(p[f"gamma{i}"]) + _per_row(p[f"beta{i}"])
        if train and spec["dropout"] > 0 and (i > 0 or spec["batch_norm"]):
            drop = (_uniform(rng, h.shape) >= spec["dropout"]) / (1.0 - spec["dropout"])
            h = h * drop
        inside = h
        z = h @ p[f"w{i}"] + _per_row(p[f"b{i}"])
        h, slope = activate(spec["activation"] if i < layers - 1 else "identity", z)
        cache.append((norm, drop, inside, slope))
    return h[..., 0], cache


def backward(spec: dict, flat, cache, d_pred):
    """Gradient of the flat weights from the gradient of the predictions."""
    p, grads, d = unpack(spec, flat), {}, d_pred[..., None]
    for i in reversed(range(len(spec["hidden"]) + 1)):
        if spec["kind"] == "nalu":
            h, t, s, logs, add, mul, gate = cache[i]
            w = t * s
            d_add, d_mul = d * gate, d * (1.0 - gate) * mul
            d_gate = d * (add - mul) * gate * (1.0 - gate)
            d_w = h.mT @ d_add + logs.mT @ d_mul
            grads[f"w{i}"] = d_w * (1.0 - t * t) * s
            grads[f"m{i}"] = d_w * t * s * (1.0 - s)
            grads[f"g{i}"] = h.mT @ d_gate
            d = d_add @ w.mT + d_gate @ p[f"g{i}"].mT + (d_mul @ w.mT) * np.sign(h) / (np.abs(h) + LOG_EPS)
            continue
        norm, drop, inside, slope = cache[i]
        dz = d * slope
        w = p[f"w{i}"]
        grads[f"w{i}"] = inside.mT @ dz + spec["l1"] * np.sign(w) + spec["l2"] * w
        grads[f"b{i}"] = dz.sum(axis=-2)
        d = dz @ w.mT
        if drop is not None:
            d = d * drop
        if norm is not None:
            xhat, inv, _, _ = norm
            grads[f"gamma{i}"], grads[f"beta{i}"] = (d * xhat).sum(axis=-2), d.sum(axis=-2)
            grads[f"mean{i}"] = np.zeros_like(inv)
            grads[f"var{i}"] = np.zeros_like(inv)
            dx = d * _per_row(p[f"gamma{i}"])
            d = _per_row(inv) * (dx - _per_row(dx.mean(axis=-2)) - xhat * _per_row((dx * xhat).mean(axis=-2)))
    return pack(spec, grads)


def update_moving(spec: dict, flat, cache) -> None:
    """Move the batch-norm statistics towards the batch's, in place."""
    if spec["kind"] == "nalu" or not spec["batch_norm"]:
        return
    p = unpack(spec, flat)
    for i, (norm, *_rest) in enumerate(cache):
        for name, value in (("mean", norm[2]), ("var", norm[3])):
            block = p[f"{name}{i}"]
            block *= BN_MOMENTUM
            block += (1.0 - BN_MOMENTUM) * value


def loss_gradient(spec: dict, pred, y, err):
    """Gradient of the batch loss by the predictions: mean square, half sum of squares, or chi-square."""
    e = pred - y
    if spec["loss"] == "chisq":
        return 2.0 * e / (err * err)
    return e if spec["loss"] == "l2" else 2.0 * e / e.shape[-1]


def adam(flat, grad, m, v, t: float, lr: float) -> float:
    """One Adam step in place; returns the new step count."""
    t += 1.0
    m *= 0.9
    m += 0.1 * grad
    v *= 0.999
    v += 0.001 * grad * grad
    flat -= lr * (m / (1.0 - 0.9**t)) / (np.sqrt(v / (1.0 - 0.999**t)) + 1e-8)
    return t
