"""Networks trained data-parallel on Spark (R-14, R-17 .. R-20).

Rows are hashed into lanes, whose number depends on the row count alone, packed, checkpointed and cached. An epoch is one job:
every lane starts from the same weights, takes minibatch steps through its rows in an order hashed from epoch and key, and its
weights count by its rows; the sums are added up by Spark, so the driver's part does not grow with the lanes. Lanes are dealt
to tasks, at most two per core or 64, and a task's lanes step side by side in stacked products; neither decides order or
steps: shards and cores do not change what is learned.
Averaged local steps are not the sequential minibatch descent of a single machine; ``mode="sync"`` takes one
full-gradient step per epoch instead, whose result does not depend on the sharding.
"""

from __future__ import annotations

import json
import math

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol, HasSeed
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenfit import schema
from lumenfit.functions import kernels
from lumenfit.functions.hashing import hash60
from lumenfit.operators.common import FEW_TASKS, sum_cells
from lumenfit.session import materialise_for_passes

# Sums kept per split while an epoch runs.
_SUMS = ("n", "sse", "sae", "chisq", "close", "y", "yy")


def _features(df: DataFrame, col: str) -> Column:
    if isinstance(df.schema[col].dataType, T.ArrayType):
        return F.col(col).cast("array<double>")
    return vector_to_array(F.col(col))


ROWS_PER_LANE = 10_000  # rows that one lane steps through between two averages
_MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9)  # odd constants that spread bits


STEP_BYTES = 64 << 20  # rows and weights of the lanes that a task steps through at a time

# A lane's rows as stored for the passes: packed columns, one record for its part of an Arrow batch.
_PACKED = {"h": np.int64, "x": np.float64, "y": np.float64, "e": np.float64, "t": np.bool_}
_LANES = "lane long, n long, width int, y_n long, y_sum double, " + ", ".join(f"{c} binary" for c in _PACKED)
_LANE_COLUMNS = [c.split()[0] for c in _LANES.split(", ")]


def _pack(batches):
    """Rows sorted by lane as records of packed columns, which a pass reads without taking rows apart."""
    for batch in batches:
        if not batch.num_rows:
            continue
        if batch.column("t").null_count:
            raise ValueError("rows without a split")
        lanes, y = batch.column("lane").to_numpy(), batch.column("y")
        columns = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in _PACKED if c != "x"}
        columns["x"] = kernels.matrix(batch.column("x"))
        there = y.is_valid().to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(np.diff(lanes)) + 1).tolist(), len(lanes)]
        for a, b in zip(cuts, cuts[1:]):
            part = there[a:b]
            record = [lanes[a], b - a, columns["x"].shape[1], part.sum(), columns["y"][a:b][part].sum()]
            record += [np.ascontiguousarray(columns[c][a:b], dtype).tobytes() for c, dtype in _PACKED.items()]
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.float64(), *[pa.binary()] * len(_PACKED)]
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(record, types)], _LANE_COLUMNS)


def _lane_rows(batches):
    """The rows of each lane as arrays; the records of a lane follow each other."""
    now, held = None, []
    for batch in batches:
        columns = [batch.column(c) for c in _PACKED]
        for i, lane in enumerate(batch.column("lane").to_pylist()):
            if held and lane != now:
                yield now, *_joined(held)
                held = []
            now = lane
            held.append([np.frombuffer(c[i].as_buffer(), k) for c, k in zip(columns, _PACKED.values())])
    if held:
        yield now, *_joined(held)


def _joined(records):
    h, x, y, err, test = records[0] if len(records) == 1 else map(np.concatenate, zip(*records))
    return x.reshape(len(h), -1), h, y, err, test


def _step_lanes(spec, flat, m, v, t, lr, batch, held):
    """Minibatch steps through the rows of several lanes, given as (generator, x, y, err), all from the same weights.

    Lanes step side by side in stacked products, each through its own rows with weights of its own, as if one after another.
    Returns weights, both moments and the step count of each lane as one row.
    """
    order = sorted(range(len(held)), key=lambda i: -len(held[i][2]))  # lanes that still have rows stay in front
    rngs, sizes = [held[i][0] for i in order], [len(held[i][2]) for i in order]
    x = np.zeros((len(order), sizes[0], held[0][1].shape[1]))
    y, err = np.zeros(x.shape[:2]), np.ones(x.shape[:2])
    for at, i in enumerate(order):
        for all_lanes, own in zip((x, y, err), held[i][1:]):
            all_lanes[at, :sizes[at]] = own
    w, m, v = (np.tile(a, (len(order), 1)) for a in (flat, m, v))

    def step(lanes, rows, t):
        p, cache = kernels.forward(spec, w[lanes], x[lanes, rows], True, rngs[lanes])
        g = kernels.backward(spec, w[lanes], cache, kernels.loss_gradient(spec, p, y[lanes, rows], err[lanes, rows]))
        t = kernels.adam(w[lanes], g, m[lanes], v[lanes], t, lr)
        kernels.update_moving(spec, w[lanes], cache)
        return t

    left, ts = len(order), [t]
    for k in range(sizes[0] // batch):
        while sizes[left - 1] < (k + 1) * batch:
            left -= 1
        ts.append(step(slice(0, left), slice(k * batch, (k + 1) * batch), ts[-1]))
    out = np.empty((len(order), 3 * len(flat) + 1))
    for at, i in enumerate(order):
        t1, rest = ts[sizes[at] // batch], sizes[at] % batch
        if rest:
            t1 = step(slice(at, at + 1), slice(sizes[at] - rest, sizes[at]), t1)
        out[i] = np.concatenate([w[at], m[at], v[at], [t1]])
    return out


def _epoch_task(spec, flat, m, v, t, lr, batch, seed, epoch, mode, shift, learn):
    """The function one task runs over its lanes."""

    def run(batches):
        total, grads = np.zeros(3 * len(flat) + 1), np.zeros_like(flat)
        trained, sums = 0, np.zeros((2, len(_SUMS)))
        held, size = [], 0

        def step_held():
            for (_, _, own, _), row in zip(held, _step_lanes(spec, flat, m, v, t, lr, batch, held)):
                np.add(total, len(own) * row, out=total)
            held.clear()

        for lane, x, h, y, err, test in _lane_rows(batches):
            pred, _ = kernels.forward(spec, flat, x)
            diff, moved = pred - y, y - shift
            cells = np.stack([
                np.ones_like(y), diff**2, np.abs(diff), (diff / err) ** 2,
                np.abs(diff) <= 1e-4 + 1e-4 * np.abs(pred), moved, moved**2,
            ], axis=1)
            sums[0] += cells[~test].sum(axis=0)
            sums[1] += cells[test].sum(axis=0)
            rows = np.flatnonzero(~test)
            if not learn or not len(rows):
                continue
            trained += len(rows)
            if mode == "sync":
                plain = _sum_spec(spec)
                p, cache = kernels.forward(plain, flat, x[rows])
                d = kernels.loss_gradient(plain, p, y[rows], err[rows])
                grads += kernels.backward(plain, flat, cache, d)
                continue
            key = (h[rows].astype(np.uint64) + np.uint64(epoch + 1)) * np.uint64(_MIX[0])
            key = (key ^ (key >> np.uint64(29))) * np.uint64(_MIX[1])
            rows = rows[np.lexsort((h[rows], key ^ (key >> np.uint64(32))))]
            rng = np.random.default_rng([seed, epoch, lane])  # dropout
            held.append((rng, x[rows], y[rows], err[rows]))
            size += 8 * (len(rows) * (x.shape[1] + 2) + 3 * len(flat))
            if size >= STEP_BYTES:
                step_held()
                size = 0
        if held:
            step_held()
        body = grads if mode == "sync" else total
        yield kernels.cells(np.concatenate([body, [trained], sums.ravel()]))

    return run


def _sum_spec(spec: dict) -> dict:
    """The same network with a loss that adds up over rows and no penalty."""
    loss = "l2" if spec["loss"] == "mse" else spec["loss"]
    return {**spec, "loss": loss, **({"l1": 0.0, "l2": 0.0} if spec["kind"] == "dense" else {})}


def _penalty(spec: dict, flat):
    """Gradient of the L1 and L2 penalties alone."""
    blocks = {k: np.zeros_like(b) for k, b in kernels.unpack(spec, flat).items()}
    if spec["kind"] == "dense":
        for k, b in kernels.unpack(spec, flat).items():
            if k[0] == "w":
                blocks[k] = spec["l1"] * np.sign(b) + spec["l2"] * b
    return kernels.pack(spec, blocks)


def _metrics(sums: np.ndarray) -> dict:
    out = {}
    for name, row in zip(("train", "test"), sums):
        s = dict(zip(_SUMS, row))
        sst = s["yy"] - s["y"] ** 2 / s["n"] if s["n"] else 0.0
        out[f"r2_{name}"] = 1.0 - s["sse"] / sst if sst > 0 else None
        out[f"chisq_{name}"] = float(s["chisq"]) if s["n"] else None
    out["loss"] = float(0.5 * sums[0, 1])
    out["accuracy"] = float(sums[0, 4] / sums[0, 0]) if sums[0, 0] else None
    return out


class _NetParams(HasFeaturesCol, HasLabelCol, HasPredictionCol, HasSeed,
                 DefaultParamsReadable, DefaultParamsWritable):
    errCol = Param(Params._dummy(), "errCol", "error column, empty for none", TypeConverters.toString)
    splitCol = Param(Params._dummy(), "splitCol", "split column, empty for none", TypeConverters.toString)
    keyCol = Param(Params._dummy(), "keyCol", "unique row key", TypeConverters.toString)
    epochs = Param(Params._dummy(), "epochs", "passes over the data", TypeConverters.toInt)
    batch = Param(Params._dummy(), "batch", "minibatch rows", TypeConverters.toInt)
    lr = Param(Params._dummy(), "lr", "learning rate", TypeConverters.toFloat)
    shards = Param(Params._dummy(), "shards", "partitions of the data, 0 for one per lane up to twice the cores", TypeConverters.toInt)
    mode = Param(Params._dummy(), "mode", "average or sync", TypeConverters.toString)
    keepBest = Param(Params._dummy(), "keepBest", "keep the best test R2 weights", TypeConverters.toBoolean)

    def _net_defaults(self, kwargs: dict, **more) -> None:
        self._setDefault(**{**dict(
            featuresCol="features", labelCol="flux", predictionCol="prediction", seed=42, errCol="",
            splitCol="", keyCol="idx", epochs=20, batch=32, lr=1e-3, shards=0, mode="average",
            keepBest=False,
        ), **more})
        self._set(**{k: v for k, v in kwargs.items() if v is not None})

    def _spec(self, n_in: int) -> dict:
        raise NotImplementedError

    def _prepared(self, df: DataFrame) -> DataFrame:
        """Rows in their lanes, in a fixed order, packed."""
        err, split = self.getOrDefault(self.errCol), self.getOrDefault(self.splitCol)
        lanes = max(1, -(-df.count() // ROWS_PER_LANE))
        shards = self.getOrDefault(self.shards) or min(lanes, max(FEW_TASKS, 2 * df.sparkSession.sparkContext.defaultParallelism))
        test = F.col(split) != "train" if split else F.lit(False)
        return df.select(
            hash60(self.getOrDefault(self.keyCol), self.getSeed()).alias("h"),
            _features(df, self.getFeaturesCol()).alias("x"),
            F.col(self.getLabelCol()).cast("double").alias("y"),
            (F.col(err).cast("double") if err else F.lit(1.0)).alias("e"),
            test.alias("t"),
        ).withColumn("lane", F.col("h") % lanes).repartition(shards, "lane").sortWithinPartitions("lane", "h").mapInArrow(_pack, _LANES)

    def lanes(self, df: DataFrame) -> DataFrame:
        """The rows in their lanes, stored; fits that share columns, key and seed can take this table in place of ``df``.

        The caller unpersists it.
        """
        return materialise_for_passes(self._prepared(df))

    def _train(self, df: DataFrame, start: "NetworkModel | None" = None) -> "NetworkModel":
        stored = df.columns == _LANE_COLUMNS
        data = df if stored else self.lanes(df)
        try:
            head = data.agg(F.max("width"), F.sum("y_sum") / F.sum("y_n")).first()
            spec = start.spec() if start else self._spec(head[0])
            if self.getOrDefault(self.mode) == "sync" and (
                spec.get("batch_norm") or spec.get("dropout")
            ):
                raise ValueError("sync mode takes full-gradient steps: no dropout, no batch normalisation")
            flat = start.final() if start else kernels.initial(spec, self.getSeed())
            return self._epochs(data, spec, flat, float(head[1]), start)
        finally:
            if not stored:
                data.unpersist()

    def _epochs(self, data: DataFrame, spec: dict, flat, shift: float, start: "NetworkModel | None") -> "NetworkModel":
        mode, epochs = self.getOrDefault(self.mode), self.getOrDefault(self.epochs)
        lr, n = self.getOrDefault(self.lr), len(flat)
        done, m, v, t = start.state() if start else (0, np.zeros(n), np.zeros(n), 0.0)
        history, best, tasks = [], (-math.inf, None), data.rdd.getNumPartitions()
        for epoch in range(epochs + 1):
            task = _epoch_task(
                spec, flat, m, v, t, lr, self.getOrDefault(self.batch), self.getSeed(), done + epoch, mode,
                shift, epoch < epochs,
            )
            values = np.array(sum_cells(data.mapInArrow(task, kernels.CELLS), tasks))
            body, trained = values[: -2 * len(_SUMS) - 1], values[-2 * len(_SUMS) - 1]
            scores = _metrics(values[-2 * len(_SUMS):].reshape(2, -1))
            if epoch:
                history.append({"epoch": done + epoch - 1, **scores})
                r2 = scores["r2_test"]
                if r2 is not None and r2 >= best[0]:
                    best = (r2, flat.copy())
            if epoch == epochs or trained == 0:
                continue
            if mode == "sync":
                flat = flat.copy()
                t = kernels.adam(flat, body / trained + _penalty(spec, flat), m, v, t, lr)
            else:
                mean = body / trained
                flat, m, v, t = mean[:n].copy(), mean[n:2 * n].copy(), mean[2 * n:3 * n].copy(), mean[3 * n]
        kept = best[1] if self.getOrDefault(self.keepBest) and best[1] is not None else flat
        model = NetworkModel()._set(
            featuresCol=self.getFeaturesCol(), predictionCol=self.getPredictionCol(),
            specJson=json.dumps(spec), weights=kept.tolist(), historyJson=json.dumps(history),
            stateJson=json.dumps({
                "epochs": done + epochs, "final": flat.tolist(), "m": m.tolist(), "v": v.tolist(), "t": float(t),
            }),
        )
        return model


def _scorer(spec: dict, flat):
    """An Arrow-batched function from a feature array to the network's prediction."""

    @F.arrow_udf("double")
    def score(x: pa.Array) -> pa.Array:
        if not len(x):
            return pa.array([], pa.float64())
        return pa.array(kernels.forward(spec, flat, kernels.matrix(x))[0])

    return score


class NetworkModel(Model, HasFeaturesCol, HasPredictionCol, DefaultParamsReadable, DefaultParamsWritable):
    """A trained network; scoring is an Arrow-batched function over the feature column (R-20)."""

    specJson = Param(Params._dummy(), "specJson", "network layout", TypeConverters.toString)
    weights = Param(Params._dummy(), "weights", "flat weights", TypeConverters.toListFloat)
    historyJson = Param(Params._dummy(), "historyJson", "scores per epoch", TypeConverters.toString)
    stateJson = Param(Params._dummy(), "stateJson", "final weights and the optimiser's state", TypeConverters.toString)

    def __init__(self):
        super().__init__()
        self._setDefault(featuresCol="features", predictionCol="prediction", historyJson="[]", stateJson="{}")

    def spec(self) -> dict:
        return json.loads(self.getOrDefault(self.specJson))

    def flat(self) -> np.ndarray:
        return np.array(self.getOrDefault(self.weights))

    def final(self) -> np.ndarray:
        """The weights after the last epoch, where scoring may use those of the best epoch."""
        state = json.loads(self.getOrDefault(self.stateJson))
        return np.array(state["final"]) if state else self.flat()

    def state(self) -> tuple[int, np.ndarray, np.ndarray, float]:
        """Epochs done and the optimiser's moments and step count, zero where the model was stored without."""
        state, n = json.loads(self.getOrDefault(self.stateJson)), len(self.flat())
        if not state:
            return 0, np.zeros(n), np.zeros(n), 0.0
        return state["epochs"], np.array(state["m"]), np.array(state["v"]), state["t"]

    def blocks(self) -> dict:
        """Weights by block name."""
        return kernels.unpack(self.spec(), self.flat())

    def history(self, spark) -> DataFrame:
        """E-19: loss, accuracy, R2 and chi-square of both splits after every epoch, over whole splits."""
        names = schema.HISTORY_SCHEMA.fieldNames()
        rows = [tuple(h[c] for c in names) for h in json.loads(self.getOrDefault(self.historyJson))]
        return spark.createDataFrame(rows, schema.HISTORY_SCHEMA)

    def _transform(self, df: DataFrame) -> DataFrame:
        score = _scorer(self.spec(), self.flat())
        return df.withColumn(self.getPredictionCol(), score(_features(df, self.getFeaturesCol())))


class DenseRegressor(Estimator, _NetParams):
    """R-17 / R-18: dense layers with dropout, batch normalisation, L1 and L2 penalties.

    ``loss`` is ``mse`` or ``chisq`` (squared errors over the squared ``errCol``). ``hidden`` defaults to three
    layers as wide as the input.
    """

    hidden = Param(Params._dummy(), "hidden", "hidden layer widths", TypeConverters.toListInt)
    activation = Param(Params._dummy(), "activation", "hidden activation", TypeConverters.toString)
    dropout = Param(Params._dummy(), "dropout", "share of units dropped", TypeConverters.toFloat)
    batchNorm = Param(Params._dummy(), "batchNorm", "normalise layer inputs", TypeConverters.toBoolean)
    l1 = Param(Params._dummy(), "l1", "L1 penalty", TypeConverters.toFloat)
    l2 = Param(Params._dummy(), "l2", "L2 penalty", TypeConverters.toFloat)
    loss = Param(Params._dummy(), "loss", "mse or chisq", TypeConverters.toString)

    @keyword_only
    def __init__(
        self, *, hidden=None, activation="elu", dropout=0.5, batchNorm=False, l1=0.0, l2=0.0, loss="mse",
        featuresCol="features", labelCol="flux", predictionCol="prediction", errCol="", splitCol="",
        keyCol="idx", epochs=20, batch=32, lr=1e-3, shards=0, mode="average", keepBest=False, seed=42,
    ):
        super().__init__()
        self._net_defaults(
            self._input_kwargs, hidden=[], activation="elu", dropout=0.5, batchNorm=False, l1=0.0,
            l2=0.0, loss="mse",
        )

    def _spec(self, n_in: int) -> dict:
        return {
            "kind": "dense", "n_in": n_in, "hidden": self.getOrDefault(self.hidden) or [n_in] * 3,
            "activation": self.getOrDefault(self.activation),
            "dropout": self.getOrDefault(self.dropout), "batch_norm": self.getOrDefault(self.batchNorm),
            "l1": self.getOrDefault(self.l1), "l2": self.getOrDefault(self.l2),
            "loss": self.getOrDefault(self.loss),
        }

    def _fit(self, df: DataFrame) -> NetworkModel:
        return self._train(df)

    def resume(self, model: NetworkModel, df: DataFrame) -> NetworkModel:
        """R-14: continue from a trained model's final weights and optimiser state, as if it had never stopped."""
        return self._train(df, model)


class NALURegressor(Estimator, _NetParams):
    """R-19: stacked neural arithmetic logic units, half-sum-of-squares loss, Adam."""

    layers = Param(Params._dummy(), "layers", "hidden layers", TypeConverters.toInt)
    neurons = Param(Params._dummy(), "neurons", "units per layer, 0 for the input width", TypeConverters.toInt)

    @keyword_only
    def __init__(
        self, *, layers=1, neurons=0, featuresCol="features", labelCol="flux", predictionCol="prediction",
        errCol="", splitCol="", keyCol="idx", epochs=200, batch=32, lr=1e-3, shards=0, mode="average",
        keepBest=False, seed=42,
    ):
        super().__init__()
        self._net_defaults(self._input_kwargs, layers=1, neurons=0, epochs=200)

    def _spec(self, n_in: int) -> dict:
        width = self.getOrDefault(self.neurons) or n_in
        return {
            "kind": "nalu", "n_in": n_in, "hidden": [width] * self.getOrDefault(self.layers), "loss": "l2",
        }

    def _fit(self, df: DataFrame) -> NetworkModel:
        return self._train(df)

    def resume(self, model: NetworkModel, df: DataFrame) -> NetworkModel:
        """R-14: continue from a trained model's final weights and optimiser state, as if it had never stopped."""
        return self._train(df, model)


def register_sql(spark, model: NetworkModel | None = None, name: str = "network_score") -> None:
    """Make the activations, and a trained network, callable from SQL text.

    The activations are SQL functions that the optimizer inlines; the network is an Arrow-batched function of
    an ``array<double>``.
    """
    from lumenfit.functions.activations import LEAKY_SLOPE, SELU_ALPHA, SELU_SCALE

    bodies = {
        "relu": "greatest(x, 0e0)",
        "leaky_relu": f"if(x >= 0, x, {LEAKY_SLOPE!r}D * x)",
        "elu": "if(x >= 0, x, expm1(x))",
        "selu": f"{SELU_SCALE!r}D * if(x >= 0, x, {SELU_ALPHA!r}D * expm1(x))",
        "sigmoid": "1e0 / (1e0 + exp(-x))",
    }
    for fn, body in bodies.items():
        spark.sql(f"create or replace temporary function {fn}(x double) returns double return {body}")
    if model is not None:
        spark.udf.register(name, _scorer(model.spec(), model.flat()))
