"""Anomaly models. Scores: lower is odder; a row is an anomaly under the model's offset.

fit() and score() take small matrices. fitted() and scored() take tables: the local outlier factor and the distance to density clusters then
learn from every row, by neighbour joins (density.py), an isolation forest's trees draw from every row (forest.py), and so do ensembles of these; the
one-class machine and the autoencoders are still fitted on a bounded sample (SAMPLE, by hash of the id) on the driver. Every row is scored on the executors.
"""

from __future__ import annotations

import io
import json
from collections.abc import Iterator
from functools import reduce
from operator import and_
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import density, forest

#: Rows that a model is fitted on at most.
SAMPLE = 4096


class Model:
    """fit, score, predict (-1 anomaly, 1 normal), and state() / load() of arrays and numbers."""

    name = "model"
    contamination = 0.1

    def fit(self, x: np.ndarray) -> Model:
        raise TypeError(f"{type(self).__name__} has no fit of its own")

    def scale(self, x: np.ndarray, learn: bool = False) -> np.ndarray:
        if learn:
            self.centre, spread = x.mean(0), x.std(0)
            self.spread = np.where(spread > 0, spread, 1.0)
        return (x - self.centre) / self.spread

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.of_scaled(self.scale(x))

    def predict(self, x: np.ndarray) -> np.ndarray:
        return np.where(self.score(x) < self.offset, -1, 1)

    def state(self) -> dict:
        return dict(vars(self))

    def over_rows(self):
        """The same model as it learns from a whole table, if there is one."""


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances; what is rounding beside the rows' own lengths is 0."""
    la, lb = (a * a).sum(1)[:, None], (b * b).sum(1)[None, :]
    square = la + lb - 2 * a @ b.T
    return np.sqrt(np.where(square > 1e-12 * (la + lb), square, 0.0))


class LocalOutlierFactor(Model):
    """Density of a row's neighbourhood against its neighbours'. Of neighbours that tie, the first rows of the sample count."""

    name = "lof"

    def __init__(self, contamination: float = 0.1, neighbours: int = 20):
        self.contamination, self.neighbours = contamination, neighbours

    def over_rows(self):
        return density.NeighbourFactor(self.contamination, self.neighbours)

    def fit(self, x):
        self.rows = self.scale(x, learn=True)
        self.k = max(1, min(self.neighbours, len(x) - 1))
        d = _distances(self.rows, self.rows)
        np.fill_diagonal(d, np.inf)
        near = np.argsort(d, axis=1, kind="stable")[:, : self.k]
        own = np.take_along_axis(d, near, 1)
        self.reach = own[:, -1]
        self.density = 1 / (np.maximum(own, self.reach[near]).mean(1) + 1e-10)
        factor = self.density[near].mean(1) / self.density
        self.offset = float(np.percentile(-factor, 100 * self.contamination))
        return self

    def of_scaled(self, z):
        d = _distances(z, self.rows)
        near = np.argsort(d, axis=1, kind="stable")[:, : self.k]
        density = 1 / (np.maximum(np.take_along_axis(d, near, 1), self.reach[near]).mean(1) + 1e-10)
        return -self.density[near].mean(1) / density


class DensityClusters(Model):
    """Distance to the nearest row of any cluster: rows with `least` rows within eps (themselves too), and rows within eps of those.

    predict() takes the batch's own quantile as threshold; without a cluster every score is 0.
    """

    name = "dbscan"

    def __init__(self, contamination: float = 0.1, eps: float = 0.5, least: int = 5):
        self.contamination, self.eps, self.least = contamination, eps, least

    def over_rows(self):
        return density.ClusterDistance(self.contamination, self.eps, self.least)

    def fit(self, x):
        z = self.scale(x, learn=True)
        near = _distances(z, z) <= self.eps
        core = near.sum(1) >= self.least
        self.rows = z[core | (near & core[None, :]).any(1)]
        self.offset = float(np.percentile(self.of_scaled(z), 100 * self.contamination))
        return self

    def of_scaled(self, z):
        return 0.0 - _distances(z, self.rows).min(1) if len(self.rows) else np.zeros(len(z))

    def predict(self, x):
        score = self.score(x)
        return np.where(score < np.percentile(score, 100 * self.contamination), -1, 1)


def _mean_path(n: np.ndarray) -> np.ndarray:
    """Mean depth of a failed search among n rows."""
    n = np.asarray(n, dtype=float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + np.euler_gamma) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


class IsolationForest(Model):
    """Random splits: rows that are soon alone are odd. Trees are complete arrays of 2^depth places, so that all rows walk them at once."""

    name = "isolation_forest"

    def __init__(self, contamination: float = 0.1, trees: int = 100, sample: int = 256, seed: int = 42):
        self.contamination, self.trees, self.sample, self.seed = contamination, trees, sample, seed

    def over_rows(self):
        return forest.Forest(self.contamination, self.trees, self.sample, self.seed)

    def fit(self, x):
        rng = np.random.default_rng(self.seed)
        z = self.scale(x, learn=True)
        m = min(self.sample, len(z))
        self.depth = max(1, int(np.ceil(np.log2(max(m, 2)))))
        places = 2 ** (self.depth + 1)
        self.feature = np.full((self.trees, places), -1)
        self.cut, self.leaf = np.zeros((self.trees, places)), np.zeros((self.trees, places))
        for tree in range(self.trees):
            self._grow(z[rng.choice(len(z), m, replace=False)], tree, rng)
        self.usual = float(_mean_path(m)) or 1.0
        self.offset = float(np.percentile(self.of_scaled(z), 100 * self.contamination))
        return self

    def _grow(self, rows: np.ndarray, tree: int, rng: np.random.Generator) -> None:
        todo = [(1, 0, rows)]
        while todo:
            place, depth, part = todo.pop()
            wide = np.flatnonzero(np.ptp(part, axis=0) > 0) if len(part) > 1 and depth < self.depth else []
            if not len(wide):
                self.leaf[tree, place] = depth + _mean_path(len(part))
                continue
            f = rng.choice(wide)
            at = rng.uniform(part[:, f].min(), part[:, f].max())
            self.feature[tree, place], self.cut[tree, place] = f, at
            todo += [(2 * place, depth + 1, part[part[:, f] <= at]), (2 * place + 1, depth + 1, part[part[:, f] > at])]

    def of_scaled(self, z):
        total, every = np.zeros(len(z)), np.arange(len(z))
        for tree in range(self.trees):
            at = np.ones(len(z), dtype=int)
            for _ in range(self.depth):
                f = self.feature[tree, at]
                at = np.where(f < 0, at, 2 * at + (z[every, np.maximum(f, 0)] > self.cut[tree, at]))
            total += self.leaf[tree, at]
        return -(2 ** (-total / self.trees / self.usual))

    def importances(self) -> np.ndarray:
        """Share of all splits by feature, splits higher in a tree counting more."""
        weight = 2.0 ** -np.floor(np.log2(np.maximum(np.arange(self.feature.shape[1]), 1)))
        w = np.bincount(self.feature[self.feature >= 0], weights=np.broadcast_to(weight, self.feature.shape)[self.feature >= 0], minlength=len(self.centre))
        return w / max(w.sum(), 1e-300)


class OneClassMachine(Model):
    """One-class support vectors with a Gaussian kernel (gamma: 1 / (features x variance)), by pairwise steps on the worst pair."""

    name = "one_class_svm"

    def __init__(self, contamination: float = 0.1, most: int = 1024, steps: int = 20_000, tolerance: float = 1e-6):
        self.contamination, self.most, self.steps, self.tolerance = contamination, most, steps, tolerance

    def fit(self, x):
        z = self.scale(x, learn=True)[: self.most]
        self.gamma = 1 / (z.shape[1] * (z.var() or 1.0))
        kernel, n = np.exp(-self.gamma * _distances(z, z) ** 2), len(z)
        full = self.contamination * n
        weight = np.zeros(n)
        weight[: int(full)] = 1.0
        if int(full) < n:
            weight[int(full)] = full - int(full)
        gradient = kernel @ weight
        for _ in range(self.steps):
            up, down = np.where(weight < 1, gradient, np.inf).argmin(), np.where(weight > 0, gradient, -np.inf).argmax()
            gap = gradient[down] - gradient[up]
            if gap < self.tolerance:
                break
            step = min(gap / max(kernel[up, up] + kernel[down, down] - 2 * kernel[up, down], 1e-12), 1 - weight[up], weight[down])
            weight[up] += step
            weight[down] -= step
            gradient += step * (kernel[:, up] - kernel[:, down])
        free = (weight > 1e-9) & (weight < 1 - 1e-9)
        self.offset = float(gradient[free].mean() if free.any() else gradient[weight > 0].max())
        self.rows, self.weight = z[weight > 0], weight[weight > 0]
        return self

    def of_scaled(self, z):
        return np.exp(-self.gamma * _distances(z, self.rows) ** 2) @ self.weight


class BothAgree(Model):
    """Isolation forest and LOF: an anomaly only where both say so; the score is their mean."""

    name = "if_and_lof"

    def __init__(self, contamination: float = 0.1, seed: int = 42):
        self.contamination, self.parts = contamination, [IsolationForest(contamination, seed=seed), LocalOutlierFactor(contamination)]

    def fit(self, x):
        self.parts = [m.fit(x) for m in self.parts]
        return self

    def score(self, x):
        return sum(m.score(x) for m in self.parts) / len(self.parts)

    def predict(self, x):
        return np.where(np.all([m.predict(x) == -1 for m in self.parts], axis=0), -1, 1)


class WeightedVote(Model):
    """Any models: an anomaly where those that say so hold over half of all weight."""

    name = "weighted_vote"

    def __init__(self, models: list[Model], weights: list[float]):
        if not models:
            raise ValueError("a vote needs a model")
        self.parts, self.weights = models, weights

    def fit(self, x):
        self.parts = [m.fit(x) for m in self.parts]
        return self

    def score(self, x):
        return -sum(w * (m.predict(x) == -1) for m, w in zip(self.parts, self.weights, strict=True))

    def predict(self, x):
        return np.where(-self.score(x) > sum(self.weights) / 2, -1, 1)


class Autoencoder(Model):
    """Rows through layers that narrow to `latent` and widen again; the error of what comes out is the score, negated.

    kind "conv": the features as a line, three convolutions of width 3 (32, 16, 8 channels) halved twice, mirrored by doubling;
    "dense": fully connected. Trained by Adam on shuffled batches, a tenth held out; it stops when that has not improved for
    `patience` rounds, and keeps the best weights.
    """

    name = "autoencoder"

    def __init__(self, contamination: float = 0.1, latent: int = 8, rounds: int = 50, batch: int = 64, patience: int = 5, rate: float = 0.002, kind: str = "conv", seed: int = 42):
        self.contamination, self.latent, self.rounds, self.batch, self.patience, self.rate, self.kind, self.seed = contamination, latent, rounds, batch, patience, rate, kind, seed

    def _layers(self, width: int) -> list[tuple]:
        if self.kind == "dense":
            return [("dense", width, 32, True), ("dense", 32, self.latent, False), ("dense", self.latent, 32, True), ("dense", 32, width, False)]
        quarter = -(-width // 4)
        wide = quarter * 4
        return [("line", width, wide), ("conv", 1, 32), ("halve",), ("conv", 32, 16), ("halve",), ("conv", 16, 8), ("flat",), ("dense", 8 * quarter, self.latent, False), ("dense", self.latent, 8 * quarter, True), ("fold", quarter, 8), ("conv", 8, 16), ("double",), ("conv", 16, 32), ("double",), ("flat",), ("dense", 32 * wide, width, False)]

    def _start(self, width: int, rng: np.random.Generator) -> list[np.ndarray]:
        out = []
        for kind, *size in self._layers(width):
            if kind in ("dense", "conv"):
                shape = (size[0] * (3 if kind == "conv" else 1), size[1])
                out += [rng.normal(size=shape) * np.sqrt(2 / shape[0]), np.zeros(shape[1])]
        return out

    def _run(self, z: np.ndarray, weights: list[np.ndarray], target: np.ndarray | None = None):
        """What comes out, and with a target the gradient of the mean squared error in every weight."""
        steps, at, h = [], 0, z
        for kind, *size in self._layers(z.shape[1]):
            if kind == "line":
                steps.append((kind, size))
                h = np.pad(h, ((0, 0), (0, size[1] - size[0])))[:, :, None]
            elif kind in ("dense", "conv"):
                if kind == "conv":
                    p = np.pad(h, ((0, 0), (1, 1), (0, 0)))
                    h = np.concatenate([p[:, :-2], p[:, 1:-1], p[:, 2:]], axis=2)
                out = h @ weights[at] + weights[at + 1]
                on = out > 0 if kind == "conv" or size[2] else np.ones_like(out, dtype=bool)
                steps.append((kind, at, h, on))
                h, at = out * on, at + 2
            elif kind == "halve":
                pair = h.reshape(len(h), -1, 2, h.shape[2])
                first = pair[:, :, 0] >= pair[:, :, 1]
                steps.append((kind, first))
                h = np.where(first, pair[:, :, 0], pair[:, :, 1])
            elif kind == "double":
                steps.append((kind,))
                h = np.repeat(h, 2, axis=1)
            else:
                steps.append((kind, h.shape))
                h = h.reshape(len(h), -1) if kind == "flat" else h.reshape(len(h), size[0], size[1])
        if target is None:
            return h
        grads = [np.zeros_like(w) for w in weights]
        g = 2 * (h - target) / target.size
        for kind, *kept in reversed(steps):
            if kind in ("dense", "conv"):
                k, inp, on = kept
                g = g * on
                grads[k], grads[k + 1] = inp.reshape(-1, inp.shape[-1]).T @ g.reshape(-1, g.shape[-1]), g.reshape(-1, g.shape[-1]).sum(0)
                g = g @ weights[k].T
                if kind == "conv":
                    c, wide = g.shape[2] // 3, g.shape[1]
                    back = np.zeros((len(g), wide + 2, c))
                    for j in range(3):
                        back[:, j : j + wide] += g[:, :, j * c : (j + 1) * c]
                    g = back[:, 1:-1]
            elif kind == "halve":
                first = kept[0]
                g = np.stack([g * first, g * ~first], axis=2).reshape(len(g), -1, g.shape[2])
            elif kind == "double":
                g = g.reshape(len(g), -1, 2, g.shape[2]).sum(2)
            elif kind == "line":
                g = g[:, : kept[0][0], 0]
            else:
                g = g.reshape(kept[0])
        return h, grads

    def fit(self, x):
        rng = np.random.default_rng(self.seed)
        z = self.scale(x, learn=True)
        order = rng.permutation(len(z))
        held, rows = z[order[: max(1, len(z) // 10)]], z[order[max(1, len(z) // 10) :]] if len(z) > 1 else z
        weights = self._start(z.shape[1], rng)
        speed, power = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
        best, waited, turn = (np.inf, weights), 0, 0
        for _ in range(self.rounds):
            rows = rows[rng.permutation(len(rows))]
            for at in range(0, len(rows), self.batch):
                part = rows[at : at + self.batch]
                turn += 1
                for k, g in enumerate(self._run(part, weights, part)[1]):
                    speed[k] = 0.9 * speed[k] + 0.1 * g
                    power[k] = 0.999 * power[k] + 0.001 * g * g
                    weights[k] = weights[k] - self.rate * (speed[k] / (1 - 0.9**turn)) / (np.sqrt(power[k] / (1 - 0.999**turn)) + 1e-8)
            loss = float(((self._run(held, weights) - held) ** 2).mean())
            best, waited = ((loss, [w.copy() for w in weights]), 0) if loss < best[0] else (best, waited + 1)
            if waited >= self.patience:
                break
        self.loss, self.weights = best
        self.offset = float(np.percentile(self.of_scaled(z), 100 * self.contamination))
        return self

    def of_scaled(self, z):
        return -((self._run(z, self.weights) - z) ** 2).mean(1)


class Detector:
    """A forest and LOF of one table behind one call: method "isolation_forest", "lof" or "ensemble" (an anomaly where both say so, the mean of their scores)."""

    METHODS = ("isolation_forest", "lof", "ensemble")

    def __init__(self, contamination: float = 0.1, seed: int = 42):
        self.contamination, self.seed, self.both = contamination, seed, None

    def fit(self, df: DataFrame, vector_col: str = "features", id_col: str = "id") -> Detector:
        self.both = fitted(BothAgree(self.contamination, self.seed), df, vector_col, id_col)
        return self

    def predict(self, df: DataFrame, method: str = "ensemble", vector_col: str = "features") -> DataFrame:
        """df with score and is_anomaly; rows without a vector have neither."""
        if self.both is None:
            raise ValueError("a detector is fitted before it predicts")
        if method not in self.METHODS:
            raise ValueError(f"no method {method}; there are {', '.join(self.METHODS)}")
        return scored(df, dict(zip(self.METHODS, (*self.both.parts, self.both), strict=True))[method], vector_col)


def recalibrated(model: Model, x: np.ndarray) -> Model:
    """The model with its threshold, and if it has lost its scale that too, taken from x."""
    if getattr(model, "centre", None) is None:
        model.scale(x, learn=True)
    model.offset = float(np.percentile(model.score(x), 100 * model.contamination))
    return model


#: Every model by name; register() adds one.
REGISTRY: dict[str, type[Model]] = {m.name: m for m in (LocalOutlierFactor, DensityClusters, IsolationForest, OneClassMachine, BothAgree, Autoencoder)}


def register(model: type[Model]) -> type[Model]:
    if not issubclass(model, Model):
        raise TypeError("a model is a Model")
    REGISTRY[model.name] = model
    return model


def create(name: str, **options) -> Model:
    if name not in REGISTRY:
        raise ValueError(f"no model {name}; there are {sorted(REGISTRY)}")
    return REGISTRY[name](**options)


def dumps(model: Model) -> bytes:
    """A model as bytes: numbers as text, arrays as they are; no code. What was learnt from a whole table is saved by model.table.save(folder)."""
    if hasattr(model, "table"):
        raise ValueError("a model of a table is saved by its table")
    arrays: dict[str, np.ndarray] = {}

    def plain(v, path):
        if isinstance(v, np.ndarray):
            arrays[path] = v
            return {"array": path}
        if isinstance(v, Model):
            return {"model": v.name, "state": {k: plain(x, f"{path}.{k}") for k, x in v.state().items()}}
        if isinstance(v, list):
            return [plain(x, f"{path}.{k}") for k, x in enumerate(v)]
        return v.item() if isinstance(v, np.generic) else v

    told, out = json.dumps(plain(model, "m")), io.BytesIO()
    np.savez(out, told=np.frombuffer(told.encode(), dtype=np.uint8), **arrays)
    return out.getvalue()


def loads(data: bytes) -> Model:
    kept = np.load(io.BytesIO(data), allow_pickle=False)

    def back(v):
        if isinstance(v, list):
            return [back(x) for x in v]
        if isinstance(v, dict) and "array" in v:
            return kept[v["array"]]
        if isinstance(v, dict) and "model" in v:
            kind = next(c for c in (*REGISTRY.values(), WeightedVote) if c.name == v["model"])
            model = kind.__new__(kind)
            vars(model).update({k: back(x) for k, x in v["state"].items()})
            return model
        return v

    return back(json.loads(bytes(kept["told"]).decode()))


def save(model: Model, path: str | Path) -> None:
    Path(path).write_bytes(dumps(model))


def load(path: str | Path) -> Model | None:
    """The saved model; None where there is no file."""
    return loads(Path(path).read_bytes()) if Path(path).exists() else None


def inventory(folder: str | Path) -> list[dict]:
    """Each registered model: its type, whether the folder holds one, its size in kB, and its name there."""
    files = {name: Path(folder) / f"{name}.npz" for name in REGISTRY}
    return [{"model": n, "type": REGISTRY[n].__name__, "has_artifact": p.exists(), "size_kb": round(p.stat().st_size / 1024, 1) if p.exists() else 0.0, "file": p.name} for n, p in sorted(files.items())]


def sample(df: DataFrame, vector_col: str = "features", id_col: str = "id", rows: int = SAMPLE) -> np.ndarray:
    """At most `rows` vectors, those whose ids have the least hashes, in order of id; not-finite values as 0."""
    chosen = df.filter(F.col(vector_col).isNotNull()).orderBy(F.xxhash64(id_col), id_col).limit(rows).select(id_col, vector_col).toPandas().sort_values(id_col)
    return np.nan_to_num(np.array(chosen[vector_col].tolist(), dtype=float), posinf=0.0, neginf=0.0)


def fitted(model: Model, df: DataFrame, vector_col: str = "features", id_col: str = "id", rows: int = SAMPLE) -> Model:
    """The model, learnt from df: from every row where it can (`table`), an ensemble by its parts, else from a sample."""
    if isinstance(model, (BothAgree, WeightedVote)):
        model.parts = [fitted(m, df, vector_col, id_col, rows) for m in model.parts]
    elif (table := model.over_rows()) is not None:
        model.table = table.fit(df, vector_col, id_col)
    else:
        model.fit(sample(df, vector_col, id_col, min(rows, getattr(model, "most", rows))))
    return model


def fit_scored(df: DataFrame, model: Model, vector_col: str = "features", id_col: str = "id", keep: list[str] | None = None) -> DataFrame:
    """scored() of the rows that the model is fitted on here, in one go where the model can; of df's columns only `keep`, if given."""
    table = model.over_rows()
    if isinstance(table, forest.Forest):
        model.table = table
        return table.fit_score(df, vector_col, id_col, keep)
    if isinstance(table, (density.NeighbourFactor, density.ClusterDistance)):
        model.table = table
        out = table.fit_score(df, vector_col, id_col)
    else:
        out = scored(df, fitted(model, df, vector_col, id_col), vector_col)
    return out if keep is None else out.select(*keep, "score", "is_anomaly")


def fit_scored_both(df: DataFrame, factor: LocalOutlierFactor, clusters: DensityClusters, vector_col: str = "features", id_col: str = "id") -> DataFrame:
    """fit_scored() of both by one search for neighbours: df with score and is_anomaly of the factor, cluster_score and cluster_anomaly of the clusters."""
    return density.fit_score_both(df, factor.over_rows(), clusters.over_rows(), vector_col, id_col)


def scored(df: DataFrame, model: Model, vector_col: str = "features") -> DataFrame:
    """df with score and is_anomaly; rows without a vector have neither. A model of a sample is broadcast. Thresholds are the models' own
    (the cluster distance's: of all rows that are scored), also within an ensemble, so that no row's answer depends on its batch."""
    if hasattr(model, "table"):
        return model.table.score(df, vector_col)
    if isinstance(model, (BothAgree, WeightedVote)):
        columns, out = df.columns, df
        for k, part in enumerate(model.parts):
            out = scored(out, part, vector_col).withColumnsRenamed({"score": f"__score{k}", "is_anomaly": f"__odd{k}"})
        odd = [F.col(f"__odd{k}") for k in range(len(model.parts))]
        if isinstance(model, BothAgree):
            score, flag = sum((F.col(f"__score{k}") for k in range(len(odd))), F.lit(0.0)) / len(odd), reduce(and_, odd)
        else:
            score = 0.0 - sum((w * o.cast("double") for w, o in zip(model.weights, odd, strict=True)), F.lit(0.0))
            flag = -score > sum(model.weights) / 2
        return out.select(*columns, score.alias("score"), flag.alias("is_anomaly"))
    sent = df.sparkSession.sparkContext.broadcast(dumps(model))
    columns = df.columns
    at = columns.index(vector_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = loads(sent.value)
        for b in batches:
            rows = b.column(at).to_pylist()
            known = [k for k, v in enumerate(rows) if v is not None]
            score, odd = np.full(len(rows), np.nan), np.zeros(len(rows), dtype=bool)
            for k in range(0, len(known), 1024):
                part = known[k : k + 1024]
                x = np.nan_to_num(np.array([rows[i] for i in part], dtype=float), posinf=0.0, neginf=0.0)
                score[part] = own.score(x)
                odd[part] = score[part] < own.offset if hasattr(own, "offset") else own.predict(x) == -1
            missing = np.isnan(score)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score, pa.float64(), mask=missing), pa.array(odd, pa.bool_(), mask=missing)], names=[*columns, "score", "is_anomaly"])

    from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField("score", DoubleType()), StructField("is_anomaly", BooleanType())]))
