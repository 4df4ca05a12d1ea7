"""Kernels by landmarks (Nystroem): explicit features whose products come near a kernel's, support-vector machines by Newton steps, and Platt scaling of their margins."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that serve as landmarks, a stated sample: the first by a hash of their key.
LANDMARKS = 200
KINDS = ("rbf", "poly", "sigmoid")
#: Directions of the landmarks with less than this share of the largest's weight are left out.
LEAST_WEIGHT = 1e-10
#: Tasks whose sums meet in a Newton step, and numbers of a sum that travel together.
TASKS, WIDTH = 256, 4_096


@dataclass
class Kernel:
    """``kind`` of kernel, its landmarks, and the matrix that makes the products of features equal the kernel among landmarks."""

    kind: str
    degree: int
    gamma: float
    landmarks: list[list[float]]
    weights: list[list[float]]

    @staticmethod
    def fit(df: DataFrame, features: Sequence[str], kind: str, *, degree: int = 3, gamma: float | None = None, key: str = "row_key", n: int = LANDMARKS) -> Kernel:
        """``gamma`` defaults to 1 / (features * variance of all their numbers). Rows that repeat are one landmark."""
        if kind not in KINDS:
            raise ValueError(f"no kernel {kind}")
        x = F.array(*[F.col(f).cast("double") for f in features])
        if gamma is None:
            numbers = df.select(F.explode(x).alias("v")).agg(F.var_pop("v")).first()[0]
            gamma = 1.0 / (len(features) * numbers) if numbers else 1.0
        chosen = df.select(x.alias("x"), F.xxhash64(F.col(key)).alias("h"), F.col(key).alias("k")).orderBy("h", "k").limit(n).collect()
        landmarks = np.unique(np.array([r["x"] for r in chosen]), axis=0)
        own = Kernel(kind, degree, gamma, landmarks.tolist(), [])
        values, vectors = np.linalg.eigh(own.products(landmarks, landmarks))
        keep = values > LEAST_WEIGHT * max(values.max(), 0.0)
        if not keep.any():
            raise ValueError(f"the {kind} kernel is not positive on any direction of the landmarks")
        own.weights = (vectors[:, keep] / np.sqrt(values[keep])).tolist()
        return own

    def products(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if self.kind == "rbf":
            return np.exp(-self.gamma * ((a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1)[None, :] - 2 * a @ b.T).clip(0))
        return (self.gamma * a @ b.T) ** self.degree if self.kind == "poly" else np.tanh(self.gamma * a @ b.T)

    def vector(self, features: Sequence[str]) -> Column:
        """A row's kernel features."""

        @F.pandas_udf("array<double>")
        def made(x: pd.Series) -> pd.Series:
            if not len(x):
                return pd.Series([], dtype=object)
            return pd.Series(list(self.products(np.stack(x.to_numpy()), np.array(self.landmarks)) @ np.array(self.weights)), dtype=object)

        return made(F.array(*[F.col(f).cast("double") for f in features]))


# ---------------------------------------------------------------- machines


@dataclass
class Machines:
    """One machine for each class: the weights of the features and, last, of a constant 1; and the curve of each margin."""

    weights: list[list[float]]
    curves: list[list[float]]

    def chances(self, vector: Column) -> Column:
        margins = [margin(vector, w) for w in self.weights]
        return F.array(*[F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.lit(a) * m + F.lit(b)))) for m, (a, b) in zip(margins, self.curves, strict=True)])


def margin(vector: Column, weights: Sequence[float]) -> Column:
    return F.aggregate(F.zip_with(vector, F.array(*[F.lit(w) for w in weights[:-1]]), lambda x, w: x * w), F.lit(weights[-1]), lambda s, x: s + x)


def fit_machines(rows: DataFrame, n_features: int, n_classes: int, folds: int, cost: float, write: Callable[[DataFrame], DataFrame], *, most: int = 40) -> Machines:
    """Fits on ``x`` (array), ``label``, ``weight``, ``fold``: for each class, and for each fold left out, half the square of the weights plus ``cost`` times the squared shortfalls.

    All machines take each Newton step together: one pass sums their values, slopes and curvatures, and the driver solves for each as many
    equations as there are features. A step that does not lower the value is halved. The curves are
    fitted on the margins of the folds that a machine has not seen; a class that is missing from the rest keeps the whole's margins.
    """
    d, n = n_features + 1, n_classes * (folds + 1)
    tasks = rows.coalesce(TASKS)  # bounds the sums that meet
    now, best, value = np.zeros((n, d)), np.zeros((n, d)), np.full(n, np.inf)
    ridge = np.ones(d)
    ridge[-1] = 1e-9
    open_ = np.ones(n, bool)
    for _ in range(most):
        sums = _sums(tasks, now, n_classes, folds, cost, np.flatnonzero(open_))
        for m in np.flatnonzero(open_):
            total = sums.get(int(m), np.zeros(d * d + d + 1))
            found = total[-1] + (ridge * now[m] ** 2).sum() / 2
            if found > value[m] * (1 + 1e-12) and np.abs(now[m] - best[m]).max() > 1e-9:
                now[m] = (now[m] + best[m]) / 2
                continue
            slope = total[d * d : -1] + ridge * now[m]
            step = np.linalg.solve(total[: d * d].reshape(d, d) + np.diag(ridge), slope)
            open_[m] = np.abs(step).max() > 1e-6 * max(1.0, np.abs(now[m]).max())
            best[m], value[m] = now[m], found
            now[m] = now[m] - step if open_[m] else now[m]
        if not open_.any():
            break
    by = best.reshape(folds + 1, n_classes, d)
    counts = {(r["fold"], int(r["label"])) for r in rows.select("fold", "label").distinct().collect()}
    told = []
    for c in range(n_classes):
        m = margin(F.col("x"), by[0, c].tolist())
        for fold in range(folds):
            if any(k == c and f != fold for f, k in counts):
                m = F.when(F.col("fold") == fold, margin(F.col("x"), by[fold + 1, c].tolist())).otherwise(m)
        told.append(m.alias(f"m{c}"))
    margins = write(rows.select("label", *told))
    return Machines(by[0].tolist(), platt(margins, n_classes))


def _sums(rows: DataFrame, weights: np.ndarray, n_classes: int, folds: int, cost: float, open_: np.ndarray) -> dict[int, np.ndarray]:
    """For each open machine curvature, slope and value of its errors."""
    d = weights.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(open_), d * d + d + 1))
        for batch in batches:
            x = batch.column(0).flatten().to_numpy().reshape(batch.num_rows, d - 1)
            x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
            label, weight, fold = (batch.column(i).to_numpy() for i in (1, 2, 3))
            for i, m in enumerate(open_.tolist()):
                left_out, c = m // n_classes - 1, m % n_classes
                y = np.where(label == c, 1.0, -1.0)
                short = 1 - y * (x @ weights[m])
                used = (short > 0) & (fold != left_out)
                xs, ys, ss, ws = x[used], y[used], short[used], weight[used] * cost
                total[i, : d * d] += ((xs * (2 * ws)[:, None]).T @ xs).ravel()
                total[i, d * d : -1] -= (2 * ws * ys * ss) @ xs
                total[i, -1] += (ws * ss**2).sum()
        for i, m in enumerate(open_.tolist()):
            for at in range(0, total.shape[1], WIDTH):
                part = total[i, at : at + WIDTH]
                yield pa.RecordBatch.from_arrays([pa.array([m], pa.int32()), pa.array([at], pa.int32()), pa.array([part.tolist()], pa.list_(pa.float64()))], names=["m", "at", "v"])

    sent = rows.select("x", "label", "weight", "fold").mapInArrow(run, "m int, at int, v array<double>")

    def added(table: pa.Table) -> pa.Table:
        v = np.sum([x for x in table.column("v").to_pylist()], axis=0)
        return pa.table({"m": table.column("m").slice(0, 1), "at": table.column("at").slice(0, 1), "v": pa.array([v.tolist()], pa.list_(pa.float64()))})

    out: dict[int, np.ndarray] = {}
    for r in sent.groupBy("m", "at").applyInArrow(added, "m int, at int, v array<double>").collect():
        out.setdefault(r["m"], np.zeros(d * d + d + 1))[r["at"] : r["at"] + len(r["v"])] = r["v"]
    return out


def platt(margins: DataFrame, n_classes: int, most: int = 50) -> list[list[float]]:
    """a and b of the chance 1 / (1 + exp(-(a margin + b))) of each class, by Newton steps towards Platt's targets, which stay off 0 and 1.

    ``margins``: ``label`` and m0, m1, ... A step is one aggregate for all classes. A class that all rows, or none, belong to gets a constant chance.
    """
    first = margins.agg(F.count(F.lit(1)).alias("n"), *[F.sum((F.col("label") == c).cast("double")).alias(f"y{c}") for c in range(n_classes)]).first()
    targets, curves, open_ = [], np.zeros((n_classes, 2)), []
    for c in range(n_classes):
        yes, no = first[f"y{c}"] or 0.0, first["n"] - (first[f"y{c}"] or 0.0)
        high, low = (yes + 1) / (yes + 2), 1 / (no + 2)
        targets.append(F.when(F.col("label") == c, high).otherwise(low))
        if yes and no:
            open_.append(c)
        else:
            curves[c, 1] = np.log((high if yes else low) / (1 - (high if yes else low)))
    for _ in range(most):
        if not open_:
            break
        sums = []
        for c in open_:
            m = F.col(f"m{c}")
            p = F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.lit(float(curves[c, 0])) * m + F.lit(float(curves[c, 1])))))
            w = p * (1 - p)
            sums += [F.sum(x).alias(f"{k}{c}") for k, x in (("aa", w * m * m), ("ab", w * m), ("bb", w), ("a", (targets[c] - p) * m), ("b", targets[c] - p))]
        r = margins.agg(*sums).first()
        for c in list(open_):
            h = np.array([[r[f"aa{c}"], r[f"ab{c}"]], [r[f"ab{c}"], r[f"bb{c}"]]]) + 1e-12 * np.eye(2)
            step = np.linalg.solve(h, [r[f"a{c}"], r[f"b{c}"]])
            step *= min(1.0, 5.0 / max(np.abs(step).max(), 1e-300))  # far from the top a curve is flat
            curves[c] += step
            if np.abs(step).max() < 1e-9:
                open_.remove(c)
    return curves.tolist()
