"""Moments of classes: one aggregate, merged and scaled without another look at the rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from pitchflow.operators.scaling import KINDS, Scaler


def class_moments(df: DataFrame, features: Sequence[str], label: str = "label", by: Sequence[str | Column] = ()) -> DataFrame:
    """Per class (and ``by``): count, means, population covariance of each pair of features, least and largest value, in one aggregate."""
    pairs = [(i, j) for i in range(len(features)) for j in range(i, len(features))]
    sums = [a for i, f in enumerate(features) for a in (F.avg(f).alias(f"mean_{i}"), F.min(f).alias(f"low_{i}"), F.max(f).alias(f"high_{i}"))]
    return df.groupBy(*by, label).agg(F.count(F.lit(1)).alias("n"), *sums, *[F.covar_pop(features[i], features[j]).alias(f"cov_{i}_{j}") for i, j in pairs])


@dataclass
class Moments:
    """By class, in order: rows, means, covariances, least and largest values."""

    classes: list[float]
    n: np.ndarray
    mean: np.ndarray
    cov: np.ndarray
    low: np.ndarray
    high: np.ndarray

    @staticmethod
    def of(rows: Sequence[Row], n_features: int, label: str = "label") -> Moments:
        """From the rows of ``class_moments``; several of one class are merged."""
        classes = sorted({r[label] for r in rows})
        parts = [[_one(r, n_features) for r in rows if r[label] == c] for c in classes]
        merged = [_merged(p) for p in parts]
        return Moments([float(c) for c in classes], *(np.array([m[i] for m in merged]) for i in range(5)))

    def scaler(self, features: Sequence[str], kind: str) -> Scaler:
        """What fitting a scaler on the same rows gives."""
        if kind not in KINDS:
            raise ValueError(f"no scaler {kind}")
        n, mean, cov, low, high = _merged([(self.n[c], self.mean[c], self.cov[c], self.low[c], self.high[c]) for c in range(len(self.classes))])
        shift = {"min-max": low, "max-abs": np.zeros(len(low)), "standard": mean}[kind]
        scale = {"min-max": high - low, "max-abs": np.maximum(np.abs(low), np.abs(high)), "standard": np.sqrt(np.diag(cov))}[kind]
        return Scaler(kind, dict(zip(features, shift.tolist(), strict=True)), dict(zip(features, scale.tolist(), strict=True)))

    def scaled(self, scaler: Scaler | None) -> Moments:
        """The moments of scaled rows."""
        if scaler is None:
            return self
        shift = np.array(list(scaler.shift.values()))
        scale = np.array([s or 1.0 for s in scaler.scale.values()])
        return Moments(self.classes, self.n, (self.mean - shift) / scale, self.cov / np.outer(scale, scale), (self.low - shift) / scale, (self.high - shift) / scale)


def _one(r: Row, d: int) -> tuple[float, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    cov = np.zeros((d, d))
    for i in range(d):
        for j in range(i, d):
            cov[i, j] = cov[j, i] = r[f"cov_{i}_{j}"]
    return (float(r["n"]), *(np.array([float(r[f"{x}_{i}"]) for i in range(d)]) for x in ("mean",)), cov, *(np.array([float(r[f"{x}_{i}"]) for i in range(d)]) for x in ("low", "high")))


def _merged(parts: Sequence[tuple]) -> tuple[float, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n = sum(p[0] for p in parts)
    mean = sum(p[0] * p[1] for p in parts) / n
    cov = sum(p[0] * (p[2] + np.outer(p[1] - mean, p[1] - mean)) for p in parts) / n
    return n, mean, cov, np.min([p[3] for p in parts], axis=0), np.max([p[4] for p in parts], axis=0)
