"""Gaussian, multinomial and complement Bayes in closed form: class moments in, scores out as expressions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitchflow.operators.moments import Moments, class_moments

# Smoothing of variances (a share of the largest) and of counts.
VARIANCE_SHARE, ADDED = 1e-9, 1.0
KINDS = ("gaussian", "multinomial", "complement")


@dataclass
class Bayes:
    """Per class c the score sum_i (square_ci (x_i - centre_ci) ** 2 + linear_ci x_i) + constant_c."""

    features: list[str]
    classes: list[float]
    square: list[list[float]]
    centre: list[list[float]]
    linear: list[list[float]]
    constant: list[float]

    @staticmethod
    def fit(df: DataFrame, features: Sequence[str], *, kind: str = "gaussian", label: str = "label") -> Bayes:
        """Reads one row per class back, whatever the number of rows. Rows with null features or label are left out."""
        rows = class_moments(df.na.drop("any", subset=[*features, label]), features, label).collect()
        if not rows:
            raise ValueError("no rows to fit")
        return Bayes.of(Moments.of(rows, len(features), label), features, kind)

    @staticmethod
    def of(m: Moments, features: Sequence[str], kind: str = "gaussian") -> Bayes:
        if kind not in KINDS:
            raise ValueError(f"no algorithm {kind}")
        prior = np.log(m.n / m.n.sum())
        zeros = np.zeros_like(m.mean)
        if kind == "gaussian":
            all_mean = (m.n[:, None] * m.mean).sum(axis=0) / m.n.sum()
            var = np.array([np.diag(c) for c in m.cov])
            all_var = (m.n[:, None] * (var + (m.mean - all_mean) ** 2)).sum(axis=0) / m.n.sum()
            var = var + VARIANCE_SHARE * all_var.max()
            var[var <= 0] = np.finfo(float).tiny
            return Bayes(list(features), m.classes, (-0.5 / var).tolist(), m.mean.tolist(), zeros.tolist(), (prior - 0.5 * np.log(2 * np.pi * var).sum(axis=1)).tolist())
        if m.low.min() < 0:
            raise ValueError(f"{kind} Bayes takes no negative features")
        sums = m.n[:, None] * m.mean
        if kind == "multinomial":
            added = sums + ADDED
            weights, constant = np.log(added / added.sum(axis=1, keepdims=True)), prior
        else:
            rest = sums.sum(axis=0) - sums + ADDED
            weights, constant = -np.log(rest / rest.sum(axis=1, keepdims=True)), prior * (len(m.classes) == 1)
        return Bayes(list(features), m.classes, zeros.tolist(), zeros.tolist(), weights.tolist(), constant.tolist())

    def score(self, c: int, values: Sequence[Column] | None = None) -> Column:
        """Of the row's features, or of ``values`` in their stead."""
        out = F.lit(self.constant[c])
        for i, x in enumerate(values or [F.col(f) for f in self.features]):
            if self.square[c][i]:
                gap = x - F.lit(self.centre[c][i])
                out = out + F.lit(self.square[c][i]) * gap * gap
            if self.linear[c][i]:
                out = out + F.lit(self.linear[c][i]) * x
        return out

    def probabilities(self, n_classes: int, values: Sequence[Column] | None = None) -> Column:
        """Shares of the classes 0, 1, ... as an array, not yet summing to one; 0 for a class that no row had."""
        scores = {int(v): self.score(c, values) for c, v in enumerate(self.classes)}
        best = F.greatest(*scores.values()) if len(scores) > 1 else next(iter(scores.values()))
        return F.array(*[F.exp(scores[c] - best) if c in scores else F.lit(0.0) for c in range(n_classes)])
