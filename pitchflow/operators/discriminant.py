"""Linear and quadratic discriminants in closed form: moments in one aggregate, small solves, scores as expressions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitchflow.operators.moments import Moments, class_moments

def oas_shrinkage(covariance: np.ndarray, n: int) -> np.ndarray:
    """The covariance shrunk towards a multiple of the identity by the oracle approximating rule."""
    d = len(covariance)
    mean, square = np.trace(covariance) / d, (covariance**2).mean()
    top = square + mean**2
    low = (n + 1) * (square - mean**2 / d)
    share = 1.0 if low == 0 else min(top / low, 1.0)
    return (1 - share) * covariance + share * mean * np.eye(d)


@dataclass
class Discriminant:
    """Per class c a score x'Ax + b'x + k; ``quadratic`` has a covariance for each class, else one is shared."""

    features: list[str]
    classes: list[float]
    square: list[list[list[float]] | None]
    linear: list[list[float]]
    constant: list[float]

    @staticmethod
    def fit(df: DataFrame, features: Sequence[str], *, label: str = "label", quadratic: bool = False, oas: bool = False) -> Discriminant:
        """Reads one row per class back, whatever the number of rows. Rows with null features or label are left out."""
        rows = class_moments(df.na.drop("any", subset=[*features, label]), features, label).collect()
        if not rows:
            raise ValueError("no rows to fit")
        return Discriminant.of(Moments.of(rows, len(features), label), features, quadratic=quadratic, oas=oas)

    @staticmethod
    def of(m: Moments, features: Sequence[str], *, quadratic: bool = False, oas: bool = False) -> Discriminant:
        n, means, covariances, total = m.n, m.mean, m.cov, m.n.sum()
        square: list[list[list[float]] | None] = []
        linear, constant = [], []
        if not quadratic:
            if oas:
                shared = sum(n[c] / total * _shrunk(covariances[c], int(n[c])) for c in range(len(n)))
            else:
                shared = (n[:, None, None] * covariances).sum(axis=0) / max(total - len(n), 1)
            inverse = np.linalg.pinv(shared)
        for c in range(len(n)):
            spread = 0.0
            if quadratic:
                own = covariances[c] * n[c] / max(n[c] - 1, 1)
                inverse = np.linalg.pinv(own)
                square.append((-inverse / 2).tolist())
                values = np.linalg.eigvalsh(own)
                spread = float(np.log(values[values > 1e-12]).sum())
            else:
                square.append(None)
            linear.append((inverse @ means[c]).tolist())
            constant.append(float(-means[c] @ inverse @ means[c] / 2 + np.log(n[c] / total) - spread / 2))
        return Discriminant(list(features), m.classes, square, linear, constant)

    def score(self, c: int, values: Sequence[Column] | None = None) -> Column:
        """Of the row's features, or of ``values`` in their stead."""
        x = list(values or [F.col(f) for f in self.features])
        terms = [F.lit(self.constant[c]), *(F.lit(w) * v for w, v in zip(self.linear[c], x, strict=True))]
        if self.square[c] is not None:
            a = self.square[c]
            terms += [F.lit(a[i][j] * (1.0 if i == j else 2.0)) * x[i] * x[j] for i in range(len(x)) for j in range(i, len(x))]
        out = terms[0]
        for t in terms[1:]:
            out = out + t
        return out

    def probabilities(self, n_classes: int, values: Sequence[Column] | None = None) -> Column:
        """Shares of the classes 0, 1, ... as an array, not yet summing to one; 0 for a class that no row had."""
        scores = {int(v): self.score(c, values) for c, v in enumerate(self.classes)}
        best = F.greatest(*scores.values()) if len(scores) > 1 else next(iter(scores.values()))
        return F.array(*[F.exp(scores[c] - best) if c in scores else F.lit(0.0) for c in range(n_classes)])


def _shrunk(covariance: np.ndarray, n: int) -> np.ndarray:
    """OAS on standardised features, then scaled back."""
    scale = np.sqrt(np.diag(covariance))
    scale[scale == 0] = 1.0
    return oas_shrinkage(covariance / np.outer(scale, scale), n) * np.outer(scale, scale)
