"""Kernel features against the kernels themselves, and Platt's curve against plain Newton steps."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitchflow.operators import kernels, models


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(0, 1, (80, 2)).round(3)
    y = (np.hypot(x[:, 0], x[:, 1]) > 1.1).astype(float)
    return spark.createDataFrame([(i, *map(float, v), float(c)) for i, (v, c) in enumerate(zip(x, y))], "match_id long, a double, b double, label double").repartition(3), x, y


@pytest.mark.parametrize("kind", kernels.KINDS)
def test_products_of_features_are_the_kernel(rows, kind):
    df, x, _ = rows
    k = kernels.Kernel.fit(df, ("a", "b"), kind, key="match_id")
    assert abs(k.gamma - 1 / (2 * x.var())) < 1e-9
    got = np.array([r[0] for r in df.orderBy("match_id").select(k.vector(("a", "b"))).collect()])
    g = k.gamma * x @ x.T
    want = {"rbf": np.exp(-k.gamma * ((x[:, None] - x[None]) ** 2).sum(axis=2)), "poly": g**3, "sigmoid": np.tanh(g)}[kind]
    if kind == "sigmoid":  # its part that is positive
        values, vectors = np.linalg.eigh(want)
        want = vectors * values.clip(0) @ vectors.T
    assert np.abs(got @ got.T - want).max() < 1e-6
    few = kernels.Kernel.fit(df, ("a", "b"), kind, key="match_id", n=20)
    assert len(few.landmarks) == 20 and len(few.weights[0]) <= 20


def test_a_ring_needs_a_kernel(rows):
    df, _, y = rows
    right = lambda **s: models.fit(df, ("a", "b"), "svm", **s).predict(df).where("prediction = label").count()
    assert right(kernel="rbf", gamma=2.0) >= 76 and right(kernel="rbf", gamma=2.0) > right(kernel="linear")


def test_machines_are_at_the_least_value(spark):
    """Of half the squared weights plus the squared shortfalls: no slope is left, for the whole and for each fold."""
    rng = np.random.default_rng(4)
    x, y, fold = rng.normal(0, 1, (60, 3)), rng.integers(0, 3, 60), np.arange(60) % 2
    weight = rng.random(60) + 0.5
    df = spark.createDataFrame([(v, int(c), float(w), int(f)) for v, c, w, f in zip(x.tolist(), y, weight, fold)], "x array<double>, label int, weight double, fold int").repartition(3)
    got = np.array(kernels.fit_machines(df, 3, 3, 2, 0.7, models.written).weights)
    ones = np.concatenate([x, np.ones((60, 1))], axis=1)
    for c in range(3):
        t = np.where(y == c, 1, -1)
        short = np.maximum(1 - t * (ones @ got[c]), 0)
        slope = got[c] * [1, 1, 1, 0] - 2 * 0.7 * (weight * t * short) @ ones
        assert np.abs(slope).max() < 1e-4


def test_platt_equals_newton(spark):
    rng = np.random.default_rng(8)
    m = rng.normal(0, 1, 200)
    hit = (rng.random(200) < 1 / (1 + np.exp(-(1.5 * m - 0.5)))).astype(float)
    df = spark.createDataFrame([(float(a), -float(a), int(b)) for a, b in zip(m, hit)], "m1 double, m0 double, label int")
    t = np.where(hit == 1, (hit.sum() + 1) / (hit.sum() + 2), 1 / (200 - hit.sum() + 2))
    x, w = np.stack([m, np.ones(200)]), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-w @ x))
        w = w + np.linalg.solve((x * (p * (1 - p))) @ x.T, x @ (t - p))
    other, own = kernels.platt(df, 2)
    assert np.abs(np.array(own) - w).max() < 1e-6 and abs(other[0] - w[0]) < 0.2
    (a, b), _ = kernels.platt(df.withColumn("label", F.lit(0)), 2)
    assert a == 0 and abs(1 / (1 + np.exp(-b)) - 201 / 202) < 1e-9
    with pytest.raises(ValueError, match="no kernel"):
        kernels.Kernel.fit(df, ("m1",), "x")
