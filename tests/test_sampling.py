"""Order statistics against sorting, and the samplers' rows against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitchflow.operators import models, neighbours, ranks, sampling

X = ("a", "b")


@pytest.mark.parametrize(("bins", "fetched"), [(1_024, 1_000), (3, 1), (2, 0)])
def test_order_statistics_equal_sorting(spark, monkeypatch, bins, fetched):
    monkeypatch.setattr(ranks, "BINS", bins)
    monkeypatch.setattr(ranks, "FETCHED", fetched)
    rnd = random.Random(bins)
    values = {"x": [rnd.choice([0.0, -1.5, 1e-300, 1e300, -1e300, rnd.random()]) for _ in range(60)], "y": [7.0] * 20, None: [rnd.gauss(0, 1) for _ in range(15)]}
    rows = [(g, v, rnd.randint(-(2**60), 2**60)) for g, vs in values.items() for v in vs] + [("x", None, 1), ("y", float("nan"), 1)]
    df = spark.createDataFrame(rows, "g string, v double, k long").repartition(3)
    asked = {"x": [1, 17, 60, 61], "y": [1, 20], None: [8], "z": [1]}
    got = ranks.order_statistics(df, "g", "v", asked)
    assert got == {(g, k): sorted(values[g])[k - 1] for g, ks in asked.items() if g in values for k in ks if k <= len(values[g])}
    assert ranks.order_statistics(df, "g", "k", {"x": [5]}) == {("x", 5): sorted(k for g, _, k in rows if g == "x")[4]}
    assert abs(ranks.quantiles(df, "g", "v", {None: 0.37})[None] - np.percentile(values[None], 37)) < 1e-12
    top = [r["k"] for r in ranks.top_rows(df.where("g = 'x'"), "v", "k", 25).collect()]
    assert sorted(top) == sorted(k for _, _, k in sorted((r for r in rows if r[0] == "x" and r[1] is not None), key=lambda r: (-r[1], r[2]))[:25])
    assert ranks.top_rows(df, "v", "k", 0).count() == 0


@pytest.fixture(scope="module")
def points(spark):
    rng, rows = np.random.default_rng(2), []
    for c, (n, at) in enumerate(((50, (0, 0)), (30, (3, 0)), (12, (0, 3)))):
        rows += [(len(rows) + i, *map(float, rng.normal(at, 0.9)), float(c), "t") for i in range(n)]
    return spark.createDataFrame(rows, "match_id long, a double, b double, label double, note string").repartition(2).cache()


def test_made_rows_lie_between_neighbours_and_reruns_agree(points):
    made = sampling.svm_smote(points, X)
    assert sampling.class_counts(made) == {0.0: 50, 1.0: 50, 2.0: 50} and made.select("match_id").distinct().count() == 150
    again = sampling.svm_smote(points.repartition(5), X)
    new = lambda df: sorted((r["match_id"], r["a"], r["b"], r["label"]) for r in df.where("match_id < 0").collect())
    assert [tuple(round(x, 9) for x in r) for r in new(made)] == [tuple(round(x, 9) for x in r) for r in new(again)]
    old = {}
    for r in points.collect():
        old.setdefault(r["label"], []).append(np.array([r["a"], r["b"]]))
    for _, a, b, label in new(made):
        p, own = np.array([a, b]), old[label]
        near = {i: sorted((j for j in range(len(own)) if j != i), key=lambda j: np.linalg.norm(own[i] - own[j]))[:5] for i in range(len(own))}
        gap = min(abs(np.linalg.norm(own[i] - p) + np.linalg.norm(p - own[j]) - np.linalg.norm(own[i] - own[j])) for i in near for j in near[i])
        assert gap < 1e-9
    assert made.where("match_id < 0 and note is not null").isEmpty()


def test_hardness_limits_are_the_quantiles(points):
    kept = sampling.instance_hardness(points, X, folds=2, n_estimators=3)
    counts = sampling.class_counts(kept)
    assert counts[2.0] == 12 and 12 <= counts[0.0] < 50 and 12 <= counts[1.0] <= 30
    assert sampling.class_counts(sampling.instance_hardness(points.where("label = 1"), X)) == {1.0: 30}


def test_near_miss_equals_brute_force(points):
    rows = [(r["match_id"], np.array([r["a"], r["b"]]), r["label"]) for r in points.collect()]
    want = {i for i, _, c in rows if c == 2}
    small = [(i, x) for i, x, c in rows if c == 2]
    d = lambda x, y: float(neighbours._distances(x[None], y[None], 2)[0, 0])
    for c in (0, 1):
        mine = [(i, x) for i, x, k in rows if k == c]
        met = {i for _, s in small for i, _ in sorted(mine, key=lambda m: (d(s, m[1]), m[0]))[:5]}
        far = sorted((-np.mean(sorted(d(x, s) for _, s in small)[:5]), i) for i, x in mine if i in met)
        want |= {i for _, i in far[:12]}
    assert {r["match_id"] for r in sampling.near_miss(points, X).collect()} == want
    assert models.class_weights(points).select(F.sum("weight")).first()[0] == pytest.approx(92.0)
