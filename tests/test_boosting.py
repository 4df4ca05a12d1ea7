"""Boosted trees against hand-worked leaves and a plain exact boosting on small tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitchflow.operators import boosting, models


def plain(x, y, n_classes, rounds, depth, rate, least, penalty, alpha):
    """Margins after some rounds; splits at every value, as there are fewer than bins."""
    k = 1 if n_classes == 2 else n_classes
    margins = np.zeros((len(y), k))
    shrink = lambda g: math.copysign(max(abs(g) - alpha, 0), g)
    score = lambda g, h: shrink(g) ** 2 / (h + penalty)
    for _ in range(rounds):
        g, h = (v / boosting.UNIT for v in boosting.gradients(margins, y))
        step = np.zeros_like(margins)
        for m in range(k):

            def grow(rows, left):
                gt, ht = g[rows, m].sum(), h[rows, m].sum()
                best = None
                if left:
                    for f in range(x.shape[1]):
                        for v in sorted(set(x[rows, f]))[:-1]:
                            a = rows[x[rows, f] <= v]
                            gl, hl = g[a, m].sum(), h[a, m].sum()
                            gain = round(score(gl, hl) + score(gt - gl, ht - hl) - score(gt, ht), 9)
                            if hl >= least and ht - hl >= least and gain > boosting.LEAST_GAIN and (best is None or gain > best[0]):
                                best = gain, f, v
                if best is None:
                    step[rows, m] = -rate * shrink(gt) / (ht + penalty)
                    return
                grow(rows[x[rows, best[1]] <= best[2]], left - 1)
                grow(rows[x[rows, best[1]] > best[2]], left - 1)

            grow(np.arange(len(y)), depth)
        margins += step
    return boosting.chances(margins)


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(5)
    x = rng.integers(0, 9, (70, 3)).astype(float)
    y = ((x[:, 0] > 4) * 1 + (x[:, 1] > 5) * (x[:, 0] > 2) * 1 + (rng.random(70) < 0.1)).clip(0, 2).astype(int)
    df = spark.createDataFrame([(i, *map(float, v), float(c)) for i, (v, c) in enumerate(zip(x.tolist(), y))], "match_id long, a double, b double, c double, label double").repartition(3)
    return df, x, y


@pytest.mark.parametrize(("classes", "settings"), [(3, {}), (3, {"lambda": 0.1, "alpha": 0.7, "min_child_weight": 3, "max_depth": 2}), (2, {"lambda": 2.0, "alpha": 1.0, "learning_rate": 0.5, "max_depth": 4})])
def test_equals_plain_boosting(table, classes, settings):
    df, x, y = table
    y = y if classes == 3 else (y > 0).astype(int)
    df = df.withColumn("label", F.least("label", F.lit(float(classes - 1))))
    model = models.fit(df, ("a", "b", "c"), "extremeboosting", n_estimators=10 if not settings else 2, **settings)
    got = np.array([[r[f"p_{c}"] for c in range(classes)] for r in model.predict_proba(df).orderBy("match_id").collect()])
    s = {"max_depth": 6, "learning_rate": 0.3, "min_child_weight": 1, "lambda": 1.0, "alpha": 0.0} | settings
    want = plain(x, y, classes, 10 if not settings else 2, s["max_depth"], s["learning_rate"], s["min_child_weight"], s["lambda"], s["alpha"])
    assert np.abs(got - want).max() < 1e-6


def test_hand_worked_tree(spark):
    """Two classes, margin 0: g = 0.5 - y, h = 0.25. x <= 1 holds labels 0, 0, 1; x <= 2 of the rest 1, 1, 1; x = 3 holds 0."""
    rows = [(0, 1.0, 0.0), (1, 1.0, 0.0), (2, 1.0, 1.0), (3, 2.0, 1.0), (4, 2.0, 1.0), (5, 2.0, 1.0), (6, 3.0, 0.0)]
    df = spark.createDataFrame(rows, "match_id long, x double, label double")
    model = boosting.fit(df, ["x"], 2, models.written, n_estimators=1, max_depth=2, learning_rate=1.0, min_child_weight=0, penalty=1.0, alpha=0.0)
    # first split: left {0, 0, 1}: 0.5 ** 2 / 1.75, right: (-1) ** 2 / 2, all: 0.5 ** 2 / 2.75; or {.., 2}: 1 / 2.5 and 0.25 / 1.25
    gain = {1: 0.25 / 1.75 + 1 / 2 - 0.25 / 2.75, 2: 1 / 2.5 + 0.25 / 1.25 - 0.25 / 2.75}
    tree = model.rounds[0][0]
    assert gain[1] > gain[2] and tree[0][:3] == [0, 0, 1] and abs(tree[0][4] - gain[1]) < 1e-6
    values = sorted(round(n[3], 6) for n in tree if n[0] < 0)
    assert values == sorted(round(v, 6) for v in (-0.5 / 1.75, 1.5 / 1.75, -0.5 / 1.25))
    assert boosting.leaf_value(-1.0, 1.0, 1.0, 0.4) == 0.3 and boosting.leaf_value(0.3, 1.0, 1.0, 0.4) == 0.0


def test_every_setting_of_the_search_is_accepted_and_saved(spark, table, tmp_path):
    df, *_ = table
    chosen = {k: list(v)[-1] for k, v in models.SEARCH["extremeboosting"].items()} | {"n_estimators": 2, "max_depth": 2}
    model = models.fit(df, ("a", "b", "c"), "extremeboosting", calibrate=True, folds=2, **chosen)
    model.save(str(tmp_path / "m"))
    again = models.Classifier.load(spark, str(tmp_path / "m"))
    told = lambda m: [tuple(r) for r in m.predict_proba(df).select("match_id", "p_0", "prediction").orderBy("match_id").collect()]
    assert told(model) == told(again) and abs(sum(model.feature_importances().values()) - 1) < 1e-9
