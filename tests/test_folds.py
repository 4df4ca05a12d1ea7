"""One-pass cross-validation equals training fold by fold, for every closed-form classifier and scaler; Bayes in plain numpy."""

from functools import reduce

import numpy as np
import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchflow.operators import bayes, models, splits, training
from pitchflow.operators.cleaning import complete_rows
from pitchflow.plans.matches import matches

SF = "/root/testdata/sf0.001"
FEATURES = ("odd_x", "odd_2", "hc")
CASES = [
    {"algorithm": "discriminant"}, {"algorithm": "discriminant", "normalizer": None, "oas": True}, {"algorithm": "discriminant", "normalizer": "min-max", "decision_boundary": "quadratic"},
    {"algorithm": "naivebayes", "calibrate": False, "normalizer": "max-abs", "kind": "complement"}, {"algorithm": "naivebayes", "calibrate": False, "target": "over-under"},
]


@pytest.fixture(scope="module")
def table(spark):
    return matches(spark, SF).cache()


def rounded(df):
    return sorted(tuple(str(r[c]) for c in ("fold", "data", "accuracy", "f1", "precision", "recall")) for r in df.collect())


@pytest.mark.parametrize("case", CASES)
def test_one_pass_equals_fold_by_fold(table, case):
    parts = splits.sliding_folds(complete_rows(table), 3, 20.0)
    own = {"target": "result"} | case

    def fold_by_fold(parts, k):
        out = []
        for fold in range(k):
            part = lambda p: parts.where((F.col("fold") == fold) & (F.col("part") == p)).drop("fold", "part")  # noqa: B023, E731
            out.append(training.train(part("train"), part("test"), features=FEATURES, **own)[1].withColumn("fold", F.lit(fold)))
        return reduce(DataFrame.unionByName, out)

    got = training.cross_validate_sliding(table, k=3, features=FEATURES, **own)
    assert rounded(got) == rounded(fold_by_fold(parts, 3))
    dealt = splits.stratified_folds(models.targets(complete_rows(table), own["target"]), "label", "match_id", 2).drop("label")
    twice = dealt.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("f")).withColumn("part", F.when(F.col("fold") == F.col("f"), "test").otherwise("train")).drop("fold").withColumnRenamed("f", "fold")
    assert rounded(training.cross_validate(table, k=2, features=FEATURES, **own)) == rounded(fold_by_fold(twice, 2))


def test_few_exchanges(table):
    plan = training.cross_validate_sliding(table, k=3, features=FEATURES, algorithm="discriminant", normalizer=None)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") + plan.count("Exchange SinglePartition") <= 6


def test_empty_and_tiny_tables(table):
    with pytest.raises(ValueError, match="no rows"):
        training.cross_validate_sliding(table.limit(0), k=3, features=FEATURES, algorithm="discriminant")
    few = table.orderBy("match_date").limit(40)
    got = training.cross_validate_sliding(few, k=4, features=FEATURES, algorithm="discriminant", normalizer=None)
    assert {r["fold"] for r in got.collect()} == {0, 1, 2, 3}  # classes may be absent from the first folds


def test_bayes_equals_numpy(spark):
    rng = np.random.default_rng(3)
    x, y = rng.integers(0, 7, (50, 3)).astype(float), rng.integers(0, 3, 50)
    df = spark.createDataFrame([(i, *v, float(c)) for i, (v, c) in enumerate(zip(x.tolist(), y.tolist()))], "i long, a double, b double, c double, label double")
    prior = np.log(np.bincount(y) / 50)
    means, var = (np.array([getattr(x[y == c], f)(axis=0) for c in range(3)]) for f in ("mean", "var"))
    var = var + 1e-9 * x.var(axis=0).max()
    sums = np.array([x[y == c].sum(axis=0) for c in range(3)])
    rest = sums.sum(axis=0) - sums + 1
    want = {
        "gaussian": prior - 0.5 * (np.log(2 * np.pi * var).sum(axis=1) + ((x[:, None] - means) ** 2 / var).sum(axis=2)),
        "multinomial": prior + x @ np.log((sums + 1) / (sums + 1).sum(axis=1, keepdims=True)).T,
        "complement": x @ -np.log(rest / rest.sum(axis=1, keepdims=True)).T,
    }
    for kind, scores in want.items():
        model = bayes.Bayes.fit(df, ("a", "b", "c"), kind=kind)
        got = np.array(df.orderBy("i").select(*[model.score(c) for c in range(3)]).collect())
        assert np.abs(got - scores).max() < 1e-9
        told = models.fit(df, ("a", "b", "c"), "naivebayes", key="i", kind=kind).predict(df).orderBy("i").collect()
        assert [int(r["prediction"]) for r in told] == scores.argmax(axis=1).tolist()
    with pytest.raises(ValueError, match="negative"):
        bayes.Bayes.fit(df.withColumn("a", -F.col("a") - 1), ("a",), kind="multinomial")
    with pytest.raises(ValueError, match="no algorithm"):
        bayes.Bayes.fit(df, ("a",), kind="x")
