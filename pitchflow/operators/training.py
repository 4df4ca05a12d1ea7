"""Training sets, training, cross-validation and prediction."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitchflow.operators import folds, models, scaling, splits
from pitchflow.operators.cleaning import complete_rows, features_of
from pitchflow.operators.sampling import resample

# What a fixture to predict holds.
FIXTURE = ("match_date", "home", "away", "odd_1", "odd_x", "odd_2")


def preprocess(df: DataFrame, *, target: str = "result", normalizer: str | scaling.Scaler | None = None, sampler: str | None = None, features: Sequence[str] | None = None, key: str = "match_id", seed: int = 0) -> tuple[DataFrame, list[str], scaling.Scaler | None]:
    """Rows without nulls, their label, single-precision features, scaled and resampled; the features; the fitted scaler.

    A scaler's name fits it; a fitted one is only applied. Labels and features stay in one row, so
    their numbers agree.
    """
    wanted = list(features or features_of(df))
    rows = models.targets(complete_rows(df), target).withColumns({f: F.col(f).cast("float").cast("double") for f in wanted})
    scaled, scaler = scaling.scale(rows, wanted, normalizer)
    return resample(scaled, wanted, sampler, key=key, seed=seed), wanted, scaler


def check_complete(df: DataFrame) -> None:
    """One pass over the rows; any null or NaN is an error."""
    gap = F.lit(False)
    for f in df.schema:
        bad = F.col(f"`{f.name}`").isNull()
        gap = gap | (bad | F.isnan(f"`{f.name}`") if f.dataType.typeName() in ("double", "float") else bad)
    if df.agg(F.max(gap)).first()[0]:
        raise ValueError("there are nulls in the training rows; drop them first")


@dataclass
class Trained:
    """A classifier with what it needs to read rows: target, features, scaler."""

    classifier: models.Classifier
    target: str
    features: list[str]
    scaler: scaling.Scaler | None
    key: str = "match_id"

    def read(self, df: DataFrame) -> DataFrame:
        found = df.withColumns({f: F.col(f).cast("float").cast("double") for f in self.features}).na.drop("any", subset=self.features).withColumn("row_key", F.col(self.key).cast("long"))
        return self.scaler.transform(found) if self.scaler else found

    def predict(self, df: DataFrame) -> DataFrame:
        """Keys with p_0, p_1, ... and ``prediction``; rows with null features are left out."""
        return self.classifier.predict_proba(self.read(df)).drop("row_key")

    def evaluate(self, df: DataFrame, name: str) -> DataFrame:
        """accuracy, f1, precision, recall, data (``name``)."""
        rows = models.targets(complete_rows(df), self.target)
        return self.classifier.evaluate(self.read(rows)).withColumn("data", F.lit(name))


def train(train_df: DataFrame, eval_df: DataFrame | None = None, *, algorithm: str = "randomforest", target: str = "result", normalizer: str | None = "standard", sampler: str | None = None, calibrate: bool = True, features: Sequence[str] | None = None, check_nan: bool = False, key: str = "match_id", **settings: Any) -> tuple[Trained, DataFrame]:
    """A fitted model, and its metrics on the training rows and, if given, the evaluation rows."""
    if check_nan:
        check_complete(train_df)
    rows, features, scaler = preprocess(train_df, target=target, normalizer=normalizer, sampler=sampler, features=features, key=key)
    trained = Trained(models.fit(rows, features, algorithm, key=key, calibrate=calibrate, **settings), target, features, scaler, key)
    metrics = trained.evaluate(train_df, "Train")
    return trained, metrics if eval_df is None else metrics.unionByName(trained.evaluate(eval_df, "Evaluation"))


@dataclass
class _Closed:
    features: list[str]
    columns: list[Column]
    settings: dict[str, Any]


def _closed(df: DataFrame, target: str, settings: dict[str, Any]) -> _Closed | None:
    """What a cross-validation in one pass needs, if moments determine the classifier and rows are neither resampled nor calibrated."""
    chosen = {"algorithm": "randomforest", "normalizer": "standard", "sampler": None, "calibrate": True} | settings
    if chosen["algorithm"] not in folds.CLOSED or chosen["sampler"] or chosen["calibrate"] and chosen["algorithm"] != "discriminant":
        return None
    features = list(chosen.get("features") or features_of(df))
    rest = {x: v for x, v in chosen.items() if x not in ("sampler", "calibrate", "features", "target", "key", "check_nan")}
    return _Closed(features, [F.col(f).cast("float").cast("double").alias(f) for f in features], rest)


def cross_validate(df: DataFrame, *, k: int = 5, key: str = "match_id", target: str = "result", check_nan: bool = False, seed: int = 0, **settings: Any) -> DataFrame:
    """Metrics of both parts of k stratified folds, with ``fold`` from 0."""
    if check_nan:
        check_complete(df)
    dealt = splits.stratified_folds(models.targets(complete_rows(df), target), "label", key, k, seed)
    closed = _closed(df, target, settings)
    if closed is not None:
        rows = models.written(dealt.select("match_date", "label", "fold", *closed.columns))
        every = F.array(*[F.lit(i) for i in range(k)])
        told = folds.one_pass(rows.withColumnRenamed("fold", "own"), closed.features, F.col("own"), [lambda p, i=i: p != i for i in range(k)], every, lambda fold: F.col("own") == fold, **closed.settings)
        return told.drop("start_date", "end_date", "samples")
    dealt = dealt.drop("label")
    out = []
    for fold in range(k):
        _, metrics = train(dealt.where(F.col("fold") != fold).drop("fold"), dealt.where(F.col("fold") == fold).drop("fold"), target=target, key=key, **settings)
        out.append(metrics.withColumn("fold", F.lit(fold)))
    return reduce(DataFrame.unionByName, out)


def cross_validate_sliding(df: DataFrame, *, k: int = 5, test_pct: float = 20.0, key: str = "match_id", check_nan: bool = False, **settings: Any) -> DataFrame:
    """Metrics of both parts of k growing folds, with ``fold``, first and last date and number of rows."""
    if check_nan:
        check_complete(df)
    closed = _closed(df, settings.get("target", "result"), settings)
    if closed is not None:
        placed = splits.placed(models.targets(complete_rows(df), settings.get("target", "result")))
        rows = models.written(placed.select("match_date", "label", "place", *closed.columns))
        m = rows.count() // k
        train_ends = [(i + 1) * m - math.floor((i + 1) * m * test_pct / 100) for i in range(k)]
        # between two edges rows are alike: they train the same folds
        edges = sorted({*train_ends, *((i + 1) * m for i in range(k))})
        part, first, train_end = F.lit(None).cast("int"), F.lit(None).cast("int"), F.lit(0)
        for edge in reversed(edges):
            part = F.when(F.col("place") <= edge, edge).otherwise(part)
        for i in reversed(range(k)):
            first = F.when(F.col("place") <= (i + 1) * m, i).otherwise(first)
        for i, end in enumerate(train_ends):
            train_end = F.when(F.col("fold") == i, end).otherwise(train_end)
        used = rows.where(F.col("place") <= k * m)
        return folds.one_pass(used, closed.features, part, [lambda p, end=end: p <= end for end in train_ends], F.sequence(first, F.lit(k - 1)), lambda fold: F.col("place") > train_end, **closed.settings)
    dealt = splits.sliding_folds(complete_rows(df), k, test_pct)
    ranges = splits.fold_ranges(dealt).withColumn("data", F.when(F.col("part") == "train", "Train").otherwise("Evaluation")).drop("part")
    out = []
    for fold in range(k):
        part = lambda p: dealt.where((F.col("fold") == fold) & (F.col("part") == p)).drop("fold", "part")  # noqa: B023, E731
        _, metrics = train(part("train"), part("test"), key=key, **settings)
        out.append(metrics.withColumn("fold", F.lit(fold)))
    return reduce(DataFrame.unionByName, out).join(ranges, ["fold", "data"])


def check_fixture(fixtures: DataFrame, *, one_row: bool = False) -> None:
    """The columns that a prediction needs; with ``one_row`` exactly one row."""
    missing = [c for c in FIXTURE if c not in fixtures.columns]
    if missing:
        raise ValueError(f"fixtures lack {missing}")
    if one_row and len(fixtures.limit(2).collect()) != 1:
        raise ValueError("exactly one fixture is needed")


def as_features(fixtures: DataFrame, schema: DataFrame, fill: float = 0.0) -> DataFrame:
    """``fixtures`` with all columns of ``schema``: missing ones are added as null, then null numbers become ``fill``."""
    have = {c.lower() for c in fixtures.columns}
    added = fixtures.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in schema.schema if f.name.lower() not in have])
    return added.na.fill(fill)


def with_config(trained: Trained, **changes: Any) -> Trained:
    """The same model under a configuration with changes."""
    return replace(trained, classifier=replace(trained.classifier, config=trained.classifier.config | changes))
