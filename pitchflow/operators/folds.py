"""Cross-validation of closed-form classifiers in one pass: moments of slices, fitted per fold, all folds scored at once."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from pitchflow.operators.bayes import Bayes
from pitchflow.operators.discriminant import Discriminant
from pitchflow.operators.metrics import metrics_of_counts
from pitchflow.operators.moments import Moments, class_moments
from pitchflow.operators.scaling import Scaler

#: Classifiers that moments of the classes determine.
CLOSED = ("discriminant", "naivebayes")
Closed = Discriminant | Bayes


def _fitted(rows: Sequence[Row], features: Sequence[str], algorithm: str, normalizer: str | None, settings: dict[str, Any]) -> tuple[Closed, Scaler | None]:
    m = Moments.of(rows, len(features))
    scaler = m.scaler(features, normalizer) if normalizer else None
    if algorithm == "naivebayes":
        return Bayes.of(m.scaled(scaler), features, settings.get("kind", "gaussian")), scaler
    return Discriminant.of(m.scaled(scaler), features, quadratic=settings.get("decision_boundary", "linear") == "quadratic", oas=settings.get("oas", False)), scaler


def _said(model: Closed, scaler: Scaler | None, n_classes: int) -> Column:
    """The likeliest class of a row, the first of equals."""
    values = [F.col(f) for f in model.features]
    if scaler is not None:
        values = [(v - F.lit(scaler.shift[f])) / F.lit(scaler.scale[f] or 1.0) for f, v in zip(model.features, values, strict=True)]
    shares = model.probabilities(n_classes, values)
    return (F.array_position(shares, F.array_max(shares)) - 1).cast("double")


def one_pass(rows: DataFrame, features: Sequence[str], part: Column, trains: Sequence[Callable[[int], bool]], folds_of: Column, is_test: Callable[[Column], Column], *, algorithm: str, normalizer: str | None = None, **settings: Any) -> DataFrame:
    """``fold``, ``data``, the metrics, first and last date and number of rows of both parts of every fold.

    ``rows`` (a table that is cheap to read twice) has ``label`` and the features as doubles. ``part``: the slice of a row; ``trains[i]``: whether fold i
    trains on a slice. One aggregate gives the moments of every slice and class, a row for each to the driver; a fold's are merged from
    its slices. ``folds_of``: the folds of a row, for all of which it is scored at once; ``is_test``: whether it is held out of one.
    """
    found = class_moments(rows.withColumn("part", part), features, by=["part"]).collect()
    if not found:
        raise ValueError("no rows to fit")
    n_classes = max(int(max(r["label"] for r in found)) + 1, 2)
    said = F.lit(None).cast("double")
    for i, trained in enumerate(trains):
        own = [r for r in found if trained(r["part"])]
        if own:
            said = F.when(F.col("fold") == i, _said(*_fitted(own, features, algorithm, normalizer, settings), n_classes)).otherwise(said)
    each = rows.select("*", F.explode(folds_of).alias("fold"))
    scored = each.select("fold", F.when(is_test(F.col("fold")), "Evaluation").otherwise("Train").alias("data"), "match_date", "label", said.alias("prediction"))
    counts = scored.groupBy("fold", "data", "label", "prediction").agg(F.count(F.lit(1)).alias("n"), F.min("match_date").alias("first"), F.max("match_date").alias("last"))
    ranges = counts.groupBy("fold", "data").agg(F.collect_list(F.struct("label", "prediction", "n")).alias("cells"), F.min("first").alias("start_date"), F.max("last").alias("end_date"), F.sum("n").alias("samples"))
    told = metrics_of_counts(ranges.select("fold", "data", "start_date", "end_date", "samples", F.inline("cells")), "fold", "data", "start_date", "end_date", "samples")
    out = told.select("accuracy", "f1", "precision", "recall", "data", "fold", "start_date", "end_date", "samples")
    return out.coalesce(1).sortWithinPartitions("fold", F.desc("data"))  # two rows for each fold
