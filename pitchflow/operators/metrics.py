"""Classification metrics from a confusion matrix."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchflow.functions.columns import round_even


def confusion(df: DataFrame, label: str, prediction: str) -> DataFrame:
    return df.groupBy(F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(F.count(F.lit(1)).alias("n"))


def classification_metrics(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """One row: accuracy and macro f1, precision, recall over labels that are true or predicted.

    Division by zero gives 0; three decimals, half to even; no rows give four zeros. Only counts
    per pair of labels are shuffled.
    """
    return _scores(confusion(df, label, prediction)).select("accuracy", "f1", "precision", "recall")


def metrics_of_counts(counts: DataFrame, *by: str) -> DataFrame:
    """The same for each group of a table of ``label``, ``prediction``, ``n``."""
    return _scores(counts, *by)


def _scores(counts: DataFrame, *by: str) -> DataFrame:
    sides = counts.select(*by, F.explode(F.array(F.struct(F.col("label").alias("c"), F.col("n").alias("true_n"), F.lit(0).alias("said_n"), F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0).alias("hit")), F.struct(F.col("prediction").alias("c"), F.lit(0).cast("long").alias("true_n"), F.col("n").cast("int").alias("said_n"), F.lit(0).cast("long").alias("hit")))).alias("x")).select(*by, "x.*")
    classes = sides.groupBy(*by, "c").agg(F.sum("true_n").alias("t"), F.sum("said_n").alias("s"), F.sum("hit").alias("hit"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    scored = classes.select(*by, "t", "hit", ratio(F.col("hit"), F.col("s")).alias("p"), ratio(F.col("hit"), F.col("t")).alias("r"), ratio(2 * F.col("hit"), F.col("s") + F.col("t")).alias("f"))
    value = lambda x: round_even(F.coalesce(x, F.lit(0.0)), 3)
    return scored.groupBy(*by).agg(value(F.sum("hit").cast("double") / F.sum("t")).alias("accuracy"), value(F.avg("f")).alias("f1"), value(F.avg("p")).alias("precision"), value(F.avg("r")).alias("recall"))
