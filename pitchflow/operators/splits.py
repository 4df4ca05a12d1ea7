"""Splits by time and cross-validation folds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _numbered(df: DataFrame, order: Sequence[str], descending: bool, name: str) -> DataFrame:
    """Places from 1 in time order. Days are counted first, so only the rows of a day are sorted together."""
    day, *ties = order
    turn = F.desc if descending else F.asc
    days = df.groupBy(day).agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy(turn(day)).rowsBetween(Window.unboundedPreceding, -1)
    offsets = days.select(F.col(day).alias("_day"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy(day).orderBy(*[turn(t) for t in ties]))
    placed = df.withColumn("_in_day", within).join(offsets, F.col(day).eqNullSafe(F.col("_day")))
    return placed.withColumn(name, F.col("_before") + F.col("_in_day")).drop("_in_day", "_day", "_before")


def placed(df: DataFrame, order: Sequence[str] = ("match_date", "home", "match_id")) -> DataFrame:
    """``df`` with ``place``: its row's place in time, from 1."""
    return _numbered(df, order, False, "place")


def holdout(df: DataFrame, size: int | float, order: Sequence[str] = ("match_date", "home", "match_id")) -> DataFrame:
    """``df`` with ``part``: 'test' for the newest rows, else 'train'. A float is a percentage, an int a count."""
    n = df.agg(F.count(F.lit(1)).alias("_n"))  # one row
    wanted = F.floor(F.col("_n") * F.lit(float(size)) / 100) if isinstance(size, float) else F.lit(size)
    placed = _numbered(df, order, True, "_place").join(F.broadcast(n), F.lit(True))
    return placed.withColumn("part", F.when(F.col("_place") <= wanted, "test").otherwise("train")).drop("_place", "_n")


def sliding_folds(df: DataFrame, k: int, test_pct: float, order: Sequence[str] = ("match_date", "home", "match_id")) -> DataFrame:
    """Rows repeated for each fold they are in, with ``fold`` (from 0) and ``part``.

    Fold i holds the oldest (i + 1) * floor(n / k) rows, of which the newest ``test_pct`` percent
    are its test rows; the newest n mod k rows are in none.
    """
    n = df.agg(F.floor(F.count(F.lit(1)) / k).alias("_m"))  # one row
    placed = _numbered(df, order, False, "_place").join(F.broadcast(n), F.lit(True))
    first = F.greatest(F.ceil(F.col("_place") / F.col("_m")) - 1, F.lit(0)).cast("int")
    dealt = placed.where((F.col("_m") > 0) & (F.col("_place") <= F.col("_m") * k)).withColumn("fold", F.explode(F.sequence(first, F.lit(k - 1))))
    total = (F.col("fold") + 1) * F.col("_m")
    is_test = F.col("_place") > total - F.floor(total * F.lit(float(test_pct)) / 100)
    return dealt.withColumn("part", F.when(is_test, "test").otherwise("train")).drop("_place", "_m")


def fold_ranges(folds: DataFrame) -> DataFrame:
    """First and last date and number of rows of each fold's parts."""
    return folds.groupBy("fold", "part").agg(F.min("match_date").alias("start_date"), F.max("match_date").alias("end_date"), F.count(F.lit(1)).alias("samples"))


def shuffled_places(df: DataFrame, label: str, key: str, name: str, seed: int = 0) -> DataFrame:
    """``df`` with ``name``: each row's place among those of its label, from 0, in an order that only key and seed decide.

    The order is cut into 1,024 slices per label, which are counted first, so no task sorts a label's rows.
    """
    shuffled = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    dealt = df.withColumn("_order", shuffled).withColumn("_slice", F.conv(F.substring("_order", 1, 3), 16, 10).cast("int") % 1024)
    counts = dealt.groupBy(F.col(label).alias("_label"), F.col("_slice").alias("_s")).agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("_label").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_label", "_s", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy(label, "_slice").orderBy("_order", key)) - 1
    out = dealt.withColumn("_place", place).join(offsets, F.col(label).eqNullSafe(F.col("_label")) & (F.col("_slice") == F.col("_s")))
    return out.withColumn(name, F.col("_before") + F.col("_place")).drop("_order", "_slice", "_place", "_label", "_s", "_before")


def stratified_folds(df: DataFrame, label: str, key: str, k: int, seed: int = 0) -> DataFrame:
    """``df`` with ``fold``: rows of each label dealt in turn in an order that only key and seed decide."""
    return shuffled_places(df, label, key, "fold", seed).withColumn("fold", F.pmod("fold", F.lit(k)).cast("int"))
