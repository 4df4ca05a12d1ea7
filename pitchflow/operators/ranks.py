"""Exact order statistics and top rows by counted histograms: no task sorts, or holds, more than a bin's rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bins of one look at an interval, and rows of a bin that are fetched instead of looked at again.
BINS, FETCHED = 1_024, 1_000


def order_statistics(df: DataFrame, group: str, value: str, ranks: Mapping[Any, Sequence[int]]) -> dict[tuple[Any, int], Any]:
    """The value of each rank (1 is the smallest) in each group asked for; null values and NaN do not count.

    All ranks are narrowed down together. A look counts the rows of each rank's interval in ``BINS`` bins and keeps the bin that holds
    the rank, with its least and largest value; equal values end the search, and so do few rows, which are fetched.
    A rank beyond the group's rows has no value and is left out.
    """
    kind = dict(df.dtypes)[value]
    rows = df.where(F.col(value).isNotNull() & (~F.isnan(value) if kind in ("double", "float") else F.lit(True))).select(F.col(group).alias("g"), F.col(value).alias("v"))
    found: dict[tuple[Any, int], Any] = {}
    ends = {r["g"]: (r["low"], r["high"], r["n"]) for r in rows.groupBy("g").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count(F.lit(1)).alias("n")).collect()}
    open_ = {(g, k): (*ends[g], 0) for g, some in ranks.items() for k in some if g in ends and 1 <= k <= ends[g][2]}
    while open_:
        for (g, k), (low, high, n, before) in list(open_.items()):
            if low == high:
                found[g, k] = low
            elif n <= FETCHED:
                found[g, k] = sorted(r["v"] for r in rows.where(F.col("g").eqNullSafe(F.lit(g)) & F.col("v").between(low, high)).select("v").collect())[k - before - 1]
            if (g, k) in found:
                del open_[g, k]
        if not open_:
            break
        looks = list(open_.items())
        places = [_place(g, low, high, i) for i, ((g, _), (low, high, *_)) in enumerate(looks)]
        bins = rows.select("v", F.explode(F.array_compact(F.array(*places))).alias("at")).groupBy("at.look", "at.bin").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect()
        for i, ((g, k), (*_, before)) in enumerate(looks):
            for r in sorted((r for r in bins if r["look"] == i), key=lambda r: r["bin"]):
                if before + r["n"] >= k:
                    open_[g, k] = r["low"], r["high"], r["n"], before
                    break
                before += r["n"]
    return found


def _place(g: Any, low: Any, high: Any, look: int) -> Column:
    """The bin of a row in the interval, null for rows that are not in it."""
    wide = (lambda x: x.cast("decimal(20,0)")) if isinstance(low, int) else (lambda x: x.cast("double") / 2)  # noqa: E731  halves do not overflow
    share = (wide(F.col("v")) - wide(F.lit(low))).cast("double") / (wide(F.lit(high)) - wide(F.lit(low))).cast("double")
    inside = F.col("g").eqNullSafe(F.lit(g)) & F.col("v").between(low, high)
    return F.when(inside, F.struct(F.lit(look).alias("look"), F.least(F.floor(share * BINS), F.lit(BINS - 1)).cast("int").alias("bin")))


def quantiles(df: DataFrame, group: str, value: str, shares: Mapping[Any, float]) -> dict[Any, float]:
    """The exact quantile of each group, between two values in proportion."""
    sizes = {r["g"]: r["n"] for r in df.where(F.col(value).isNotNull() & ~F.isnan(value)).groupBy(F.col(group).alias("g")).agg(F.count(F.lit(1)).alias("n")).collect()}
    at = {g: (sizes[g] - 1) * share for g, share in shares.items() if g in sizes}
    found = order_statistics(df, group, value, {g: sorted({int(x) + 1, min(int(x) + 2, sizes[g])}) for g, x in at.items()})
    return {g: found[g, int(x) + 1] + (x - int(x)) * (found[g, min(int(x) + 2, sizes[g])] - found[g, int(x) + 1]) for g, x in at.items()}


def top_rows(df: DataFrame, value: str, key: str, n: int) -> DataFrame:
    """The n rows of the largest values; of equal values those with the smallest keys (whole numbers)."""
    marked = df.withColumn("_all", F.lit(0))
    total = df.where(F.col(value).isNotNull()).count()
    if n >= total:
        return df.where(F.col(value).isNotNull())
    if n < 1:
        return df.limit(0)
    least = order_statistics(marked, "_all", value, {0: [total - n + 1]})[0, total - n + 1]
    above = df.where(F.col(value) > least).count()
    last = order_statistics(marked.where(F.col(value) == least), "_all", key, {0: [n - above]})[0, n - above]
    return df.where((F.col(value) > least) | (F.col(value) == least) & (F.col(key) <= last))
