"""Cleaning and validation of raw season tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pitchflow.functions.columns import over_under, parse_match_date, parse_season

# Columns of the two raw layouts, and their names in the match table.
MAIN_COLUMNS = {
    "Date": "match_date", "Season": "season", "HomeTeam": "home", "AwayTeam": "away", "FTHG": "hg", "FTAG": "ag", "FTR": "result",
    "AvgH": "odd_1", "AvgD": "odd_x", "AvgA": "odd_2", "HST": "hst", "AST": "ast", "HC": "hc", "AC": "ac",
}
EXTRA_COLUMNS = {
    "Date": "match_date", "Season": "season", "Home": "home", "Away": "away", "HG": "hg", "AG": "ag", "Res": "result",
    "AvgCH": "odd_1", "AvgCD": "odd_x", "AvgCA": "odd_2",
}
BASE = ("match_date", "season", "home", "away", "hg", "ag", "result", "odd_1", "odd_x", "odd_2")
EXTENDED = ("hst", "ast", "hc", "ac")
#: Not features: identity, outcome, and what is known only after the match.
NOT_FEATURES = ("match_id", "match_date", "season", "home", "away", "hg", "ag", "result", "result_uo", "hst", "ast", "hc", "ac")


def odds_fallback(df: DataFrame, trigger: str, odds: Sequence[str], spare: Sequence[str]) -> DataFrame:
    """Where ``trigger`` is null every odd is replaced by its spare, also those that are not null."""
    missing = F.col(f"`{trigger}`").isNull()
    return df.withColumns({o: F.when(missing, F.col(f"`{s}`")).otherwise(F.col(f"`{o}`")) for o, s in zip(odds, spare, strict=True)})


def project(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.select(*[F.col(f"`{old}`").alias(new) for old, new in columns.items()])


def from_main(raw: DataFrame) -> DataFrame:
    """Match columns of a main league's seasons; ``Season`` is a whole number."""
    return project(odds_fallback(raw, "AvgH", ("AvgH", "AvgD", "AvgA"), ("B365H", "B365D", "B365A")), MAIN_COLUMNS)


def from_extra(raw: DataFrame, start_year: int) -> DataFrame:
    """Match columns of an extra league from ``start_year`` on; ``Season`` may be text."""
    season = F.col("Season") if raw.schema["Season"].dataType.typeName() != "string" else parse_season(F.col("Season"))
    return project(raw.withColumn("Season", season), EXTRA_COLUMNS).where(F.col("season") >= start_year)


def check_columns(df: DataFrame, expected: Sequence[str]) -> None:
    if list(df.columns) != list(expected):
        raise ValueError(f"columns {df.columns} are not {list(expected)}")


def check_values(df: DataFrame, start_year: int, *, known_results_only: bool = False) -> None:
    """One pass: the first season, and at most three different results (nulls count as one)."""
    seen = df.agg(F.min("season").alias("first"), F.countDistinct("result").alias("n"), F.max(F.col("result").isNull()).alias("gap"), F.max(~F.col("result").isin("H", "D", "A")).alias("odd")).first()
    if seen["first"] is not None and seen["first"] < start_year:
        raise ValueError(f"season {seen['first']} is before {start_year}")
    if seen["n"] + bool(seen["gap"]) > 3 or known_results_only and seen["odd"]:
        raise ValueError("unexpected results")


def week(partition: Sequence[str] = ("season", "home")) -> Column:
    """The home team's n-th home match of the season."""
    return F.row_number().over(Window.partitionBy(*partition).orderBy("match_date", "home", "match_id"))


def row_key(columns: Sequence[str]) -> Column:
    """A number of 60 bits that the values decide; nulls have a mark of their own. Equal rows have equal keys."""
    text = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x1e")) for c in columns])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def clean(df: DataFrame, start_year: int, *, extended: bool = False, validate: bool = True) -> DataFrame:
    """Raw match columns -> match table: null rows out, dates parsed, repeated rows merged, derived columns added."""
    columns = [*BASE, *(EXTENDED if extended else ())]
    check_columns(df, columns)
    found = df.where(F.col("match_date").isNotNull() & F.col("result").isNotNull())
    if validate:
        check_values(found, start_year)
    if df.schema["match_date"].dataType.typeName() == "string":
        found = found.withColumn("match_date", parse_match_date(F.col("match_date")))
    found = found.dropDuplicates(columns)
    keyed = found.withColumn("match_id", row_key(columns))
    uo = over_under(F.col("hg"), F.col("ag")).alias("result_uo")
    at = columns.index("result") + 1
    return keyed.withColumn("week", week()).select("match_id", *columns[:at], uo, *columns[at:], "week")


def odds_between(df: DataFrame, **ranges: tuple[float | None, float | None]) -> DataFrame:
    """Rows whose odds are in all ranges given; null odds fail a range. Belongs after the statistics."""
    for name, (low, high) in ranges.items():
        if low is not None:
            df = df.where(F.col(name) >= low)
        if high is not None:
            df = df.where(F.col(name) <= high)
    return df


def features_of(df: DataFrame, *, with_week: bool = False) -> list[str]:
    out = {*NOT_FEATURES, *(() if with_week else ("week",))}
    return [c for c in df.columns if c not in out]


def complete_rows(df: DataFrame) -> DataFrame:
    return df.na.drop("any")


def merge_seasons(history: DataFrame, fresh: DataFrame) -> DataFrame:
    """Fresh seasons replace the newest stored season and later ones; ``history`` keeps what is before."""
    newest = history.agg(F.max("season").alias("newest"))
    old = history.join(F.broadcast(newest), F.col("season") < F.col("newest")).drop("newest")  # newest is one row
    return old.unionByName(fresh, allowMissingColumns=True)
