"""Look-ups: latest form for fixtures, similar names."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType
from pyspark.sql.window import Window

from pitchflow.functions.columns import country_key

_NEWEST = ("match_date", "home", "match_id")


def latest_form(history: DataFrame, fixtures: DataFrame, *, recompute_differences: bool = False, as_of: bool = False) -> DataFrame:
    """Fixtures with the form of both teams: that of the home team's last complete home match, and the
    away team's last complete away match.

    Statistics named h... come from the home team's row and a... from the away team's. ``season``
    and ``week`` follow the newest row of all. ``fixtures``: fixture_id, match_date, home, away and
    odds. A team without a row gives nulls. With ``as_of`` only rows before the fixture's date
    count, found in the fixture's year, or else carried over from the years before, so a team's history is never in one task. Otherwise the latest rows are one
    per team, found by an aggregate that combines before it shuffles.
    """
    done = history.na.drop("any")
    copied = {r: [c for c in history.columns if c.startswith(r[0]) and c not in ("home", "away", "hg", "ag", "hst", "ast", "hc", "ac")] for r in ("home", "away")}
    out = fixtures
    for role in ("home", "away"):
        columns = copied[role]
        newest = F.max_by(F.struct(*columns), F.struct(*_NEWEST)).alias("row")
        if as_of:
            rows = _before(done, fixtures, role, columns)
            out = out.join(rows, "fixture_id", "left").select(*out.columns, *[F.col(f"row.{c}").alias(c) for c in columns])
        else:
            rows = done.groupBy(F.col(role).alias("team")).agg(newest)
            out = out.join(rows, F.col(role) == F.col("team"), "left").select(*out.columns, *[F.col(f"row.{c}").alias(c) for c in columns])
    last = done.agg(F.max_by(F.struct("season", "week"), F.struct(*_NEWEST)).alias("last"))
    out = out.join(F.broadcast(last), how="left", on=F.lit(True))  # one row
    out = out.withColumn("season", F.col("last.season")).withColumn("week", F.col("last.week") + 1).drop("last")
    if recompute_differences:
        for name, (a, b) in {"hagf": ("hgf", "agf"), "haga": ("hga", "aga"), "hagd": ("hgd", "agd"), "hawgd": ("hwgd", "awgd"), "halgd": ("hlgd", "algd")}.items():
            if {name, a, b} <= set(out.columns):
                out = out.withColumn(name, F.col(a) - F.col(b))
    return out


def _before(history: DataFrame, fixtures: DataFrame, role: str, columns: list[str]) -> DataFrame:
    """``fixture_id``, ``row``: the team's last row before the day of each fixture, by day, home team and key."""
    row = F.struct(*[F.col(c) for c in columns])
    past = history.select(F.col(role).alias("team"), F.year("match_date").alias("year"), F.col("match_date").alias("day"), F.lit(1).alias("turn"), "home", F.col("match_id").alias("tie"), row.alias("row"), F.lit(None).cast(fixtures.schema["fixture_id"].dataType).alias("fixture_id"))
    asked = fixtures.select(F.col(role).alias("team"), F.year("match_date").alias("year"), F.col("match_date").alias("day"), F.lit(0).alias("turn"), "home", F.lit(None).cast(history.schema["match_id"].dataType).alias("tie"), F.lit(None).cast(past.schema["row"].dataType).alias("row"), "fixture_id")
    # within a year: fixtures take the last row before theirs in one line of the team's rows and fixtures
    line = Window.partitionBy("team", "year").orderBy("day", "turn", "home", "tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = past.unionByName(asked).withColumn("row", F.last("row", ignorenulls=True).over(line)).where("fixture_id is not null").select("team", "year", "fixture_id", "row")
    # and of the years before, one row for each year of a team
    ends = past.groupBy("team", "year").agg(F.max_by("row", F.struct("day", "home", "tie")).alias("end")).unionByName(asked.select("team", "year").distinct().withColumn("end", F.lit(None).cast(past.schema["row"].dataType)))
    years = ends.groupBy("team", "year").agg(F.first("end", ignorenulls=True).alias("end"))
    carried = years.withColumn("carried", F.last("end", ignorenulls=True).over(Window.partitionBy("team").orderBy("year").rowsBetween(Window.unboundedPreceding, -1))).select("team", "year", "carried")
    return near.join(carried, ["team", "year"], "left").select("fixture_id", F.coalesce("row", "carried").alias("row"))


def similar_names(names: DataFrame, known: DataFrame, *, warn_below: float = 0.6) -> DataFrame:
    """``name``, ``best``, ``ratio``, ``doubtful``: the known name most like each name (ties: the largest).

    Likeness is the Ratcliff-Obershelp ratio; choice is case-sensitive, and the reported ratio ignores
    case. Twice the characters in common, with their numbers, over both lengths bounds a ratio from above, so nothing is missed:
    some known name sets a mark for each name, an index of the known names' characters finds all whose bound
    may reach the mark, and these are rated from the highest bound down until the bound falls below the best ratio.
    A name without a character in common with any known name gets the largest. Null names give nulls, and so does an empty list.
    """
    asked = names.select(F.col(names.columns[0]).alias("name"))
    distinct = asked.where("name is not null").distinct()
    stated = known.select(F.col(known.columns[0]).alias("known")).where("known is not null").distinct()
    index = stated.select("known", F.explode(_characters("known")).alias("c"))
    marked = distinct.join(_marks(distinct, stated, index), "name", "left").withColumn("mark", F.coalesce("mark", F.lit(0.0)))
    rated = _best_first(_reaching(marked, index))
    rest = stated.agg(F.max("known").alias("largest"), F.min("known").alias("smallest"))  # one row
    # without characters only an empty name is alike
    other = F.when(F.length("name") + F.length("smallest") == 0, F.col("smallest")).otherwise(F.col("largest"))
    best = distinct.join(rated, "name", "left").join(F.broadcast(rest), F.lit(True)).select("name", F.coalesce("best", other).alias("best"))
    told = _ratio(F.lower("best"), F.lower("name"))
    return asked.join(best, "name", "left").withColumn("ratio", told).withColumn("doubtful", F.col("ratio") < warn_below)


def _letters(c: str) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.substring(F.col(c), i, F.lit(1)))


def _characters(c: str) -> Column:
    """The characters of a name, each with its number among its equals: names share as many of these as they have characters in common."""
    numbered = F.transform(F.array_distinct(_letters(c)), lambda x: F.transform(F.sequence(F.lit(1), _count(c, x)), lambda i: F.concat(x, i.cast("string"))))
    return F.when(F.length(c) > 0, F.flatten(numbered)).otherwise(F.array().cast("array<string>"))


def _count(c: str, x: Column) -> Column:
    return F.length(c) - F.length(F.replace(F.col(c), x, F.lit("")))


def _bound(a: str, b: str) -> Column:
    """At least the ratio: twice the characters in common, with their numbers, over both lengths."""
    common = F.aggregate(F.array_distinct(_letters(a)), F.lit(0), lambda s, x: s + F.least(_count(a, x), _count(b, x)))
    return F.lit(2.0) * F.when((F.length(a) > 0) & (F.length(b) > 0), common).otherwise(0) / F.greatest(F.length(a) + F.length(b), F.lit(1))


def _marks(names: DataFrame, stated: DataFrame, index: DataFrame, per_character: int = 8) -> DataFrame:
    """``name``, ``mark``: a ratio that some known name reaches. Any would do, a high one spares work.

    Looked at are names equal but for case, and, of a few names kept for each character, the one with the highest bound.
    """
    cased = stated.groupBy(F.lower("known").alias("low")).agg(F.max("known").alias("known"))
    equal = names.join(cased, F.lower("name") == F.col("low")).select("name", "known")
    some = index.groupBy("c", F.pmod(F.xxhash64("known"), F.lit(per_character)).alias("slot")).agg(F.max("known").alias("known"))
    met = names.select("name", F.explode(_characters("name")).alias("c")).join(some.select("c", "known"), "c").select("name", "known").distinct()
    likely = met.groupBy("name").agg(F.max_by("known", F.struct(_bound("name", "known"), F.col("known"))).alias("known"))
    return equal.unionByName(likely).withColumn("ratio", _ratio(F.col("name"), F.col("known"))).groupBy("name").agg(F.max("ratio").alias("mark"))


def _reaching(marked: DataFrame, index: DataFrame) -> DataFrame:
    """``name``, ``known``, ``bound``: all pairs whose bound is not below the name's mark.

    A pair that reaches mark m has at least m n / (2 - m) characters in common, n being the name's length. So it has one among the name's
    rarest characters, once so many less one are left out; only these look into the index, within the lengths that can do.
    """
    how_many = index.groupBy("c").agg(F.count(F.lit(1)).alias("n"))
    held = marked.select("name", "mark", F.explode(_characters("name")).alias("c")).join(how_many, "c").groupBy("name", "mark").agg(F.array_sort(F.collect_list(F.struct("n", "c"))).alias("cs"))
    size = F.length("name")
    needed = F.greatest(F.ceil(F.col("mark") * size / (2 - F.col("mark")) - 1e-9), F.lit(1)).cast("int")
    looked = held.withColumn("cs", F.slice("cs", F.lit(1), F.greatest(F.size("cs") - needed + 1, F.lit(0)))).select("name", "mark", F.explode("cs.c").alias("c"))
    long_enough = F.length("known") >= F.col("mark") * size / (2 - F.col("mark")) - 1e-9
    short_enough = F.length("known") * F.col("mark") <= size * (2 - F.col("mark")) + 1e-9
    pairs = looked.join(index, "c").where(long_enough & short_enough).select("name", "mark", "known").distinct()
    return pairs.withColumn("bound", _bound("name", "known")).where(F.col("bound") >= F.col("mark")).select("name", "known", "bound")


def _best_first(pairs: DataFrame) -> DataFrame:
    """``name``, ``best``: each name's pairs stream by falling bound, and are rated only while the bound is not below the best ratio."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, best, out = None, (-1.0, ""), []
        for frame in frames:
            for name, known, bound in frame.itertuples(index=False):
                if name != now:
                    if now is not None:
                        out.append((now, best[1]))
                    now, best = name, (-1.0, "")
                if bound >= best[0]:
                    best = max(best, (_rate(known, name), known))
            if len(out) > 10_000:
                yield pd.DataFrame(out, columns=["name", "best"])
                out = []
        if now is not None:
            out.append((now, best[1]))
        if out:
            yield pd.DataFrame(out, columns=["name", "best"])

    ordered = pairs.repartition("name").sortWithinPartitions("name", F.desc("bound")).select("name", "known", "bound")
    return ordered.mapInPandas(run, "name string, best string")


def _rate(known: str, name: str) -> float:
    return difflib.SequenceMatcher(None, known, name).ratio()


@F.pandas_udf(DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else _rate(y, x) for x, y in zip(a, b, strict=True)], dtype="float64")


def country(rows: DataFrame, name: str, column: str = "name") -> DataFrame:
    """The rows whose country, in its plain form, is that of ``name``."""
    return rows.where(country_key(F.col(column)) == country_key(F.lit(name)))


def choice(rows: DataFrame, name: str, column: str = "name", order: str = "position") -> Row | None:
    """The first row of that very name, or None."""
    return rows.where(F.col(column) == name).orderBy(order).first()


def by_lower_name(catalog: DataFrame, country: str, name: str) -> DataFrame:
    """Catalog rows of a country and name, whatever their case."""
    return catalog.where((F.lower("country") == country.lower()) & (F.lower("name") == name.lower()))
