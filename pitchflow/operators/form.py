"""Team form: statistics of the last N matches of a team in a role, within a season, without the match itself."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from pitchflow.functions.columns import round_even

BASIC = (
    "hw", "aw", "hl", "al", "hgf", "agf", "hagf", "hga", "aga", "haga", "hgd", "agd", "hagd",
    "hwgd", "awgd", "hawgd", "hlgd", "algd", "halgd", "hw_pct", "hl_pct", "aw_pct", "al_pct",
)
EXTRA = ("hstf", "astf", "hcf", "acf")


def _flag(condition: Column) -> Column:
    """1 or 0; unknown is 0."""
    return F.coalesce(condition, F.lit(False)).cast("int")


class Form:
    """Expressions of every statistic. All those of a role share one window, so one sort."""

    def __init__(self, n: int = 10, margin: int = 2, league: Sequence[str] = ()):
        self.n, self.margin = n, margin
        self.window = {role: Window.partitionBy(*league, "season", role).orderBy("match_date", "home", "match_id") for role in ("home", "away")}

    def rolled(self, value: Column, role: str) -> Column:
        """Sum over the n matches before, null if there are fewer values."""
        frame: WindowSpec = self.window[role].rowsBetween(-self.n, -1)
        return F.when(F.count(value).over(frame) >= self.n, F.sum(value).over(frame)).cast("double")

    def share(self, flag: Column, role: str) -> Column:
        """Percent of all matches before in the season, one decimal, half to even."""
        frame = self.window[role].rowsBetween(Window.unboundedPreceding, -1)
        ratio = F.try_divide(F.sum(flag).over(frame).cast("double"), F.count(F.lit(1)).over(frame).cast("double"))
        return round_even(ratio * 100, 1)

    def base(self, needed: set[str]) -> dict[str, Column]:
        """The needed ones of the statistics that come from one role's matches."""
        hg, ag, result, m = F.col("hg"), F.col("ag"), F.col("result"), self.margin
        home_won, away_won = _flag(result == "H"), _flag(result == "A")
        ahead, behind = _flag(hg - ag >= m), _flag(ag - hg >= m)
        rolled = {
            "hw": (home_won, "home"), "aw": (away_won, "away"), "hl": (away_won, "home"), "al": (home_won, "away"),
            "hgf": (hg, "home"), "agf": (ag, "away"), "hga": (ag, "home"), "aga": (hg, "away"),
            "hgd": (hg - ag, "home"), "agd": (ag - hg, "away"),
            "hwgd": (ahead, "home"), "awgd": (behind, "away"), "hlgd": (behind, "home"), "algd": (ahead, "away"),
            "hstf": (F.col("hst"), "home"), "astf": (F.col("ast"), "away"), "hcf": (F.col("hc"), "home"), "acf": (F.col("ac"), "away"),
        }
        shares = {"hw_pct": (home_won, "home"), "hl_pct": (away_won, "home"), "aw_pct": (away_won, "away"), "al_pct": (home_won, "away")}
        return {k: self.rolled(*v) for k, v in rolled.items() if k in needed} | {k: self.share(*v) for k, v in shares.items() if k in needed}


#: Home minus away of two other statistics.
DIFFERENCES = {"hagf": ("hgf", "agf"), "haga": ("hga", "aga"), "hagd": ("hgd", "agd"), "hawgd": ("hwgd", "awgd"), "halgd": ("hlgd", "algd")}


def team_form(df: DataFrame, wanted: Sequence[str] = BASIC, *, n: int = 10, margin: int = 2, league: Sequence[str] = ()) -> DataFrame:
    """``df`` with the wanted statistics, in the order asked for.

    Rows are partitioned by season and team once per role; order is by date, then home team, then
    match id. A null goal count makes the sums over it null; a null result counts as no win.
    """
    missing = [s for s in wanted if s in EXTRA and {"hstf": "hst", "astf": "ast", "hcf": "hc", "acf": "ac"}[s] not in df.columns]
    unknown = [s for s in wanted if s not in BASIC + EXTRA]
    if missing or unknown:
        raise ValueError(f"no columns for {missing}, no such statistics {unknown}")
    needed = {x for s in wanted for x in DIFFERENCES.get(s, (s,))}
    form = Form(n, margin, league)
    base = form.base(needed)
    named = {k: f"__{k}" for k in base}
    out = df.select("*", *[v.alias(named[k]) for k, v in base.items()])
    value = lambda s: F.col(named[DIFFERENCES[s][0]]) - F.col(named[DIFFERENCES[s][1]]) if s in DIFFERENCES else F.col(named[s])
    return out.select(*df.columns, *[value(s).alias(s) for s in wanted])


def newest_first(df: DataFrame) -> DataFrame:
    return df.orderBy(F.desc("match_date"), F.desc("home"), F.desc("match_id"))
