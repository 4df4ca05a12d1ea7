"""Command line: set leagues up, train, predict, and read saved pages."""

from __future__ import annotations

import argparse
import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchflow.functions.columns import percent_text
from pitchflow.operators import documents, form, lookup, models, splits, training
from pitchflow.sources import pages, seasons
from pitchflow.sources.stores import League, LeagueStore, ModelStore, catalog_leagues, fixture_row

# Columns of the two raw layouts that are read.
MAIN_RAW = (
    "Date string, HomeTeam string, AwayTeam string, FTHG int, FTAG int, FTR string, AvgH double, AvgD double, AvgA double, "
    "B365H double, B365D double, B365A double, HST int, AST int, HC int, AC int"
)
EXTRA_RAW = "Date string, Season string, Home string, Away string, HG int, AG int, Res string, AvgCH double, AvgCD double, AvgCA double"


def fetch(spark: SparkSession, league: League, start_year: int, this_year: int | None = None) -> DataFrame | None:
    """Raw seasons of a league from its files: one a season for main leagues, else one for all."""
    if league.category == "main":
        years = range(start_year, (this_year or dt.date.today().year) + 1)
        return seasons.read_seasons(spark, {y: seasons.season_url(league.url, y) for y in years}, MAIN_RAW)
    return seasons.read_extra(spark, league.url, EXTRA_RAW)


def setup(spark: SparkSession, a: argparse.Namespace) -> DataFrame | None:
    catalog = seasons.league_catalog(spark, a.catalog)
    if a.list:
        return catalog.select("country", "name", "start_year", "category").orderBy("country", "name")
    found = catalog_leagues(lookup.by_lower_name(catalog, a.country, a.name))
    if not found:
        raise ValueError(f"no league {a.name} of {a.country}")
    choices = {"league_id": a.league_id or found[0].name, "history_window": a.history_window, "goal_diff_margin": a.goal_diff_margin, "statistics": form.BASIC}
    league = found[0].with_choices(**choices, **({"start_year": a.start_year} if a.start_year else {}))
    return LeagueStore(spark, a.root).create(league, lambda one, year: fetch(spark, one, year))


def train(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    table = LeagueStore(spark, a.root).load(a.league_id)
    if table is None:
        raise ValueError(f"no league {a.league_id}")
    parts = splits.holdout(table.na.drop("any"), a.eval_ratio)
    part = lambda p: parts.where(F.col("part") == p).drop("part")
    trained, metrics = training.train(part("train"), part("test"), algorithm=a.algo, target=a.target, normalizer=None if a.normalizer == "none" else a.normalizer, calibrate=not a.no_calibrate)
    ModelStore(spark, a.root).save(trained, a.league_id, a.model_id)
    return metrics


def predict(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    table = LeagueStore(spark, a.root).load(a.league_id)
    trained, _ = ModelStore(spark, a.root).load(a.league_id, a.model_id)
    if table is None or trained is None:
        raise ValueError("no such league or model")
    fixture = fixture_row(spark, a.date or dt.date.today().isoformat(), a.home, a.away, a.odds)
    known = table.select(F.col("home").alias("team")).union(table.select("away")).distinct()
    for side in ("home", "away"):  # names as they are typed become the league's own
        told = lookup.similar_names(fixture.select(side).distinct(), known).select(F.col("name").alias(side), "best")
        fixture = fixture.join(told, side).withColumn(side, F.col("best")).drop("best")
    training.check_fixture(fixture, one_row=True)
    ready = lookup.latest_form(table, fixture.withColumn("fixture_id", F.lit(1)))
    filled = training.as_features(ready.withColumn("match_id", F.col("fixture_id").cast("long")), table)
    out = trained.predict(filled)
    return out.select("home", "away", "prediction", *[percent_text(F.col(f"p_{c}")).alias(f"p_{c}") for c in range(trained.classifier.n_classes)])


def scrape(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Documents from a table of saved pages: match_id, summary, statistics."""
    found = pages.match_documents(spark.read.parquet(a.pages))
    if found.isEmpty():
        raise ValueError("no match pages found")
    documents.write_documents(found, a.out, a.file_type, files=a.files)
    return found.agg(F.count(F.lit(1)).alias("n_documents"))


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="pitchflow")
    commands = top.add_subparsers(dest="command", required=True)
    s = commands.add_parser("setup")
    for flag in ("--catalog", "--root", "--country", "--name", "--league-id"):
        s.add_argument(flag)
    s.add_argument("--list", action="store_true")
    s.add_argument("--start-year", type=int)
    s.add_argument("--history-window", type=int, default=10)
    s.add_argument("--goal-diff-margin", type=int, default=2)
    t = commands.add_parser("train")
    p = commands.add_parser("predict")
    for one in (t, p):
        for flag in ("--root", "--league-id", "--model-id"):
            one.add_argument(flag, required=True)
    t.add_argument("--algo", choices=sorted(models.ALGORITHMS), default="randomforest")
    t.add_argument("--target", choices=("result", "over-under"), default="result")
    t.add_argument("--normalizer", choices=("none", "standard", "min-max", "max-abs"), default="standard")
    t.add_argument("--eval-ratio", type=float, default=20.0)
    t.add_argument("--no-calibrate", action="store_true")
    for flag in ("--home", "--away"):
        p.add_argument(flag, required=True)
    p.add_argument("--odds", type=float, nargs=3, required=True)
    p.add_argument("--date")
    c = commands.add_parser("scrape")
    for flag in ("--pages", "--out"):
        c.add_argument(flag, required=True)
    c.add_argument("--file-type", choices=sorted(documents.EXTENSIONS), default="json")
    c.add_argument("--files", type=int, default=1)
    return top


def main(arguments: Sequence[str] | None = None, spark: SparkSession | None = None) -> DataFrame | None:
    """Runs one command, shows its table and returns it."""
    a = parser().parse_args(arguments)
    if a.command == "setup" and not a.list and not (a.country and a.name):
        raise SystemExit("a league needs its country and name")
    session = spark or SparkSession.builder.appName("pitchflow").getOrCreate()
    out = {"setup": setup, "train": train, "predict": predict, "scrape": scrape}[a.command](session, a)
    if out is None:
        print("nothing found")
    else:
        out.show(truncate=False)
    return out


if __name__ == "__main__":
    main()
