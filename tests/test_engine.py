import datetime as dt

import pytest
from pyspark.sql import functions as F

from pitchflow.functions import columns as X
from pitchflow.operators import cleaning, documents, form, lookup, metrics, models, scaling
from pitchflow.sources import seasons


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_dates_seasons_and_text(spark):
    assert [value(spark, X.parse_match_date(F.lit(t))) for t in ("13/08/05", "05/08/2005", "2005-04-05")] == [dt.date(2005, 8, 13), dt.date(2005, 8, 5), dt.date(2005, 4, 5)]
    assert value(spark, X.parse_season(F.lit("2012/2013"))) == 2012
    with pytest.raises(Exception, match="not a season"):
        value(spark, X.parse_season(F.lit("201213")))
    assert value(spark, X.season_code(F.lit(1999))) == "9900"
    assert value(spark, X.country_key(F.lit("South-Korea!"))) == "south-korea"
    assert value(spark, X.title_words(F.lit("premier-league_uK"))) == "Premier League UK"
    assert value(spark, X.stage_of(F.lit("CUP - Final - Round 2 "))) == "Round 2"
    assert value(spark, X.clean_information(F.lit(": KICK  OFF 20:00 "))) == "KICK OFF 2000"
    assert value(spark, X.round_even(F.lit(6.25), 1)) == 6.2
    assert value(spark, X.penalties(F.lit("After Penalties 4 - 3\n"))) == "4-3"
    assert value(spark, X.link_id(F.lit("g_1_abg_1_"))) == "abg_1_"


def test_odds_fallback_replaces_all_three(spark):
    df = spark.createDataFrame([(None, 3.0, 4.0, 1.1, 1.2, 1.3), (2.0, None, 4.0, 1.1, 1.2, 1.3)], "AvgH double, AvgD double, AvgA double, B365H double, B365D double, B365A double")
    got = cleaning.odds_fallback(df, "AvgH", ("AvgH", "AvgD", "AvgA"), ("B365H", "B365D", "B365A")).select("AvgH", "AvgD", "AvgA").collect()
    assert [tuple(r) for r in got] == [(1.1, 1.2, 1.3), (2.0, None, 4.0)]


def test_form_needs_n_matches_and_values(spark):
    rows = [(i, dt.date(2020, 1, 1 + i), 2020, "A", "B", g, 0, "H" if g else "D") for i, g in enumerate([1, 2, None, 1, 1])]
    df = spark.createDataFrame(rows, "match_id int, match_date date, season int, home string, away string, hg int, ag int, result string")
    got = form.team_form(df, ("hw", "hgf", "hw_pct"), n=2).orderBy("match_id").collect()
    assert [r["hgf"] for r in got] == [None, None, 3.0, None, None]
    assert [r["hw"] for r in got] == [None, None, 2.0, 1.0, 1.0]
    assert [r["hw_pct"] for r in got] == [None, 100.0, 100.0, 66.7, 75.0]
    with pytest.raises(ValueError):
        form.team_form(df, ("hstf",))


def test_short_and_long_csv_rows(spark, tmp_path):
    path = tmp_path / "s.csv"
    path.write_text("Date,Home,HG\n01/02/2020,A,1\n02/02/2020,B\n03/02/2020,C,1,9\n04/02/2020,D,x\n")
    got = seasons.read_seasons(spark, {2020: str(path), 2021: str(tmp_path / "none.csv")}, "Date string, Home string, HG int, AG int")
    assert sorted((r["Home"], r["HG"], r["AG"], r["Season"]) for r in got.collect()) == [("A", 1, None, 2020), ("B", None, None, 2020), ("D", None, None, 2020)]
    assert seasons.read_seasons(spark, {2021: str(tmp_path / "none.csv")}, "Date string") is None


def test_stored_league_overwrites_its_seasons_only(spark, tmp_path):
    root = str(tmp_path / "store")
    seasons.save_league(spark.createDataFrame([(1, 2019), (2, 2020)], "x int, season int"), root, "l1")
    seasons.save_league(spark.createDataFrame([(3, 2020)], "x int, season int"), root, "l1")
    assert sorted((r["x"], r["season"]) for r in seasons.load_league(spark, root, "l1").collect()) == [(1, 2019), (3, 2020)]
    assert seasons.load_league(spark, root, "l2") is None


def test_documents_flatten_with_last_category(spark):
    row = ("m1", "Round 1", None, None, ("A", None), None, None, [("Refe ree", "x"), ("refe ree", "y")], [("Shots", "1", "2")])
    df = spark.createDataFrame([row], documents.SCHEMA)
    got = documents.flat_table(df).first().asDict()
    assert got["information.refe_ree"] == "y" and got["statistics.shots.away"] == "2" and got["home.name"] == "A" and "status" not in got
    assert value(spark, F.to_json(documents.pair_siblings(F.array(F.lit("a"), F.lit("b"), F.lit("c"))))) == '[{"category":"a","value":"b"},{"category":"c"}]'


def test_metrics_of_nothing_and_names(spark):
    empty = spark.createDataFrame([], "y string, p string")
    assert tuple(metrics.classification_metrics(empty, "y", "p").first()) == (0.0, 0.0, 0.0, 0.0)
    got = lookup.similar_names(spark.createDataFrame([("Arsenel",), (None,)], "n string"), spark.createDataFrame([("Arsenal",), ("Chelsea",)], "n string"))
    assert {(r["name"], r["best"]) for r in got.collect()} == {("Arsenel", "Arsenal"), (None, None)}


def test_scaler_and_model_round_trip(spark, tmp_path):
    rows = [(i, float(i), float(i % 7), 5.0, "HDA"[i % 3 if i < 60 else 0], 1, 1) for i in range(90)]
    df = models.class_weights(models.targets(spark.createDataFrame(rows, "k int, a double, b double, c double, result string, hg int, ag int")))
    scaled, scaler = scaling.scale(df, ("a", "b", "c"), "standard")
    assert scaling.Scaler.from_json(scaler.to_json()) == scaler and scaled.agg(F.max("c")).first()[0] == 0.0
    model = models.fit(scaled, ("a", "b", "c"), "randomforest", key="k", n_estimators=3, max_depth=5)
    model.save(str(tmp_path / "model"))
    again = models.Classifier.load(spark, str(tmp_path / "model"))
    told = again.predict_proba(scaled)
    assert told.count() == 90 and models.evaluate(again, scaled).first()["accuracy"] > 0.4
    assert abs(sum(told.select("p_0", "p_1", "p_2").first()) - 1) < 1e-9


def test_corner_form_without_shots(spark):
    rows = [(i, dt.date(2020, 1, 1 + i), 2020, "A", "B", 1, 0, "H", i) for i in range(4)]
    df = spark.createDataFrame(rows, "match_id int, match_date date, season int, home string, away string, hg int, ag int, result string, hc int")
    assert [r["hcf"] for r in form.team_form(df, ("hcf",), n=2).orderBy("match_id").collect()] == [None, None, 1.0, 3.0]
