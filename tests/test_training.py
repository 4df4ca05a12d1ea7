"""Classifiers, calibration, samplers, stores and the command line on small tables."""

import difflib
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitchflow import cli
from pitchflow.operators import cleaning, lookup, models, neighbours, sampling, splits, training
from pitchflow.plans.matches import matches
from pitchflow.sources import seasons, stores

SF = "/root/testdata/sf0.001"
X = ("a", "b")


@pytest.fixture(scope="module")
def points(spark):
    """Three classes of 60, 40 and 20 rows around three places."""
    rng, rows = np.random.default_rng(2), []
    for c, (n, at) in enumerate(((60, (0, 0)), (40, (3, 0)), (20, (0, 3)))):
        rows += [(len(rows) + i, *map(float, rng.normal(at, 0.8)), float(c)) for i in range(n)]
    return spark.createDataFrame(rows, "match_id long, a double, b double, label double").repartition(2).cache()


@pytest.mark.parametrize(
    "algorithm, settings",
    [("decisiontree", {"max_features": "sqrt", "max_depth": 5}), ("discriminant", {"oas": True}), ("discriminant", {"decision_boundary": "quadratic"}), ("knn", {"weights": "distance", "p": 1}), ("naivebayes", {}), ("svm", {}), ("svm", {"kernel": "rbf", "gamma": 0.5}), ("svm", {"kernel": "poly", "degree": 3}), ("svm", {"kernel": "sigmoid", "class_weight": False}), ("logistic", {})],
)
def test_classifiers_tell_classes_apart_and_survive_saving(spark, points, tmp_path, algorithm, settings):
    model = models.fit(points, X, algorithm, **settings)
    keyed = points.withColumn("row_key", F.col("match_id"))
    got = model.predict_proba(keyed)
    assert got.where("abs(p_0 + p_1 + p_2 - 1) < 1e-9").count() == 120
    assert got.where("prediction = label").count() > 95
    models.save_model(model, str(tmp_path / "m"))
    again = models.Classifier.load(spark, str(tmp_path / "m")).predict_proba(keyed)
    assert sorted(r[0] for r in again.select("prediction").collect()) == sorted(r[0] for r in got.select("prediction").collect())


def test_calibration_and_what_models_tell(points):
    keyed = points.withColumn("row_key", F.col("match_id"))
    forest = models.fit(points, X, "randomforest", calibrate=True, folds=2, n_estimators=3, max_depth=4)
    assert len(forest.members) == 2 and forest.evaluate(keyed).first()["accuracy"] > 0.8
    assert abs(sum(forest.feature_importances().values()) - 1) < 1e-9 and forest.forest_member(1).depth >= 1
    line = models.fit(points, X, "logistic")
    assert all(v > 0 for v in line.coefficients().values())
    with pytest.raises(ValueError):
        models.fit(points, X, "discriminant").feature_importances()
    with pytest.raises(ValueError, match="not fitted"):
        models.save_model(None, "x")
    with pytest.raises(RuntimeError, match="not fitted"):
        models.evaluate(None, points)
    with pytest.raises(ValueError, match="no rows"):
        models.fit(points.where("false"), X, "logistic")
    with pytest.raises(TypeError):
        models.one_hot(points, kind="over-under")
    assert set(models.search_space("knn")) == {"calibrate", "normalizer", "sampler", "n_neighbors", "weights", "p"}
    assert models.default_config("svm", kernel="rbf") == {"algorithm": "svm", "calibrate": True, "normalizer": None, "sampler": None, "kernel": "rbf"}


def test_samplers(points):
    fewer = sampling.class_counts(sampling.near_miss(points, X))  # candidates may be fewer than the smallest class
    assert fewer[2.0] == 20 and 5 <= fewer[0.0] <= 20 and 5 <= fewer[1.0] <= 20
    made = sampling.resample(points, X, "svm-smote")
    assert sampling.class_counts(made) == {0.0: 60, 1.0: 60, 2.0: 60} and made.select("match_id").distinct().count() == 180
    easy = sampling.class_counts(sampling.instance_hardness(points, X, folds=2, n_estimators=3))
    assert easy[2.0] == 20 and 20 <= easy[0.0] < 60 and 20 <= easy[1.0] <= 40
    assert sampling.resample(points, X, None) is points
    with pytest.raises(ValueError, match="no sampler"):
        sampling.resample(points, X, "x")


def test_nearest_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    v = rng.integers(0, 6, (90, 3)).astype(float)
    rows = [(i, v[i].tolist(), 1) for i in range(90)] + [(90, None, 1), (91, [1.0], 1), (92, [None, 1.0, 1.0], 1), (None, [1.0] * 3, 1)]
    df = spark.createDataFrame(rows, "k long, v array<double>, y int").repartition(4)
    for p in (1, 2):
        got = {(r["query"], r["rank"]): r["neighbour"] for r in neighbours.nearest(df, df.where("k % 20 = 0 or k > 88"), 4, key="k", vector="v", label="y", p=p).collect()}
        for q in (0, 20, 40, 60, 80, 89):
            d = sorted((round(float((np.abs(v[q] - v[i]) ** p).sum()), 9), i) for i in range(90) if i != q)
            assert [got[q, r + 1] for r in range(4)] == [i for _, i in d[:4]]
        assert not [q for q, _ in got if q > 89]


def test_similar_names_equal_brute_force(spark):
    known = ["Arsenal", "Arsenic", "Chelsea", "Real Madrid", "Real Betis", "zz"]
    names = ["Arsenel", "real madrid", "Betis", "Qwx", "", "CHELSEA"]
    got = {r["name"]: (r["best"], r["ratio"]) for r in lookup.similar_names(spark.createDataFrame([(n,) for n in [*names, None]], "n string"), spark.createDataFrame([(n,) for n in known], "n string")).collect()}
    for n in names:
        best = max(known, key=lambda k: (difflib.SequenceMatcher(None, k, n).ratio(), k))
        assert got[n][0] == best and abs(got[n][1] - difflib.SequenceMatcher(None, n.lower(), best.lower()).ratio()) < 1e-12
    assert got[None] == (None, None)


def test_short_names_with_separators_equal_brute_force(spark):
    """No bigram in common is no reason to miss a name; the largest of equals is told."""
    rnd = random.Random(8)
    made = lambda: "".join(rnd.choice("abcA-. é") for _ in range(rnd.randint(0, 7)))
    names, known = sorted({made() for _ in range(2_300)})[:2_000], sorted({made() for _ in range(60)} | {"a-b-c", "abq", "c" * 230})
    names += ["abc", "a" * 260, "zzz", "𝒳y"]
    frame = lambda xs: spark.createDataFrame([(x,) for x in xs], "n string").repartition(3)
    got = {r["name"]: r["best"] for r in lookup.similar_names(frame(names), frame(known)).collect()}
    rate = lambda k, n: difflib.SequenceMatcher(None, k, n).ratio()
    assert got == {n: max(known, key=lambda k: (rate(k, n), k)) for n in names}
    assert got["zzz"] == max(known) and lookup.similar_names(frame(["abc"]), frame(["a-b-c", "abq"])).first()["best"] == "a-b-c"
    none = lookup.similar_names(frame(["a"]), frame(["a"]).limit(0)).first()
    assert (none["best"], none["ratio"]) == (None, None)


def test_row_keys_tell_nulls_apart(spark):
    rows = [("01/02/2020", 2020, "A", "B", 1, 0, "H", 1.0, 2.0, 3.0, hst, ast, 1, 1) for hst, ast in ((None, 3), (3, None))]
    df = spark.createDataFrame(rows, "match_date string, season int, home string, away string, hg int, ag int, result string, odd_1 double, odd_x double, odd_2 double, hst int, ast int, hc int, ac int")
    assert cleaning.clean(df, 2000, extended=True).select("match_id").distinct().count() == 2
    with pytest.raises(ValueError, match="before"):
        cleaning.clean(df, 2021, extended=True)
    with pytest.raises(ValueError, match="columns"):
        cleaning.clean(df.drop("ac"), 2000, extended=True)


def test_season_files_with_quotes_and_latin_text(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Date,Home,HG\n01/02/2020,"A, ""x""\nB",1\n02/02/2020,C,1,9\n')
    (tmp_path / "b.csv").write_bytes("Date,Home,HG\n01/02/2021,Málaga,2\n".encode("latin-1"))
    (tmp_path / "c.csv").write_text("")
    got = seasons.read_seasons(spark, {2020: str(tmp_path / "a.csv"), 2021: str(tmp_path / "b.csv"), 2022: str(tmp_path / "c.csv")}, "Date string, Home string, HG int")
    assert sorted((r["Home"], r["HG"]) for r in got.collect()) == [('A, "x"\nB', 1), ("Málaga", 2)]
    assert seasons.read_extra(spark, "nowhere://x/y.csv", "Date string") is None


def test_command_line_from_files_to_a_prediction(spark, tmp_path):
    table = matches(spark, SF).where("season in (1996, 1997)")
    raw = table.select(*[F.col(new).alias(old) for old, new in cleaning.MAIN_COLUMNS.items()]).withColumn("Date", F.date_format("Date", "dd/MM/yyyy")).withColumns({"B365H": F.lit(1.5), "B365D": F.lit(2.5), "B365A": F.lit(3.5)})
    for year in (1996, 1997):
        raw.where(F.col("Season") == year).drop("Season").write.option("header", True).csv(str(tmp_path / f"raw/{year % 100:02d}{(year + 1) % 100:02d}"))
    entry = {"country": "X", "name": "Y", "start_year": 1996, "category": "main", "url": str(tmp_path / "raw") + "/{}"}
    (tmp_path / "catalog.json").write_text(json.dumps({"leagues": [entry]}))
    root = str(tmp_path / "store")
    assert cli.main(["setup", "--catalog", str(tmp_path / "catalog.json"), "--list"], spark).count() == 1
    with pytest.raises(SystemExit):
        cli.main(["setup", "--root", root], spark)
    with pytest.raises(ValueError, match="no league"):
        cli.main(["setup", "--catalog", str(tmp_path / "catalog.json"), "--root", root, "--country", "q", "--name", "Y"], spark)
    made = cli.main(["setup", "--catalog", str(tmp_path / "catalog.json"), "--root", root, "--country", "x", "--name", "y", "--league-id", "l", "--start-year", "1990", "--history-window", "2"], spark)
    assert made.count() == table.count()
    metrics = cli.main(["train", "--root", root, "--league-id", "l", "--model-id", "m", "--algo", "discriminant"], spark)
    assert [r["data"] for r in metrics.collect()] == ["Train", "Evaluation"]
    told = cli.main(["predict", "--root", root, "--league-id", "l", "--model-id", "m", "--home", "T1", "--away", "t2", "--odds", "2", "3", "4", "--date", "1998-01-01"], spark).collect()
    assert len(told) == 1 and told[0]["home"] == "T1" and told[0]["p_0"].endswith("%")

    leagues, saved = stores.LeagueStore(spark, root), stores.ModelStore(spark, root)
    assert leagues.ids() == ["l"] and leagues.index["l"].start_year == 1996 and saved.ids("l") == ["m"] and saved.has("l", "m")
    trained, config = saved.load("l", "m")
    assert config["algorithm"] == "discriminant" and trained.scaler.kind == "standard"
    saved.update_config(config | {"note": 1})
    assert stores.ModelStore(spark, root).load_config("l", "m")["note"] == 1
    with pytest.raises(ValueError, match="not fitted"):
        saved.save(None, "l", "n")
    assert leagues.update("l", lambda league, year: None).count() == table.count()
    saved.delete_model("l", "m")
    assert saved.load("l", "m") == (None, None) and stores.ModelStore(spark, root).index == {}
    leagues.delete("l")
    assert leagues.load("l") is None and stores.LeagueStore(spark, root).ids() == []
    with pytest.raises(ValueError, match="begins"):
        stores.check_year(stores.League.from_row(entry), 1995)


def test_training_checks_and_folds(spark):
    df = matches(spark, SF).select("match_id", "match_date", "season", "home", "away", "hg", "ag", "result", "odd_1", "odd_x", "odd_2")
    with pytest.raises(ValueError, match="nulls"):
        training.train(df, check_nan=True)
    got = training.cross_validate(df, k=2, algorithm="discriminant", calibrate=False).collect()
    assert [(r["fold"], r["data"]) for r in got] == [(0, "Train"), (0, "Evaluation"), (1, "Train"), (1, "Evaluation")] and all(0 < r["accuracy"] < 1 for r in got)
    fixture = stores.fixture_row(spark, "2020-01-01", "A", "B", (1, 2, 3))
    training.check_fixture(fixture, one_row=True)
    with pytest.raises(ValueError, match="exactly one"):
        training.check_fixture(fixture.union(fixture), one_row=True)
    with pytest.raises(ValueError, match="lack"):
        training.check_fixture(fixture.drop("odd_x"))
    filled = training.as_features(fixture, df).first()
    assert filled["hg"] == 0 and filled["result"] is None and filled["odd_x"] == 2.0
    assert splits.holdout(df, 20.0).where("part = 'test'").count() == df.count() // 5
