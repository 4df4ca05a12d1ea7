"""Commits of stored leagues and indexes: replaced seasons go, and what breaks off changes nothing."""

import pytest
from pyspark.sql import functions as F

from pitchflow.operators import models
from pitchflow.sources import stores

SCHEMA = "season int, home string, hg int"


def league(**choices):
    return stores.League("X", "Y", 1990, "main", "", league_id="l", **choices)


def table(spark, *seasons, goals=1):
    return spark.createDataFrame([(s, f"T{i}", goals) for s in seasons for i in range(3)], SCHEMA)


def held(df):
    return sorted(df.groupBy("season").agg(F.sum("hg")).collect())


def test_create_again_leaves_no_old_season(spark, tmp_path):
    store = stores.LeagueStore(spark, str(tmp_path))
    store.save(table(spark, 1995, 1996, 1997), league())
    store.save(table(spark, 1997, 1998, goals=2), league(), keep_older=True)
    assert held(store.load("l")) == [(1995, 3), (1996, 3), (1997, 6), (1998, 6)]
    before = store.load("l")
    store.save(table(spark, 2000, 2001), league())
    assert held(store.load("l")) == [(2000, 3), (2001, 3)] and set(store.load("l").columns) == {"season", "home", "hg"}
    assert held(before) == [(1995, 3), (1996, 3), (1997, 6), (1998, 6)]  # a reader of the version before
    store.save(table(spark), league())
    assert held(store.load("l")) == [] and stores.LeagueStore(spark, str(tmp_path)).ids() == ["l"]


def test_a_save_that_breaks_off_changes_nothing(spark, tmp_path, monkeypatch):
    store = stores.LeagueStore(spark, str(tmp_path))
    store.save(table(spark, 1995), league())
    broken = table(spark, 1995, 1996, goals=9).withColumn("hg", F.when(F.col("season") == 1996, F.raise_error(F.lit("gone")).cast("int")).otherwise(F.col("hg")))
    with pytest.raises(Exception, match="gone"):
        store.save(broken, league())
    assert held(store.load("l")) == [(1995, 3)]
    monkeypatch.setattr(stores._Folder, "write_json", lambda *a, **b: (_ for _ in ()).throw(OSError("crash before the commit")))
    with pytest.raises(OSError):
        store.save(table(spark, 1996), league())
    monkeypatch.undo()
    again = stores.LeagueStore(spark, str(tmp_path))
    assert held(again.load("l")) == [(1995, 3)] and again.ids() == ["l"]
    again.save(table(spark, 1997), league())
    assert len(again._names("l/table")) == 2  # the newest version's and the one's before; what broke off is cleared


def test_an_index_is_never_gone(spark, tmp_path):
    store = stores._Folder(spark, str(tmp_path))
    assert store.read_json("i") == {}
    for n in range(4):
        assert store.write_json("i", {"n": n}) == n + 1
        assert store.read_json("i") == {"n": n}
    assert store.versions("i") == [3, 4]
    (tmp_path / "i" / "draft-x").write_text("{half")
    assert store.read_json("i") == {"n": 3}


def test_the_same_version_is_committed_once(spark, tmp_path, monkeypatch):
    store = stores._Folder(spark, str(tmp_path))
    store.write_json("i", {"n": 0})
    monkeypatch.setattr(stores._Folder, "versions", lambda self, path: [])  # a writer that has not seen the first version
    with pytest.raises(RuntimeError, match="another writer"):
        store.write_json("i", {"n": 9})
    monkeypatch.undo()
    assert store.read_json("i") == {"n": 0}


def test_a_class_without_rows_gets_no_share(spark):
    df = spark.createDataFrame([(i, float(i % 2) * 4 + (i % 5) / 9, float(i % 3), float(i % 2) * 2) for i in range(30)], "match_id long, a double, b double, label double")
    got = models.fit(df, ("a", "b"), "discriminant").predict_proba(df)
    assert got.where("prediction = label and p_1 = 0 and abs(p_0 + p_2 - 1) < 1e-9").count() == 30
