"""Keyed tables: batches fold, a batch that comes again counts once, and every commit is a snapshot."""

import json

from pyspark.sql import functions as F

from pitchflow.operators import documents
from pitchflow.sources import pages
from pitchflow.streaming import refresh

SCHEMA = "k long, at long, v string"


def rows(df):
    return sorted(tuple(r) for r in df.select("k", "at", "v").collect())


def test_batches_fold_and_count_once(spark, tmp_path):
    table, want = refresh.KeyedTable(spark, str(tmp_path), "k", ("at", "v"), waiting=3), {}
    assert table.table() is None
    for n in range(8):
        batch = [(k, n, f"{n}-{k}") for k in range(n % 3, 9, 3)] + [(n, n, "twice"), (n, n, "again")]
        want |= {k: max([r for r in batch if r[0] == k], key=lambda r: (r[1], r[2])) for k, *_ in batch}
        assert table.upsert(spark.createDataFrame(batch, SCHEMA), n)
        if n in (1, 4):  # the same batch again: once waiting, once with others
            table.upsert(spark.createDataFrame(batch, SCHEMA), n)
        assert rows(table.table()) == sorted(want.values())
    late = spark.createDataFrame([(0, 99, "late")], SCHEMA)
    assert not table.upsert(late, 2) and rows(table.table()) == sorted(want.values())  # folded already
    now = table.read_json("manifest")
    assert now["upto"] == 5 and set(now["batches"]) == {"6", "7"} and len(table._names("data")) <= 2 * (1 + 3)
    table.fold()
    assert table.read_json("manifest")["batches"] == {} and rows(table.table()) == sorted(want.values())


def test_a_reader_keeps_its_version(spark, tmp_path):
    table = refresh.KeyedTable(spark, str(tmp_path), "k", ("at",), waiting=2)
    table.upsert(spark.createDataFrame([(1, 1, "a")], SCHEMA), 0)
    before = table.table()
    table.upsert(spark.createDataFrame([(1, 2, "b"), (2, 2, "c")], SCHEMA), 1)  # folds
    assert rows(before) == [(1, 1, "a")] and rows(table.table()) == [(1, 2, "b"), (2, 2, "c")]
    assert table.versions("manifest") == [2, 3]
    (tmp_path / "data" / "left-over").mkdir()
    table.fold()
    assert "left-over" not in table._names("data")


def test_pages_become_documents_while_they_come_in(spark, tmp_path):
    page = lambda goals: f"<div class='detailScore__wrapper'><span>{goals}</span><span class='detailScore__divider'>-</span><span>0</span></div>"
    for n in range(4):
        made = spark.createDataFrame([(f"m{n}", page(n), None), ("m0", page(9), None)], "match_id string, summary string, statistics string")
        made.coalesce(1).write.parquet(str(tmp_path / "in" / f"p{n}"))
    stream = spark.readStream.schema(made.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    refresh.upsert_stream(stream, str(tmp_path / "t"), "match_id", ("result",), str(tmp_path / "c"), each=pages.match_documents, waiting=2).awaitTermination()
    found = refresh.latest(spark, str(tmp_path / "t"), "match_id", ("result",))
    assert sorted((r["match_id"], r["result"]["home"]) for r in found.collect()) == [("m0", "9"), ("m1", "1"), ("m2", "2"), ("m3", "3")]
    assert len(refresh.KeyedTable(spark, str(tmp_path / "t"), "match_id", ("result",)).versions("manifest")) == 2
    path = documents.write_documents(found, str(tmp_path / "out"), "json")
    text = "".join(r[0] + "\n" for r in spark.read.text(path).collect())
    assert json.loads(text)["m3"]["result"] == {"home": "3", "away": "0"}
    flat = documents.flat_table(found.withColumn("stage", F.lit(None).cast("string")))
    assert flat.count() == 4 and "stage" not in flat.columns
