"""Flat tables hold and shuffle one row for each document."""

from pitchflow.operators import documents


def test_a_row_for_each_document(spark, monkeypatch):
    made, filed = [], documents.filed
    monkeypatch.setattr(documents, "filed", lambda df, name: made.append(filed(df, name)) or made[-1])
    side, none = ("A", "/a"), (None, None, None, None)
    rows = [
        ("1", "s", None, "Finished", side, (None, None), ("1", "0", None, None), [("Big Crowd", "1"), (None, "x"), ("big crowd", "2")], [("Shots", "1", None), ("SHOTS", "3", "4")]),
        ("1", "r", None, "Finished", side, (None, None), ("2", "0", None, None), None, []),
        (None, None, None, "Finished", None, None, none, None, None),
        ("2", None, None, None, None, None, none, [], [("x.y", None, "7")]),
    ]
    flat = documents.flat_table(spark.createDataFrame(rows, documents.SCHEMA).repartition(3))
    assert flat.columns == ["match_id", "stage", "status", "home.name", "home.image", "result.home", "result.away", "information.big_crowd", "statistics.shots.away", "statistics.shots.home", "statistics.x.y.away"]
    want = {("1", "s", "Finished", "A", "/a", "2", "0", "2", "4", "3", None), (None, None, "Finished", *[None] * 8), ("2", *[None] * 9, "7")}
    assert {tuple(r) for r in flat.collect()} == want
    assert [t.count() for t in made] == [len(rows)]
    empty = documents.flat_table(spark.createDataFrame([("9", *[None] * 5, none, None, None)], documents.SCHEMA))
    assert [tuple(r) for r in empty.collect()] == [("9",)]
