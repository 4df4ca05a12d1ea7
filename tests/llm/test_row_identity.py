"""Rows with null or repeated ids and different texts lose their own words only; copies between them are found."""

import hashlib
import random

import duckdb
import pytest

from pitchflow.llm import lines, queries, substrings

LARGEST = (1 << 63) - 1


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(8)
    words = [f"v{i}" for i in range(50)]
    made = [" ".join(rnd.choices(words, k=rnd.randint(1, 14))) for _ in range(50)]
    made += [m + " extra" for m in made]
    texts = ["\n".join(rnd.choices(made, k=rnd.randint(1, 9))) for _ in range(60)]
    ids = [None, 7, LARGEST, *range(20)]
    out = [(None if i % 3 == 0 else ids[i % len(ids)], t) for i, t in enumerate(texts)]
    return [*out, out[0], out[1], (None, None), (None, ""), (7, None)]


def test_line_dedup_equals_its_sql(spark, rows, tmp_path):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [(r["doc_id"], r["n_lines"], r["n_removed"], None if r["text"] is None else hashlib.sha256(r["text"].encode()).hexdigest()) for r in lines.line_dedup(df, "doc_id", "text").collect()]
    con = duckdb.connect()
    df.coalesce(1).write.parquet(str(tmp_path / "documents"))
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents/*.parquet'")
    want = con.execute(queries.ORACLE_SQL["op8_line_dedup"]).fetchall()
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert len(got) == len(rows) and any(n for d, _, n, _ in got if d is None)


def test_substrings_of_null_and_repeated_ids(spark, rows):
    rnd = random.Random(9)
    words = [f"u{i}" for i in range(900)]
    shared = " ".join(rnd.choices(words, k=30))
    unlike = [" ".join(rnd.choices(words, k=40)) for _ in range(6)]
    made = [(None, f"{unlike[0]} {shared}"), (None, f"{shared} {unlike[1]}"), (5, f"{shared} {unlike[2]}"), (5, f"{unlike[3]} {shared}"), (LARGEST, f"{unlike[4]} {shared}"), (None, f"{unlike[5]} {unlike[5]}"), (None, None)]
    df = spark.createDataFrame([*made, made[0]], "doc_id long, text string").repartition(3)
    got = [(r["doc_id"], r["kept_text"]) for r in substrings.substring_dedup(df, "doc_id", "text", with_text=True).collect()]
    assert sorted((d for d, _ in got), key=repr) == sorted((d for d, _ in [*made, made[0]]), key=repr)
    # nothing unlike is lost, and of the shared passage one place, in a row with the least id, is left
    assert all(sum(u in t for _, t in got) >= 1 for u in unlike)
    assert [d for d, t in got if shared in t] == [5]
    assert {t for d, t in got if d == LARGEST} == {unlike[4]} and (None, unlike[5]) in got
    assert sorted(t for d, t in got if d is None) == sorted([unlike[0], unlike[0], unlike[1], unlike[5], ""])
