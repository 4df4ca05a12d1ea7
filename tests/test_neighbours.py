"""Exact neighbours against brute force, with few and many pivots, hot cells, repeated keys and every row as a query."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from pitchflow.operators import neighbours as N

SF = "/root/testdata/sf0.001"


def plain(rows, queries, k, p):
    out = {}
    for q, x in queries:
        d = sorted((float(N._distances(np.array([x]), np.array([v]), p)[0, 0]), i) for i, v in rows if i != q and len(v) == len(x))
        out[q] = [i for _, i in d[:k]]
    return out


@pytest.mark.parametrize(("p", "pivots", "cell_rows", "cell_queries"), [(2, 64, 4_096, 32_768), (1, 5, 7, 9), (2, 1, 10, 4), (3, 16, 20, 20)])
def test_all_rows_as_queries_equal_brute_force(spark, monkeypatch, p, pivots, cell_rows, cell_queries):
    for name, value in (("PIVOTS", pivots), ("CELL_ROWS", cell_rows), ("CELL_QUERIES", cell_queries)):
        monkeypatch.setattr(N, name, value)
    rng = np.random.default_rng(p + pivots)
    points = np.concatenate([rng.normal(0, 1, (60, 3)), rng.normal(8, 0.1, (60, 3)), np.zeros((40, 3)), rng.integers(0, 3, (20, 3))]).round(2)
    rows = [(i, x.tolist()) for i, x in enumerate(points)] + [(500 + i, [float(i), 1.0]) for i in range(4)]
    extra = [(900, None, 1), (901, [None, 1.0, 2.0], 1), (902, [], 1), (903, [float("nan"), 1.0, 1.0], 1), (904, [float("inf"), 1.0, 1.0], 1), (None, [1.0, 1.0, 1.0], 1), (905, [1.0], 1)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows] + extra, "k long, v array<double>, y int").repartition(4)
    got = {}
    for r in N.nearest(df, df, 4, key="k", vector="v", label="y", p=p).collect():
        got.setdefault(r["query"], {})[r["rank"]] = r["neighbour"]
    assert {q: [found[i + 1] for i in range(len(found))] for q, found in got.items()} == {q: found for q, found in plain(rows, rows, 4, p).items() if found}


def test_cells_far_away_are_not_looked_at():
    cells = N.Cells({2: np.array([[0.0, 0.0], [100.0, 0.0]])})
    cells.reach[2], cells.rows[2], cells.near[2] = np.array([1.0, 1.0]), np.array([9, 9]), [[0.0, 0.1, 0.2], [0.0, 0.1, 0.2]]
    d = np.array([[0.5, 99.5], [50.0, 50.0]])
    assert cells.reached(d, 2, cells.limits(d, 2, 2)).tolist() == [[True, False], [True, True]]


def test_repeated_keys_count_as_the_query(spark):
    rows = [(1, [float(i), 0.0], 0) for i in range(30)] + [(2, [100.0, 0.0], 1), (3, [200.0, 0.0], 1)]
    df = spark.createDataFrame(rows, "k long, v array<double>, y int")
    got = N.nearest(df, df.where("k = 1").limit(1), 2, key="k", vector="v", label="y").collect()
    assert sorted((r["rank"], r["neighbour"]) for r in got) == [(1, 2), (2, 3)]
    assert N.nearest(df.limit(0), df, 2, key="k", vector="v", label="y").count() == 0
    assert N.nearest(df, df.limit(0), 2, key="k", vector="v", label="y").count() == 0


def test_votes_of_all_embeddings_equal_sql(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet")
    got = N.knn_vote(N.nearest(rows, rows, 5, key="vec_id", vector="embedding", label="label"))
    sql = f"""WITH e AS (SELECT * FROM '{SF}/embeddings.parquet'),
d AS (SELECT q.vec_id AS query, r.vec_id, r.label, list_distance(CAST(q.embedding AS DOUBLE[]), CAST(r.embedding AS DOUBLE[])) AS d FROM e q JOIN e r ON q.vec_id <> r.vec_id),
b AS (SELECT query, label FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY d, vec_id) AS k FROM d) WHERE k <= 5),
v AS (SELECT query, label, count(*) AS votes FROM b GROUP BY query, label)
SELECT query, label, votes FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY votes DESC, label) AS k FROM v) WHERE k = 1"""
    want = {(q, label, float(n)) for q, label, n in duckdb.connect().execute(sql).fetchall()}
    assert {tuple(r) for r in got.select("query", "prediction", F.col("votes").cast("double")).collect()} == want
