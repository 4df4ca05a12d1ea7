"""Cells are divided as tables grow: exact with any pivots, and a query meets a bounded number of rows."""

import numpy as np
import pytest

from pitchflow.operators import neighbours as N


@pytest.mark.parametrize(("p", "pivots", "inner_rows", "k"), [(2, 3, 1, 4), (1, 64, 2, 30), (2, 1, 5, 1), (3, 2, 10_000, 3)])
def test_exact_with_any_inner_pivots(spark, monkeypatch, p, pivots, inner_rows, k):
    monkeypatch.setattr(N, "PIVOTS", pivots)
    monkeypatch.setattr(N, "INNER_ROWS", inner_rows)
    rng = np.random.default_rng(k)
    points = np.concatenate([rng.normal(0, 1, (120, 2)), np.zeros((40, 2)), rng.integers(0, 4, (60, 2)), [[1e6, 1e6]], rng.normal(50, 0.01, (20, 2))]).round(2)
    known = [(i, x.tolist(), 1) for i, x in enumerate(points)] + [(900, [1.0, 2.0, 3.0], 1), (901, [1.0, 2.0, 4.0], 0)]
    asked = [(1_000 + i, x.tolist(), 0) for i, x in enumerate(np.concatenate([rng.normal(0, 3, (40, 2)), [[1e6, 0.0]]]).round(2))] + known[:50] + known[-2:]
    schema = "k long, v array<double>, y int"
    got = {}
    for r in N.nearest(spark.createDataFrame(known, schema).repartition(3), spark.createDataFrame(asked, schema), k, key="k", vector="v", label="y", p=p).collect():
        got.setdefault(r["query"], {})[r["rank"]] = r["neighbour"]
    for q, x, _ in asked:
        d = sorted((float(N._distances(np.array([x]), np.array([v]), p)[0, 0]), i) for i, v, _ in known if i != q and len(v) == len(x))
        assert [got.get(q, {})[j + 1] for j in range(len(got.get(q, {})))] == [i for _, i in d[:k]], q


def test_rows_met_do_not_grow_with_the_table(spark, monkeypatch):
    monkeypatch.setattr(N, "PIVOTS", 4)
    monkeypatch.setattr(N, "INNER_ROWS", 16)
    rng, met = np.random.default_rng(1), []
    for n in (2_000, 8_000):
        x = rng.uniform(0, 100, (n, 2))
        known = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "key long, vector array<double>, label long")
        cells, _ = N._cells(known, 5, 2)
        rows = np.concatenate([own.rows[2] for own in cells.inner[2]])
        assert rows.sum() == n
        asked = rng.uniform(0, 100, (200, 2))
        met.append(rows[cells.meeting(asked, 5, 2, np.zeros(200, bool))[1]].sum() / 200)
    assert met[1] < 1.5 * met[0] < 0.3 * 2_000
