"""Sources that tie in size per weight share the mix by weight, and none is lost."""

from fractions import Fraction

import pytest

from pitchflow.llm import mixing


def level(sizes, weights, limit):
    """Targets by sharing again and again what full sources leave."""
    weight = {s: weights[i % len(weights)] for i, s in enumerate(sorted(sizes))}
    full = set()
    while True:
        left = sum(sizes.values()) - sum(limit * sizes[s] for s in full)
        rest = sum(w for s, w in weight.items() if s not in full)
        more = {s for s in sizes if s not in full and left * weight[s] >= limit * sizes[s] * rest}
        if not more:
            return {s: float(limit * sizes[s] if s in full else Fraction(left * weight[s], rest)) for s in sizes}
        full |= more


@pytest.mark.parametrize("sizes", [{"a": 1000, "b": 500, "c": 10, "d": 1000}, {"a": 500, "b": 200, "c": 300}, {"a": 500, "b": 200, "c": 100}, {"a": 50, "b": 20, "c": 10, "d": 50, "e": 9000}])
def test_targets_of_tied_sources(spark, sizes):
    sized = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long").repartition(3)
    got = {r["source"]: r["target"] for r in mixing.source_targets(sized, "source", "size").collect()}
    assert got == pytest.approx(level(sizes, mixing.WEIGHTS, mixing.MAX_REPEATS))


def test_a_tie_loses_no_source(spark):
    rows = [(i, s, 1) for s, n in {"a": 500, "b": 200, "c": 300}.items() for i in range(n)]
    out = mixing.repetitions(spark.createDataFrame(rows, "doc_id long, source string, size long"), "doc_id", "source", "size")
    assert all(r["repeats"] >= 0 for r in out.select("repeats").collect())
    assert {r["source"] for r in mixing.emit(out).select("source").distinct().collect()} == {"a", "b", "c"}
