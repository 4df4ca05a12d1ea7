"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchflow.llm.tables import materialize


def _smallest(links: DataFrame) -> DataFrame:
    """u, m: the smallest of u and its neighbours. Sums up before it shuffles, so a hot u is no trouble."""
    return links.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))


def _star(links: DataFrame) -> DataFrame:
    """links (u, v) with the smallest neighbour m of each u; both sides are read tables, so AQE can split a hot u."""
    return links.join(materialize(_smallest(links), "smallest"), "u")


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """``node``, ``component`` (smallest node of the component) for every node with a link to another.

    Nodes are whole numbers. The links are replaced, round by round, by links to smaller nodes
    until every component is a star around its smallest node, which takes about log(diameter)
    rounds. Each round is written to the shared folder, so no lineage builds up. Nulls, links of a
    node to itself and repeated links are ignored; an empty table gives no rows.
    """
    links = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u is not null and v is not null and u > v").distinct()
    links = materialize(links, "links")
    state = _state(links)
    for _ in range(max_rounds):
        if not state[0]:
            break
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = materialize(_star(both).where("v > u and v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        near = _star(large)
        small = near.select("u", F.col("m").alias("v")).unionByName(near.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        links = materialize(small.where("u > v").distinct(), "small")
        now = _state(links)
        if now == state:
            return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        state = now
    if state[0]:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return links.select(F.col("u").alias("node"), F.col("v").alias("component"))
