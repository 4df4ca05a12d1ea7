"""Mixing sources to target weights: whole repetitions plus one hash-seeded coin per document."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pitchflow.llm.tables import free_name, fresh

#: Weights of the sources in code-point order (null last), repeating.
WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
#: The coin has this many equally likely values (13 hexadecimal digits of an MD5 sum).
COIN = 16**13


def source_targets(sized: DataFrame, source: str, size: str, weights: Sequence[int] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """One row per source: ``source``, ``source_size``, ``weight``, ``target``.

    Targets share the total of all sizes by weight; none is above ``max_repeats`` times its
    source's size, and the excess is shared again by weight until none is. That is a water level:
    with sources ordered by size per weight, the first k are full, and k is found from running
    sums in whole numbers. Only the per-source sums, one row per source, are ordered together.
    """
    sums = sized.groupBy(F.col(source).alias("source")).agg(F.sum(size).alias("source_size"))
    by_name = Window.partitionBy().orderBy(F.col("source").asc_nulls_last())
    ranked = sums.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int")).cast("long"))
    full = F.col("source_size") * max_repeats
    by_ratio = Window.partitionBy().orderBy((full / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    rest = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    levelled = (
        ranked.withColumn("total", F.sum("source_size").over(everything))
        .withColumn("left", F.col("total") - F.coalesce(F.sum(full).over(before), F.lit(0)))
        .withColumn("left_weight", F.sum("weight").over(rest))
        # this source is not full if its share of what the sources before it leave is below its limit
        .withColumn("open", F.col("left") * F.col("weight") < full * F.col("left_weight"))
    )
    # of sources that tie in size per weight the first has the most weight left; those after it had it taken off as if full
    place = F.struct((full / F.col("weight")).alias("ratio"), (-F.col("left_weight")).alias("place"))
    first = F.min_by(F.when(F.col("open"), F.struct("left", "left_weight")), F.when(F.col("open"), place)).over(everything)
    target = F.when(F.col("open"), F.col("first.left").cast("double") * F.col("weight") / F.col("first.left_weight")).otherwise(full.cast("double"))
    return levelled.withColumn("first", first).select("source", "source_size", "weight", target.alias("target"))


def coin(key: Column, seed: int) -> Column:
    """A number in [0, 1) that only the key and the seed decide."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(key.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(COIN))


def repetitions(df: DataFrame, key: str, source: str, size: str, *, weights: Sequence[int] = WEIGHTS, max_repeats: int = MAX_REPEATS, seed: int = 42) -> DataFrame:
    """``df`` with ``source_size``, ``target`` and ``repeats``, how often the mix takes the row.

    The rate of a source is its target over its size; each row is taken floor(rate) times, and
    once more if its coin, seeded by ``key``, falls below the fraction. ``df`` must give the same
    rows when read twice. Reruns agree. The per-source table is small next to the rows (one row
    a source) and joins on the source name; Spark broadcasts it if its measured size is small and
    otherwise splits the hot sources.

    A null source is a source of its own; null sizes count as 0; a source of size 0 has target 0
    and its rows are taken 0 times; repeated rows share one coin; an empty table gives no rows;
    columns of ``df`` named like the new ones are replaced.
    """
    rows = fresh(df, "source_size", "target", "repeats")
    name, rate, link = (free_name(rows, n) for n in ("mix_source", "mix_rate", "mix_target"))
    sized = rows.select(F.col(source).alias("source"), F.coalesce(F.col(size), F.lit(0)).cast("long").alias("size"))
    targets = source_targets(sized, "source", "size", weights, max_repeats).select(F.col("source").alias(name), F.col("source_size"), F.col("target").alias(link))
    joined = rows.join(targets, rows[source].eqNullSafe(targets[name]), "left").withColumnRenamed(link, "target")
    with_rate = joined.withColumn(rate, F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))
    whole = F.floor(F.col(rate))
    extra = (coin(F.col(key), seed) < F.col(rate) - whole).cast("int")
    return with_rate.withColumn("repeats", (whole + extra).cast("int")).drop(name, rate)


def emit(df: DataFrame, repeats: str = "repeats") -> DataFrame:
    """Each row as often as its ``repeats`` says, without that column."""
    n = free_name(df, "copy")
    return df.withColumn(n, F.explode(F.expr(f"array_repeat(0, `{repeats}`)"))).drop(n, repeats)
