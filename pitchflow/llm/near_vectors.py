"""Embedding near-dedup by spherical-cap filters from structured random product codes.

A code is a random rotation and, for each of two halves of the rotated vector, a list of random
directions; its filters are all combinations of one direction from each list. A vector is
list-decoded, half by half, to every filter on whose direction it comes within a margin of its
best one, so the threshold adapts to vector and code. Vectors meet where they share a filter and are
verified there in double precision. There are about as many filters as vectors of the largest
label, so what meets in a filter by chance does not grow with the table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchflow.llm.components import components
from pitchflow.llm.tables import key_name, materialize

MIN_COSINE = 0.98
N_CODES = 2
#: Directions for each half, at least; a code has the square of this many filters.
LEAST_DIRECTIONS = 64
#: Vectors of a label for each filter of a code.
PER_FILTER = 4
#: A filter is exceeded within this cosine of the vector's best filter.
MARGIN = 0.06
#: Members of a filter beyond which they are cut into parts that meet pairwise.
BLOCK = 2_048

# ---------------------------------------------------------------- filters


@lru_cache(maxsize=16)
def product_codes(dim: int, n_directions: int = LEAST_DIRECTIONS, n_codes: int = N_CODES, seed: int = 7) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each code the directions of both halves, turned back: two arrays [directions, dim]."""
    even, out = dim + dim % 2, []
    for code in range(n_codes):
        rng = np.random.default_rng((seed, code, dim))
        turn, _ = np.linalg.qr(rng.standard_normal((even, even)))
        halves = []
        for half in (turn[: even // 2], turn[even // 2 :]):
            directions = rng.standard_normal((n_directions, even // 2))
            directions /= np.linalg.norm(directions, axis=1, keepdims=True)
            halves.append((directions @ half)[:, :dim] / np.sqrt(2))
        out.append((halves[0], halves[1]))
    return out


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled by their largest component first, so that squares neither overflow nor vanish."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def directions_for(n: int) -> int:
    """Directions, a power of two, with at least one filter for each PER_FILTER of n vectors."""
    out = LEAST_DIRECTIONS
    while out * out * PER_FILTER < n:
        out *= 2
    return out


def exceeded(vectors: np.ndarray, n_directions: int = LEAST_DIRECTIONS, margin: float = MARGIN) -> tuple[np.ndarray, np.ndarray]:
    """row, filter of all filters that each unit vector exceeds, in order of row and filter.

    A pair of directions can only be within the margin if each is within it of the best of its half.
    """
    rows, found = [], []
    for code, (left, right) in enumerate(product_codes(vectors.shape[1], n_directions)):
        for at in range(0, len(vectors), 512):
            part = vectors[at : at + 512]
            a, b = part @ left.T, part @ right.T
            a -= a.max(axis=1, keepdims=True)
            b -= b.max(axis=1, keepdims=True)
            for row in range(len(part)):
                i, j = np.flatnonzero(a[row] >= -margin), np.flatnonzero(b[row] >= -margin)
                p, q = np.nonzero(a[row, i][:, None] + b[row, j][None, :] >= -margin)
                rows.append(np.full(len(p), row + at))
                found.append((code * n_directions + i[p]) * n_directions + j[q])
    row, which = np.concatenate(rows), np.concatenate(found)
    order = np.lexsort((which, row))
    return row[order], which[order]


def _decode(batches: Iterator[pa.RecordBatch], n_directions: int) -> Iterator[pa.RecordBatch]:
    """label, rep, size, vector -> a row for each filter, with all filters of the vector."""
    for batch in batches:
        lists = batch.column(3)
        lengths = np.diff(lists.offsets.to_numpy())
        values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        for dim in np.unique(lengths).tolist():
            which = np.flatnonzero(lengths == dim)
            row, found = exceeded(unit(values[starts[which][:, None] + np.arange(dim)]), n_directions)
            counts = np.bincount(row, minlength=len(which))
            # the list of all filters of the vector, once for each of its rows
            first, many = (np.cumsum(counts) - counts)[row], counts[row]
            places = np.repeat(first, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            offsets = np.concatenate(([0], np.cumsum(many))).astype(np.int32)
            taken = batch.take(pa.array(which[row]))
            filters = pa.ListArray.from_arrays(pa.array(offsets), pa.array(found[places].astype(np.int64)))
            yield pa.RecordBatch.from_arrays([taken.column(0), pa.array(np.full(len(row), dim, np.int32)), pa.array(found.astype(np.int64)), taken.column(1), taken.column(2), taken.column(3), filters], names=["label", "dim", "filter", "rep", "size", "vector", "filters"])


# ---------------------------------------------------------------- comparing


def _seen_before(filters: list[np.ndarray], at: int) -> np.ndarray:
    """Which pairs share a filter below ``at``, where they have been counted."""
    lower = [f[f < at] for f in filters]
    names, column = np.unique(np.concatenate(lower), return_inverse=True) if lower else (np.zeros(0), np.zeros(0, np.int64))
    member = np.zeros((len(filters), len(names)), np.float32)
    member[np.repeat(np.arange(len(filters)), [len(x) for x in lower]), column] = 1
    return member @ member.T > 0


def _roots(close: np.ndarray) -> np.ndarray:
    """The lowest row that each row reaches."""
    label = np.arange(len(close))
    while True:
        low = np.minimum(label, np.where(close, label[None, :], len(label)).min(axis=1))
        low = low[low]
        if (low == label).all():
            return label
        label = low


def _block_links(at: int, rep: np.ndarray, size: np.ndarray, side: np.ndarray, vectors: np.ndarray, filters: list[np.ndarray], min_cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """rep, root, number of linked vectors not counted under a lower filter, for members with links."""
    v = unit(vectors.astype(np.float64))
    close = v @ v.T >= min_cosine
    if side.min() != side.max():  # two parts meet: only pairs across
        close &= side[:, None] != side[None, :]
    np.fill_diagonal(close, False)
    has = np.flatnonzero(close.any(axis=1))
    if not len(has):
        return rep[:0], rep[:0], size[:0]
    has = has[np.argsort(rep[has], kind="stable")]
    close = close[np.ix_(has, has)]
    new = close & ~_seen_before([filters[i] for i in has.tolist()], at)
    return rep[has], rep[has][_roots(close)], new @ size[has]


def _compare(batches: Iterator[pa.RecordBatch], min_cosine: float) -> Iterator[pa.RecordBatch]:
    """Rows come ordered by label, dim, filter, part; the last group of a batch waits for the next."""
    held: list[pa.RecordBatch] = []

    def done(table: pa.Table) -> Iterator[pa.RecordBatch]:
        key = np.stack([table.column(i).to_numpy() for i in (0, 1, 2, 3, 4)])
        starts = np.flatnonzero(np.concatenate(([True], (key[:, 1:] != key[:, :-1]).any(axis=0))))
        table = table.combine_chunks()
        rep, size, side = (table.column(i).to_numpy() for i in (5, 6, 7))
        out = []
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), table.num_rows], strict=True):
            if b - a > 1:
                vectors = table.column(8).slice(a, b - a).combine_chunks().flatten().to_numpy().reshape(b - a, -1)
                lists = table.column(9).slice(a, b - a).combine_chunks()
                filters = np.split(lists.flatten().to_numpy(), np.cumsum(np.diff(lists.offsets.to_numpy()))[:-1])
                out.append(_block_links(int(key[2, a]), rep[a:b], size[a:b], side[a:b], vectors, filters, min_cosine))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*out, strict=True)], names=["rep", "root", "n"])

    for batch in batches:
        if not batch.num_rows:
            continue
        key = [np.asarray(batch.column(i).to_numpy()) for i in range(5)]
        last = np.logical_and.reduce([k == k[-1] for k in key])
        begin = batch.num_rows - int(np.argmin(last[::-1])) if not last.all() else 0
        if held and any(k[0] != np.asarray(held[-1].column(i).to_numpy())[-1] for i, k in enumerate(key)):
            yield from done(pa.Table.from_batches(held))
            held = []
        if begin:
            yield from done(pa.Table.from_batches([*held, batch.slice(0, begin)]))
            held = []
        held.append(batch.slice(begin))
    if held:
        yield from done(pa.Table.from_batches(held))


def _usable(vector: str):
    value = F.col(vector)
    sound = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return value.isNotNull() & sound & F.exists(value, lambda x: x != 0)


def near_vectors(df: DataFrame, key: str, vector: str, label: str, *, min_cosine: float = MIN_COSINE, block: int = BLOCK) -> DataFrame:
    """One row per row of ``df``: ``key``, ``n_links``, ``component_id``, ``kept``.

    Vectors link when their labels are equal and not null, their lengths are equal and their
    cosine is at least ``min_cosine``. Equal vectors are merged first and count as linked; of the
    others no pair below the cosine is linked, and a pair is found if it shares a filter, which
    the margin makes all but sure (tests ask for 1,990 of 2,000 pairs at the limit). ``n_links`` counts the other rows linked directly.

    Vectors that are null, empty, zero or hold nulls or numbers that are not finite link with
    nothing, nor do rows with a null key. Repeated rows count as vectors of their own. An empty
    table gives no rows. ``key`` and ``label`` must be whole numbers. A key named like a new column gets an underscore in front.
    """
    kind = "float" if df.schema[vector].dataType.simpleString() == "array<float>" else "double"
    rows = df.select(F.col(key).alias("key"), F.col(label).cast("long").alias("label"), F.col(vector).cast(f"array<{kind}>").alias("vector"))
    rows = rows.withColumn("usable", F.col("key").isNotNull() & F.col("label").isNotNull() & F.coalesce(_usable("vector"), F.lit(False)))
    named = rows.withColumn("h1", F.xxhash64("label", "vector")).withColumn("h2", F.xxhash64(F.lit(1), "vector", "label"))
    ids = materialize(named.select("key", "usable", "h1", "h2"), "vectors")
    groups = named.where("usable").groupBy("h1", "h2").agg(F.min("key").alias("rep"), F.count(F.lit(1)).alias("size"), F.first("label").alias("label"), F.first("vector").alias("vector"))
    classes = materialize(groups, "classes")

    # what comes as floats travels as floats, and is compared in double precision
    most = classes.groupBy("label").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    n_directions = directions_for(most)
    decoded = classes.select("label", "rep", "size", "vector").mapInArrow(lambda it: _decode(it, n_directions), f"label long, dim int, filter long, rep long, size long, vector array<{kind}>, filters array<long>")
    met = materialize(decoded, "filters")
    bucket = ["label", "dim", "filter"]
    crowds = materialize(met.groupBy(*bucket).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).withColumn("parts", F.ceil(F.col("n") / block).cast("int")).drop("n"), "filter-sizes")
    own = F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")
    dealt = met.join(crowds, bucket).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.withColumn("p", F.least("own", "other")).withColumn("q", F.greatest("own", "other"))
    ordered = dealt.select(*bucket, "p", "q", "rep", "size", "own", "vector", "filters").repartition(*bucket, "p", "q").sortWithinPartitions(*bucket, "p", "q")
    found = materialize(ordered.mapInArrow(lambda it: _compare(it, min_cosine), "rep long, root long, n long"), "links")

    counts = found.groupBy("rep").agg(F.sum("n").alias("n"))
    merged = components(found.select("rep", "root").where("rep <> root").distinct(), "rep", "root").withColumnRenamed("node", "rep")
    settled = classes.select("h1", "h2", "rep", "size").join(counts, "rep", "left").join(merged, "rep", "left")
    settled = materialize(settled.select("h1", "h2", (F.col("size") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id")), "settled")
    known = ids.where("usable").join(settled, ["h1", "h2"]).select("key", "n_links", "component_id")
    alone = ids.where("not usable").select("key", F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component_id"))
    return known.unionByName(alone).select(F.col("key").alias(key_name(key, "n_links", "component_id", "kept")), "n_links", F.col("component_id").cast("long").alias("component_id"), F.col("key").eqNullSafe(F.col("component_id")).alias("kept"))
