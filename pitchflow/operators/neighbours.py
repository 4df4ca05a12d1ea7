"""Exact nearest neighbours of any number of queries, by pivots and the triangle inequality, and their votes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pitchflow.operators.tables import written

#: Queries, rows and numbers of a vector that are compared at once; they bound memory.
QUERIES, ROWS, NUMBERS = 256, 256, 64
#: Pivots of the vectors of one length, a stated sample; rows of a cell and queries of a cell that meet in one group.
PIVOTS, CELL_ROWS, CELL_QUERIES = 64, 4_096, 32_768
#: Of so many rows, times the numbers of their vectors, one is a pivot within its cell, so that inner cells do not grow with the table.
INNER_ROWS = 512
#: Bounds are widened by this share, far beyond what rounding can do.
SLACK = 1e-9


def _usable(vector: str) -> Column:
    return F.col(vector).isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))


def _distances(a: np.ndarray, b: np.ndarray, p: int) -> np.ndarray:
    """Minkowski distances of all rows of ``a`` to all of ``b``; the same for a pair whatever else is compared with it."""
    out = np.zeros((len(a), len(b)))
    for i in range(0, len(a), QUERIES):
        for j in range(0, len(b), ROWS):
            for at in range(0, a.shape[1], NUMBERS):
                gap = np.abs(a[i : i + QUERIES, None, at : at + NUMBERS] - b[None, j : j + ROWS, at : at + NUMBERS])
                out[i : i + QUERIES, j : j + ROWS] += gap.sum(axis=2) if p == 1 else (gap**p).sum(axis=2)
    return out if p == 1 else out ** (1 / p)


def _matrices(batch: pa.RecordBatch, column: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """The batch by length of its vectors, each part with them as a matrix."""
    lists = batch.column(column)
    lengths = np.diff(lists.offsets.to_numpy())
    for n in np.unique(lengths).tolist():
        some = batch.take(pa.array(np.flatnonzero(lengths == n)))
        yield some, some.column(column).flatten().to_numpy().reshape(-1, n)


class Cells:
    """What is known of the cells: by length of the vectors the pivots, how far each cell reaches, its rows, and its rows' smallest distances to the pivot.

    ``inner``: the cells that each cell is dealt to in its turn; ``first``: the number of the first of them.
    """

    def __init__(self, pivots: dict[int, np.ndarray]):
        self.pivots = pivots
        self.reach = {n: np.full(len(v), -1.0) for n, v in pivots.items()}
        self.rows = {n: np.zeros(len(v), np.int64) for n, v in pivots.items()}
        self.near: dict[int, list[list[float]]] = {n: [[] for _ in v] for n, v in pivots.items()}
        self.inner: dict[int, list[Cells]] = {}
        self.first: dict[int, np.ndarray] = {}

    def divide(self, pivots: dict[tuple[int, int], list[list[float]]]) -> None:
        """Gives each cell its inner cells: one around its own pivot and those around more pivots."""
        for n, own in self.pivots.items():
            self.inner[n] = [Cells({n: np.array([v.tolist(), *pivots.get((n, c), [])])}) for c, v in enumerate(own)]
            self.first[n] = np.cumsum([0, *[len(i.pivots[n]) for i in self.inner[n]]])

    def place(self, n: int, leaf: int) -> tuple[int, "Cells", int]:
        """The cell of an inner cell's number, its inner cells, and the place in them."""
        cell = int(np.searchsorted(self.first[n], leaf, "right")) - 1
        return cell, self.inner[n][cell], leaf - int(self.first[n][cell])

    def meeting(self, x: np.ndarray, k: int, p: int, everywhere: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which queries meet which inner cells; those marked look at all."""
        n = x.shape[1]
        d = _distances(x, self.pivots[n], p)
        home, limit = d.argmin(axis=1), self.limits(d, n, k)
        for c in np.unique(home).tolist():
            inner, some = self.inner[n][c], np.flatnonzero(home == c)
            limit[some] = np.minimum(limit[some], inner.limits(_distances(x[some], inner.pivots[n], p), n, k))
        limit[everywhere] = np.inf
        reached, rows, leaves = self.reached(d, n, limit), [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for c in np.flatnonzero(reached.any(axis=0)).tolist():
            inner, some = self.inner[n][c], np.flatnonzero(reached[:, c])
            row, leaf = np.nonzero(inner.reached(_distances(x[some], inner.pivots[n], p), n, limit[some]))
            rows.append(some[row])
            leaves.append(leaf + self.first[n][c])
        return np.concatenate(rows), np.concatenate(leaves)

    def limits(self, d: np.ndarray, n: int, k: int) -> np.ndarray:
        """No k-th neighbour is farther: by the triangle inequality each cell's rows nearest to its pivot are not. One more counts, as a query may be a row."""
        cell = np.array([c for c, near in enumerate(self.near[n]) for _ in near], np.int64)
        near = np.array([x for found in self.near[n] for x in found])
        if len(near) <= k:
            return np.full(len(d), np.inf)
        return np.partition(d[:, cell] + near, k, axis=1)[:, k] * (1 + SLACK) + SLACK

    def reached(self, d: np.ndarray, n: int, limit: np.ndarray) -> np.ndarray:
        """Which cells may hold a row within the limit: those whose rows' ring comes near enough, and whose side of the bisector does."""
        limit = limit[:, None] * (1 + SLACK) + SLACK
        return (self.rows[n] > 0) & (d - self.reach[n] <= limit) & ((d - d.min(axis=1, keepdims=True)) / 2 <= limit)


def _dealt(known: DataFrame, cells: Cells, p: int) -> DataFrame:
    """``known`` with its inner cell: that of the nearest pivot in the cell of the nearest pivot, and the distances to both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some, x in _matrices(batch, "vector"):
                n = x.shape[1]
                d = _distances(x, cells.pivots[n], p)
                best = d.argmin(axis=1)
                leaf, away = np.zeros(len(x), np.int64), np.zeros(len(x))
                for c in np.unique(best).tolist():
                    own = np.flatnonzero(best == c)
                    within = _distances(x[own], cells.inner[n][c].pivots[n], p)
                    leaf[own], away[own] = within.argmin(axis=1) + cells.first[n][c], within.min(axis=1)
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(np.full(len(x), n, np.int32)), pa.array(leaf.astype(np.int32)), pa.array(away), pa.array(best.astype(np.int32)), pa.array(d[np.arange(len(x)), best])], names=[*batch.schema.names, "length", "cell", "away", "outer", "outer_away"])

    return known.mapInArrow(run, "key long, vector array<double>, label long, length int, cell int, away double, outer int, outer_away double")


def _cells(known: DataFrame, k: int, p: int) -> tuple[Cells, DataFrame]:
    """The cells of the rows and the rows in them. To the driver come ``PIVOTS`` vectors for each length and one of ``INNER_ROWS`` times the length, and k + 1 distances for each of these."""
    first = F.row_number().over(Window.partitionBy("length").orderBy(F.xxhash64("key"), "key"))
    chosen = known.withColumn("length", F.size("vector")).withColumn("place", first).where(F.col("place") <= PIVOTS).select("length", "vector").collect()
    pivots: dict[int, list[list[float]]] = {}
    for r in chosen:
        if r["vector"] not in pivots.setdefault(r["length"], []):
            pivots[r["length"]].append(r["vector"])
    cells = Cells({n: np.array(v) for n, v in pivots.items()})
    inner: dict[tuple[int, int], list[list[float]]] = {}
    mixed = F.pmod(F.xxhash64(F.lit("inner"), "key", "vector"), F.size("vector") * INNER_ROWS)
    for r in known.where(mixed == 0).select("vector").distinct().orderBy("vector").collect():
        v = np.array([r["vector"]])
        inner.setdefault((v.shape[1], int(_distances(v, cells.pivots[v.shape[1]], p).argmin())), []).append(r["vector"])
    cells.divide(inner)
    dealt = written(_dealt(known, cells, p))

    def told(cell: str, away: str) -> DataFrame:
        near = F.row_number().over(Window.partitionBy("length", cell).orderBy(away))
        nearest = dealt.select("length", cell, away).withColumn("place", near).where(F.col("place") <= k + 1).groupBy("length", cell).agg(F.array_agg(away).alias("near"))
        return dealt.groupBy("length", cell).agg(F.max(away).alias("reach"), F.count(F.lit(1)).alias("n")).join(nearest, ["length", cell])

    for r in told("outer", "outer_away").collect():
        cells.reach[r["length"]][r["outer"]], cells.rows[r["length"]][r["outer"]], cells.near[r["length"]][r["outer"]] = r["reach"], r["n"], r["near"]
    for r in told("cell", "away").collect():
        _, own, i = cells.place(r["length"], r["cell"])
        own.reach[r["length"]][i], own.rows[r["length"]][i], own.near[r["length"]][i] = r["reach"], r["n"], r["near"]
    return cells, dealt.drop("outer", "outer_away")


def _sent(queries: DataFrame, cells: Cells, k: int, p: int) -> DataFrame:
    """``query``, ``vector``, ``length``, ``cell`` of every cell that may hold one of the query's k nearest rows. Queries whose key several rows have look everywhere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some, x in _matrices(batch, "vector"):
                n = x.shape[1]
                if n not in cells.pivots:
                    continue
                row, cell = cells.meeting(x, k, p, some.column("repeated").to_numpy(zero_copy_only=False))
                for at in range(0, len(row), 10_000):
                    r, c = row[at : at + 10_000], cell[at : at + 10_000]
                    picked = some.take(pa.array(r))
                    yield pa.RecordBatch.from_arrays([picked.column("query"), picked.column("vector"), pa.array(np.full(len(r), n, np.int32)), pa.array(c.astype(np.int32))], names=["query", "vector", "length", "cell"])

    return queries.select("query", "vector", "repeated").mapInArrow(run, "query long, vector array<double>, length int, cell int")


def _met(both: DataFrame, k: int, p: int) -> DataFrame:
    """The k best of each query in each group; a group's rows come before its queries, which stream by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, keys, labels, rows = None, [], [], []
        matrix = None
        for batch in batches:
            groups = np.stack([batch.column(c).to_numpy() for c in ("length", "cell", "row_part", "query_part", "is_query")], axis=1)
            edges = np.flatnonzero(np.concatenate([[True], (groups[1:] != groups[:-1]).any(axis=1)]))
            for low, high in zip(edges.tolist(), [*edges[1:].tolist(), len(groups)]):
                group, is_query = tuple(groups[low, :4].tolist()), groups[low, 4]
                if group != now:
                    now, keys, labels, rows, matrix = group, [], [], [], None
                some = batch.slice(low, high - low)
                x = some.column("vector").flatten().to_numpy().reshape(high - low, -1)
                if not is_query:
                    keys.append(some.column("key").to_numpy())
                    labels.append(some.column("label").to_numpy(zero_copy_only=False).astype(np.int64))
                    rows.append(x)
                    continue
                if not rows:
                    continue
                if matrix is None:
                    matrix, k_all, l_all = np.concatenate(rows), np.concatenate(keys), np.concatenate(labels)
                for at in range(0, len(x), QUERIES):
                    yield from _best(some.column("key").to_numpy()[at : at + QUERIES], x[at : at + QUERIES], k_all, l_all, matrix, k, p)

    ordered = both.repartition("length", "cell", "row_part", "query_part").sortWithinPartitions("length", "cell", "row_part", "query_part", "is_query")
    return ordered.mapInArrow(run, "query long, neighbour long, label long, distance double")


def _best(q: np.ndarray, points: np.ndarray, keys: np.ndarray, labels: np.ndarray, x: np.ndarray, k: int, p: int) -> Iterator[pa.RecordBatch]:
    d = _distances(points, x, p)
    d[q[:, None] == keys[None, :]] = np.inf
    # all that may be among the k best, ties included, are put in order
    last = min(k, d.shape[1]) - 1
    row, column = np.nonzero((d <= np.partition(d, last, axis=1)[:, last : last + 1]) & np.isfinite(d))
    order = np.lexsort((keys[column], d[row, column], row))
    row, column = row[order], column[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    row, column = row[place < k], column[place < k]
    yield pa.RecordBatch.from_arrays([pa.array(q[row]), pa.array(keys[column]), pa.array(labels[column]), pa.array(d[row, column])], names=["query", "neighbour", "label", "distance"])


def nearest(rows: DataFrame, queries: DataFrame, k: int, *, key: str, vector: str, label: str, p: int = 2) -> DataFrame:
    """``query``, ``rank``, ``neighbour``, ``label``, ``distance``: the k nearest rows of each query but itself, exactly.

    Rows are dealt to the nearest of some pivots, and in its cell to the nearest of more. How far the cells reach, and the smallest distances to their pivots, bound how far a
    query's k-th neighbour can be, so most cells need not be looked at (for any Minkowski distance). Query and row
    meet in groups of bounded size: rows of a large cell, and the queries of a popular one, are dealt to several groups; each
    sends a query's k best, which are merged. Ties go to the smaller key. Only vectors of one length meet; rows and queries whose
    key, label or vector is null, or whose vector is empty or holds nulls or what is not finite, have no neighbours. Rows with the query's
    key count as the query itself.
    """
    known = rows.where(F.col(key).isNotNull() & F.col(label).isNotNull() & _usable(vector)).select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("vector"), F.col(label).cast("long").alias("label"))
    stated = queries.where(F.col(key).isNotNull() & _usable(vector)).select(F.col(key).cast("long").alias("query"), F.col(vector).cast("array<double>").alias("vector"))
    cells, dealt = _cells(known, k, p)
    repeated = known.groupBy("key").count().where("count > 1").select(F.col("key").alias("query"), F.lit(True).alias("repeated"))
    sent = written(_sent(stated.join(repeated, "query", "left").withColumn("repeated", F.coalesce("repeated", F.lit(False))), cells, k, p))
    sizes = {(n, int(cells.first[n][c]) + i): (int(r), 1) for n, all_ in cells.inner.items() for c, own in enumerate(all_) for i, r in enumerate(own.rows[n].tolist())}
    for r in sent.groupBy("length", "cell").agg(F.count(F.lit(1)).alias("n")).collect():  # one row for each pivot
        sizes[r["length"], r["cell"]] = sizes[r["length"], r["cell"]][0], r["n"]
    parts = [(n, c, -(-max(r, 1) // CELL_ROWS), -(-q // CELL_QUERIES)) for (n, c), (r, q) in sizes.items()]
    table = F.broadcast(rows.sparkSession.createDataFrame(parts, "length int, cell int, row_parts int, query_parts int"))  # one row for each pivot
    part = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    mine = dealt.join(table, ["length", "cell"]).withColumn("row_part", F.pmod(F.xxhash64("key", "away"), F.col("row_parts")).cast("int")).withColumn("query_part", every("query_parts"))
    theirs = sent.join(table, ["length", "cell"]).withColumn("query_part", part("query", "query_parts")).withColumn("row_part", every("row_parts"))
    columns = ["length", "cell", "row_part", "query_part", "is_query", "key", "label", "vector"]
    both = mine.withColumn("is_query", F.lit(0)).select(columns).unionByName(theirs.withColumns({"is_query": F.lit(1), "label": F.lit(None).cast("long")}).withColumnRenamed("query", "key").select(columns))
    ranked = _met(both, k, p).withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("distance", "neighbour")))
    return ranked.where(F.col("rank") <= k).select("query", "rank", "neighbour", "label", "distance")


def knn_vote(neighbours: DataFrame, weights: str = "uniform") -> DataFrame:
    """``query``, ``prediction``, ``votes``: the label with most votes; ties go to the smaller label."""
    weight = F.lit(1.0) if weights == "uniform" else F.try_divide(F.lit(1.0), F.col("distance"))
    votes = neighbours.groupBy("query", "label").agg(F.sum(F.coalesce(weight, F.lit(1e12))).alias("votes"))
    return votes.groupBy("query").agg(F.max_by(F.struct("label", "votes"), F.struct("votes", -F.col("label"))).alias("best")).select("query", F.col("best.label").alias("prediction"), F.col("best.votes").alias("votes"))
