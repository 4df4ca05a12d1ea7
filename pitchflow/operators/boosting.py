"""Second-order boosted trees: histograms of gradients in one aggregate for each level, penalised leaves, a softmax over classes."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Bins of a feature at most; its edges are quantiles.
BINS = 64
#: Gradients are summed as whole numbers of this share, so no order of the sums changes a tree.
UNIT = float(1 << 24)
#: Margins are written every so many rounds; the trees since then are applied again.
WRITTEN = 8
#: Cells of a histogram that a task holds; larger ones are sent batch by batch.
CELLS = 1 << 21
#: A split has to gain more than this.
LEAST_GAIN = 1e-6

Tree = list[list[float]]  # a row for each node: feature (-1: leaf), last bin to the left, left child, value, gain


@dataclass
class Boosted:
    """Trees for one margin (two classes) or one margin a class, and the edges of the features' bins."""

    features: list[str]
    n_classes: int
    rate: float
    edges: list[list[float]]
    rounds: list[list[Tree]] = field(default_factory=list)

    @property
    def n_margins(self) -> int:
        return 1 if self.n_classes == 2 else self.n_classes

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, i], side="left") for i, e in enumerate(self.edges)], axis=1).astype(np.uint8)

    def margins(self, bins: np.ndarray, since: int = 0) -> np.ndarray:
        out = np.zeros((len(bins), self.n_margins))
        for trees in self.rounds[since:]:
            for m, tree in enumerate(trees):
                table = np.array(tree)
                out[:, m] += table[leaves(table, bins), 3]
        return out

    def probabilities(self) -> Column:
        """Class probabilities of a row, as an array."""

        @F.pandas_udf("array<double>")
        def told(x: pd.Series) -> pd.Series:
            return pd.Series(list(chances(self.margins(self.binned(np.stack(x.to_numpy()))))) if len(x) else [], dtype=object)

        return told(F.array(*[F.col(f).cast("double") for f in self.features]))

    def importances(self) -> list[float]:
        """The average gain of each feature's splits, as shares of one."""
        gains, n = np.zeros(len(self.features)), np.zeros(len(self.features))
        for node in (node for trees in self.rounds for tree in trees for node in tree if node[0] >= 0):
            gains[int(node[0])] += node[4]
            n[int(node[0])] += 1
        mean = gains / np.maximum(n, 1)
        return (mean / max(mean.sum(), 1e-300)).tolist()


def leaves(tree: np.ndarray, bins: np.ndarray) -> np.ndarray:
    """The node at which each row ends."""
    node = np.zeros(len(bins), np.int64)
    while True:
        feature = tree[node, 0].astype(np.int64)
        inside = np.flatnonzero(feature >= 0)
        if not len(inside):
            return node
        at = node[inside]
        node[inside] = tree[at, 2].astype(np.int64) + (bins[inside, feature[inside]] > tree[at, 1])


def chances(margins: np.ndarray) -> np.ndarray:
    if margins.shape[1] == 1:
        p = 1 / (1 + np.exp(-margins[:, 0]))
        return np.stack([1 - p, p], axis=1)
    e = np.exp(margins - margins.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def gradients(margins: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the log loss by each margin, in units."""
    p = chances(margins)
    if margins.shape[1] == 1:
        g, h = p[:, 1:] - label[:, None], p[:, 1:] * p[:, :1]
    else:
        g, h = p - (label[:, None] == np.arange(margins.shape[1])), 2 * p * (1 - p)
    return np.rint(g * UNIT).astype(np.int64), np.rint(h * UNIT).astype(np.int64)


def _prepared(df: DataFrame, model: Boosted, label: str) -> DataFrame:
    """Bins (a byte a feature), label and margins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = model.binned(batch.column(0).flatten().to_numpy().reshape(-1, len(model.features)))
            margins = np.zeros((len(bins), model.n_margins))
            yield _row(bins, batch.column(1), margins)

    return df.select(F.array(*[F.col(f).cast("double") for f in model.features]), F.col(label).cast("int")).mapInArrow(run, _ROW)


_ROW = "bins binary, label int, margins array<double>"


def _row(bins: np.ndarray, label: pa.Array, margins: np.ndarray) -> pa.RecordBatch:
    offsets = pa.array(np.arange(0, margins.size + 1, margins.shape[1]), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array([b.tobytes() for b in bins], pa.binary()), label, pa.ListArray.from_arrays(offsets, pa.array(margins.ravel()))], names=["bins", "label", "margins"])


def _read(batch: pa.RecordBatch, model: Boosted, since: int) -> tuple[np.ndarray, np.ndarray]:
    bins = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(-1, len(model.features))
    return bins, batch.column(2).flatten().to_numpy().reshape(-1, model.n_margins) + model.margins(bins, since)


def _moved(rows: DataFrame, model: Boosted, since: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins, margins = _read(batch, model, since)
            yield _row(bins, batch.column(1), margins)

    return rows.mapInArrow(run, _ROW)


def _histogram(rows: DataFrame, model: Boosted, since: int, trees: list[Tree], open_: list[list[int]]) -> DataFrame:
    """``tree``, ``node``, ``feature``, ``bin``, ``g``, ``h``: sums over the rows in the open nodes."""
    n_features = len(model.features)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [np.array(t) for t in trees]
        places = [np.full(len(t), -1) for t in trees]
        base, total = [], 0
        for m, nodes in enumerate(open_):
            places[m][nodes] = np.arange(len(nodes))
            base.append(total)
            total += len(nodes)
        names = [(m, n) for m, nodes in enumerate(open_) for n in nodes]
        size = total * n_features * BINS
        held = np.zeros((2, size), np.int64) if size <= CELLS else None

        def told(cells: np.ndarray, g: np.ndarray, h: np.ndarray) -> pa.RecordBatch:
            owner = np.array(names)[cells // (n_features * BINS)]
            return pa.RecordBatch.from_arrays([pa.array(owner[:, 0].astype(np.int32)), pa.array(owner[:, 1].astype(np.int32)), pa.array((cells // BINS % n_features).astype(np.int32)), pa.array((cells % BINS).astype(np.int32)), pa.array(g), pa.array(h)], names=["tree", "node", "feature", "bin", "g", "h"])

        for batch in batches:
            bins, margins = _read(batch, model, since)
            g, h = gradients(margins, batch.column(1).to_numpy())
            for m, table in enumerate(tables):
                place = places[m][leaves(table, bins)]
                here = np.flatnonzero(place >= 0)
                if not len(here):
                    continue
                cell = ((base[m] + place[here])[:, None] * n_features + np.arange(n_features)) * BINS + bins[here]
                cells, back = np.unique(cell.ravel(), return_inverse=True)
                sums = [np.rint(np.bincount(back, np.repeat(v[here, m], n_features))).astype(np.int64) for v in (g, h)]
                if held is None:
                    yield told(cells, *sums)
                else:
                    held[0, cells] += sums[0]
                    held[1, cells] += sums[1]
        if held is not None and (cells := np.flatnonzero(held.any(axis=0))).size:
            yield told(cells, held[0, cells], held[1, cells])

    sent = rows.mapInArrow(run, "tree int, node int, feature int, bin int, g long, h long")
    return sent.groupBy("tree", "node", "feature", "bin").agg((F.sum("g") / UNIT).alias("g"), (F.sum("h") / UNIT).alias("h"))


def _shrunk(g: Column, alpha: float) -> Column:
    return F.when(g > alpha, g - alpha).when(g < -alpha, g + alpha).otherwise(0.0)


def leaf_value(g: float, h: float, penalty: float, alpha: float) -> float:
    """The best value of a leaf: -g / (h + lambda), with g shrunk by alpha."""
    shrunk = g - alpha if g > alpha else g + alpha if g < -alpha else 0.0
    return -shrunk / (h + penalty) if h + penalty > 0 else 0.0


def _splits(cells: DataFrame, penalty: float, alpha: float, least: float) -> DataFrame:
    """One row for each open node: its sums, and the split that gains most (ties: first feature, first bin), if one gains."""
    of = Window.partitionBy("tree", "node", "feature")
    to_left = of.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = cells.select("*", F.sum("g").over(to_left).alias("gl"), F.sum("h").over(to_left).alias("hl"), F.sum("g").over(of).alias("gt"), F.sum("h").over(of).alias("ht"))
    score = lambda g, h: F.try_divide(_shrunk(g, alpha) * _shrunk(g, alpha), h + penalty)
    gr, hr = F.col("gt") - F.col("gl"), F.col("ht") - F.col("hl")
    gain = score(F.col("gl"), F.col("hl")) + score(gr, hr) - score(F.col("gt"), F.col("ht"))
    fits = (F.col("hl") >= least) & (hr >= least) & (hr > 0)
    told = both.withColumn("gain", F.when(fits & (gain > LEAST_GAIN), F.round(gain, 9)))
    best = F.max_by(F.struct("feature", "bin", "gl", "hl", "gain"), F.struct("gain", -F.col("feature"), -F.col("bin")))
    return told.groupBy("tree", "node").agg(best.alias("best"), F.max_by("gt", F.col("feature") * -1).alias("g"), F.max_by("ht", F.col("feature") * -1).alias("h"))


def fit(df: DataFrame, features: Sequence[str], n_classes: int, write, *, n_estimators: int = 100, max_depth: int = 6, learning_rate: float = 0.3, min_child_weight: float = 1, penalty: float = 1.0, alpha: float = 0.0, label: str = "label") -> Boosted:  # noqa: ANN001
    """Boosts on the rows of ``df`` (no nulls). ``write`` writes a table and reads it back.

    Each level of a round is one pass over bins and margins and one aggregate, whatever the number of nodes; of it only one row for
    each open node comes to the driver. ``penalty`` (lambda) and ``alpha`` shrink leaves, ``min_child_weight`` is the
    least sum of second derivatives of a child.
    """
    shares = [i / BINS for i in range(1, BINS)]
    found = df.agg(*[F.percentile_approx(F.col(f).cast("double"), shares, 10_000).alias(f"e{i}") for i, f in enumerate(features)]).first()
    model = Boosted(list(features), n_classes, learning_rate, [sorted(set(e)) for e in found])
    rows, since = write(_prepared(df, model, label)), 0
    for done in range(n_estimators):
        if done - since == WRITTEN:
            rows, since = write(_moved(rows, model, since)), done
        trees: list[Tree] = [[[-1, 0, 0, 0.0, 0.0]] for _ in range(model.n_margins)]
        open_: list[list[int]] = [[0] for _ in trees]
        for _ in range(max_depth):
            best = sorted(_splits(_histogram(rows, model, since, trees, open_), penalty, alpha, min_child_weight).collect(), key=lambda r: (r["tree"], r["node"]))
            open_ = [[] for _ in trees]
            for r in best:
                tree, b = trees[r["tree"]], r["best"]
                if b is None or b["gain"] is None:
                    tree[r["node"]][3] = learning_rate * leaf_value(r["g"], r["h"], penalty, alpha)
                    continue
                left = len(tree)
                tree[r["node"]] = [b["feature"], b["bin"], left, 0.0, b["gain"]]
                for g, h in ((b["gl"], b["hl"]), (r["g"] - b["gl"], r["h"] - b["hl"])):
                    open_[r["tree"]].append(len(tree))
                    tree.append([-1, 0, 0, learning_rate * leaf_value(g, h, penalty, alpha), 0.0])
            if not any(open_):
                break
        model.rounds.append(trees)
    return model
