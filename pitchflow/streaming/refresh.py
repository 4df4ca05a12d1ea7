"""Incremental refresh: a stream of rows folded into a keyed table, each micro-batch once; every commit is a snapshot."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from pitchflow.operators.documents import last_per_key
from pitchflow.sources.stores import _Folder

#: Batches that wait beside the folded table until they are folded into it.
WAITING = 8


class KeyedTable(_Folder):
    """A table of the last row per key: a folded part, batches that wait to be folded, and a manifest that names them.

    A batch counts from the commit of the manifest on. A batch that comes again, after a failure, replaces itself while it
    waits and is passed over once it is folded, so nothing counts twice. Readers see one version, before or after a commit;
    they read the folded part and at most ``waiting`` batches, however many came before.
    """

    def __init__(self, spark: SparkSession, root: str, key: str, order: Sequence[str], waiting: int = WAITING):
        super().__init__(spark, root)
        self.key, self.order, self.waiting = key, list(order), waiting

    def upsert(self, batch: DataFrame, number: int) -> bool:
        """Commits a batch; False if it is folded already."""
        now = self.read_json("manifest") or {"folded": None, "upto": -1, "batches": {}, "schema": batch.schema.json()}
        if number <= now["upto"]:
            return False
        now["batches"][str(number)] = self._write(last_per_key(batch, self.key, self.order))
        self.write_json("manifest", now)
        if len(now["batches"]) >= self.waiting:
            self.fold()
        return True

    def fold(self) -> None:
        """Folds the waiting batches into the table, which is written anew, and commits that."""
        now = self.read_json("manifest")
        if now and now["batches"]:
            folded = self._write(self.table())
            self.write_json("manifest", now | {"folded": folded, "upto": max(map(int, now["batches"])), "batches": {}})
        self._clear()

    def table(self, version: int | None = None) -> DataFrame | None:
        """The last row of each key as of the newest commit, or of a kept one; None before the first."""
        now = self.read_json("manifest") if version is None else json.loads(self._text(f"manifest/v{version}"))
        if not now:
            return None
        schema = StructType.fromJson(json.loads(now["schema"]))
        parts = [f"{self.root}/{x}" for x in (now["folded"], *now["batches"].values()) if x]
        rows = [self.spark.read.schema(schema).parquet(p) for p in parts]
        return last_per_key(reduce(DataFrame.unionByName, rows), self.key, self.order)

    def _write(self, df: DataFrame) -> str:
        name = f"data/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{name}")
        return name

    def _clear(self) -> None:
        """Deletes what no kept version names."""
        kept = set()
        for v in self.versions("manifest"):
            now = json.loads(self._text(f"manifest/v{v}"))
            kept |= {x for x in (now["folded"], *now["batches"].values()) if x}
        for name in self._names("data"):
            if f"data/{name}" not in kept:
                self.delete(f"data/{name}")


def upsert_stream(stream: DataFrame, table: str, key: str, order: Sequence[str], checkpoint: str, *, each: Callable[[DataFrame], DataFrame] | None = None, waiting: int = WAITING) -> StreamingQuery:
    """Folds the last row per key of each micro-batch into the ``KeyedTable`` at ``table``; ``latest`` reads it.

    ``each`` works on a batch first: with ``pages.match_documents`` pages become documents while they come in, and every
    commit is a snapshot of the documents so far.
    """
    kept = KeyedTable(stream.sparkSession, table, key, order, waiting)
    return stream.writeStream.foreachBatch(lambda batch, number: kept.upsert(each(batch) if each else batch, number) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, table: str, key: str, order: Sequence[str]) -> DataFrame | None:
    """The keyed table as of the newest commit."""
    return KeyedTable(spark, table, key, order).table()


def windowed_counts(stream: DataFrame, time: str, kind: str, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    return stream.withWatermark(time, late).groupBy(F.window(time, size).alias("w"), F.col(kind)).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), kind, "n")


def windowed_table(stream: DataFrame, time: str, kind: str, table: str, checkpoint: str, **settings: str) -> StreamingQuery:
    """Counts per window and kind, as of each micro-batch, into ``table``/batch=N; ``latest`` by batch gives the newest."""

    def fold(batch: DataFrame, number: int) -> None:
        batch.withColumn("seen", F.lit(number)).write.mode("overwrite").parquet(f"{table}/batch={number}")

    counts = windowed_counts(stream, time, kind, **settings)
    return counts.writeStream.foreachBatch(fold).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
