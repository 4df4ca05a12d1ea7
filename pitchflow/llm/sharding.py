"""Sharding over fixed virtual slots with a versioned slot-to-shard map.

Every record hashes by its key into one of a fixed, large number of virtual slots. Bytes are
summed per slot, and a map from slots to shards is made from those sums and stored under a
version. Growing, shrinking or evening out shards only edits the map; records never rehash.
The map has one row per virtual slot whatever the size of the data, so it is the one thing that
is collected and broadcast.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pitchflow.llm.tables import fresh, free_name, materialize

N_SLOTS = 16_384
#: Parts into which each slot's rows are dealt to be numbered.
PARTS = 16


@dataclass(frozen=True)
class SlotMap:
    """Shard of each virtual slot, with the bytes and rows of the slot when the map was made."""

    version: int
    n_shards: int
    shard: list[int]
    size: list[int]
    rows: list[int] = field(default_factory=list)

    def loads(self) -> list[int]:
        out = [0] * self.n_shards
        for s, b in zip(self.shard, self.size, strict=True):
            out[s] += b
        return out


def virtual_slot(key: str, n_slots: int = N_SLOTS) -> Column:
    """A row's slot by its key; rows without a key are dealt by their place in the table."""
    return F.pmod(F.when(F.col(key).isNull(), F.xxhash64(F.monotonically_increasing_id())).otherwise(F.xxhash64(F.col(key))), F.lit(n_slots)).cast("int")


def slot_sums(df: DataFrame, slot: str, size: str, n_slots: int = N_SLOTS) -> tuple[list[int], list[int]]:
    """Bytes and rows of every slot; at most ``n_slots`` rows come to the driver."""
    size_of, rows_of = [0] * n_slots, [0] * n_slots
    sums = df.groupBy(F.col(slot).alias("s")).agg(F.sum(F.coalesce(F.col(size), F.lit(0))).alias("b"), F.count(F.lit(1)).alias("n"))
    for s, b, n in sums.collect():
        size_of[s], rows_of[s] = int(b), int(n)
    return size_of, rows_of


def plan_slots(size: list[int], n_shards: int, rows: list[int] | None = None) -> SlotMap:
    """Version 1: the heaviest slot goes to the lightest shard, again and again."""
    if n_shards < 1:
        raise ValueError("n_shards must be at least 1")
    rows = rows or [0] * len(size)
    shard, heap = [0] * len(size), [(0, 0, s) for s in range(n_shards)]
    for slot in sorted(range(len(size)), key=lambda i: (-size[i], i)):
        load, n, s = heapq.heappop(heap)
        shard[slot] = s
        heapq.heappush(heap, (load + size[slot], n + 1, s))
    return SlotMap(1, n_shards, shard, list(size), list(rows))


def rebalance(old: SlotMap, size: list[int] | None = None, n_shards: int | None = None, rows: list[int] | None = None) -> SlotMap:
    """The next version: edits as few slots as it can for new sizes or another number of shards.

    Slots of shards that no longer exist move first; then slots leave shards above the mean, the
    largest that still fits first, for the lightest shard, while that narrows the gap.
    """
    size, n = list(size or old.size), n_shards or old.n_shards
    shard, load, of = list(old.shard), [0] * n, [[] for _ in range(n)]
    moving = []
    for slot, s in enumerate(shard):
        if s < n:
            load[s] += size[slot]
            of[s].append(slot)
        else:
            moving.append(slot)
    heap = [(load[s], s) for s in range(n)]
    heapq.heapify(heap)
    for slot in sorted(moving, key=lambda i: (-size[i], i)):
        b, s = heapq.heappop(heap)
        shard[slot] = s
        of[s].append(slot)
        load[s] = b + size[slot]
        heapq.heappush(heap, (load[s], s))
    mean = sum(load) / n
    for s in sorted(range(n), key=lambda i: (-load[i], i)):
        for slot in sorted(of[s], key=lambda i: (-size[i], i)):
            to = min(range(n), key=lambda i: (load[i], i))
            if size[slot] and load[s] - size[slot] >= mean - size[slot] / 2 and load[to] + size[slot] < load[s]:
                shard[slot] = to
                load[s] -= size[slot]
                load[to] += size[slot]
    return SlotMap(old.version + 1, n, shard, size, list(rows or old.rows))


def save_map(spark: SparkSession, slot_map: SlotMap, path: str) -> None:
    """Adds the version to the map table at ``path``; an existing version is not overwritten."""
    rows = slot_map.rows or [0] * len(slot_map.shard)
    data = [(i, s, b, n, slot_map.n_shards) for i, (s, b, n) in enumerate(zip(slot_map.shard, slot_map.size, rows, strict=True))]
    frame = spark.createDataFrame(data, "virtual_slot int, shard int, bytes long, n_rows long, n_shards int")
    frame.coalesce(1).write.mode("error").parquet(f"{path}/version={slot_map.version}")


def load_map(spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
    """The given version of the map, or else the newest."""
    table = spark.read.parquet(path)
    if version is None:
        version = table.agg(F.max("version")).first()[0]
    got = table.where(F.col("version") == version).orderBy("virtual_slot").collect()
    if not got:
        raise ValueError(f"no version {version} of the slot map")
    return SlotMap(int(version), got[0]["n_shards"], [r["shard"] for r in got], [r["bytes"] for r in got], [r["n_rows"] for r in got])


def map_frame(spark: SparkSession, slot_map: SlotMap, slot: str, shard: str, base: str) -> DataFrame:
    """One row per virtual slot: its shard, and how many rows of the shard lie in lower slots."""
    at, data = [0] * slot_map.n_shards, []
    for i, (s, n) in enumerate(zip(slot_map.shard, slot_map.rows or [0] * len(slot_map.shard), strict=True)):
        data.append((i, s, at[s]))
        at[s] += n
    return spark.createDataFrame(data, f"`{slot}` int, `{shard}` int, `{base}` long")


def assign_shards(df: DataFrame, key: str, size: str, n_shards: int, *, n_slots: int = N_SLOTS, map_path: str | None = None, slot_map: SlotMap | None = None) -> DataFrame:
    """``df`` with ``shard``, ``slot`` (place within the shard, gapless from 0), ``virtual_slot``, ``map_version``.

    Rows hash by ``key`` into ``n_slots`` virtual slots. Without ``slot_map`` the map is made from
    the bytes per slot and, with ``map_path``, stored there as version 1. With ``slot_map`` that
    map (such as an edited later version) decides. ``df`` is read once and kept in the shared
    folder, so pass the columns that are wanted, not more.

    Null keys are dealt over all slots, and rows of a repeated key share one; a null size counts as 0; repeated rows get places of their own in an
    arbitrary order among themselves; an empty table gives no rows; columns of ``df`` named like
    the four new ones are replaced.
    """
    spark = df.sparkSession
    keyed = fresh(df, "shard", "slot", "virtual_slot", "map_version").withColumn("virtual_slot", virtual_slot(key, n_slots))
    kept = materialize(keyed, "slots")
    sizes, rows = slot_sums(kept, "virtual_slot", size, n_slots)
    if slot_map is None:
        slot_map = plan_slots(sizes, n_shards, rows)
        if map_path:
            save_map(spark, slot_map, map_path)
            slot_map = load_map(spark, map_path, 1)
    else:
        slot_map = SlotMap(slot_map.version, slot_map.n_shards, slot_map.shard, sizes, rows)
    base, part, place, before = (free_name(kept, x) for x in ("base", "part", "place", "before"))
    mapped = map_frame(spark, slot_map, "virtual_slot", "shard", base)
    # a slot holds about 1 / n_slots of the rows, but all rows of a repeated key: its rows are dealt into parts, which are counted first
    dealt = kept.withColumn(part, F.pmod(F.xxhash64(F.lit(1), *kept.columns), F.lit(PARTS)).cast("int"))
    counts = dealt.groupBy("virtual_slot", part).agg(F.count(F.lit(1)).alias("n"))
    lower = Window.partitionBy("virtual_slot").orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("virtual_slot", part, F.coalesce(F.sum("n").over(lower), F.lit(0)).alias(before))
    within = Window.partitionBy("virtual_slot", part).orderBy(F.col(key), F.col(size))
    placed = dealt.withColumn(place, F.row_number().over(within) - 1).join(starts, ["virtual_slot", part])
    return placed.join(F.broadcast(mapped), "virtual_slot").withColumn("slot", (F.col(base) + F.col(before) + F.col(place)).cast("long")).withColumn("map_version", F.lit(slot_map.version)).drop(base, part, place, before)


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard; each task writes to one shard's folder only."""
    sharded.repartition("shard", F.floor(F.col("slot") / 1_000_000)).write.partitionBy("shard").parquet(path)
