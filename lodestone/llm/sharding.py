"""Sharding through fixed virtual slots.

Records hash into thousands of slots that never change.  A versioned map sends slots to shards;
balancing edits the map and moves whole slots, so a record's slot is stable while shards change.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import stored

SLOTS = 4096


def virtual_slot(key: Column, otherwise: Column, slots: int = SLOTS) -> Column:
    """The slot of a record: its key's hash, or the hash of ``otherwise`` where the key is null."""
    hashed = F.when(key.isNull(), F.xxhash64(otherwise)).otherwise(F.xxhash64(key.cast("string")))
    return F.pmod(hashed, F.lit(slots)).cast("int")


@dataclass(frozen=True)
class SlotMap:
    """Version ``version`` of the slot-to-shard map; ``history`` holds (version, moved slots) of each edit."""

    version: int
    shards: int
    shard_of: tuple[int, ...]
    history: tuple[tuple[int, int], ...] = field(default=())

    @staticmethod
    def initial(shards: int, slots: int = SLOTS) -> SlotMap:
        return SlotMap(1, shards, tuple(s % shards for s in range(slots)))

    def rebalanced(self, slot_bytes: dict[int, int], shards: int | None = None) -> SlotMap:
        """The next version, whose shards differ in bytes by as little as moving whole slots allows.

        Slots move from the fullest shard to the emptiest while that narrows their gap: of the
        slots of the fullest, the one nearest half the gap.  Few slots move, most stay.  New shards
        start empty; slots of shards that are gone move first.
        """
        shards = shards or self.shards
        home = list(self.shard_of)
        load = [0] * shards
        held: list[set[int]] = [set() for _ in range(shards)]
        homeless = []
        for slot, shard in enumerate(home):
            if shard < shards:
                load[shard] += slot_bytes.get(slot, 0)
                held[shard].add(slot)
            else:
                homeless.append(slot)
        heap = [(b, s) for s, b in enumerate(load)]
        heapq.heapify(heap)
        for slot in sorted(homeless, key=lambda s: (-slot_bytes.get(s, 0), s)):
            bytes_, shard = heapq.heappop(heap)
            home[slot], load[shard] = shard, bytes_ + slot_bytes.get(slot, 0)
            held[shard].add(slot)
            heapq.heappush(heap, (load[shard], shard))
        while True:
            full, empty = max(range(shards), key=lambda s: (load[s], -s)), min(range(shards), key=lambda s: (load[s], s))
            gap = load[full] - load[empty]
            best = min((s for s in held[full] if 0 < slot_bytes.get(s, 0) < gap), key=lambda s: (abs(2 * slot_bytes[s] - gap), s), default=None)
            if best is None:
                break
            held[full].discard(best)
            held[empty].add(best)
            home[best] = empty
            load[full] -= slot_bytes[best]
            load[empty] += slot_bytes[best]
        moved = sum(a != b for a, b in zip(home, self.shard_of, strict=True))
        return SlotMap(self.version + 1, shards, tuple(home), (*self.history, (self.version + 1, moved)))

    def table(self, spark) -> DataFrame:
        """The map as rows (version, shards, virtual_slot, shard), to be written beside the data."""
        return spark.createDataFrame([(self.version, self.shards, s, h) for s, h in enumerate(self.shard_of)], "version int, shards int, virtual_slot int, shard int")

    def store(self, spark, path: str) -> None:
        """Add this version to the map stored at ``path``."""
        self.table(spark).coalesce(1).write.mode("append").parquet(path)

    @staticmethod
    def from_table(rows: DataFrame, version: int | None = None) -> SlotMap:
        """Read version ``version`` (the latest if None) back; a map has a fixed number of rows.

        ``history`` is counted from the stored versions up to this one.
        """
        version = version or rows.agg(F.max("version")).first()[0]
        held = rows.where(F.col("version") == version).collect()
        found = {r["virtual_slot"]: r["shard"] for r in held}
        before = rows.select((F.col("version") + 1).alias("version"), "virtual_slot", F.col("shard").alias("former"))
        moves = rows.where(F.col("version") <= version).join(before, ["version", "virtual_slot"]).groupBy("version").agg(F.count_if(F.col("shard") != F.col("former")).alias("moved"))
        return SlotMap(version, held[0]["shards"], tuple(found[s] for s in range(len(found))), tuple((r["version"], r["moved"]) for r in moves.orderBy("version").collect()))


def shard_records(records: DataFrame, size: Column, map_path: str, key: str = "doc_id", text: str = "text", shards: int = 8, slots: int = SLOTS, group_rows: int = 250_000) -> tuple[DataFrame, SlotMap]:
    """Assign every record to a shard; returns (assignment, edited map).

    The latest version of the map is read from ``map_path`` (version 1, which deals ``slots`` in turn, is
    stored there first if nothing is; a stored map's slots stay), edited for the bytes of these records and stored as the next
    version, which the assignment reads.

    The assignment has ``key``, ``size``, ``text_crc32``, ``virtual_slot``, ``shard``, ``map_version`` and
    ``slot``, the record's place in its shard, without gaps from 0.  Null keys hash by their text, so many
    of them spread.  Repeated rows are separate records.  An empty table gives no rows and an edited map
    without moves.  Records of one virtual slot are numbered in groups of about ``group_rows`` by a hash
    of key and text, so texts of one hot key spread; rows equal in both stay together.  What reaches the
    driver is a count and a sum for each virtual slot and a count for each group.
    """
    spark = records.sparkSession
    if not stored(spark, map_path):
        SlotMap.initial(shards, slots).store(spark, map_path)
    current = SlotMap.from_table(spark.read.parquet(map_path))
    slots = len(current.shard_of)
    rows = records.select(
        F.col(key), size.cast("long").alias("size"), F.crc32(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")).alias("text_crc32"),
        virtual_slot(F.col(key), F.coalesce(F.col(text).cast("string"), F.lit("")), slots).alias("virtual_slot"),
    )
    totals = rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).collect()  # at most one row a slot
    current.rebalanced({r["virtual_slot"]: r["bytes"] for r in totals}, shards).store(spark, map_path)
    edited = SlotMap.from_table(spark.read.parquet(map_path))
    groups = {r["virtual_slot"]: -(-r["n"] // group_rows) for r in totals if r["n"] > group_rows}
    of_slot = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for item in groups.items() for x in item]), F.col("virtual_slot")), F.lit(1)) if groups else F.lit(1)
    rows = rows.withColumn("group", F.pmod(F.xxhash64(key, "text_crc32"), of_slot).cast("int"))
    counts = {(r["virtual_slot"], r["group"]): r["count"] for r in rows.groupBy("virtual_slot", "group").count().collect()} if groups else {(r["virtual_slot"], 0): r["n"] for r in totals}
    starts, reached = [], [0] * edited.shards
    for (slot, group), count in sorted(counts.items()):
        shard = edited.shard_of[slot]
        starts.append((slot, group, shard, reached[shard]))
        reached[shard] += count
    places = F.broadcast(spark.createDataFrame(starts, "virtual_slot int, group int, shard int, start long"))  # slots + records / group_rows rows
    within = Window.partitionBy("virtual_slot", "group").orderBy(key, "text_crc32", "size")
    out = rows.withColumn("at", F.row_number().over(within)).join(places, ["virtual_slot", "group"])
    return out.select(key, "size", "text_crc32", "virtual_slot", "shard", (F.col("start") + F.col("at") - 1).alias("slot"), F.lit(edited.version).alias("map_version")), edited
