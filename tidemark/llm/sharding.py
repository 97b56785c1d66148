"""Sharding over fixed virtual slots.

A record's virtual slot is a hash of its id and text checksum, modulo a fixed
number of slots in the thousands.  A map of a version assigns each slot to a shard:
the first version of a query deals the slots out in turn; ``rebalanced`` edits a map after the
bytes per slot, moves slots from the heaviest shard to the lightest and no slot that
may stay.  The maps are small tables of as many rows as there are slots, each
version written once.

A slot that holds more than ``HOT`` of a shard's mean bytes (rows that are equal in
id and text, or very long texts) is marked as spread in the map, and stays marked in
later versions: its records are hashed over all slots by their row number too, which
is stored with the records before anything depends on it.  So no slot weighs more
than a record or two beyond its share, and equal records are dealt out evenly.

A record's size is the UTF-8 bytes of its text (null: none) plus 1.  ``slot`` is
its place inside its shard, from 0 without gaps: its rank in its virtual slot's part
after the rows of the shard's earlier parts.  Ids may be null or repeat; texts may
be null, empty or very long (only their size and checksum leave the scan); an empty
table gives an empty one; columns other than doc_id and text play no part.

The records pass through one shuffle, by virtual slot and part, without their
texts.  The driver sees one row per part of a virtual slot.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.runtime import Durable

#: Virtual slots; parts of a slot, for places; share of a shard's mean bytes beyond which a slot is spread; by how much of it shards may differ.
SLOTS, PARTS, HOT, FINE = 4096, 16, 1 / 64, 0.002


@dataclass(frozen=True)
class SlotMap:
    version: int
    shards: int
    shard_of: tuple[int, ...]
    spread: frozenset[int] = frozenset()

    @classmethod
    def dealt(cls, shards: int, slots: int = SLOTS) -> SlotMap:
        """A first map before any bytes are known: the slots in turn."""
        return cls(1, shards, tuple(slot % shards for slot in range(slots)))

    @classmethod
    def first(cls, sizes: dict[int, int], shards: int, slots: int = SLOTS) -> SlotMap:
        """A first map by known bytes: the largest slots first, always to the lightest shard."""
        heap = [(0, shard) for shard in range(shards)]
        out = [0] * slots
        for slot in sorted(range(slots), key=lambda s: (-sizes.get(s, 0), s)):
            load, shard = heapq.heappop(heap)
            out[slot] = shard
            heapq.heappush(heap, (load + sizes.get(slot, 0), shard))
        return cls(1, shards, tuple(out))

    def spreading(self, sizes: dict[int, int], hot: float = HOT) -> SlotMap:
        """The next version, in which slots of too many bytes are spread too."""
        limit = hot * sum(sizes.values()) / self.shards
        more = {s for s, size in sizes.items() if size > limit}
        return self if more <= self.spread else SlotMap(self.version + 1, self.shards, self.shard_of, self.spread | more)

    def rebalanced(self, sizes: dict[int, int], shards: int, tolerance: float = 0.02) -> SlotMap:
        """The next version: slots of shards that are gone move, then slots move from the heaviest shard to the lightest until these differ by no more than a share of the mean, or no move helps."""
        out, load = list(self.shard_of), [0] * shards
        members: list[list[int]] = [[] for _ in range(shards)]
        loose = []
        for slot, shard in enumerate(out):
            if shard < shards:
                load[shard] += sizes.get(slot, 0)
                members[shard].append(slot)
            else:
                loose.append(slot)
        for slot in sorted(loose, key=lambda s: (-sizes.get(s, 0), s)):
            to = min(range(shards), key=lambda s: (load[s], s))
            out[slot], load[to] = to, load[to] + sizes.get(slot, 0)
            members[to].append(slot)
        for _ in range(len(out)):
            high, low = max(range(shards), key=lambda s: (load[s], -s)), min(range(shards), key=lambda s: (load[s], s))
            gap = load[high] - load[low]
            if gap * shards <= tolerance * sum(load):
                break
            fits = [s for s in members[high] if 0 < sizes.get(s, 0) < gap]
            if not fits:
                break
            slot = min(fits, key=lambda s: (abs(gap / 2 - sizes.get(s, 0)), s))
            members[high].remove(slot)
            members[low].append(slot)
            out[slot], load[high], load[low] = low, load[high] - sizes[slot], load[low] + sizes[slot]
        return SlotMap(self.version + 1, shards, tuple(out), self.spread)

    def save(self, spark: SparkSession, folder: str) -> str:
        """Write this version; an existing version is never written again."""
        path = f"{folder.rstrip('/')}/v{self.version:06d}"
        rows = [(self.version, self.shards, slot, shard, slot in self.spread) for slot, shard in enumerate(self.shard_of)]
        spark.createDataFrame(rows, "version int, shards int, vslot int, shard int, spread boolean").coalesce(1).write.parquet(path)
        return path

    @classmethod
    def load(cls, spark: SparkSession, folder: str, version: int) -> SlotMap:
        rows = spark.read.parquet(f"{folder.rstrip('/')}/v{version:06d}").orderBy("vslot").collect()
        return cls(version, rows[0].shards, tuple(r.shard for r in rows), frozenset(r.vslot for r in rows if r.spread))


def records(documents: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and row number of each document."""
    crc = F.crc32(F.col("text").cast("binary"))
    return documents.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1).alias("size"), crc.alias("text_crc32"), F.monotonically_increasing_id().alias("row"))


def slotted(rows: DataFrame, by: SlotMap) -> DataFrame:
    """The records with their virtual slot and its part."""
    slots = len(by.shard_of)
    slot = F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(slots)).cast("int")
    if by.spread:
        flags = F.lit(bytes(s in by.spread for s in range(slots)))
        again = F.pmod(F.xxhash64("doc_id", "text_crc32", "row"), F.lit(slots)).cast("int")
        slot = F.when(F.substring(flags, slot + 1, F.lit(1)) == F.lit(b"\1"), again).otherwise(slot)
    part = F.pmod(F.xxhash64("row", "text_crc32"), F.lit(PARTS)).cast("int")
    return rows.withColumn("vslot", slot).withColumn("part", part)


def slot_sizes(rows: DataFrame) -> dict[int, int]:
    """The bytes of each virtual slot."""
    return {r.vslot: r.bytes for r in rows.groupBy("vslot").agg(F.sum("size").alias("bytes")).collect()}


def assign(rows: DataFrame, by: SlotMap) -> DataFrame:
    """The slotted records with their shard by a map, and their place in it."""
    spark = rows.sparkSession
    held = {(r.vslot, r.part): r.n for r in rows.groupBy("vslot", "part").agg(F.count(F.lit(1)).alias("n")).collect()}
    at, starts = [0] * by.shards, []
    for slot, part in sorted(held):
        shard = by.shard_of[slot]
        starts.append((slot, part, shard, at[shard]))
        at[shard] += held[slot, part]
    placed = spark.createDataFrame(starts, "vslot int, part int, shard int, start long")  # slots times parts at most
    rank = F.row_number().over(Window.partitionBy("vslot", "part").orderBy("doc_id", "text_crc32", "row"))
    return rows.withColumn("_rank", rank).join(F.broadcast(placed), ["vslot", "part"]).withColumn("slot", F.col("start") + F.col("_rank") - 1).drop("_rank", "start", "part", "row")


def shard(documents: DataFrame, shards: int, folder: str, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, vslot, shard and slot of each document; the versions of the map are stored in a folder."""
    spark = documents.sparkSession
    rows = Durable(spark, "sharding").write(records(documents), "records")
    by = SlotMap.dealt(shards, slots)
    by.save(spark, folder)
    sizes = slot_sizes(slotted(rows, by))
    spread = by.spreading(sizes)
    if spread is not by:
        by, sizes = spread, slot_sizes(slotted(rows, spread))
        by.save(spark, folder)
    by = by.rebalanced(sizes, shards, FINE)
    by.save(spark, folder)
    return assign(slotted(rows, SlotMap.load(spark, folder, by.version)), by)
