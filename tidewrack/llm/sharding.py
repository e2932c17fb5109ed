"""Sharding by fixed virtual slots.

Records hash into thousands of slots; bytes and rows are added up per slot; a
versioned table maps slots to shards. Rebalancing edits that table and moves
whole slots, so it never touches a record that stays. The statistics and the
map have one row per slot, which the ``slots`` parameter bounds whatever the
corpus size: they are the only thing that the driver sees.
"""

from __future__ import annotations

import heapq
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewrack.session import scratch_folder

SLOTS = 4096


@dataclass(frozen=True)
class SlotMap:
    """A version of the map: the shard of each slot, and how many shards there are."""

    version: int
    shards: int
    shard_of: tuple[int, ...]


def with_slot(df: DataFrame, key: str, other: str, slots: int = SLOTS) -> DataFrame:
    """Add ``vslot``, the fixed virtual slot of ``key``; rows whose key is null spread by ``other``."""
    spread = F.when(F.col(key).isNull(), F.col(other))
    return df.withColumn("vslot", F.pmod(F.xxhash64(F.col(key), spread), F.lit(slots)).cast("int"))


def slot_stats(slotted: DataFrame, size: str) -> dict[int, tuple[int, int]]:
    """Bytes and rows per slot that has any; at most one row per slot reaches the driver."""
    rows = slotted.groupBy("vslot").agg(F.sum(size).alias("bytes"), F.count(F.lit(1)).alias("n")).collect()
    return {r.vslot: (int(r.bytes or 0), r.n) for r in rows}


def new_map(weights: dict[int, int], shards: int, slots: int = SLOTS) -> SlotMap:
    """Version 1: the heaviest slot goes to the lightest shard, again and again; ties go to the smaller number."""
    heap = [(0, 0, k) for k in range(shards)]
    shard_of = [0] * slots
    for slot in sorted(range(slots), key=lambda s: (-weights.get(s, 0), s)):
        load, held, shard = heapq.heappop(heap)
        shard_of[slot] = shard
        heapq.heappush(heap, (load + weights.get(slot, 0), held + 1, shard))
    return SlotMap(1, shards, tuple(shard_of))


def add_shard(old: SlotMap, weights: dict[int, int]) -> SlotMap:
    """The next version with one more shard, which takes slots only into itself.

    Each old shard gives up about its excess over the new mean: its slots are
    gone through from the heaviest, and one moves if it still fits the excess.
    """
    new = old.shards
    mean = sum(weights.values()) / (new + 1)
    load = [0] * new
    for slot, shard in enumerate(old.shard_of):
        load[shard] += weights.get(slot, 0)
    shard_of = list(old.shard_of)
    for slot in sorted(range(len(shard_of)), key=lambda s: (-weights.get(s, 0), s)):
        shard, weight = shard_of[slot], weights.get(slot, 0)
        if weight and load[shard] - weight >= mean:
            shard_of[slot] = new
            load[shard] -= weight
    return SlotMap(old.version + 1, new + 1, tuple(shard_of))


def save_map(spark: SparkSession, slot_map: SlotMap, path: str) -> None:
    """Store a version as Parquet under ``path``; versions stand beside one another and are never changed."""
    rows = [(slot_map.version, slot_map.shards, s, k) for s, k in enumerate(slot_map.shard_of)]
    spark.createDataFrame(rows, "version int, shards int, vslot int, shard int").coalesce(1).write.mode("overwrite").parquet(f"{path}/version={slot_map.version}/")


def load_map(spark: SparkSession, path: str, version: int) -> SlotMap:
    """Read a stored version; one row per slot."""
    rows = spark.read.parquet(f"{path}/version={version}/").orderBy("vslot").collect()
    return SlotMap(version, rows[0].shards, tuple(r.shard for r in rows))


def place(slotted: DataFrame, slot_map: SlotMap, stats: dict[int, tuple[int, int]], order: list) -> DataFrame:
    """Add ``shard`` and ``slot``, the record's place in its shard, gapless from 0.

    The place is the rows of the shard's earlier slots plus the rank within the
    record's own slot, so no window is wider than one slot.
    """
    spark = slotted.sparkSession
    ahead = [0] * slot_map.shards
    rows = []
    for vslot, shard in enumerate(slot_map.shard_of):
        rows.append((vslot, shard, ahead[shard]))
        ahead[shard] += stats.get(vslot, (0, 0))[1]
    mapped = F.broadcast(spark.createDataFrame(rows, "vslot int, shard int, ahead long"))  # one row per slot
    rank = F.row_number().over(Window.partitionBy("vslot").orderBy(*order))
    return slotted.withColumn("_rank", rank).join(mapped, "vslot").withColumn("slot", F.col("ahead") + F.col("_rank") - 1).drop("_rank", "ahead")


def shard_documents(docs: DataFrame, shards: int = 16, slots: int = SLOTS, map_path: str | None = None) -> DataFrame:
    """Put every document into one of ``shards`` shards of near-equal bytes.

    Columns: doc_id, size (UTF-8 bytes of the text, null: none, plus 1),
    text_crc32, law ('bytes'), shard, slot, grown_shard (null: the law is not
    'key'), vslot, map_version, next_shard (the shard after one more is added:
    unchanged, or the new one). Slots hash doc_id, so the documents of one text
    are a group that is spread over shards: a text that a third of all rows have
    cannot outweigh a shard. Rows with a null id spread by their text, repeated
    rows stay together, very long texts only weigh more, extra columns play no
    part, and an empty table gives an empty result. Without ``map_path`` the map
    goes to scratch, which ``drop_scratch`` deletes; name a durable folder to
    keep its versions.
    """
    spark = docs.sparkSession
    base = docs.select(
        F.col("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    slotted = with_slot(base, "doc_id", "text_crc32", slots)
    stats = slot_stats(slotted, "size")
    weights = {k: v[0] for k, v in stats.items()}
    first = new_map(weights, shards, slots)
    grown = add_shard(first, weights)
    if map_path is None:
        map_path = f"{scratch_folder(spark)}/slot-map-{uuid.uuid4().hex}"
    for version in (first, grown):
        save_map(spark, version, map_path)
    stored = load_map(spark, map_path, 1)
    after = spark.read.parquet(f"{map_path}/version=2/").select("vslot", F.col("shard").alias("next_shard"))
    placed = place(slotted, stored, stats, ["doc_id", "text_crc32", "size"]).join(F.broadcast(after), "vslot")  # one row per slot
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "vslot", F.lit(1).alias("map_version"), "next_shard",
    )
