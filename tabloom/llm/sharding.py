"""Sharding by fixed virtual slots with a versioned slot-to-shard map."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import Scratch, read, text_of

SLOTS = 4096
SHARDS = 16
TOLERANCE = 0.0005


def even_map(slots: int, shards: int) -> list[int]:
    """Version 1: slots dealt in turn."""
    return [s % shards for s in range(slots)]


def rebalance(load: list[int], owner: list[int], shards: int, tolerance: float = TOLERANCE) -> list[int]:
    """Edit a map until shards hold near equal bytes, moving as few slots as the greedy rule needs.

    Each step moves one slot from the heaviest shard to the lightest: the slot whose bytes come
    nearest to half the gap. It ends when the gap is within `tolerance` of the mean or when no
    slot of the heaviest shard is smaller than the gap. Works on `len(load)` numbers only.
    """
    owner = list(owner)
    total = [0] * shards
    members: list[set[int]] = [set() for _ in range(shards)]
    for slot, shard in enumerate(owner):
        total[shard] += load[slot]
        members[shard].add(slot)
    goal = tolerance * sum(total) / shards
    while True:
        heavy = max(range(shards), key=lambda i: (total[i], -i))
        light = min(range(shards), key=lambda i: (total[i], i))
        gap = total[heavy] - total[light]
        fitting = [s for s in members[heavy] if 0 < load[s] < gap]
        if gap <= goal or not fitting:
            return owner
        slot = min(fitting, key=lambda s: (abs(2 * load[s] - gap), s))
        members[heavy].remove(slot)
        members[light].add(slot)
        total[heavy] -= load[slot]
        total[light] += load[slot]
        owner[slot] = light


def grow(load: list[int], owner: list[int], shards: int) -> list[int]:
    """Edit a map for one more shard: slots only move into the new one, from the heaviest first."""
    owner = list(owner)
    total = [0] * (shards + 1)
    for slot, shard in enumerate(owner):
        total[shard] += load[slot]
    goal = sum(total) / (shards + 1)
    for slot in sorted(range(len(owner)), key=lambda s: (-load[s], s)):
        if total[owner[slot]] - load[slot] >= goal and total[shards] + load[slot] <= goal:
            total[owner[slot]] -= load[slot]
            total[shards] += load[slot]
            owner[slot] = shards
    return owner


def assign_shards(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS) -> tuple[DataFrame, DataFrame]:
    """Shard every document; returns (assignment, map).

    A document's virtual slot is a hash of its id and text modulo `slots`. Bytes are summed per
    slot, the even map is edited until shards weigh near the same, and both versions are written
    as the map table (version, slot, shard, bytes) that later rebalancing starts from.

    Assignment: doc_id, size (UTF-8 bytes + 1), text_crc32, virtual_slot, shard, position (the
    document's place in its shard, from 0 without gaps).
    Null texts weigh 1 and have the checksum of the empty text; null ids are hashed by their
    text alone; repeated rows share a slot and take places next to each other; an empty table
    gives no rows. Other columns of `docs` are not read.
    """
    spark = docs.sparkSession
    text = text_of(F.col("text"))
    hashed = Scratch(spark).keep(
        docs.select(
            F.col("doc_id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.pmod(F.xxhash64(F.col("doc_id"), text), F.lit(slots)).cast("int").alias("virtual_slot"),
        ),
        "slots",
    )
    sums = hashed.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).collect()
    load, rows = [0] * slots, [0] * slots
    for r in sums:  # at most `slots` rows
        load[r["virtual_slot"]], rows[r["virtual_slot"]] = r["bytes"], r["rows"]
    first = even_map(slots, shards)
    second = rebalance(load, first, shards)
    filled, offset = [0] * shards, []
    for slot, shard in enumerate(second):
        offset.append(filled[shard])
        filled[shard] += rows[slot]
    versions = [(v, s, owner[s], load[s]) for v, owner in ((1, first), (2, second)) for s in range(slots)]
    table = Scratch(spark).keep(
        spark.createDataFrame(versions, "version int, slot int, shard int, bytes long").coalesce(1), "slot-map"
    )
    lookup = spark.createDataFrame(
        [(s, second[s], offset[s]) for s in range(slots)], "virtual_slot int, shard int, _offset long"
    )
    inside = Window.partitionBy("virtual_slot").orderBy(F.col("doc_id").asc_nulls_last(), "text_crc32", "size")
    placed = (
        hashed.withColumn("_rank", F.row_number().over(inside))
        .join(F.broadcast(lookup), "virtual_slot")
        .withColumn("position", (F.col("_offset") + F.col("_rank") - 1).cast("long"))
        .drop("_offset", "_rank")
    )
    return placed, table


def op8_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed, _ = assign_shards(read(spark, sf_dir, "documents"))
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        F.col("position").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "virtual_slot",
    )
