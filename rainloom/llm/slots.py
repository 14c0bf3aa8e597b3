"""Sharding through fixed virtual slots and a versioned slot-to-shard map.

A record belongs to one of SLOTS virtual slots for ever; only the small map from slots to shards changes.
A new map deals the slots out by their bytes, the largest first; rebalancing edits the stored map, moving as
few slots as bring the shards near the mean, and stores it as the next version.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from rainloom.llm.common import query, split_repeats, table, text_or_empty
from rainloom.session import cut_lineage, new_folder

SLOTS = 4096
MAP = "version int, virtual_slot int, shard int, bytes long, rows long"


def with_slot(records: DataFrame, *key: str, slots: int = SLOTS) -> DataFrame:
    """Column virtual_slot in 0..slots-1 by a hash of the key columns (nulls hash too)."""
    return records.withColumn("virtual_slot", F.pmod(F.xxhash64(*key), F.lit(slots)).cast("int"))


def slot_sizes(records: DataFrame) -> dict[int, tuple[int, int]]:
    """Bytes and rows of each slot that holds records: at most SLOTS entries, summed before the shuffle."""
    got = records.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).collect()
    return {r["virtual_slot"]: (r["bytes"], r["rows"]) for r in got}


def deal(sizes: dict[int, tuple[int, int]], shards: int, slots: int = SLOTS) -> dict[int, int]:
    """A first map: the largest slot goes to the emptiest shard, ties to the smaller number."""
    heap, out = [(0, 0, k) for k in range(shards)], {}
    for slot in sorted(range(slots), key=lambda s: (-sizes.get(s, (0, 0))[0], s)):
        used, held, shard = heapq.heappop(heap)
        out[slot] = shard
        heapq.heappush(heap, (used + sizes.get(slot, (0, 0))[0], held + 1, shard))
    return out


def rebalance(old: dict[int, int], sizes: dict[int, tuple[int, int]], shards: int, slack: float = 0.02) -> dict[int, int]:
    """Edit a map for new sizes or a new number of shards: slots leave closed or overfull shards only, and go to the emptiest."""
    size = lambda s: sizes.get(s, (0, 0))[0]
    out, load, loose = dict(old), [0] * shards, []
    for slot, shard in sorted(old.items()):
        if shard < shards:
            load[shard] += size(slot)
        else:
            loose.append(slot)
    mean = sum(map(size, old)) / shards
    if not loose and max(load) <= mean * (1 + slack) and min(load) >= mean * (1 - slack):
        return out
    for shard in range(shards):
        for slot in sorted((s for s, k in old.items() if k == shard and size(s)), key=lambda s: (-size(s), s)):
            if load[shard] - size(slot) < mean:
                continue
            load[shard] -= size(slot)
            loose.append(slot)
    heap = [(used, k) for k, used in enumerate(load)]
    heapq.heapify(heap)
    for slot in sorted(loose, key=lambda s: (-size(s), s)):
        used, shard = heapq.heappop(heap)
        out[slot] = shard
        heapq.heappush(heap, (used + size(slot), shard))
    return out


def store_map(spark: SparkSession, folder: str, version: int, shard_of: dict[int, int], sizes: dict) -> DataFrame:
    """Write one version of the map; earlier versions stay readable beside it."""
    rows = [(version, s, k, *sizes.get(s, (0, 0))) for s, k in sorted(shard_of.items())]
    spark.createDataFrame(rows, MAP).coalesce(1).write.mode("error").parquet(f"{folder}/version={version}")
    return load_map(spark, folder, version)


def load_map(spark: SparkSession, folder: str, version: int) -> DataFrame:
    return spark.read.schema(MAP.split(", ", 1)[1]).parquet(f"{folder}/version={version}")


def place(records: DataFrame, shard_map: DataFrame, *order: str) -> DataFrame:
    """Shard and gapless position `slot` in it; positions follow the slot and then `order`.

    Rows are numbered inside their virtual slot only; where a slot begins in its shard comes from the rows of
    the slots before it, over the map of SLOTS rows. Records alike in all order columns may swap places.
    """
    w = W.partitionBy("shard").orderBy("virtual_slot").rowsBetween(W.unboundedPreceding, -1)
    held = records.groupBy("virtual_slot").agg(F.count("*").alias("_rows"))
    starts = shard_map.select("virtual_slot", "shard").join(held, "virtual_slot").withColumn("_start", F.coalesce(F.sum("_rows").over(w), F.lit(0))).drop("_rows")
    n = F.row_number().over(W.partitionBy("virtual_slot").orderBy(*order))
    return records.withColumn("_n", n).join(starts, "virtual_slot").withColumn("slot", F.col("_start") + F.col("_n") - 1).drop("_n", "_start")


@query("op2_virtual_slots")
def virtual_slots(spark, sf, shards: int = 8):
    """All documents into shards of near equal bytes through a map that was edited for their sizes.

    Version 1 of the map deals the slots out evenly, before any size is known; version 2 rebalances it. A document's
    slot follows doc_id and text digest, so equal texts under other ids may lie in other shards; rows repeated wholly
    are counted and go to slots in parts. Null ids and texts are rows like others, an empty table gives none; other
    columns are not looked at. Positions follow the slot, then doc_id (null first), text digest and size.
    """
    text = text_or_empty()
    docs = table(spark, sf, "documents").select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    docs = cut_lineage(with_slot(split_repeats(docs), "doc_id", "text_crc32", "part"))
    sizes = slot_sizes(docs)
    folder = new_folder(spark, "slots")
    even = {s: s % shards for s in range(SLOTS)}
    store_map(spark, folder, 1, even, {})
    shard_map = store_map(spark, folder, 2, rebalance(even, sizes, shards, slack=0.0), sizes)
    out = place(docs, shard_map, "doc_id", "text_crc32", "size")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long"), F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")
