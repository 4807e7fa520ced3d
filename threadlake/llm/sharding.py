"""Sharding by fixed virtual slots and a versioned slot-to-shard map.

Records are hashed into ``slots`` virtual slots, a number that never changes. Bytes are summed per slot (map-side first), the slots
are dealt to the shards, largest first to the emptiest, and the map is written as version 1. Rebalancing edits the map: slots move
from the fullest to the emptiest shard until the sizes are near equal, and the edited map is the next version.
Only the map, of fixed size, comes to the driver.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SLOTS = 4096
MAP = "slot int, shard int, bytes long, rows long"


def slot_of(key: Column, extra: Column, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(key, extra), F.lit(slots)).cast("int")


def first_map(weights: dict[int, tuple[int, int]], shards: int, slots: int = SLOTS) -> list[tuple[int, int, int, int]]:
    """Longest processing time first: each slot, largest first, goes to the shard with the fewest bytes."""
    heap = [(0, s) for s in range(shards)]
    out = []
    for slot in sorted(range(slots), key=lambda s: (-weights.get(s, (0, 0))[0], s)):
        size, rows = weights.get(slot, (0, 0))
        load, shard = heapq.heappop(heap)
        heapq.heappush(heap, (load + size, shard))
        out.append((slot, shard, size, rows))
    return sorted(out)


def rebalance(old: list[tuple[int, int, int, int]], weights: dict[int, tuple[int, int]], shards: int, tolerance: float = 0.01) -> list[tuple[int, int, int, int]]:
    """The next version of a map: new weights, possibly more shards, and as few moved slots as the tolerance allows.

    The largest slot that narrows the gap between the fullest and the emptiest shard moves, until the fullest is within
    ``tolerance`` of the mean or no move helps.
    """
    now = {slot: (shard, *weights.get(slot, (0, 0))) for slot, shard, _, _ in old}
    load = dict.fromkeys(range(shards), 0)
    for shard, size, _ in now.values():
        load[shard] += size
    mean = sum(load.values()) / shards
    while True:
        full, empty = max(load, key=lambda s: (load[s], -s)), min(load, key=lambda s: (load[s], s))
        if load[full] <= mean * (1 + tolerance) and load[empty] >= mean * (1 - tolerance):
            break
        room = load[full] - load[empty]
        fits = [(size, -slot) for slot, (shard, size, _) in now.items() if shard == full and 0 < size < room]
        if not fits:
            break
        size, slot = max((x for x in fits if x[0] <= room / 2), default=min(fits))
        now[-slot] = (empty, *now[-slot][1:])
        load[full] -= size
        load[empty] += size
    return [(slot, *what) for slot, what in sorted(now.items())]


def slot_weights(rows: DataFrame) -> dict[int, tuple[int, int]]:
    """Bytes and rows per slot, from columns slot and size; as many as there are slots come to the driver."""
    return {r["vslot"]: (r["b"], r["n"]) for r in rows.groupBy("vslot").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()}


def write_map(spark: SparkSession, rows: list[tuple[int, int, int, int]], path: str, version: int) -> DataFrame:
    """Store one version of the map below ``path``; earlier versions stay."""
    spark.createDataFrame(rows, MAP).coalesce(1).write.mode("overwrite").parquet(f"{path}/version={version}")
    return read_map(spark, path, version)


def read_map(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.schema(MAP).parquet(f"{path}/version={version}")


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """(doc_id, size, text_crc32, vslot) of each row: UTF-8 bytes plus 1, null having none; the slot is by id and checksum."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    return rows.withColumn("vslot", slot_of(F.col("doc_id"), F.col("text_crc32"), slots))


def assign(docs: DataFrame, path: str, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot, vslot) for each row, under the law that shards are of near equal bytes.

    ``slot`` is the row's place in its shard, gapless from 0. The map is stored as version 1 below ``path``. Null ids and texts, repeated
    rows and extra columns are fine; an empty table gives an empty result and a map of empty slots.
    """
    spark = docs.sparkSession
    rows = sized(docs, id_col, text_col, slots)
    table = first_map(slot_weights(rows), shards, slots)
    write_map(spark, table, path, 1)
    return placed(rows, table)


def placed(rows: DataFrame, table: list[tuple[int, int, int, int]]) -> DataFrame:
    """Rows with shard and place under a map. Places count through the shard's virtual slots in order; within one, by a window of bounded share."""
    spark = rows.sparkSession
    before: dict[int, int] = {}
    offsets = []
    for slot, shard, _, n in table:
        offsets.append((slot, shard, before.get(shard, 0)))
        before[shard] = before.get(shard, 0) + n
    known = F.broadcast(spark.createDataFrame(offsets, "vslot int, shard int, base long"))  # as many rows as there are slots
    order = Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size")
    at = rows.withColumn("within", F.row_number().over(order) - 1)
    return at.join(known, "vslot").select("doc_id", "size", "text_crc32", "shard", (F.col("base") + F.col("within")).cast("long").alias("slot"), "vslot")


def write_shards(docs: DataFrame, table: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> None:
    """The documents as one folder per shard. The map is small (one row per slot) and broadcast; a shard is written by many tasks."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    slot = slot_of(F.col(id_col), F.crc32(text), slots)
    docs.withColumn("_vslot", slot).join(F.broadcast(table.select(F.col("slot").alias("_vslot"), F.col("shard").alias("_shard"))), "_vslot").drop("_vslot").write.partitionBy("_shard").parquet(path)
