"""Sharding by fixed virtual slots.

A record's virtual slot is a hash of its id, taken modulo a number of slots that never changes. A
versioned map says which shard holds each slot; adding a shard, or evening out bytes, edits the map
and moves whole slots. Only DataFrame functions run on the records; the map has SLOTS rows.

The map is a stored table, a folder for each version, in the shared folder: a version that is there is read, and the next one is
written as an edit of the last. Versions of the law `key` add shards one by one; `rebalance` moves slots by bytes.

Nulls: a null id is a key like any other ("null"); a null text has no bytes and the checksum 0.
Repeated rows get places of their own. Places are given by ranges, so that an id of most rows is many tasks. Texts of any
length are read once, for their size and checksum, and not moved. Other columns are left alone, whatever their names. An empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import kept

SLOTS = 4096
SHARDS = 24
OVERHEAD = 8


def virtual_slot(key: Column, slots: int = SLOTS) -> Column:
    """The fixed slot of a key: the first 32 bits of the md5 of its text, modulo slots."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("null")).cast("binary")), 1, 8), 16, 10).cast("long") % slots


def slot_maps(shards: int, slots: int = SLOTS) -> list[list[int]]:
    """Versions 1 to shards of the map; version n spreads the slots over n shards.

    Each is the one before it, edited: the new shard takes slots, the highest first, from whichever
    shard has the most until it has its share. Nothing moves between older shards.
    """
    held = [list(range(slots))]
    versions = [[0] * slots]
    for n in range(2, shards + 1):
        new: list[int] = []
        while len(new) < slots // n:
            new.append(max(held, key=len).pop())
        held.append(sorted(new))
        now = list(versions[-1])
        for s in new:
            now[s] = n - 1
        versions.append(now)
    return versions


def rebalanced(now: list[int], slot_bytes: dict[int, int], shards: int) -> list[int]:
    """The next version of a map: slots move from the fullest to the emptiest shard while that narrows their gap."""
    out = list(now)
    load = [0] * shards
    for s, shard in enumerate(out):
        load[shard] += slot_bytes.get(s, 0)
    while True:
        full, empty = max(range(shards), key=lambda i: load[i]), min(range(shards), key=lambda i: load[i])
        gap = load[full] - load[empty]
        fit = [(abs(gap / 2 - slot_bytes.get(s, 0)), s) for s, shard in enumerate(out) if shard == full and 0 < slot_bytes.get(s, 0) < gap]
        if not fit:
            return out
        s = min(fit)[1]
        out[s] = empty
        load[full] -= slot_bytes[s]
        load[empty] += slot_bytes[s]


def map_table(spark: SparkSession, versions: dict[int, list[int]]) -> DataFrame:
    """(version, vslot, shard): the stored form of the map; a table of versions times SLOTS rows."""
    parts = [spark.range(len(m)).select(F.lit(v).alias("version"), F.col("id").alias("vslot"), F.element_at(F.lit(m), (F.col("id") + 1).cast("int")).cast("int").alias("shard")) for v, m in versions.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def _written(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def read_map(spark: SparkSession, path: str, version: int) -> DataFrame:
    """(version, vslot, shard) of a stored version."""
    return spark.read.schema("vslot long, shard int").parquet(f"{path}/version={version}").select(F.lit(version).alias("version"), "vslot", "shard")


def write_map(spark: SparkSession, path: str, version: int, shard_of: list[int]) -> None:
    map_table(spark, {version: shard_of}).drop("version").coalesce(1).write.mode("overwrite").parquet(f"{path}/version={version}")


def stored_maps(spark: SparkSession, path: str, shards: int, slots: int = SLOTS) -> DataFrame:
    """Versions `shards` and `shards` + 1 of the law `key`, as stored below path; those that are not there are written first."""
    missing = [v for v in (shards, shards + 1) if not _written(spark, f"{path}/version={v}")]
    if missing:
        versions = slot_maps(shards + 1, slots)
        for v in missing:
            write_map(spark, path, v, versions[v - 1])
    return read_map(spark, path, shards).unionAll(read_map(spark, path, shards + 1))


def rebalance(spark: SparkSession, path: str, version: int, sizes: DataFrame, shards: int, slots: int = SLOTS) -> int:
    """Reads a stored version, moves slots by the bytes of slot_sizes, and stores what comes out as the next version, whose number it returns.

    The driver sees a number for each of the fixed slots.
    """
    now = [0] * slots
    for r in read_map(spark, path, version).collect():
        now[r["vslot"]] = r["shard"]
    if _written(spark, f"{path}/version={version + 1}"):
        raise ValueError(f"version {version + 1} of the map is there")
    held = {r["vslot"]: r["slot_bytes"] for r in sizes.collect()}
    write_map(spark, path, version + 1, rebalanced(now, held, shards))
    return version + 1


def records(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(doc_id, size, text_crc32, vslot) of documents; nothing else of them is moved."""
    raw = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    return docs.select("doc_id", (F.octet_length(raw).cast("long") + OVERHEAD).alias("size"), F.crc32(raw).alias("text_crc32"), virtual_slot(F.col("doc_id"), slots).alias("vslot"))


def slot_sizes(rows: DataFrame) -> DataFrame:
    """(vslot, slot_rows, slot_bytes)."""
    return rows.groupBy("vslot").agg(F.count("*").alias("slot_rows"), F.sum("size").alias("slot_bytes"))


def shard_records(rows: DataFrame, maps: DataFrame, version: int) -> DataFrame:
    """rows (see records) with shard, slot (the place in the shard, from 0) and grown_shard.

    A place is the rows of the shard's earlier virtual slots plus the place in the own one. Rows are dealt out by ranges of (slot,
    id, checksum, size) and numbered as they stand; a slot's rows before a partition are an offset. So no task sorts a
    shard or a slot. The joined tables have a row for each of the fixed slots, and one more for each partition.
    """
    now = maps.where(F.col("version") == version).select("vslot", "shard")
    grown = maps.where(F.col("version") == version + 1).select("vslot", F.col("shard").alias("grown_shard"))
    before = Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1)
    starts = now.join(grown, "vslot").join(slot_sizes(rows), "vslot").withColumn("start", F.coalesce(F.sum("slot_rows").over(before), F.lit(0)))
    order = ["vslot", "doc_id", "text_crc32", "size", "tie"]
    dealt = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    # The number of a partition, and in the lower 33 bits a row's place in it.
    own = kept(dealt.drop("tie").withColumn("at", F.monotonically_increasing_id()))
    own = own.withColumns({"part": F.shiftright("at", 33), "at": F.col("at").bitwiseAND(F.lit((1 << 33) - 1))})
    runs = own.groupBy("part", "vslot").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    earlier = Window.partitionBy("vslot").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = runs.select("part", "vslot", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")).alias("shift"))
    placed = own.join(F.broadcast(shifts), ["part", "vslot"]).withColumn("place", F.col("at") + F.col("shift") + 1)
    return placed.join(F.broadcast(starts), "vslot").select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("start") + F.col("place") - 1).alias("slot"), "grown_shard",
        F.col("vslot").cast("long").alias("virtual_slot"), "slot_bytes", F.lit(version).alias("map_version"))
