"""Shards from fixed virtual slots and a versioned map of slots to shards.

A record's slot is a hash of its key modulo a fixed number of slots.  Which
shard holds a slot is written in a map; growing the cluster or evening out
sizes edits the map and makes its next version, so only whole slots move.

Rows are placed by the latest version in the map's folder.  Their bytes are
added up by slot, and if shards are uneven, an edited map is stored as the
next version, by which the next call places rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch

SLOTS = 1 << 14
SHARDS = 24
#: Sub-groups of a slot's rows for numbering: no sort holds more than such a part of one key's rows.
PARTS = 64
RECORD_BYTES = 8


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """A key's virtual slot: the first 60 bits of the MD5 of its text; a null key counts as empty text."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long"), F.lit(slots)).cast("int")


@dataclass(frozen=True)
class SlotMap:
    """Version and owner of each slot."""

    version: int
    shards: int
    owner: tuple[int, ...]

    @staticmethod
    def initial(shards: int, slots: int = SLOTS) -> SlotMap:
        """Version 1: slots dealt in turn."""
        if not 1 <= shards <= slots:
            raise ValueError(f"from 1 to {slots} shards")
        return SlotMap(1, shards, tuple(s % shards for s in range(slots)))

    def grown(self) -> SlotMap:
        """One more shard; it takes an even share of slots from the shards that have most, and nothing else moves."""
        owner, held = list(self.owner), self._held()
        for _ in range(len(owner) // (self.shards + 1)):
            giver = max(range(self.shards), key=lambda s: (len(held[s]), -s))
            owner[held[giver].pop()] = self.shards
        return SlotMap(self.version + 1, self.shards + 1, tuple(owner))

    def rebalanced(self, sizes: dict[int, int], tolerance: float = 0.02) -> SlotMap:
        """Move slots from the fullest to the emptiest shard while that lowers the difference; ``sizes``: bytes by slot."""
        owner, held = list(self.owner), self._held()
        load = [sum(sizes.get(s, 0) for s in held[k]) for k in range(self.shards)]
        goal = max(1, sum(load) / self.shards)
        moved = False
        for _ in range(len(owner)):
            high, low = max(range(self.shards), key=lambda s: (load[s], -s)), min(range(self.shards), key=lambda s: (load[s], s))
            room = load[high] - load[low]
            fit = [s for s in held[high] if 0 < sizes.get(s, 0) < room]
            if room <= tolerance * goal or not fit:
                break
            slot = min(fit, key=lambda s: (abs(room / 2 - sizes[s]), s))
            held[high].remove(slot)
            held[low].append(slot)
            owner[slot], moved = low, True
            load[high] -= sizes[slot]
            load[low] += sizes[slot]
        return SlotMap(self.version + 1, self.shards, tuple(owner)) if moved else self

    def _held(self) -> list[list[int]]:
        held: list[list[int]] = [[] for _ in range(self.shards)]
        for slot, shard in enumerate(self.owner):
            held[shard].append(slot)
        return held

    def save(self, spark: SparkSession, path: str) -> None:
        """Write this version below ``path``; one that is already there is an error, so no version is ever changed."""
        rows = [(self.version, self.shards, s, k) for s, k in enumerate(self.owner)]
        spark.createDataFrame(rows, "version int, shards int, slot int, shard int").coalesce(1).write.mode("errorifexists").parquet(_version_path(path, self.version))

    @staticmethod
    def load(spark: SparkSession, path: str, version: int) -> SlotMap:
        rows = spark.read.parquet(_version_path(path, version)).orderBy("slot").collect()
        return SlotMap(version, rows[0]["shards"], tuple(r["shard"] for r in rows))

    @staticmethod
    def versions(spark: SparkSession, path: str) -> list[int]:
        """Versions that have been written whole below ``path``, in order; none if there is no such folder."""
        jvm = spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(path)
        fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(folder):
            return []
        names = [x.getPath() for x in fs.listStatus(folder)]
        return sorted(int(m[1]) for x in names if (m := re.fullmatch(r"v(\d+)", x.getName())) and fs.exists(jvm.org.apache.hadoop.fs.Path(x, "_SUCCESS")))

    @staticmethod
    def latest(spark: SparkSession, path: str, shards: int, slots: int = SLOTS) -> SlotMap:
        """The last version below ``path``; where there is none, the initial one, which is written."""
        found = SlotMap.versions(spark, path)
        if not found:
            first = SlotMap.initial(shards, slots)
            first.save(spark, path)
            return first
        last = SlotMap.load(spark, path, found[-1])
        if (last.shards, len(last.owner)) != (shards, slots):
            raise ValueError(f"version {last.version} of the map has {last.shards} shards and {len(last.owner)} slots")
        return last


def _version_path(path: str, version: int) -> str:
    return f"{path}/v{version:08d}"


def slot_bytes(rows: DataFrame) -> DataFrame:
    """(virtual_slot, rows, bytes) of rows with ``virtual_slot`` and ``size``, for each slot that has rows.

    Repeated rows count each time; an empty table gives no slots.
    """
    return rows.groupBy("virtual_slot").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"))


def shard(docs: DataFrame, scratch: Scratch, folder: str, shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """``doc_id, size, text_crc32, virtual_slot, slot_bytes, shard, slot, grown_shard, balanced_shard`` of each row of ``docs`` (doc_id, text).

    ``shard`` is by the latest version of the map below ``folder`` (the initial
    one if there is none), ``grown_shard`` by that with one more shard,
    ``balanced_shard`` by that edited so that shards have about the same bytes,
    which is stored as the next version if a slot moves.  So as long as no
    version is added, doc_id and the number of shards decide ``shard``.
    ``slot`` is the row's place in its shard, gapless from 0; ``slot_bytes``
    are the bytes of its virtual slot.  Size: UTF-8 bytes of the text (null:
    none) and 8.  A null doc_id is a key like any other; rows with the same
    doc_id share a shard and have places of their own.  An empty table gives
    no rows and stores no further version; other columns are left out, so
    their names don't matter.  The driver gets the bytes of each slot, of
    which there are ``slots`` at most.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + F.lit(RECORD_BYTES)).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        slot_of(F.col("doc_id"), slots).alias("virtual_slot"),
        (F.spark_partition_id() % PARTS).alias("part"),
    )
    rows = rows.withColumn("part", F.pmod(F.col("part") + F.col("text_crc32"), F.lit(PARTS)).cast("int"))
    rows = scratch.stage(rows)

    now = SlotMap.latest(scratch.spark, folder, shards, slots)
    sizes = {r["virtual_slot"]: r["bytes"] for r in slot_bytes(rows).collect()}
    grown, even = now.grown(), now.rebalanced(sizes)
    if even is not now:
        even.save(scratch.spark, folder)
    table = [(k, sizes.get(k, 0), now.owner[k], grown.owner[k], even.owner[k]) for k in range(slots)]
    owners = scratch.stage(scratch.spark.createDataFrame(table, "virtual_slot int, slot_bytes long, shard int, grown_shard int, balanced_shard int").coalesce(1))

    each = rows.groupBy("virtual_slot", "part").agg(F.count("*").alias("k")).join(F.broadcast(owners), "virtual_slot")
    # One row for each slot and part: at most slots * PARTS of them, however many records there are.
    before = "coalesce(sum(k) over (partition by shard order by virtual_slot, part rows between unbounded preceding and 1 preceding), 0)"
    places = each.select(*owners.columns, "part", F.expr(before).alias("before"))
    inside = F.expr("row_number() over (partition by virtual_slot, part order by doc_id, text_crc32, size) - 1")
    out = rows.withColumn("inside", inside).join(places, ["virtual_slot", "part"])
    return out.select("doc_id", "size", "text_crc32", "virtual_slot", "slot_bytes", "shard", (F.col("before") + F.col("inside")).cast("long").alias("slot"), "grown_shard", "balanced_shard")
