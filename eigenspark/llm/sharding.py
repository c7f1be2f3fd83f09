"""Sharding by fixed virtual slots."""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, exists, partitions, shared_path

SLOTS = 4096
#: Rows of a virtual slot that one task numbers, about: at least so many, and 1 / (16 * partitions) of all rows.
ROWS = 1000


@dataclass(frozen=True)
class SlotMap:
    """A version of the map from virtual slots to shards."""

    version: int
    shards: int
    shard_of: tuple[int, ...]

    def frame(self, spark) -> DataFrame:
        """The map as a table: map_version, shards, vslot, shard."""
        return spark.createDataFrame([(self.version, self.shards, v, s) for v, s in enumerate(self.shard_of)], "map_version int, shards int, vslot int, shard int")

    def save(self, spark, path: str) -> None:
        """Appends this version to the store of all versions."""
        self.frame(spark).coalesce(1).write.mode("append").parquet(path)

    @staticmethod
    def load(spark, path: str, version: int | None = None) -> SlotMap:
        """A stored version, the last if none is given."""
        rows = spark.read.parquet(path)
        version = rows.agg(F.max("map_version")).first()[0] if version is None else version
        got = rows.where(F.col("map_version") == version).orderBy("vslot").collect()
        return SlotMap(version, got[0].shards, tuple(r.shard for r in got))


def even_map(weights: list[int], shards: int) -> SlotMap:
    """Deals out slots by falling weight, each to the lightest shard so far."""
    heap = [(0, s) for s in range(shards)]
    out = [0] * len(weights)
    for v in sorted(range(len(weights)), key=lambda v: (-weights[v], v)):
        load, s = heapq.heappop(heap)
        out[v] = s
        heapq.heappush(heap, (load + weights[v], s))
    return SlotMap(1, shards, tuple(out))


def rebalanced(old: SlotMap, weights: list[int], shards: int | None = None) -> SlotMap:
    """The next version: slots move only from shards above the mean to those below it, the largest that fit first.

    With more shards, the new ones start empty, so slots move into them alone unless old shards were uneven.  With fewer,
    the slots of those that are gone go to the lightest of the others first.
    """
    shards = old.shards if shards is None else shards
    out, load, homeless = list(old.shard_of), [0] * shards, []
    by_weight = sorted(range(len(out)), key=lambda v: (-weights[v], v))
    for v in by_weight:
        if out[v] < shards:
            load[out[v]] += weights[v]
        else:
            homeless.append(v)
    heap = [(load[s], s) for s in range(shards)]
    heapq.heapify(heap)
    for v in homeless:
        _, s = heapq.heappop(heap)
        out[v] = s
        load[s] += weights[v]
        heapq.heappush(heap, (load[s], s))
    mean = sum(load) / shards
    to = range(old.shards, shards) if shards > old.shards else range(shards)
    for v in by_weight:
        best = min(to, key=lambda s: (load[s], s))
        if load[out[v]] - weights[v] >= mean * 0.999 and load[best] + weights[v] <= mean * 1.001:
            load[out[v]] -= weights[v]
            load[best] += weights[v]
            out[v] = best
    return SlotMap(old.version + 1, shards, tuple(out))


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and a hash of the text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text, F.lit("group")).alias("text_hash"),
    )


#: Equal rows that are numbered by one task at a time.
COPIES = 10_000


def numbered(rows: DataFrame) -> DataFrame:
    """rows with a number that tells equal ones apart, whatever the layout of files."""
    same = rows.groupBy(*rows.columns).agg(F.count("*").alias("times"))
    some = same.withColumn("_from", F.explode(F.expr(f"sequence(0L, times - 1, {COPIES}L)")))
    some = some.repartition("doc_id", "text_hash", "_from")  # many copies are written by many tasks
    return some.withColumn("copy", F.explode(F.expr(f"sequence(_from, least(_from + {COPIES}, times) - 1)"))).drop("times", "_from")


def shard_rows(docs: DataFrame, shards: int = 16, slots: int = SLOTS, store: str | None = None) -> tuple[DataFrame, SlotMap, list[int]]:
    """Rows with their shard and place in it, the map, and the bytes of each virtual slot.

    Records are hashed by their text into virtual slots, so equal texts share a slot and a shard.  Only a group of equal
    texts that has more bytes than a shard's share is hashed by doc_id too, and so spread; there are fewer such groups
    than shards.  The map deals out slots by their bytes, so sizes of shards are near equal (law `bytes`).  It is
    stored under `store` (a new folder in the shared checkpoint folder unless given) and read from there; where versions
    are stored already, the last one is edited for the bytes at hand and stored as the next.  slot is the place in the shard,
    from 0, by virtual slot and doc_id; slots of many rows are numbered in parts, dealt by id, text
    and a number for repeated rows, so that no place depends on the layout of files.  Null and
    empty texts count 1 byte, texts of any length their UTF-8 bytes; null ids and repeated rows are rows like others; an
    empty table gives an empty result; other columns don't matter.
    """
    spark = docs.sparkSession
    rows = checkpointed(sized(docs))
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    share = total / shards - 2 * total / slots  # what such a group shares its slot with comes on top
    large = rows.groupBy("text_hash").agg(F.sum("size").alias("b")).where((F.col("b") > share) & (F.col("b") > 1)).select("text_hash", F.lit(True).alias("large"))
    rows = rows.join(F.broadcast(large), "text_hash", "left")  # about as many rows as shards, at most
    rows = rows.withColumn("vslot", F.when(F.col("large"), F.pmod(F.xxhash64("text_hash", "doc_id"), F.lit(slots))).otherwise(F.pmod("text_hash", F.lit(slots))).cast("int"))
    weights, counts = [0] * slots, [0] * slots
    for r in rows.groupBy("vslot").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect():  # at most `slots` rows
        weights[r.vslot], counts[r.vslot] = r.b, r.n
    old = None
    if store is None:
        store = shared_path(spark, "slot-map-")
    elif exists(spark, store):
        old = SlotMap.load(spark, store)
    (even_map(weights, shards) if old is None else rebalanced(old, weights, shards)).save(spark, store)
    chosen = SlotMap.load(spark, store)
    most = max(ROWS, sum(counts) // (16 * partitions(docs)))
    split = {v: -(-n // most) for v, n in enumerate(counts) if n > most}  # parts of slots with many rows
    placed = rows.withColumn("part", F.lit(0))
    if split:
        parts = F.create_map(*[F.lit(x) for v, n in split.items() for x in (v, n)])[F.col("vslot")]
        many = numbered(rows.where(F.col("vslot").isin(list(split))))
        many = many.withColumn("part", F.pmod(F.xxhash64("doc_id", "text_crc32", "size", "copy"), parts).cast("int")).drop("copy")
        placed = checkpointed(placed.where(~F.col("vslot").isin(list(split))).unionByName(many))
    rows = placed
    pieces = {(v, 0): n for v, n in enumerate(counts) if v not in split}
    if split:
        pieces |= {(r.vslot, r.part): r.n for r in rows.where(F.col("vslot").isin(list(split))).groupBy("vslot", "part").agg(F.count("*").alias("n")).collect()}  # at most 17 * partitions more than slots
    before, filled = [], [0] * chosen.shards
    for (v, p), n in sorted(pieces.items()):
        s = chosen.shard_of[v]
        before.append((v, p, s, filled[s]))
        filled[s] += n
    places = spark.createDataFrame(before, "vslot int, part int, shard int, before long")
    order = Window.partitionBy("vslot", "part").orderBy("doc_id", "text_crc32", "size")
    out = rows.withColumn("nth", F.row_number().over(order)).join(F.broadcast(places), ["vslot", "part"])
    out = out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("nth") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.col("vslot").alias("virtual_slot"), F.lit(chosen.version).alias("map_version"))
    return out, chosen, weights
