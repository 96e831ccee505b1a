"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Each shard has ``vnodes`` points on a ring of 65,536 positions; a key belongs to the next point clockwise.
A shard's load is bounded: the bounds add up to the number of rows and differ by one at most, so keys that
find their shard full go on clockwise and the result is balanced exactly (law ``rows``). The walk is made
on the number of keys of each arc (as many numbers as there are points), which gives for the ranks of an
arc the shard and slot. A row's rank follows from its key's position, then from a hash of key, size and checksum,
so it does not depend on the files it came in; only equal rows, which can't be told apart, are numbered by task.
Ranks are sums of counts, so no shard, arc or copied key meets in one task, and all of it is native.

Growing from k to k + 1 shards lowers every bound and adds ``vnodes`` points: rows move from each old shard
by about 1 / (k + 1) of its load, beside overflow that changes its way.

Defined results: a null text has 0 bytes (size 1, crc32 0); a null key has one fixed position; repeated
rows and keys are rows of their own; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

RING = 1 << 16


def points(shards: int, vnodes: int) -> list[tuple[int, int]]:
    """(position, shard) of all virtual nodes, clockwise."""
    return sorted((int.from_bytes(hashlib.sha256(f"{s}/{v}".encode()).digest()[:2], "big"), s) for s in range(shards) for v in range(vnodes))


def walk(counts: dict[int, int], ring: list[tuple[int, int]], shards: int) -> list[tuple[int, int, int, int, int]]:
    """(arc, first rank, end rank, shard, first slot): where the keys of each arc go.

    Keys of an arc meet its point first; those that don't fit go to the next point clockwise before the
    keys of the next arc do, until all have a place.
    """
    total = sum(counts.values())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    taken, out, carry = [0] * shards, [], []
    for turn in range(shards * len(ring) + 1):
        if turn >= len(ring) and not carry:
            break
        arc = turn % len(ring)
        if turn < len(ring) and counts.get(arc):
            carry.append((arc, 0, counts[arc]))
        shard, rest = ring[arc][1], []
        for origin, a, b in carry:
            n = min(b - a, room[shard] - taken[shard])
            if n:
                out.append((origin, a, a + n, shard, taken[shard]))
                taken[shard] += n
            if a + n < b:
                rest.append((origin, a + n, b))
        carry = rest
    return out


def shard(docs: DataFrame, key: str = "doc_id", text: str = "text", shards: int = 16, vnodes: int = 64) -> DataFrame:
    """key, size, text_crc32, shard and slot of every row."""
    spark = docs.sparkSession
    ring = points(shards, vnodes)
    arcs, at = [], 0
    for position in range(RING):
        while at < len(ring) and ring[at][0] < position:
            at += 1
        arcs.append((position, at % len(ring)))
    of = F.broadcast(spark.createDataFrame(arcs, "position int, arc int"))  # RING rows always
    rows = docs.select(
        F.col(key).alias("key"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.encode(F.col(text), "UTF-8"), F.lit(b""))).alias("text_crc32"),
        F.shiftrightunsigned(F.xxhash64(F.col(key).cast("string")), 48).cast("int").alias("position"),
        F.spark_partition_id().alias("task"),
    ).withColumn("turn", F.xxhash64(F.col("key").cast("string"), "text_crc32", "size"))
    rows = rows.withColumn("sub", F.shiftrightunsigned("turn", 52).cast("int"))  # parts that the rows of one key are dealt to
    rows = materialize(rows, "shard-rows")
    per = rows.groupBy("position", "sub", "turn", "task").agg(F.count("*").alias("n"))
    before = lambda n, by, order: F.sum(n).over(Window.partitionBy(*by).orderBy(order)) - F.col(n)
    equal = per.groupBy("position", "sub", "turn").agg(F.sum("n").alias("m"))
    subs = equal.groupBy("position", "sub").agg(F.sum("m").alias("m")).select("position", "sub", before("m", ["position"], "sub").alias("part"))
    place = per.groupBy("position").agg(F.sum("n").alias("n")).join(of, "position")  # at most RING rows
    totals = {r.arc: r.n for r in place.groupBy("arc").agg(F.sum("n").alias("n")).collect()}  # at most shards * vnodes rows
    place = F.broadcast(place.select("position", "arc", before("n", ["arc"], "position").alias("place")))
    base = per.select("position", "sub", "turn", "task", before("n", ["position", "sub", "turn"], "task").alias("copy"))
    base = base.join(equal.select("position", "sub", "turn", before("m", ["position", "sub"], "turn").alias("row")), ["position", "sub", "turn"])
    base = base.join(subs, ["position", "sub"]).join(place, "position").drop("sub")
    runs = spark.createDataFrame(walk(totals, ring, shards), "arc int, first long, end long, shard int, slot0 long")
    local = F.row_number().over(Window.partitionBy("position", "turn", "task").orderBy("text_crc32")) - 1
    ranked = rows.withColumn("local", local).join(base, ["position", "turn", "task"]).withColumn("rank", F.col("place") + F.col("part") + F.col("row") + F.col("copy") + F.col("local"))
    found = ranked.join(F.broadcast(runs), (ranked.arc == runs.arc) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("end")))
    return found.select(F.col("key").alias(key), "size", "text_crc32", "shard", (F.col("slot0") + F.col("rank") - F.col("first")).alias("slot"))
