"""Verdicts and views of the admin surface: routing of a request, land guards, liveness, gauges, fetch order, status rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.routing import fnv1a64, logical_slot, mix64

REFUSED_MS = 3000
FAILED_PROBES = 3


def routing_verdict() -> Column:
    """0 for served here, else the refusal; columns slot, leader, self, state, served_base, control_only."""
    retired = (F.col("slot") > 0) & (F.pow(F.lit(2), F.length(F.bin(F.col("slot").cast("long"))) - 1) < F.col("served_base"))
    return (
        F.when((F.coalesce("leader", F.lit("")) == "") & retired, 1010)
        .when((F.coalesce("leader", F.lit("")) == "") & F.col("control_only"), 1009)
        .when(F.coalesce("leader", F.lit("")) == "", 0)
        .when((F.col("state") == "migrating") & (F.col("leader") != F.col("self")), 1004)
        .when(F.col("leader") == F.col("self"), 0)
        .otherwise(1003)
    )


def land_guard() -> Column:
    """0 where an append may land, else 1006 or 1008; columns pending, has_copy, copy_leo, epoch, seat_leo, seat_ms."""
    led_before = F.col("epoch") >= 2
    return F.when(F.col("pending"), 1006).when(~F.col("has_copy") & led_before, 1008).when(F.col("has_copy") & (F.col("copy_leo") == 0) & led_before & (F.col("seat_leo") > 0) & (F.col("seat_ms") >= 2000), 1008).otherwise(0)


def busy_slots(placements: DataFrame, leos: DataFrame) -> DataFrame:
    """Slots with records on some replica, or that no replica answers for."""
    seats = placements.select("slot", F.explode("replicas").alias("node"))
    top = seats.join(leos, ["slot", "node"]).groupBy("slot").agg(F.max("leo").alias("leo"))
    return placements.select("slot").join(top, "slot", "left").where(F.col("leo").isNull() | (F.col("leo") > 0)).select("slot")


def liveness(probes: DataFrame, started_ms: int = 0, grace_ms: int = 0) -> DataFrame:
    """node, down after its last probe; probes: node, at_ms, answered, refused.

    A streak of failures ends at an answer. A node is down after three failed probes in a row that were not
    refusals, or after refusals without a break for three seconds. Within the grace after the start, failures of a
    node that has not answered yet are held: they count for nothing.
    """
    w = Window.partitionBy("node").orderBy("at_ms")
    silent = F.sum(F.col("answered").cast("int")).over(w) == 0
    nodes = probes.select("node").distinct()
    rows = probes.withColumn("held", silent & (F.col("at_ms") < started_ms + grace_ms)).where(~F.col("held")).drop("held")
    streak = F.sum(F.col("answered").cast("int")).over(w)
    unrefused = F.sum((~F.col("refused")).cast("int")).over(w)
    rows = rows.withColumn("streak", streak).withColumn("run", unrefused)
    rows = rows.withColumn("fails", F.sum((~F.col("answered")).cast("int")).over(Window.partitionBy("node", "streak").orderBy("at_ms")))
    rows = rows.withColumn("since", F.min(F.when(F.col("refused"), F.col("at_ms"))).over(Window.partitionBy("node", "run").orderBy("at_ms")))
    hit = ~F.col("answered") & F.when(F.col("refused"), F.col("at_ms") - F.col("since") >= REFUSED_MS).otherwise(F.col("fails") >= FAILED_PROBES)
    last = rows.withColumn("hit", hit).groupBy("node", "streak").agg(F.bool_or("hit").alias("down"))
    verdicts = last.groupBy("node").agg(F.max_by("down", "streak").alias("down"))
    return nodes.join(verdicts, "node", "left").select("node", F.coalesce("down", F.lit(False)).alias("down"))


def fetch_order(slots: DataFrame, rotation: int) -> DataFrame:
    """slot and its place: acknowledgement-critical ones first, then ring seats that are moving, then the rest; each from the rotation on."""
    n = slots.agg(F.count("*").alias("n"))
    turned = slots.crossJoin(F.broadcast(n)).withColumn("turn", F.pmod(F.col("i") - rotation, F.col("n")))
    group = F.when(F.col("critical"), 0).when(F.col("ring_moving"), 1).otherwise(2)
    return turned.withColumn("place", F.row_number().over(Window.orderBy(group, "turn")) - 1).select("slot", "place")


def adopt(asked: DataFrame, pending: DataFrame, led: DataFrame) -> DataFrame:
    """slot and adopted: pending here and led here; asked slots that are not are skipped."""
    mine = pending.select("slot").join(led.select("slot"), "slot", "left_semi").select("slot", F.lit(True).alias("adopted"))
    return asked.select("slot").distinct().join(mine, "slot", "left").select("slot", F.coalesce("adopted", F.lit(False)).alias("adopted"))


def write_counters(log: DataFrame) -> DataFrame:
    """Per slot records and bytes, all and of clients; log: slot, bytes, origin."""
    client = F.col("origin") == "client"
    return log.groupBy("slot").agg(
        F.count("*").alias("writes"), F.sum("bytes").alias("write_bytes"), F.count(F.when(client, 1)).alias("client_writes"), F.coalesce(F.sum(F.when(client, F.col("bytes"))), F.lit(0)).alias("client_write_bytes")
    )


def commit_floor(reports: DataFrame, step: int = 1_000_000) -> DataFrame:
    """The floor after each report: the highest so far of its slot, from the highest of earlier steps of ``at`` and those of its own."""
    cut = reports.withColumn("floor_step", F.floor(F.col("at") / step))
    tops = cut.groupBy("slot", "floor_step").agg(F.max("leo").alias("top"))
    earlier = tops.withColumn("earlier", F.max("top").over(Window.partitionBy("slot").orderBy("floor_step").rowsBetween(Window.unboundedPreceding, -1))).drop("top")
    w = Window.partitionBy("slot", "floor_step").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = cut.withColumn("floor", F.max("leo").over(w)).join(earlier, ["slot", "floor_step"])
    return local.withColumn("floor", F.greatest("floor", "earlier")).drop("floor_step", "earlier")


def prefix_ack(results: DataFrame, floors: DataFrame) -> DataFrame:
    """A batch's successes up to its slot's floor stay; those above are 1007. Exists and failures need no floor."""
    late = (F.col("status") == "success") & (F.col("seq") > F.col("floor"))
    return results.join(F.broadcast(floors), "slot").withColumn("err_id", F.when(late, 1007).otherwise(F.col("err_id"))).withColumn("status", F.when(late, "fail").otherwise(F.col("status"))).drop("floor")


def worst_ack(slots: DataFrame, n: int) -> DataFrame:
    """The n slots with the highest wait (99 %), then lag, then slot."""
    return slots.where("appends > 0").orderBy(F.desc("wait_p99"), F.desc("lag_peak"), "slot").limit(n)


def status_json(rows: DataFrame, key: str = "slot") -> DataFrame:
    """The key and each row as JSON."""
    return rows.select(key, F.to_json(F.struct(*sorted(rows.columns))).alias("json"))


def seed_ids(spark: SparkSession, slot: int, size: int, prefix: str, n: int) -> DataFrame:
    """Of n numbered ids those that route to the slot."""
    return spark.range(n).select(F.concat(F.lit(prefix), F.col("id")).alias("aggregate_id")).where(logical_slot("aggregate_id", size) == slot)


class CommandFilter:
    """A Bloom filter over command ids: never a false absent. Merges of filters of one shape are exact unions."""

    def __init__(self, bits: int, probes: int = 10, data: np.ndarray | None = None):
        self.bits, self.probes = bits, probes
        self.data = np.zeros(bits // 8, np.uint8) if data is None else data

    def places(self, ids: pa.Array) -> np.ndarray:
        h = fnv1a64(ids)
        other = mix64(h) | np.uint64(1)
        return np.stack([(h + np.uint64(i) * other) % np.uint64(self.bits) for i in range(self.probes)]).astype(np.int64)

    def add(self, ids: pa.Array) -> None:
        p = self.places(ids).ravel()
        np.bitwise_or.at(self.data, p >> 3, (1 << (p & 7)).astype(np.uint8))

    def maybe(self, ids: pa.Array) -> np.ndarray:
        p = self.places(ids)
        return ((self.data[p >> 3] >> (p & 7)) & 1).all(0)


def build_filter(log: DataFrame, bits: int, probes: int = 10, block: int = 1 << 16) -> CommandFilter:
    """One filter over all commands of a log. Tasks send the blocks of bits they set; a block's copies meet in one task.

    ``bits`` is the size of one generation's filter, whatever the log's; filters of generations are OR-ed in the same way.
    """

    def build(batches):
        f = CommandFilter(bits, probes)
        for b in batches:
            f.add(b.column(0))
        for at in range(0, len(f.data), block):
            piece = f.data[at : at + block]
            if piece.any():
                yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([piece.tobytes()], pa.binary())], ["at", "bits"])

    def merge(batches):
        found: dict[int, np.ndarray] = {}
        for b in batches:
            for at, piece in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                new = np.frombuffer(piece, np.uint8)
                found[at] = found[at] | new if at in found else new
        for at, piece in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([piece.tobytes()], pa.binary())], ["at", "bits"])

    total = CommandFilter(bits, probes)
    for r in log.select("command_id").mapInArrow(build, "at long, bits binary").repartition("at").mapInArrow(merge, "at long, bits binary").toLocalIterator():
        total.data[r["at"] : r["at"] + len(r.bits)] = np.frombuffer(r.bits, np.uint8)
    return total


def maybe_known(asked: DataFrame, command: str, known: CommandFilter) -> DataFrame:
    """asked with maybe: false only for commands that are surely not in the log."""
    shared = asked.sparkSession.sparkContext.broadcast(known)  # a fixed number of bits

    @F.arrow_udf("boolean")
    def look(ids: pa.Array) -> pa.Array:
        return pa.array(shared.value.maybe(ids).astype(bool))

    return asked.withColumn("maybe", look(command))
