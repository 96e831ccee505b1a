"""Replica state: eligibility, watermarks, acknowledgements, divergence, health and roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import ISR_STALE_MS


def eligible(now_ms: Column, leader_leo: Column) -> Column:
    """Whether a follower's progress counts for the watermark: fresh, alive, and caught up while it is building or a migration target."""
    fresh = now_ms - F.col("last_ok_ms") < ISR_STALE_MS
    caught_up = F.col("leo") >= leader_leo
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    return fresh & ~flag("session_gone") & ~flag("down") & (~flag("building") | caught_up) & (~flag("is_target") | caught_up)


def isr_members(progress: DataFrame) -> DataFrame:
    """slot, node of followers in sync; progress: slot, node, leo, last_ok_ms, building, is_target, down, session_gone, leader, leader_leo, now_ms."""
    return progress.where((F.col("node") != F.col("leader")) & eligible(F.col("now_ms"), F.col("leader_leo"))).select("slot", "node")


def high_watermark(progress: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    """slot, hw: the least LEO of the leader and its eligible followers, never below the previous one."""
    ok = (F.col("node") != F.col("leader")) & eligible(F.col("now_ms"), F.col("leader_leo"))
    low = progress.groupBy("slot").agg(F.max("leader_leo").alias("leader_leo"), F.min(F.when(ok, F.col("leo"))).alias("least"))
    hw = F.least("leader_leo", F.coalesce("least", "leader_leo"))
    if previous is None:
        return low.select("slot", hw.alias("hw"))
    return low.join(previous.withColumnRenamed("hw", "before"), "slot", "left").select("slot", F.greatest(hw, F.coalesce("before", F.lit(0))).alias("hw"))


def ack_verdict(appends: DataFrame, marks: DataFrame) -> DataFrame:
    """appends: slot, seq; marks: slot, hw, durable. Acknowledged up to both, otherwise 1007 (the record is in the log)."""
    done = F.col("seq") <= F.least("hw", "durable")
    return appends.join(F.broadcast(marks), "slot").select("slot", "seq", F.when(done, "success").otherwise("fail").alias("status"), F.when(done, 0).otherwise(1007).alias("err_id"))


def freshest_replica(progress: DataFrame) -> DataFrame:
    """slot, node with the highest LEO; of equals the earliest in the replica list."""
    return progress.groupBy("slot").agg(F.max_by("node", F.struct("leo", -F.col("pos"))).alias("node"), F.max("leo").alias("leo"))


def copy_divergence(leader: DataFrame, copy: DataFrame) -> DataFrame:
    """Slots and seqs where a copy's record differs from the leader's, or is missing inside its range."""
    reach = copy.groupBy("slot").agg(F.max("seq").alias("copy_leo"))
    a = leader.select("slot", "seq", F.col("command_id").alias("leader_command"), F.col("version").alias("leader_version")).join(F.broadcast(reach), "slot").where("seq <= copy_leo").drop("copy_leo")
    b = copy.select("slot", "seq", F.col("command_id").alias("copy_command"), F.col("version").alias("copy_version"))
    differ = ~(F.col("leader_command").eqNullSafe(F.col("copy_command")) & F.col("leader_version").eqNullSafe(F.col("copy_version")))
    return a.join(b, ["slot", "seq"], "full_outer").where(differ)


def _same_digest() -> Column:
    return (F.col("aggregates") == F.col("l_aggregates")) & (F.col("versions") == F.col("l_versions")) & (F.col("resolvable") == F.col("l_resolvable"))


def replica_health(placements: DataFrame, views: DataFrame) -> DataFrame:
    """slot, node, kind of each replica that is not healthy, by kind and then slot; views: slot, node, loaded, last_seq, aggregates, versions, resolvable.

    A slot whose leader can't be read has no reference and no finding; equal digests are healthy whatever the LEO.
    """
    held = placements.select("slot", "leader", F.explode("replicas").alias("node"))
    leader = views.where("loaded").select("slot", F.col("node").alias("leader"), F.col("last_seq").alias("l_last_seq"), F.col("aggregates").alias("l_aggregates"), F.col("versions").alias("l_versions"), F.col("resolvable").alias("l_resolvable"))
    rows = held.join(leader, ["slot", "leader"]).where("node <> leader").join(views, ["slot", "node"], "left")
    kind = (
        F.when(F.col("loaded").isNull(), "unreachable")
        .when(~F.col("loaded"), "not-loaded")
        .when(_same_digest(), None)
        .when(F.col("last_seq") >= F.col("l_last_seq"), "diverged")
        .otherwise("behind")
    )
    return rows.select("slot", "node", kind.alias("kind")).where("kind is not null").orderBy("kind", "slot", "node")


def health_summary(findings: DataFrame) -> DataFrame:
    """The number of findings of each of the four kinds."""
    spark = findings.sparkSession
    kinds = spark.createDataFrame([(k,) for k in ("behind", "diverged", "not-loaded", "unreachable")], "kind string")
    return kinds.join(findings.groupBy("kind").agg(F.count("*").alias("n")), "kind", "left").select("kind", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def copy_status(pairs: DataFrame) -> DataFrame:
    """For a handover the LEO is looked at first: behind, then equivalent by digest, else diverged."""
    status = F.when(F.col("last_seq") < F.col("l_last_seq"), "behind").when(_same_digest(), "equivalent").otherwise("diverged")
    return pairs.withColumn("status", status)


def cluster_storage(placements: DataFrame, sizes: DataFrame) -> DataFrame:
    """Bytes and records over leaders' copies, and whether all leaders answered; slots without a leader are skipped."""
    led = placements.where("leader <> ''").select("slot", F.col("leader").alias("node"))
    return led.join(sizes, ["slot", "node"], "left").agg(
        F.coalesce(F.sum("bytes"), F.lit(0)).cast("long").alias("bytes"), F.coalesce(F.sum("last_seq"), F.lit(0)).cast("long").alias("records"), F.coalesce(F.bool_and(F.col("bytes").isNotNull()), F.lit(True)).alias("complete")
    )


def leader_totals(placements: DataFrame, sizes: DataFrame) -> DataFrame:
    """Per node the records and bytes of the slots it leads."""
    led = placements.select("slot", "leader")
    mine = F.col("node") == F.col("leader")
    return sizes.join(F.broadcast(led), "slot").groupBy("node").agg(F.sum(F.when(mine, F.col("last_seq")).otherwise(0)).alias("records"), F.sum(F.when(mine, F.col("bytes")).otherwise(0)).alias("bytes"))


def synced_slots(placements: DataFrame, progress: DataFrame, factor: int) -> DataFrame:
    """Per leader: led, synced (copies in sync with the leader reach the factor), pending_seats (replica set short of it)."""
    alive = (F.col("now_ms") - F.col("last_ok_ms") < ISR_STALE_MS) & ~F.col("building") & ~F.coalesce("down", F.lit(False)) & ~F.coalesce("session_gone", F.lit(False))
    n = progress.where((F.col("node") != F.col("leader")) & alive).groupBy("slot").agg(F.count("*").alias("followers"))
    short = F.size("replicas") < factor
    rows = placements.where("leader <> ''").join(n, "slot", "left")
    return rows.groupBy("leader").agg(
        F.count(F.when(~short, 1)).alias("led"), F.count(F.when(~short & (F.coalesce("followers", F.lit(0)) + 1 >= factor), 1)).alias("synced"), F.count(F.when(short, 1)).alias("pending_seats")
    )


def repl_rollup(slots: DataFrame) -> DataFrame:
    """stuck slots, the largest gap and the oldest age; slots: slot, leo, hw, hw_at_ms, now_ms."""
    stuck = F.col("leo") > F.col("hw")
    age = F.when(F.col("hw_at_ms") > 0, (F.col("now_ms") - F.col("hw_at_ms")) / 1000.0).otherwise(F.lit(0.0))
    return slots.agg(F.count(F.when(stuck, 1)).alias("stuck"), F.coalesce(F.max(F.when(stuck, F.col("leo") - F.col("hw"))), F.lit(0)).alias("max_gap"), F.coalesce(F.max(F.when(stuck, age)), F.lit(0.0)).alias("oldest_s"))


def worst_stuck(slots: DataFrame, n: int) -> DataFrame:
    age = F.when(F.col("hw_at_ms") > 0, (F.col("now_ms") - F.col("hw_at_ms")) / 1000.0).otherwise(F.lit(0.0))
    return slots.where("leo > hw").select("slot", "leo", "hw", (F.col("leo") - F.col("hw")).alias("gap"), age.alias("age_s")).orderBy(F.desc("age_s"), "slot").limit(n)


def follower_rollup(progress: DataFrame) -> DataFrame:
    """Per follower, ascending: slots, slots in the ISR, oldest age and worst lag."""
    age = (F.col("now_ms") - F.col("last_ok_ms")) / 1000.0
    return progress.where("node <> leader").groupBy("node").agg(
        F.count("*").alias("slots"), F.count(F.when(F.col("now_ms") - F.col("last_ok_ms") <= ISR_STALE_MS, 1)).alias("in_isr"), F.max(age).alias("oldest_s"), F.max(F.greatest(F.col("leader_leo") - F.col("leo"), F.lit(0))).alias("worst_lag")
    ).orderBy("node")


def hw_ledger(samples: DataFrame, placements: DataFrame) -> DataFrame:
    """The latest watermark sample per slot and node of the placement's epoch; samples of other epochs are void."""
    current = samples.join(placements.select("slot", F.col("epoch").alias("now_epoch")), "slot").where("epoch = now_epoch")
    return current.groupBy("slot", "node").agg(F.max_by("hw", "at_ms").alias("hw"))


def segment_gap(leos: DataFrame, source_base: int, size: int, target_base: int, target_size: int) -> DataFrame:
    """Records of the source generation's leaders less those of the destination's."""
    inside = lambda b, n: (F.col("slot") >= b) & (F.col("slot") < b + n)
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("leo"))), F.lit(0))
    return leos.agg((total(inside(source_base, size)) - total(inside(target_base, target_size))).alias("gap"))
