"""The five reads over a directory, each with a visibility bound (0: none), and paged stream listing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.routing import logical_slot
from .directory import KEY


def visible(bound: Column | int) -> Column:
    b = F.lit(bound) if isinstance(bound, int) else bound
    return (b == 0) | (F.col("seq") <= b)


def read_stream(directory: DataFrame, aggregate_id: str, start: int = 1, limit: int = 0, bound: int = 0) -> DataFrame:
    """Ascending versions from ``start`` (0: 1), at most ``limit`` (0: all), up to the first one past the bound."""
    rows = directory.where((F.col("aggregate_id") == aggregate_id) & (F.col("version") >= max(start, 1)))
    if bound:
        seen = F.min(visible(bound).cast("int")).over(Window.partitionBy(*KEY).orderBy("version").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        rows = rows.withColumn("seen", seen).where("seen = 1").drop("seen")
    return rows.orderBy("version").limit(limit) if limit else rows


def stream_span(rows: DataFrame, start: int = 1) -> DataFrame:
    """n, next_version and last_version of a read."""
    first = max(start, 1)
    return rows.agg(F.count("*").alias("n")).select("n", (F.col("n") + first).alias("next_version"), (F.col("n") + first - 1).alias("last_version"))


def read_tails(directory: DataFrame, ids: DataFrame, bound: int = 0) -> DataFrame:
    """ids: pos, aggregate_id. One row per requested id, duplicates kept; 0 for an unknown id."""
    last = directory.where(visible(bound)).groupBy("aggregate_id").agg(F.max("version").alias("version"))
    return ids.join(last, "aggregate_id", "left").select("pos", "aggregate_id", F.coalesce("version", F.lit(0)).cast("long").alias("version"))


def version_by_time(directory: DataFrame, asked: DataFrame, bound: int = 0) -> DataFrame:
    """asked: aggregate_id, at. The highest visible version stamped no later; times may go back, so the version decides."""
    met = asked.join(directory, "aggregate_id", "left")
    ok = (F.col("unix_time") <= F.col("at")) & visible(bound)
    return met.groupBy("aggregate_id", "at").agg(F.coalesce(F.max(F.when(ok, F.col("version"))), F.lit(0)).cast("long").alias("version"))


def replay_as_of(directory: DataFrame, asked: DataFrame) -> DataFrame:
    """The records of each asked aggregate up to its version at that time."""
    anchor = version_by_time(directory, asked).withColumnRenamed("version", "anchor")
    return directory.join(anchor, "aggregate_id").where("version <= anchor").select("aggregate_id", "at", "version", "seq", "unix_time")


def read_by_command(log: DataFrame, asked: DataFrame, size: int, base: int, bound: int = 0) -> DataFrame:
    """asked: aggregate_id, command_id. Looks in the whole slot of the aggregate; the record may be another aggregate's."""
    routed = asked.withColumn("slot", logical_slot("aggregate_id", size) + base).withColumnRenamed("aggregate_id", "asked_id")
    found = log.where(visible(bound)).select("slot", "command_id", "aggregate_id", "version", "seq")
    return routed.join(found, ["slot", "command_id"], "left").select("asked_id", "command_id", "slot", F.col("seq").isNotNull().alias("found"), "aggregate_id", "version", "seq")


def page_of(streams: DataFrame, after: str = "", limit: int = 0) -> DataFrame:
    """streams: slot, aggregate_id, version, unix_time. Ids after the cursor in byte order; limit outside 1 to 1000 is 200.

    total: all streams of the slot; next_after: the page's last id only where it was cut.
    """
    n = limit if 0 < limit <= 1000 else 200
    total = streams.agg(F.count("*").alias("total"))
    rows = streams.where(F.col("aggregate_id") > after).orderBy("aggregate_id").limit(n + 1)  # a top-k
    rows = rows.withColumn("k", F.row_number().over(Window.orderBy("aggregate_id")))
    more = rows.agg(F.max("k").alias("got"), F.max(F.when(F.col("k") == n, F.col("aggregate_id"))).alias("last_id"))
    return rows.where(F.col("k") <= n).crossJoin(F.broadcast(more)).crossJoin(F.broadcast(total)).select("k", "aggregate_id", "version", "unix_time", "total", F.when(F.col("got") > n, F.col("last_id")).otherwise(F.lit("")).alias("next_after"))


def prefetch_routes(placements: DataFrame, peers: DataFrame, base: int, self_address: str) -> DataFrame:
    """logical_slot, address and its index in the order of first appearance; unmapped slots answer with ``self_address``."""
    address = F.coalesce(F.when(F.col("client_addr") != "", F.col("client_addr")), F.lit(self_address))
    rows = placements.select((F.col("slot") - base).alias("logical_slot"), "leader").join(F.broadcast(peers.select(F.col("id").alias("leader"), "client_addr")), "leader", "left").select("logical_slot", address.alias("address"))
    first = rows.withColumn("first", F.min("logical_slot").over(Window.partitionBy("address")))
    return first.withColumn("node_index", F.dense_rank().over(Window.orderBy("first")) - 1).drop("first")


def read_admission(placements: DataFrame, samples: DataFrame, node: str) -> DataFrame:
    """slot, mode (unbounded, bounded, empty, redirect) and bound for reads at ``node``.

    samples: slot, node, epoch, hw, proven, fenced. A sample counts only in the placement's epoch.
    """
    mine = samples.where(F.col("node") == node).select("slot", F.col("epoch").alias("sample_epoch"), "hw", "proven", "fenced")
    rows = placements.join(mine, "slot", "left")
    holds = F.array_contains("replicas", node)
    current = F.coalesce(F.col("proven"), F.lit(False)) & F.coalesce(F.col("sample_epoch") == F.col("epoch"), F.lit(False))
    mode = (
        F.when(F.coalesce("leader", F.lit("")) == "", "unbounded")
        .when((F.col("leader") == node) & F.coalesce("fenced", F.lit(False)), "empty")
        .when(F.col("leader") == node, "unbounded")
        .when(~holds | ~current, "redirect")
        .when(F.col("hw") == 0, "empty")
        .otherwise("bounded")
    )
    return rows.select("slot", mode.alias("mode"), F.when(mode == "bounded", F.col("hw")).otherwise(0).cast("long").alias("bound"))


def byte_cap(rows: DataFrame, partition: list[str], size: str, cap: int, step: int = 4096) -> DataFrame:
    """Leading rows by seq whose sizes add up to ``cap`` at most; the first row always.

    Sums of ``step`` seqs each show which of them the cap can reach; only their rows are put in order.
    """
    cut = rows.withColumn("cap_step", F.floor(F.col("seq") / step))
    sums = cut.groupBy(*partition, "cap_step").agg(F.sum(size).alias("cap_bytes"))
    before = F.sum("cap_bytes").over(Window.partitionBy(*partition).orderBy("cap_step")) - F.col("cap_bytes")
    reached = sums.withColumn("cap_before", before).where(F.col("cap_before") <= cap).select(*partition, "cap_step")
    w = Window.partitionBy(*partition).orderBy("seq")
    total = F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    near = cut.join(reached, [*partition, "cap_step"], "left_semi").drop("cap_step")
    return near.withColumn("cap_n", F.row_number().over(w)).withColumn("cap_total", total).where((F.col("cap_total") <= cap) | (F.col("cap_n") == 1)).drop("cap_n", "cap_total")


def slot_range(rows: DataFrame, size: str, start: int, until: int, cap: int) -> DataFrame:
    """Each slot's records from seq ``start`` to before ``until``: a run without a missing seq, of at most ``cap`` bytes, but the first always."""
    asked = rows.where((F.col("seq") >= start) & (F.col("seq") < until))
    capped = byte_cap(asked, ["slot"], size, cap)
    place = F.row_number().over(Window.partitionBy("slot").orderBy("seq"))
    return capped.withColumn("place", place).where(F.col("seq") == F.col("place") + start - 1).drop("place")


def slot_payload(rows: DataFrame, size: str, frame: str, start: int, until: int, cap: int) -> DataFrame:
    """slot, first, next, n and the concatenated frames of a slot range; at most ``cap`` bytes or one frame a slot."""
    run = slot_range(rows, size, start, until, cap)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", F.hex(frame).alias("f")))), lambda x: x["f"]), "")
    return run.groupBy("slot").agg(F.min("seq").alias("first"), (F.max("seq") + 1).alias("next"), F.count("*").alias("n"), F.unhex(joined).alias("payload"))


def sound(directory: DataFrame, claimed: DataFrame) -> DataFrame:
    """The directory with a gate: reading a record of a stream whose claimed version is not what is resolvable raises an error.

    claimed: slot, aggregate_id, version; a row per stream. One join, after which each stream's rows are side by side.
    """
    met = directory.join(claimed.select(*KEY, F.col("version").alias("claim")), KEY, "left").withColumn("held", F.max("version").over(Window.partitionBy(*KEY)))
    message = F.concat(F.lit("stream "), F.col("aggregate_id"), F.lit(" claims version "), F.col("claim").cast("string"), F.lit(" but not all versions are resolvable"))
    return met.withColumn("version", F.when(F.col("claim") != F.col("held"), F.raise_error(message).cast("long")).otherwise(F.col("version"))).drop("claim", "held")


def ids_frame(spark: SparkSession, ids: list[str]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(ids)), "pos int, aggregate_id string")
