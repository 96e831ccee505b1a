"""Event logs derived from ordinary tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.routing import logical_slot


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def assign_seq(df: DataFrame, slot: str, order: list[Column], *buckets: Column, out: str = "seq") -> DataFrame:
    """A dense number from 1 in each slot, in ``order``.

    Each of ``buckets``, from coarse to fine, must not fall as ``order`` rises within the coarser ones. Rows are numbered
    within the finest and shifted by the counts of buckets before, level by level, so no window holds a slot's rows, nor
    more than one coarser bucket's buckets. Counts meet rows where these are, by a merge: a narrow table looks small enough
    to be broadcast, and would then be put in order in the few tasks that the counts have.
    """
    names = [f"seq_bucket{i}" for i in range(len(buckets))]
    cut = df.select("*", *[b.alias(n) for b, n in zip(buckets, names, strict=True)])
    counts = cut.groupBy(slot, *names).agg(F.count("*").alias("seq_n"))
    earlier = lambda by, name: F.sum("seq_n").over(Window.partitionBy(slot, *by).orderBy(name)) - F.col("seq_n")
    before = counts.withColumn("seq_base", earlier(names[:-1], names[-1]))
    for i, name in enumerate(names[:-1]):
        level = counts.groupBy(slot, *names[: i + 1]).agg(F.sum("seq_n").alias("seq_n"))
        level = level.select(slot, *names[: i + 1], earlier(names[:i], name).alias("seq_earlier"))
        before = before.join(level, [slot, *names[: i + 1]]).withColumn("seq_base", F.col("seq_base") + F.col("seq_earlier")).drop("seq_earlier")
    before = before.drop("seq_n")
    local = F.row_number().over(Window.partitionBy(slot, *names).orderBy(*order))
    return cut.withColumn("seq_local", local).join(before.hint("merge"), [slot, *names]).withColumn(out, (F.col("seq_base") + F.col("seq_local")).cast("long")).drop(*names, "seq_base", "seq_local")


def log_events(spark: SparkSession, sf_dir: str, gen: int = 3) -> DataFrame:
    """One record per row of events; the user is the aggregate."""
    size = 1 << gen
    e = table(spark, sf_dir, "events")
    rows = e.select(
        "event_id",
        F.concat(F.lit("user-"), F.col("user_id")).alias("aggregate_id"),
        F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long").alias("version"),
        F.unix_seconds(F.col("ts").cast("timestamp")).alias("unix_time"),
        F.concat(F.lit("evt-"), F.col("event_id")).alias("command_id"),
        "event_type",
        F.col("props").alias("body"),
    ).withColumn("slot", logical_slot("aggregate_id", size) + size)
    return assign_seq(rows, "slot", [F.col("event_id")], F.floor(F.col("event_id") / 1_000_000))


def frames_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames with gaps, duplicates and out-of-order versions: orders are aggregates, line numbers versions, one slot of four by order key.

    All of a frame but its seq follows from date, key and line: rows that agree in them make equal frames, whatever their
    order, so the further columns that would order them are not read, dealt or sorted.
    """
    order = [F.col(c) for c in ("l_shipdate", "l_orderkey", "l_linenumber")]
    rows = table(spark, sf_dir, "lineitem").withColumn("slot", (F.col("l_orderkey") % 4).cast("int"))
    numbered = assign_seq(rows, "slot", order, F.struct("l_shipdate", F.shiftright("l_orderkey", 32).alias("keys")))
    return numbered.select("slot", "seq", F.concat(F.lit("ord-"), F.col("l_orderkey")).alias("aggregate_id"), F.col("l_linenumber").cast("long").alias("version"), F.unix_seconds(F.col("l_shipdate").cast("timestamp")).alias("unix_time"))


def log_conversations(spark: SparkSession, sf_dir: str, gen: int = 2) -> DataFrame:
    size = 1 << gen
    rows = table(spark, sf_dir, "conversations").select(
        F.concat(F.lit("conv-"), F.col("conv_id")).alias("aggregate_id"),
        (F.col("turn") + 1).alias("version"),
        "conv_id",
        "turn",
        F.concat(F.lit("msg-"), F.col("conv_id"), F.lit("-"), F.col("turn")).alias("command_id"),
        F.col("role").alias("event_type"),
        F.col("text").alias("body"),
    ).withColumn("slot", logical_slot("aggregate_id", size) + size)
    return assign_seq(rows, "slot", [F.col("turn"), F.col("conv_id")], F.struct("turn", F.floor(F.col("conv_id") / 1_000_000).alias("ids")))
