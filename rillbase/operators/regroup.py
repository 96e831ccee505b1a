"""Moving a log to another generation: new slots, new dense seqs, versions and commands kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.routing import logical_slot
from ..sources.logviews import assign_seq


def expand(log: DataFrame, size: int, prefix: int = 7, span: int = 1_000_000) -> DataFrame:
    """The log in the generation of ``size``: in a slot, records go by old slot, then aggregate (byte order), then version.

    Numbered by counts: of old slots, of the first ``prefix`` characters of ids, and of ids in steps of ``span`` versions.
    """
    moved = log.withColumnRenamed("slot", "old_slot").withColumnRenamed("seq", "old_seq").withColumn("slot", logical_slot("aggregate_id", size) + size)
    fine = F.struct(F.col("aggregate_id").alias("id"), F.floor(F.col("version") / span).alias("step"))
    return assign_seq(moved, "slot", [F.col("version")], F.struct("old_slot", F.substring("aggregate_id", 1, prefix).alias("head")), fine)


def replay(source: DataFrame, tails: DataFrame, last_seqs: DataFrame) -> DataFrame:
    """What a replay does with each record of ``source`` (slot, old_slot, aggregate_id, version): outcome and seq.

    tails: slot, aggregate_id, tail (what the destination holds); last_seqs: slot, last_seq. An aggregate's versions come in
    order: those up to its tail are ``skip``, each next one is ``append``, the first one beyond a gap is ``gap`` (an error
    that ends the aggregate's replay), those after it are ``unread``. Appended records get dense seqs after the slot's last.
    """
    met = source.join(tails, ["slot", "aggregate_id"], "left").withColumn("tail", F.coalesce("tail", F.lit(0)))
    new = F.col("version") > F.col("tail")
    w = Window.partitionBy("slot", "aggregate_id").orderBy("version").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    n = F.count(F.when(new, 1)).over(w)
    met = met.withColumn("behind", F.when(new, F.col("version") - F.col("tail") - n))  # 0 while no version is missing
    broken = F.count(F.when(F.col("behind") > 0, 1)).over(w)
    outcome = F.when(~new, "skip").when(broken == 0, "append").when(broken == 1, "gap").otherwise("unread")
    met = met.withColumn("outcome", outcome).drop("behind")
    bucket = F.struct("old_slot", F.substring("aggregate_id", 1, 7).alias("head"))
    fine = F.struct(F.col("aggregate_id").alias("id"), F.floor(F.col("version") / 1_000_000).alias("step"))
    put = assign_seq(met.where("outcome = 'append'"), "slot", [F.col("version")], bucket, fine, out="nth")
    put = put.join(F.broadcast(last_seqs), "slot", "left").withColumn("seq", F.coalesce("last_seq", F.lit(0)) + F.col("nth"))  # a row per slot
    rest = met.where("outcome <> 'append'").withColumn("seq", F.lit(None).cast("long"))
    columns = ["slot", "old_slot", "aggregate_id", "version", "outcome", "seq"]
    return put.select(*columns).unionByName(rest.select(*columns))


def replay_gaps(log: DataFrame, tails: DataFrame) -> DataFrame:
    """Aggregates whose replay onto ``tails`` (aggregate_id, tail) would meet a gap: their next version is beyond tail + 1."""
    rest = log.join(tails, "aggregate_id", "left").where(F.col("version") > F.coalesce("tail", F.lit(0)))
    return rest.groupBy("aggregate_id").agg(F.min("version").alias("next"), F.max("version").alias("last"), F.count_distinct("version").alias("n"), F.max(F.coalesce("tail", F.lit(0))).alias("tail")).where((F.col("next") > F.col("tail") + 1) | (F.col("last") - F.col("next") + 1 > F.col("n")))
