"""The contiguous-version directory and what is derived from it.

A version of an aggregate is resolvable when versions 1 to it are all present; the frame with the lowest seq
that claims a version has it. Later frames of that version are replays. Versions beyond a gap are withheld.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import MAX_WITHHELD

KEY = ["slot", "aggregate_id"]


def numbered(frames: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """Frames with ``nth``: 1 for the frame of its version that came first.

    Dealt by aggregate at once and put in order of version and seq, once: versions rarely repeat, so an aggregation would
    hold nearly all rows in each of its tables. The windows over versions that follow keep this order and deal.
    All columns are in the order, so that plans that read this twice deal the same rows and share them.
    """
    rows = frames.where("version >= 1").select(*keys, "version", "seq", "unix_time").repartition(*keys)
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(*keys, "version").orderBy(F.asc_nulls_last("seq"), "unix_time")))


def first_frames(frames: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """One row per claimed version: the frame that came first."""
    return numbered(frames, keys).where("nth = 1").drop("nth")


def directory(frames: DataFrame) -> DataFrame:
    """slot, aggregate_id, version, seq, unix_time of resolvable versions."""
    number = F.row_number().over(Window.partitionBy(*KEY).orderBy("version"))
    return first_frames(frames).withColumn("rn", number).where("rn = version").drop("rn")


def _changes(column: pa.Array) -> np.ndarray:
    """Whether each value but the first differs from the one before; nulls are equal."""
    now, then = column[1:], column[:-1]
    return pc.coalesce(pc.not_equal(now, then), pc.xor(pc.is_null(now), pc.is_null(then))).to_numpy(zero_copy_only=False)


def capped_directory(frames: DataFrame, cap: int = MAX_WITHHELD) -> DataFrame:
    """The directory where an aggregate remembers at most ``cap`` versions beyond a gap at a time; others stay in the log only.

    One pass over frames dealt by aggregate and sorted by seq. Rows go by as Arrow batches: only versions are looked at one
    by one, adopted rows are taken from the batch by place, and what is remembered at its end goes before the next batch.
    """
    long = [F.col(c).cast("long").alias(c) for c in ("version", "seq", "unix_time")]
    rows = frames.where("version >= 1").select(*KEY, *long).repartition(*KEY).sortWithinPartitions(*KEY, F.asc_nulls_last("seq"), "unix_time")

    def run(batches):
        before, last, held, kept = None, 0, {}, None  # held: place of each remembered version in kept and the batch after it
        for b in batches:
            if not b.num_rows:
                continue
            ids = [b.column(i) for i in range(len(KEY))]
            first = [tuple(c[0].as_py() for c in ids) != before]
            new = first + np.logical_or.reduce([_changes(c) for c in ids]).tolist()
            before = tuple(c[-1].as_py() for c in ids)
            start, out = 0, []
            if held:
                start, b = kept.num_rows, pa.Table.from_batches([kept, b]).combine_chunks().to_batches()[0]
            for i, (version, other) in enumerate(zip(b.column(len(KEY))[start:].to_pylist(), new, strict=True), start):
                if other:
                    last, held = 0, {}
                if version == last + 1:
                    last = version
                    out.append(i)
                    while last + 1 in held:
                        last += 1
                        out.append(held.pop(last))
                elif version > last and len(held) < cap:
                    held.setdefault(version, i)
            if out:
                yield b.take(pa.array(out, pa.int64()))
            kept = b.take(pa.array(list(held.values()), pa.int64()))
            held = {version: i for i, version in enumerate(held)}

    return rows.mapInArrow(run, rows.schema)


def standing(frames: DataFrame) -> DataFrame:
    """The directory with claim, the highest version of the aggregate's frames, and resolvable, its highest one here."""
    w = Window.partitionBy(*KEY).orderBy("version")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = first_frames(frames).withColumn("rn", F.row_number().over(w))
    rows = rows.withColumn("claim", F.max("version").over(whole)).withColumn("resolvable", F.count(F.when(F.col("rn") == F.col("version"), 1)).over(whole))
    return rows.where("rn = version").drop("rn")


def withheld(frames: DataFrame) -> DataFrame:
    number = F.row_number().over(Window.partitionBy(*KEY).orderBy("version"))
    return first_frames(frames).withColumn("rn", number).where("rn <> version").drop("rn")


def tails(frames: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """``keys`` and version (0 if none is resolvable): the last row of each aggregate has it, so nothing is joined or held."""
    w = Window.partitionBy(*keys).orderBy("version")
    rows = first_frames(frames, keys).withColumn("rn", F.row_number().over(w))
    found = F.count(F.when(F.col("rn") == F.col("version"), 1)).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.select(*keys, found.alias("found"), F.lead("version").over(w).alias("next"))
    return rows.where("next is null").select(*keys, F.col("found").alias("version"))


def slot_digest(frames: DataFrame, claimed: DataFrame | None = None) -> DataFrame:
    """Per slot: aggregates (also those without a resolvable version), versions and resolvable.

    claimed: slot, aggregate_id, version that a copy says it has; without it a copy claims what is resolvable. Where the
    two sums differ the copy can't serve all it claims.
    """
    t = tails(frames).withColumnRenamed("version", "resolvable")
    if claimed is None:
        t = t.withColumn("claim", F.col("resolvable"))
    else:
        t = t.join(claimed.select(*KEY, F.col("version").alias("claim")), KEY, "full_outer").withColumn("claim", F.coalesce("claim", "resolvable")).withColumn("resolvable", F.coalesce("resolvable", F.lit(0)))
    return t.groupBy("slot").agg(F.count("*").alias("aggregates"), F.sum("claim").alias("versions"), F.sum("resolvable").alias("resolvable"))


def stalled(frames: DataFrame) -> DataFrame:
    """Aggregates with withheld versions after whose last withheld frame another aggregate has a frame.

    Of each slot the two aggregates with the highest seq suffice. Frames are dealt by aggregate and put in order once; an
    aggregate's last row has its sums.
    """
    rows = frames.where("aggregate_id is not null").select(*KEY, "version", "seq").repartition(*KEY)
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy(*KEY, "version").orderBy("seq")))
    w = Window.partitionBy(*KEY).orderBy("version", "seq")
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    new = (F.col("nth") == 1) & (F.col("version") >= 1)
    rows = rows.withColumn("rn", F.count(F.when(new, 1)).over(so_far))
    held = F.when(new & (F.col("rn") != F.col("version")), F.col("seq"))
    sums = rows.select(*KEY, F.max(held).over(so_far).alias("held_seq"), F.count(held).over(so_far).alias("withheld"), F.max("seq").over(so_far).alias("last_seq"), F.lead(F.lit(1)).over(w).alias("more"))
    sums = sums.where("more is null").drop("more")
    two = sums.withColumn("place", F.row_number().over(Window.partitionBy("slot").orderBy(F.desc("last_seq")))).where("place <= 2")
    of = lambda place, c: F.max(F.when(F.col("place") == place, F.col(c)))
    of_slot = two.groupBy("slot").agg(of(1, "aggregate_id").alias("first_id"), of(1, "last_seq").alias("first_seq"), of(2, "last_seq").alias("second_seq"))
    other = F.when(F.col("aggregate_id") == F.col("first_id"), F.coalesce("second_seq", F.lit(0))).otherwise(F.col("first_seq"))
    return sums.where("withheld > 0").join(F.broadcast(of_slot), "slot").where(other > F.col("held_seq")).select(*KEY, "held_seq", "withheld")


def density(frames: DataFrame) -> DataFrame:
    """Per slot whether seq is dense from 1."""
    return frames.groupBy("slot").agg(F.min("seq").alias("min_seq"), F.max("seq").alias("max_seq"), F.count_distinct("seq").alias("n_seq")).withColumn("dense", (F.col("min_seq") == 1) & (F.col("max_seq") == F.col("n_seq")))


def command_uniqueness(log: DataFrame) -> DataFrame:
    """Per slot the number of commands and of those used more than once."""
    n = log.groupBy("slot", "command_id").agg(F.count("*").alias("n"))
    return n.groupBy("slot").agg(F.count("*").alias("commands"), F.sum(F.when(F.col("n") > 1, 1).otherwise(0)).alias("repeated"))


def claims(frames: DataFrame, claimed: DataFrame) -> DataFrame:
    """Aggregates whose claimed version is not what is resolvable (reads of them must fail)."""
    return claimed.join(tails(frames).withColumnRenamed("version", "resolvable"), KEY, "left").withColumn("resolvable", F.coalesce("resolvable", F.lit(0))).where("version <> resolvable")
