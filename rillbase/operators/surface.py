"""Views and small rules of the admin surface: describe, status, pending slots, projections, submits, repair, fetch plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.routing import fnv1a64_native, logical_slot
from .admin import land_guard, routing_verdict

#: Bytes of one slot's share and of a whole answer of a fetch, and rebuilds of a forked copy.
SLOT_BYTES, ROUND_BYTES, REBUILDS = 4 << 20, 32 << 20, 3


def project(rows: DataFrame, base: int, size: int, slot: str = "slot") -> DataFrame:
    """Rows of the served segment under logical slots; the others go."""
    return rows.where((F.col(slot) >= base) & (F.col(slot) < base + size)).withColumn(slot, F.col(slot) - base)


def project_slice(rows: DataFrame, base: int, size: int, value: str, default: object = 0) -> DataFrame:
    """slot, value for every logical slot of the segment, the default where there is none."""
    slots = rows.sparkSession.range(max(size, 0)).select(F.col("id").cast("int").alias("slot"))
    return slots.join(project(rows.select("slot", value), base, size), "slot", "left").fillna({value: default})


def filter_slots(placements: DataFrame, state: str = "all", leader: str = "all") -> DataFrame:
    """Slots of a state and a leader, ascending."""
    keep = (F.lit(state == "all") | (F.col("state") == state)) & (F.lit(leader == "all") | (F.col("leader") == leader))
    return placements.where(keep).orderBy("slot")


def filter_streams(streams: DataFrame, text: str) -> DataFrame:
    """Streams whose id contains the trimmed text, whatever its case; all for an empty one."""
    asked = text.strip().lower()
    return streams.where(F.contains(F.lower("aggregate_id"), F.lit(asked))) if asked else streams


def staging_slot(ids: DataFrame, placements: DataFrame, base: int, size: int) -> DataFrame:
    """ids with the slot of the segment being filled, null where that slot is not importing."""
    importing = placements.where("state = 'importing_in'").select(F.col("slot").alias("staged"))
    routed = ids.withColumn("staged", logical_slot("aggregate_id", size) + base)
    return routed.join(F.broadcast(importing.withColumn("there", F.lit(True))), "staged", "left").withColumn("staged", F.when(F.col("there"), F.col("staged"))).drop("there")  # at most 2,048 slots


def describe(placements: DataFrame, copies: DataFrame, digests: DataFrame, marks: DataFrame, in_sync: DataFrame, node: str, base: int) -> DataFrame:
    """A row per slot as ``node`` sees it: role, loaded, last_seq, hw, isr, digest.

    copies: slot, node, last_seq; digests: slot, node, aggregates, versions, resolvable; marks: slot, hw; in_sync: slot, node.
    """
    role = F.when(F.col("leader") == node, "leader").when(F.array_contains("replicas", node), "replica").otherwise("none")
    mine = copies.where(F.col("node") == node).select("slot", "last_seq", F.lit(True).alias("loaded"))
    digest = digests.where(F.col("node") == node).drop("node")
    members = in_sync.groupBy("slot").agg(F.array_sort(F.collect_list("node")).alias("isr"))  # a slot's seats
    rows = placements.select("slot", "leader", "epoch", "state", role.alias("role")).join(mine, "slot", "left").join(digest, "slot", "left").join(marks, "slot", "left").join(members, "slot", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return rows.select((F.col("slot") - base).alias("slot"), F.col("slot").alias("physical_slot"), "leader", "epoch", "state", "role", F.coalesce("loaded", F.lit(False)).alias("loaded"), zero("last_seq"), zero("hw"), F.coalesce("isr", F.array().cast("array<string>")).alias("isr"), zero("aggregates"), zero("versions"), zero("resolvable"))


def pending_slots(decisions: DataFrame) -> DataFrame:
    """slot and reason of the copies that the owner decision keeps closed, ascending; decisions: slot, action, reason."""
    return decisions.where("action = 'pending'").select("slot", "reason").orderBy("slot")


def submit(requests: DataFrame, results: DataFrame, marks: DataFrame) -> DataFrame:
    """What a batch's requests are answered: fence, route and land rules first, then the fold's results under one watermark a slot.

    requests: batch_id, pos, slot, fenced and the columns of ``routing_verdict`` and ``land_guard``; results: the fold's
    (batch_id, pos, status, err_id, seq) of those that may land; marks: slot, hw, durable. Of a slot's successes those up
    to both marks stay, the others are 1007; ``exists`` waits for nothing.
    """
    gate = F.when(F.col("fenced"), 1004).when(routing_verdict() != 0, routing_verdict()).otherwise(land_guard())
    rows = requests.withColumn("gate", gate).join(results.select("batch_id", "pos", "status", F.col("err_id").alias("fold_err"), "seq"), ["batch_id", "pos"], "left")
    rows = rows.join(F.broadcast(marks.select("slot", F.least("hw", "durable").alias("mark"))), "slot", "left")  # a row per slot
    late = (F.col("gate") == 0) & (F.col("status") == "success") & (F.col("seq") > F.coalesce("mark", F.lit(0)))
    err = F.when(F.col("gate") != 0, F.col("gate")).when(late, 1007).otherwise(F.col("fold_err"))
    return rows.select("batch_id", "pos", "slot", F.when((F.col("gate") != 0) | late, "fail").otherwise(F.col("status")).alias("status"), err.cast("int").alias("err_id"))


def repair_action() -> Column:
    """What is done about a forked copy; columns leads, rebuilding, attempts (made so far)."""
    return F.when(F.col("rebuilding"), "wait").when(F.col("attempts") >= REBUILDS, "quarantine").when(F.col("leads"), "keep").otherwise("rebuild")


def healed() -> Column:
    """Whether a rebuilt copy is whole again: it has the tail it was dropped at and no stalled stream; columns leo, target, stalled."""
    return (F.col("leo") >= F.col("target")) & (F.col("stalled") == 0)


def fetch_plan(slots: DataFrame, shared: Column | bool = False) -> DataFrame:
    """slot, place, bytes: what one fetch answer carries of each slot.

    slots: slot, place, pending (bytes waiting). In order of place, each slot gets up to its share of what is left of the
    round; the round is halved while another node's ring seat is catching up (``shared``). A node's slots are at most 2,048.
    """
    whole = F.when(F.lit(shared) if isinstance(shared, bool) else shared, ROUND_BYTES // 2).otherwise(ROUND_BYTES)
    want = F.least(F.col("pending"), F.lit(SLOT_BYTES))
    w = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = F.sum(want).over(w) - want
    return slots.select("slot", "place", F.greatest(F.least(want, whole - before), F.lit(0)).cast("long").alias("bytes"))


def place_frames(frames: DataFrame, answers: DataFrame) -> DataFrame:
    """Frames of a fetch answer with their seqs: the first is next less the number of frames. frames: slot, i; answers: slot, next_seq."""
    n = frames.groupBy("slot").agg(F.count("*").alias("n"))
    first = answers.join(n, "slot").select("slot", (F.col("next_seq") - F.col("n")).alias("first"))
    return frames.join(F.broadcast(first), "slot").withColumn("seq", F.col("first") + F.col("i")).drop("first")  # a row per slot


def apply_frames(frames: DataFrame, log: DataFrame) -> DataFrame:
    """slot, seq, outcome of placed frames: ``append`` beyond the copy's end, ``same`` or ``diverged`` (skipped and reported) within it."""
    end = log.groupBy("slot").agg(F.max("seq").alias("leo"))
    held = log.select("slot", "seq", F.col("command_id").alias("held_command"), F.col("version").alias("held_version"))
    rows = frames.join(F.broadcast(end), "slot", "left").join(held, ["slot", "seq"], "left")
    same = F.col("command_id").eqNullSafe(F.col("held_command")) & F.col("version").eqNullSafe(F.col("held_version"))
    return rows.select("slot", "seq", F.when(F.col("seq") > F.coalesce("leo", F.lit(0)), "append").when(same, "same").otherwise("diverged").alias("outcome"))


def read_bounds(samples: DataFrame, placements: DataFrame) -> DataFrame:
    """slot, node, bound: the watermark a seat may read up to; a seat that cannot vouch for itself is sent the leader's full end.

    samples: slot, node, epoch, hw, leader_leo, vouchable, at_ms. Only samples of the placement's epoch and of a seat count.
    """
    now = samples.join(placements.select("slot", "replicas", F.col("epoch").alias("now_epoch")), "slot").where(F.expr("epoch = now_epoch and array_contains(replicas, node)"))
    sent = F.when(F.col("vouchable"), F.col("hw")).otherwise(F.col("leader_leo"))
    return now.withColumn("sent", sent).groupBy("slot", "node").agg(F.max_by("sent", "at_ms").alias("bound"))


def handover_ready() -> Column:
    """ready, diverged or behind, from a copy status (``replication.copy_status``)."""
    return F.when(F.col("status") == "equivalent", "ready").otherwise(F.col("status"))


def migrate(placements: DataFrame, asked: DataFrame) -> DataFrame:
    """slot, step, op, args (JSON): the commands of a hand-over, staged and committed. asked: slot, to, ready, commit_leo.

    A target without a seat is seated first; then the slot is marked; leadership moves once the copy is ready.
    A target that leads already, and a slot that another migration holds, ask for nothing.
    """
    rows = asked.join(placements, "slot").where(F.col("leader") != F.col("to")).where((F.col("state") == "stable") | (F.col("migrating_to") == F.col("to")))
    slots = F.array("slot").alias("slots")
    steps = F.array(
        F.when(~F.array_contains("replicas", F.col("to")), F.struct(F.lit(1).alias("step"), F.lit("slot_add_replica").alias("op"), F.to_json(F.struct(slots, F.col("to").alias("id"))).alias("args"))),
        F.when(F.col("state") == "stable", F.struct(F.lit(2).alias("step"), F.lit("slot_state").alias("op"), F.to_json(F.struct(slots, F.lit("migrating_out").alias("state"), "to")).alias("args"))),
        F.when(F.col("ready"), F.struct(F.lit(3).alias("step"), F.lit("leader_move").alias("op"), F.to_json(F.struct(slots, "to", "commit_leo")).alias("args"))),
    )
    return rows.select("slot", F.explode(F.filter(steps, lambda x: x.isNotNull())).alias("s")).select("slot", "s.step", "s.op", "s.args")


def migration_progress(outcomes: DataFrame) -> DataFrame:
    """Of a generation replay: records in all, landed (held before or appended), left, and whether a gap stopped it; per old slot."""
    n = lambda *o: F.count(F.when(F.col("outcome").isin(*o), 1))
    return outcomes.groupBy("old_slot").agg(F.count("*").alias("records"), n("skip", "append").alias("landed"), n("gap", "unread").alias("left"), (n("gap") > 0).alias("stopped"))


def flow_setting(changes: DataFrame) -> DataFrame:
    """node, tokens, period_s, unlimited after all changes (node, seq, tokens, period_s); a removed setting has null tokens."""
    last = changes.groupBy("node").agg(F.max_by(F.struct("tokens", "period_s"), "seq").alias("x"))
    tokens, period = (F.coalesce(F.col(c), F.lit(0)) for c in ("x.tokens", "x.period_s"))
    return last.select("node", tokens.alias("tokens"), period.alias("period_s"), ((tokens <= 0) | (period <= 0)).alias("unlimited"))


def command_rows(log: DataFrame) -> DataFrame:
    """slot, hash, seq, command_id of every record."""
    return log.select("slot", fnv1a64_native(F.col("command_id")).alias("hash"), "seq", "command_id")


def write_command_index(log: DataFrame, path: str) -> None:
    """``command_rows`` as Parquet dealt by ranges of (slot, hash) and sorted in them: a lookup of a hash reads few row groups."""
    command_rows(log).repartitionByRange("slot", "hash").sortWithinPartitions("slot", "hash", "seq").write.parquet(path)


def find_commands(index: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (slot, command_id) with the first seq of that command in the slot, null for none; equal hashes are verified by id."""
    met = asked.withColumn("hash", fnv1a64_native(F.col("command_id"))).join(index.withColumnRenamed("command_id", "held"), ["slot", "hash"], "left")
    return met.groupBy("slot", "command_id").agg(F.min(F.when(F.col("held") == F.col("command_id"), F.col("seq"))).alias("seq"))


def aggregate_index(directory: DataFrame, span: int = 4096) -> DataFrame:
    """slot, aggregate_id, first_version, n, places: a row for each ``span`` versions, with their (seq, unix_time) in version order."""
    rows = directory.withColumn("block", F.floor((F.col("version") - 1) / span))
    place = F.struct("version", "seq", "unix_time")
    return rows.groupBy("slot", "aggregate_id", "block").agg(F.min("version").alias("first_version"), F.count("*").alias("n"), F.array_sort(F.collect_list(place)).alias("places")).drop("block")  # span places


def find_versions(index: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (aggregate_id, version) with seq and unix_time, null for a version that is not there."""
    block = index.withColumnRenamed("aggregate_id", "of")
    inside = (F.col("version") >= F.col("first_version")) & (F.col("version") < F.col("first_version") + F.col("n"))
    met = asked.join(block, (F.col("aggregate_id") == F.col("of")) & inside, "left").select("aggregate_id", "version", F.element_at("places", (F.col("version") - F.col("first_version") + 1).cast("int")).alias("at"))
    w = Window.partitionBy("aggregate_id", "version").orderBy(F.desc_nulls_last("seq"))  # of an id in more than one slot, and asked again
    last = F.max("unix_time").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = met.select("aggregate_id", "version", "at.seq", "at.unix_time").withColumn("nth", F.row_number().over(w)).withColumn("unix_time", last)
    return rows.where("nth = 1").drop("nth")


def node_status(slots: DataFrame, base: int, size: int) -> DataFrame:
    """One row of arrays by logical slot from slots (slot and counters): absent slots are 0."""
    names = [c for c in slots.columns if c != "slot"]
    every = slots.sparkSession.range(size).select(F.col("id").cast("int").alias("slot")).join(project(slots, base, size), "slot", "left").fillna(0)
    return every.agg(*[F.transform(F.array_sort(F.collect_list(F.struct("slot", F.col(c).alias("v")))), lambda x: x["v"]).alias(c) for c in names])


def cluster_status(placements: DataFrame, peers: DataFrame, storage: DataFrame, health: DataFrame, policy: str, factor: int, base: int, size: int) -> DataFrame:
    """One row: members, placements by logical slot, policy and factor, storage with its completeness, findings by kind; as JSON."""
    placed = project(placements, base, size).agg(F.array_sort(F.collect_list(F.struct("slot", "leader", "replicas", "epoch", "state"))).alias("slots"))
    known = peers.agg(F.array_sort(F.collect_list(F.struct("id", "client_addr", "down", "draining"))).alias("peers"))
    found = health.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "n")))).alias("health"))
    row = placed.crossJoin(known).crossJoin(storage).crossJoin(found)  # one row each
    return row.select(F.to_json(F.struct(F.lit(factor).alias("factor"), "health", "peers", F.lit(policy).alias("policy"), "slots", F.struct(*storage.columns).alias("storage"))).alias("json"))
