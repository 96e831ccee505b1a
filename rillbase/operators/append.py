"""Appends: validation, batch gates, the slot-ordered state machine, and flow control."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .. import schema as S
from ..functions.routing import logical_slot
from ..functions.scalar import is_gzip


def invalid_reason(codec: Column | None = None, flags: Column | None = None) -> Column:
    """The first failing rule of a request, null if none fails; all are refusal 1002."""
    octets = lambda c: F.coalesce(F.octet_length(c), F.lit(0))
    codec = F.col("codec") if codec is None else codec
    flags = F.lit(0) if flags is None else flags
    events = F.col("events")
    of_event = lambda e: (
        F.when(octets(e["type"]) > S.MAX_TYPE_BYTES, "event_type_too_long").when(octets(e["body"]) > S.MAX_BODY_BYTES, "body_too_large").when((codec == 1) & ~is_gzip(e["body"]), "not_gzip")
    )
    first_event = F.element_at(F.filter(F.transform(events, of_event), lambda r: r.isNotNull()), 1)
    first_event = F.when(F.exists(events, lambda e: of_event(e).isNotNull()), first_event)
    return (
        F.when((octets("aggregate_id") == 0) | (octets("command_id") == 0) | (F.coalesce(F.size(events), F.lit(0)) <= 0), "empty_field")
        .when(flags.bitwiseAND(F.lit(0xF0)) != 0, "reserved_flags")
        .when(~codec.isin(0, 1), "unknown_codec")
        .when(octets("aggregate_id") > S.MAX_ID_BYTES, "aggregate_too_long")
        .when(octets("command_id") > S.MAX_ID_BYTES, "command_too_long")
        .when(F.col("version") == 0, "version_zero")
        .when(F.size(events) > S.MAX_EVENTS, "too_many_events")
        .otherwise(first_event)
    )


def duplicate_in_batch() -> Column:
    """Whether an aggregate is named twice in the batch: every copy is refused."""
    return F.count("*").over(Window.partitionBy("batch_id", "aggregate_id")) > 1


def ordered_fold(rows: DataFrame, keys: list[str], order: list[str], inputs: list[str], keep: list[str], made: str, make: Callable[[], Callable[..., tuple]], last: bool = False) -> DataFrame:
    """Each group's rows in ``order`` through a step of its own; rows stream by, only the step's state is held.

    ``make`` gives a new group's step, from the ``inputs`` to a tuple of the ``made`` columns. Out come ``keep`` and those
    for each row, or with ``last`` for each group's last one. Groups are dealt by key and sorted within the partition.
    """
    shape = T.StructType([T.StructField(c, rows.schema[c].dataType) for c in keep] + T.StructType.fromDDL(made).fields)
    used = list(dict.fromkeys([*keys, *order, *inputs, *keep]))
    dealt = rows.select(*used).repartition(*keys).sortWithinPartitions(*keys, *order)
    out_schema = to_arrow_schema(shape)
    of_keys, of_inputs, of_keep = ([used.index(c) for c in names] for names in (keys, inputs, keep))

    def batch(out):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), out_schema, strict=True)], schema=out_schema)

    def run(batches):
        now, step, held = None, None, None
        for b in batches:
            columns = [b.column(i).to_pylist() for i in range(b.num_columns)]
            pick = lambda at: zip(*(columns[i] for i in at), strict=True)  # noqa: B023, E731
            out = []
            for key, given, kept in zip(pick(of_keys), pick(of_inputs), pick(of_keep), strict=True):
                if key != now:
                    if last and held is not None:
                        out.append(held)
                    now, step = key, make()
                held = (*kept, *step(*given))
                if not last:
                    out.append(held)
            if out:
                yield batch(out)
        if last and held is not None:
            yield batch([held])

    return dealt.mapInArrow(run, shape)


def fold_unique(frames: DataFrame) -> DataFrame:
    """The final version of each aggregate where commands are unique: arrivals in seq order, each accepted at current + 1."""

    def make():
        current = 0

        def step(version):
            nonlocal current
            if version == current + 1:
                current = version
            return (current,)

        return step

    return ordered_fold(frames, ["slot", "aggregate_id"], ["seq"], ["version"], ["slot", "aggregate_id"], "version long", make, last=True)


class SlotState:
    """What a slot knows: last seq, each aggregate's version, each command's seq and version."""

    def __init__(self) -> None:
        self.seq = 0
        self.versions: dict[str, int] = {}
        self.commands: dict[str, tuple[int, int]] = {}

    def append(self, aggregate_id: str, version: int, command_id: str, reason: str | None) -> tuple[str, int, int, int]:
        """(status, err_id, current_version, seq) of one request; 0 for what does not apply."""
        if reason:
            return "fail", 1002, 0, 0
        if command_id in self.commands:
            seq, stored = self.commands[command_id]
            return "exists", 0, stored, seq
        current = self.versions.get(aggregate_id, 0)
        if version != current + 1:
            return "fail", 1001, current, 0
        self.seq += 1
        self.versions[aggregate_id] = version
        self.commands[command_id] = (self.seq, version)
        return "success", 0, version, self.seq


#: Columns of a result.
RESULT = "batch_id long, pos int, slot int, aggregate_id string, status string, err_id int, current_version long, seq long"


def append_fold(requests: DataFrame) -> DataFrame:
    """Results of requests with slot and reason, each slot in (batch_id, pos) order.

    Whether a request is accepted depends on all accepted before it in its slot, so a slot is one stream of key
    columns; what is held are its versions and commands. Bodies are joined back by (batch_id, pos) where they are wanted.
    """
    made = "status string, err_id int, current_version long, seq long"
    return ordered_fold(requests, ["slot"], ["batch_id", "pos"], ["aggregate_id", "version", "command_id", "reason"], ["batch_id", "pos", "slot", "aggregate_id"], made, lambda: SlotState().append)


def batch_append(requests: DataFrame, size: int, epoch: int = 1, request_epoch: int = 0) -> DataFrame:
    """Batch results in request order: the layout gate (1010), repeated aggregates (1002), then the fold."""
    base = size
    gated = size <= 0 or (request_epoch not in (0, epoch))
    if gated:
        return requests.select("batch_id", "pos", F.lit(-1).alias("slot"), "aggregate_id", F.lit("fail").alias("status"), F.lit(1010).alias("err_id"), F.lit(0).cast("long").alias("current_version"), F.lit(0).cast("long").alias("seq"))
    routed = requests.withColumn("slot", logical_slot("aggregate_id", size) + base)
    reason = F.when(duplicate_in_batch(), "duplicate_in_batch").otherwise(invalid_reason())
    return append_fold(routed.withColumn("reason", reason))


class TokenBucket:
    """At most ``tokens`` away at once: a token comes back ``period`` after it was taken, or when it is refunded.

    A refund counts at once; the next deadline to pass is then the one that gives nothing back.
    """

    def __init__(self, tokens: int, period: int) -> None:
        self.tokens, self.period, self.due, self.refunded = tokens, period, deque(), 0

    def take(self, now: int) -> bool:
        """Whether a token was free; ``now`` does not fall."""
        if self.tokens <= 0 or self.period <= 0:
            return True
        while self.due and self.due[0] <= now:
            self.due.popleft()
            self.refunded = max(self.refunded - 1, 0)
        if max(len(self.due) - self.refunded, 0) >= self.tokens:
            return False
        self.due.append(now + self.period)
        return True

    def refund(self) -> None:
        self.refunded += 1


def flow_control(requests: DataFrame, tokens: int, period: int) -> DataFrame:
    """requests: node, slot, at, group_id, pos, refundable. One row each with admitted and err_id.

    A refusal (1005) refuses the rest of its slot group too; a request refused by a rule of the slot gives its token back.
    A node is one stream in (at, group_id, pos) order; its bucket and the group at hand are all that is held.
    """

    def make():
        bucket, closed = TokenBucket(tokens, period), None

        def step(at, group, refundable):
            nonlocal closed
            ok = closed != (at, group) and bucket.take(at)
            if not ok:
                closed = (at, group)
            elif refundable:
                bucket.refund()
            return ok, 0 if ok else 1005

        return step

    keep = ["node", "slot", "at", "group_id", "pos"]
    return ordered_fold(requests, ["node"], ["at", "group_id", "pos"], ["at", "group_id", "refundable"], keep, "admitted boolean, err_id int", make)


def flow_hits(admitted: DataFrame) -> DataFrame:
    """node, slot, hits, node_hits: refusals by flow control of each slot, and all of its node."""
    per = admitted.where(F.col("err_id") == 1005).groupBy("node", "slot").agg(F.count("*").alias("hits"))
    return per.withColumn("node_hits", F.sum("hits").over(Window.partitionBy("node")))


def known_commands(requests: DataFrame, log: DataFrame) -> DataFrame:
    """Requests whose command is already in their slot (slot, command_id), before any fold."""
    return requests.join(log.select("slot", "command_id").distinct(), ["slot", "command_id"], "left_semi")


def python_fold(rows: Iterable[tuple], state_of: Callable[[], SlotState] = SlotState) -> list[tuple]:
    """A plain fold over (slot, aggregate_id, version, command_id, reason), for tests and small lists."""
    states: dict[int, SlotState] = {}
    return [states.setdefault(s, state_of()).append(a, v, c, r) for s, a, v, c, r in rows]
