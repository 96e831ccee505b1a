"""The append state machine and the out-of-order hold as stateful streams."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.append import RESULT, SlotState

class Entries:
    """A map in the state as far as ``SlotState`` uses a dict; an entry is read once in a micro-batch and written when it is set."""

    def __init__(self, state):
        self.state, self.read = state, {}

    def __contains__(self, key: str) -> bool:
        if key not in self.read:
            self.read[key] = self.state.getValue((key,)) if self.state.containsKey((key,)) else None
        return self.read[key] is not None

    def __getitem__(self, key: str) -> tuple:
        if key not in self:
            raise KeyError(key)
        return self.read[key]

    def __setitem__(self, key: str, value: tuple) -> None:
        self.read[key] = value
        self.state.updateValue((key,), value)


class Versions(Entries):
    def get(self, key: str, default: int) -> int:
        return int(self[key][0]) if key in self else default

    def __setitem__(self, key: str, value: int) -> None:
        super().__setitem__(key, (value,))


class Appends(StatefulProcessor):
    """A slot's last seq, and one state entry for each aggregate and command."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seq = handle.getValueState("seq", "seq long")
        self.versions = handle.getMapState("versions", "aggregate_id string", "version long")
        self.commands = handle.getMapState("commands", "command_id string", "seq long, version long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        known = SlotState()
        known.seq = int(self.seq.get()[0]) if self.seq.exists() else 0
        known.versions, known.commands = Versions(self.versions), Entries(self.commands)
        rows = pd.concat(list(rows)).sort_values(["batch_id", "pos"], kind="stable").reset_index(drop=True)
        done = [known.append(a, int(v), c, r if isinstance(r, str) else None) for a, v, c, r in zip(rows["aggregate_id"], rows["version"], rows["command_id"], rows["reason"], strict=True)]
        self.seq.update((known.seq,))
        yield pd.concat([rows[["batch_id", "pos"]], pd.Series([key[0]] * len(rows), name="slot"), rows[["aggregate_id"]], pd.DataFrame(done, columns=["status", "err_id", "current_version", "seq"])], axis=1)

    def close(self) -> None:
        pass


def append_stream(requests: DataFrame) -> DataFrame:
    """Results of a stream of requests (slot, batch_id, pos, aggregate_id, version, command_id, reason).

    A slot's rows of a micro-batch are put in (batch_id, pos) order; the state outlives the batch, so a stream
    whose batches arrive in order has the results of one fold over all of it. A micro-batch reads and writes only
    the state entries of its own aggregates and commands. Needs the RocksDB state store
    (``spark.sql.streaming.stateStore.providerClass``).
    """
    keys = requests.select("slot", "batch_id", "pos", "aggregate_id", "version", "command_id", "reason")
    return keys.groupBy("slot").transformWithStateInPandas(Appends(), RESULT, "append", "none")


def hold_stream(frames: DataFrame) -> DataFrame:
    """aggregate_id, version, seq as versions become resolvable; frames beyond a gap wait in the state until it fills."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, held = (state.get[0], {int(k): v for k, v in json.loads(state.get[1]).items()}) if state.exists else (0, {})
        out = []
        for version, seq in sorted(((int(v), int(s)) for b in batches for v, s in zip(b["version"], b["seq"], strict=True)), key=lambda r: r[1]):
            if version > last:
                held.setdefault(version, seq)
            while last + 1 in held:
                last += 1
                out.append((key[0], last, held.pop(last)))
        state.update((last, json.dumps(held)))
        if out:
            yield pd.DataFrame(out, columns=["aggregate_id", "version", "seq"])

    return frames.select("aggregate_id", "version", "seq").groupBy("aggregate_id").applyInPandasWithState(step, "aggregate_id string, version long, seq long", "last long, held string", "append", GroupStateTimeout.NoTimeout)
