"""Counts of 64-bit hashes over a corpus, packed by hash range: a row holds many keys, a shuffle moves few rows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Distinct keys that a task holds before it sends what it has.
HOLD = 4_000_000


def hash_parts(spark) -> int:
    """Hash ranges: a power of two, about twice the shuffle partitions."""
    return 1 << max(3, int(2 * int(spark.conf.get("spark.sql.shuffle.partitions"))).bit_length())


def hash_ranges(sorted_hashes: np.ndarray, parts: int) -> np.ndarray:
    return np.searchsorted(sorted_hashes, np.arange(parts, dtype=np.uint64) << np.uint64(65 - int(parts).bit_length())).tolist() + [len(sorted_hashes)]


def sum_by_key(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], (np.add.reduceat(n, first) if len(first) else n)


def by_first(batches, width: int):
    """The rows of each first column's value in turn, from rows sorted by it: one group is held at a time."""
    now, rows = None, []
    for b in batches:
        for row in zip(*(b.column(i).to_pylist() for i in range(width)), strict=True):
            if rows and row[0] != now:
                yield now, rows
                rows = []
            now = row[0]
            rows.append(row)
    if rows:
        yield now, rows


def summed(source: DataFrame, each: Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """p, keys, counts (binary, ascending keys): the sums of ``each`` batch's keys and counts."""
    parts = hash_parts(source.sparkSession)
    schema = "p int, keys binary, counts binary"

    def blobs(keys, n):
        at = hash_ranges(keys, parts)
        some = [p for p in range(parts) if at[p + 1] > at[p]]
        return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([keys[at[p] : at[p + 1]].tobytes() for p in some], pa.binary()), pa.array([n[at[p] : at[p + 1]].tobytes() for p in some], pa.binary())], ["p", "keys", "counts"])

    def count(batches):
        keys, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for b in batches:
            got, m = each(b)
            keys, n = sum_by_key(np.concatenate([keys, got]), np.concatenate([n, m]))
            if len(keys) > HOLD:
                yield blobs(keys, n)
                keys, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        if len(keys):
            yield blobs(keys, n)

    def add(batches):
        for p, rows in by_first(batches, 3):
            keys, n = sum_by_key(np.concatenate([np.frombuffer(k, np.uint64) for _, k, _ in rows]), np.concatenate([np.frombuffer(n, np.int64) for _, _, n in rows]))
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([keys.tobytes()], pa.binary()), pa.array([n.tobytes()], pa.binary())], ["p", "keys", "counts"])

    return source.mapInArrow(count, schema).repartition("p").sortWithinPartitions("p").mapInArrow(add, schema)


def _each(batches):
    for b in batches:
        for k, n in zip(b.column("keys").to_pylist(), b.column("counts").to_pylist(), strict=True):
            yield np.frombuffer(k, np.uint64), np.frombuffer(n, np.int64)


def most_frequent(counts: DataFrame, head: int) -> tuple[np.ndarray, np.ndarray, int, int]:
    """The keys of the highest counts (at most ``head``, ascending), their counts, the sum of all counts and the number of keys."""

    def summary(batches):
        out = np.zeros((512, 2), np.int64)
        for _, n in _each(batches):
            b = np.floor(8 * np.log2(n)).astype(np.int64)
            out[:, 0] += np.bincount(b, minlength=512)
            out[:, 1] += np.bincount(b, n, minlength=512).astype(np.int64)
        some = np.flatnonzero(out[:, 0])
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(out[some, 0]), pa.array(out[some, 1])], ["b", "v", "n"])

    table = {r.b: (r.v, r.n) for r in counts.mapInArrow(summary, "b long, v long, n long").groupBy("b").agg(F.sum("v").alias("v"), F.sum("n").alias("n")).collect()}
    total_n, total_v = sum(n for _, n in table.values()), sum(v for v, _ in table.values())
    least, taken = 512, 0
    for b in sorted(table, reverse=True):
        if taken + table[b][0] > head:
            break
        taken, least = taken + table[b][0], b
    # Buckets are taken whole: where the top one alone has more than ``head`` keys none is frequent, and all are looked up.

    def frequent(batches):
        for k, n in _each(batches):
            mask = np.floor(8 * np.log2(n)) >= least
            if mask.any():
                yield pa.RecordBatch.from_arrays([pa.array([k[mask].tobytes()], pa.binary()), pa.array([n[mask].tobytes()], pa.binary())], ["k", "n"])

    rows = counts.mapInArrow(frequent, "k binary, n binary").collect()
    keys = np.concatenate([np.frombuffer(r.k, np.uint64) for r in rows] or [np.zeros(0, np.uint64)])
    n = np.concatenate([np.frombuffer(r.n, np.int64) for r in rows] or [np.zeros(0, np.int64)])
    order = np.argsort(keys)
    return keys[order], n[order], total_n, total_v
