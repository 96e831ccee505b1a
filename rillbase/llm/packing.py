"""Best-fit packing of tokenised documents into sequences of fixed capacity.

A document's ids, with an end id, are cut into pieces only where it is longer than the capacity; then the
first piece takes the remainder. Pieces are packed best-fit decreasing. Equal lengths are interchangeable,
so the plan is made from the number of pieces of each length (at most ``capacity`` numbers, whatever the
input's size): a segment tree over remaining capacities finds the tightest open bin in logarithmic time,
and a run of equal pieces goes into a run of equal bins at once. The plan says for ranks a to b of a length
which sequence and offset they have; ranks come from per-task counts and their running sums, so no row is
sorted and no length meets in one task.

Defined results: a null text is empty and packs as the end id alone; repeated rows, null ids and ties are
packed as rows of their own; an empty table packs into nothing.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, read_scratch, utf8, write_scratch
from .tokens import default_path, encoder

#: Rows of the (task, length) table that may be broadcast; beyond this it is joined by a shuffle.
BROADCAST_ROWS = 500_000


class CapacityTree:
    """A segment tree over remaining capacities: which are there, and the smallest of at least some size."""

    def __init__(self, capacity: int):
        self.size = 1 << (capacity + 1).bit_length()
        self.tree = np.zeros(2 * self.size, np.int64).tolist()

    def set(self, at: int, there: bool) -> None:
        i = at + self.size
        self.tree[i] = int(there)
        while i > 1:
            i //= 2
            self.tree[i] = self.tree[2 * i] | self.tree[2 * i + 1]

    def tightest(self, least: int) -> int:
        """The smallest capacity of ``least`` or more, or -1."""
        i = least + self.size
        if self.tree[i]:
            return least
        while i > 1:
            if not i & 1 and self.tree[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.tree[2 * i] else 2 * i + 1
                return i - self.size
            i //= 2
        return -1


def plan(counts: dict[int, int], capacity: int) -> tuple[dict[str, np.ndarray], int]:
    """Runs of equal pieces in best-fit decreasing order, and the number of sequences.

    Run: pieces of ``length`` with ranks from ``first`` on; the piece of rank r is in sequence
    bin + (r - first) // per at offset used + (r - first) % per * length.
    """
    tree, open_bins, bins, runs = CapacityTree(capacity), {}, 0, []
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = tree.tightest(length)
            if room < 0:
                room, per = capacity, capacity // length
                begin, many = bins, -(-left // per)
                bins += many
            else:
                begin, many = open_bins[room].pop()
                if not open_bins[room]:
                    tree.set(room, False)
            per = room // length
            full = min(many, left // per)
            take = full * per if full else left
            used = max(full, 1)
            runs.append((length, rank, begin, per, capacity - room))
            for first, n, rest in ((begin, used, room - (per if full else left) * length), (begin + used, many - used, room)):
                if n and rest:
                    open_bins.setdefault(rest, []).append((first, n))
                    tree.set(rest, True)
            rank, left = rank + take, left - take
    names = ("length", "first", "bin", "per", "used")
    table = np.array(runs, np.int64).reshape(-1, 5)
    table = table[np.lexsort((table[:, 1], table[:, 0]))]
    return dict(zip(names, table.T, strict=True)), bins


def pieces(docs: DataFrame, doc_id: str, text: str, capacity: int, end_id: int, tokenizer: str) -> DataFrame:
    """One row per piece with its ids, and its rank among its task's pieces of that length."""
    schema = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), *T.StructType.fromDDL("piece int, start long, length long, ids_crc32 long, ids binary, task int, rank long").fields])

    def run(batches):
        from pyspark import TaskContext

        task, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for b in batches:
            data, offsets = utf8(b.column(1))
            for i, j in chunks(offsets):
                ids, n = encoder(tokenizer).encode(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                last = np.cumsum(n)
                ids = np.insert(ids, last, end_id).astype("<u4")
                n = n + 1
                begin = np.cumsum(n) - n
                parts = -(-n // capacity)
                row = np.repeat(np.arange(len(n)), parts)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
                head = n - (parts - 1) * capacity
                start = np.where(piece > 0, head[row] + (piece - 1) * capacity, 0)
                length = np.where(piece > 0, capacity, head[row])
                order = np.argsort(length, kind="stable")
                sizes = np.bincount(length, minlength=capacity + 1)
                rank = np.empty(len(row), np.int64)
                rank[order] = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(seen, sizes)
                seen += sizes
                raw = [ids[s:e].tobytes() for s, e in zip(begin[row] + start, begin[row] + start + length, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).slice(i, j - i).take(pa.array(row)),
                        pa.array(piece, pa.int32()),
                        pa.array(start),
                        pa.array(length),
                        pa.array([zlib.crc32(x) for x in raw], pa.int64()),
                        pa.array(raw, pa.binary()),
                        pa.array(np.full(len(row), task, np.int32)),
                        pa.array(rank),
                    ],
                    schema.names,
                )

    return docs.select(doc_id, text).mapInArrow(run, schema)


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = 1024, end_id: int = 2, tokenizer: str | None = None) -> DataFrame:
    """Pieces with ids (little-endian unsigned 32-bit), their crc32, sequence_id and offset."""
    spark = docs.sparkSession
    made = pieces(docs, doc_id, text, capacity, end_id, tokenizer or default_path())
    table = read_scratch(spark, write_scratch(made, "pieces"), made.schema)
    counts = table.groupBy("task", "length").agg(F.count("*").alias("n"))
    base = counts.withColumn("base", F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")).select("task", "length", "base")
    totals = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    tasks = table.agg(F.countDistinct("task")).first()[0]
    if tasks * capacity <= BROADCAST_ROWS:
        base = F.broadcast(base)
    runs, _ = plan(totals, capacity)
    placed = table.join(base, ["task", "length"]).withColumn("rank", F.col("rank") + F.col("base")).drop("base", "task")
    shared = spark.sparkContext.broadcast(runs)  # at most (capacity + 1) squared runs, whatever the input

    @F.pandas_udf("struct<sequence_id:long,offset:long>")
    def place(length, rank):
        import pandas as pd

        r = shared.value
        n, k = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        spread = int(max(r["first"].max(initial=0), k.max(initial=0))) + 1
        at = np.searchsorted(r["length"].astype(object) * spread + r["first"] if spread > 1 << 50 else r["length"] * spread + r["first"], n * spread + k, "right") - 1
        k = k - r["first"][at]
        return pd.DataFrame({"sequence_id": r["bin"][at] + k // r["per"][at], "offset": r["used"][at] + k % r["per"][at] * n})

    out = placed.withColumn("at", place("length", "rank"))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "ids", "at.sequence_id", "at.offset")
