"""Language-model scoring: corpus-wide word counts and a gated recurrent model.

Tokens of a document: its words with A-Z lower-cased, then one end. Word counts c, their sum N and number V
are of all training documents. The base score is the add-0.1 unigram log-likelihood. The model's score is
that of a recurrent network over the ``vocabulary`` most frequent words and one class for the others; a word
of that class is then drawn from the corpus counts of the others, add-0.1 again, so it is a distribution
over all words. The network reads a whole document, its state carried from the first token to the end.

Words are 64-bit hashes. The most frequent ``head`` words are broadcast (a bounded table); counts of the
others are looked up where they are kept: each task sends its rare words by hash range, already summed per
document, and gets back sums per document. The network learns from every training document: in each of
``ROUNDS`` rounds tasks train copies of it on their own share of a part of all documents, and the copies are
averaged, weighted by tokens. What is dealt to a task follows from keys and texts, not from files.

Defined results: a null text has the end token only; a null id counts as the empty string (held out);
without training documents N and V are 0 and the model is the base; repeated rows are scored, and counted,
as rows of their own; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, drop_path, materialize, scratch_path, utf8
from .counting import hash_parts, hash_ranges, most_frequent, summed
from .gru import GRU
from .textvec import LOWER, SPACES, span_hashes, words

END = np.uint64(0x2545F4914F6CDD1D)
#: Text bytes that a task scores side by side.
UNIT_BYTES = 12 << 20
CLASSES, WIDTH = 32, 32
#: Averaging rounds of the fit, about as many tokens as a task learns from in one of them, and pieces of the summed weights.
ROUNDS, TASK_TOKENS, BLOCKS = 4, 2_000_000, 16


def tokens_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all documents, the end included, and the number of each."""
    hashes, counts = [], []
    for i, j in chunks(offsets):
        d = LOWER[data[offsets[i] : offsets[j]]]
        s, e, n = words(d, offsets[i : j + 1] - offsets[i], SPACES)
        hashes.append(np.insert(span_hashes(d, s, e), np.cumsum(n), END))
        counts.append(n + 1)
    return (np.concatenate(hashes), np.concatenate(counts)) if hashes else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def word_counts(docs: DataFrame, text: str, training: Column) -> DataFrame:
    """p, keys and counts (binary, ascending keys) of all training documents."""

    def each(batch):
        return np.unique(tokens_of(*utf8(batch.column(0)))[0], return_counts=True)

    return summed(docs.where(training).select(text), each)


class Head:
    """Frequent words, their counts and their ids in the network's vocabulary (0: any other word)."""

    def __init__(self, keys: np.ndarray, n: np.ndarray, vocabulary: int):
        self.keys, self.n = keys, n
        self.ids = np.zeros(len(keys), np.int32)
        rank = np.lexsort((keys, -n))[: vocabulary - 1]
        self.ids[rank] = np.arange(1, len(rank) + 1)
        self.words, self.word_ids = keys[self.ids > 0], self.ids[self.ids > 0]

    def find(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return np.where(self.keys[at] == hashes, at, -1)

    def read(self, hashes: np.ndarray) -> np.ndarray:
        """The vocabulary's ids of words, by a search of the vocabulary alone."""
        if not len(self.words):
            return np.zeros(len(hashes), np.int32)
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        return np.where(self.words[at] == hashes, self.word_ids[at], 0)

    def vocabulary_ids(self, at: np.ndarray) -> np.ndarray:
        return np.where(at >= 0, self.ids[at], 0) if len(self.ids) else np.zeros(len(at), np.int32)


def fit_network(docs: DataFrame, doc_id: str, text: str, training: Column, head, total: int, rounds: int = ROUNDS) -> GRU:
    """The network after a pass over all training documents (up to four where they are few), in ``rounds`` of tasks whose weights are averaged by tokens."""
    spark = docs.sparkSession
    key = F.xxhash64(F.col(doc_id).cast("string"), F.lit("fit"))

    def ids(batches):
        for b in batches:
            hashes, m = tokens_of(*utf8(b.column(1)))
            t = head.value.read(hashes).astype(np.uint16)
            at = np.concatenate([[0], np.cumsum(m)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([t[s:e].tobytes() for s, e in zip(at[:-1], at[1:], strict=True)], pa.binary())], ["h", "t"])

    rows = docs.where(training).select(key.alias("h"), F.col(text)).mapInArrow(ids, "h long, t binary").select(F.xxhash64("h", "t").alias("h"), "t")
    path = scratch_path(spark, "token-ids")
    rows.withColumn("round", F.pmod("h", F.lit(rounds)).cast("int")).write.option("compression", "zstd").partitionBy("round").parquet(path)
    stored = spark.read.schema("h long, t binary, round int").parquet(path)
    parts, epochs = max(1, round(total / rounds / TASK_TOKENS)), max(1, min(4, TASK_TOKENS // total))
    network = GRU(CLASSES, WIDTH, 16)
    for i in range(rounds):
        now = spark.sparkContext.broadcast(network)

        def fit(batches, span=(i / rounds, (i + 1) / rounds), now=now):
            from pyspark import TaskContext

            mine, used, wait, size = now.value, 0, [], 0
            mine = GRU(mine.classes, mine.width, mine.hidden)
            mine.load(now.value.flat())

            def learn():
                mine.train(wait, batch=min(256, max(16, size // 8_000)), epochs=epochs, span=span)

            for b in batches:
                for t in b.column(0).to_pylist():
                    wait.append(np.frombuffer(t, np.uint16).astype(np.int64))
                    size += len(wait[-1])
                    if size >= 2 * TASK_TOKENS:
                        learn()
                        used, wait, size = used + size, [], 0
            if wait:
                learn()
            used += size
            if used:
                blocks = np.array_split(np.append(mine.flat(), 1.0).astype(np.float64) * used, BLOCKS)
                yield pa.RecordBatch.from_arrays([pa.array(range(BLOCKS), pa.int32()), pa.array([TaskContext.get().partitionId()] * BLOCKS, pa.int32()), pa.array([x.tobytes() for x in blocks], pa.binary())], ["block", "task", "w"])

        def add(batches):
            sums = {}
            for b in batches:
                for k, w in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                    sums[k] = sums.get(k, 0) + np.frombuffer(w)
            if sums:
                yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([w.tobytes() for w in sums.values()], pa.binary())], ["block", "w"])

        dealt = stored.where(F.col("round") == i).repartition(parts, "h").sortWithinPartitions("h", "t").select("t")
        weights = dealt.mapInArrow(fit, "block int, task int, w binary").repartition(BLOCKS, "block").sortWithinPartitions("block", "task").mapInArrow(add, "block int, w binary")
        found = sorted(weights.collect(), key=lambda r: r.block)  # one network
        if found:
            w = np.concatenate([np.frombuffer(r.w) for r in found])
            network.load(w[:-1] / w[-1])
    drop_path(spark, path)
    return network


def _score_units(docs: DataFrame, doc_id: str, text: str, held: Column, head, network, parts: int) -> DataFrame:
    """Two kinds of rows: a document with the sums of its frequent words, and a unit's rare words of a hash range."""
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), *T.StructType.fromDDL("held_out boolean, unit long, idx int, n_tokens long, head_sum double, head_known long, other_sum double, n_other long, net double, p int, doc binary, word binary, times binary").fields])

    def run(batches):
        from pyspark import TaskContext

        unit, wait, size = TaskContext.get().partitionId() << 20, [], 0

        def flush():
            texts = [utf8(b.column(2)) for b in wait]
            data = np.concatenate([d for d, _ in texts])
            lengths = np.concatenate([np.diff(o) for _, o in texts])
            offsets = np.concatenate([[0], np.cumsum(lengths)])
            hashes, n = tokens_of(data, offsets)
            docs_n, starts = len(n), np.cumsum(n) - n
            at = head.value.find(hashes)
            owner = np.repeat(np.arange(docs_n), n)
            logs = np.log10(head.value.n + 0.1) if len(head.value.n) else np.zeros(1)
            ids = head.value.vocabulary_ids(at)
            there = at >= 0
            add = lambda mask, v: np.bincount(owner[mask], v, docs_n).astype(np.float64)
            net = np.zeros(docs_n) if network.value is None else network.value.score(ids.astype(np.int64), starts, n)
            other = there & (ids == 0)
            columns = [
                pa.concat_arrays([b.column(0) for b in wait]),
                pa.concat_arrays([b.column(1) for b in wait]),
                pa.array(np.full(docs_n, unit)),
                pa.array(np.arange(docs_n), pa.int32()),
                pa.array(n),
                pa.array(add(there, logs[at[there]])),
                pa.array(np.bincount(owner[there], minlength=docs_n)),
                pa.array(add(other, logs[at[other]])),
                pa.array(np.bincount(owner[ids == 0], minlength=docs_n)),
                pa.array(net),
            ]
            yield pa.RecordBatch.from_arrays([*columns, *[pa.nulls(docs_n, f) for f in (pa.int32(), pa.binary(), pa.binary(), pa.binary())]], schema.names)
            rare, mine = hashes[~there], owner[~there]
            order = np.lexsort((mine, rare))
            rare, mine = rare[order], mine[order]
            if len(rare):
                first = np.flatnonzero(np.concatenate([[True], (rare[1:] != rare[:-1]) | (mine[1:] != mine[:-1])]))
                times = np.diff(np.append(first, len(rare))).astype(np.int32)
                rare, mine = rare[first], mine[first].astype(np.int32)
                edge = hash_ranges(rare, parts)
                some = [p for p in range(parts) if edge[p + 1] > edge[p]]
                blob = lambda x: pa.array([x[edge[p] : edge[p + 1]].tobytes() for p in some], pa.binary())
                k = len(some)
                empty = [pa.nulls(k, c.type) for c in columns]
                empty[2] = pa.array(np.full(k, unit))
                yield pa.RecordBatch.from_arrays([*empty, pa.array(some, pa.int32()), blob(mine), blob(rare), blob(times)], schema.names)

        for b in batches:
            for i in range(0, b.num_rows, 2048):
                part = b.slice(i, 2048)
                wait.append(part)
                size += int(utf8(part.column(2))[1][-1])
                if size >= UNIT_BYTES:
                    yield from flush()
                    unit, wait, size = unit + 1, [], 0
        if wait:
            yield from flush()

    return docs.select(doc_id, held, text).mapInArrow(run, schema)


def _rare_sums(units: DataFrame, counts: DataFrame) -> DataFrame:
    """unit, idx, rare_sum, rare_known: the rare words' share of each document."""
    asked = units.where("p is not null").select("p", F.lit(1).alias("kind"), "unit", F.col("doc").alias("a"), F.col("word").alias("b"), F.col("times").alias("c"))
    known = counts.select("p", F.lit(0).alias("kind"), F.lit(-1).cast("long").alias("unit"), F.col("keys").alias("a"), F.col("counts").alias("b"), F.lit(None).cast("binary").alias("c"))
    both = known.unionByName(asked).repartition("p").sortWithinPartitions("p", "kind")

    def answer(batches):
        now, keys, n = None, np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            out = [[], [], [], []]
            for p, kind, unit, a, b, c in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if p != now:
                    now, keys, n = p, np.zeros(0, np.uint64), np.zeros(0, np.int64)
                if kind == 0:
                    keys, n = np.frombuffer(a, np.uint64), np.frombuffer(b, np.int64)
                    continue
                docs, word, times = np.frombuffer(a, np.int32), np.frombuffer(b, np.uint64), np.frombuffer(c, np.int32)
                got = np.zeros(len(word), np.int64)
                if len(keys):
                    at = np.minimum(np.searchsorted(keys, word), len(keys) - 1)
                    got = np.where(keys[at] == word, n[at], 0)
                some, inverse = np.unique(docs, return_inverse=True)
                out[0].append(unit)
                out[1].append(some.tobytes())
                out[2].append(np.bincount(inverse, times * np.log10(got + 0.1), len(some)).astype(np.float64).tobytes())
                out[3].append(np.bincount(inverse, times * (got > 0), len(some)).astype(np.int32).tobytes())
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), *[pa.array(x, pa.binary()) for x in out[1:]]], ["unit", "docs", "sums", "known"])

    def add(batches):
        sums: dict[int, list[np.ndarray]] = {}
        for b in batches:
            for unit, docs, s, k in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                d = np.frombuffer(docs, np.int32)
                x = sums.setdefault(unit, [np.zeros(0), np.zeros(0, np.int64)])
                if d[-1] >= len(x[0]):
                    grow = int(d[-1]) + 1 - len(x[0])
                    x[0], x[1] = np.append(x[0], np.zeros(grow)), np.append(x[1], np.zeros(grow, np.int64))
                x[0][d] += np.frombuffer(s, np.float64)
                x[1][d] += np.frombuffer(k, np.int32)
        for unit, (s, k) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), unit)), pa.array(np.arange(len(s)), pa.int32()), pa.array(s), pa.array(k)], ["unit", "idx", "rare_sum", "rare_known"])

    return both.mapInArrow(answer, "unit long, docs binary, sums binary, known binary").repartition("unit").mapInArrow(add, "unit long, idx int, rare_sum double, rare_known long")


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", held_out: Column | None = None, head: int = 1 << 16) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10) of every row."""
    spark = docs.sparkSession
    held = F.lit(False) if held_out is None else held_out
    counts = materialize(word_counts(docs, text, ~held), "word-counts")
    keys, n, total, distinct = most_frequent(counts, head)
    table = Head(keys, n, CLASSES * WIDTH)
    shared = spark.sparkContext.broadcast(table)  # at most `head` words
    network = spark.sparkContext.broadcast(fit_network(docs, doc_id, text, ~held, shared, total) if total else None)
    inside = table.ids > 0
    others = float(total - n[inside].sum() + 0.1 * (distinct - inside.sum() + 1))
    units = materialize(_score_units(docs, doc_id, text, held.alias("held_out"), shared, network, hash_parts(spark)), "scored-units")
    rare = _rare_sums(units, counts)
    rows = units.where("p is null").join(rare, ["unit", "idx"], "left").fillna(0, ["rare_sum", "rare_known"])
    base = F.col("head_sum") + F.col("rare_sum") - F.col("n_tokens") * float(np.log10(total + 0.1 * (distinct + 1)))
    model = base if not total else F.col("net") / float(np.log(10)) + F.col("other_sum") + F.col("rare_sum") - F.col("n_other") * float(np.log10(others))
    return rows.select("doc_id", "held_out", "n_tokens", (F.col("head_known") + F.col("rare_known")).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), model.alias("score"))
