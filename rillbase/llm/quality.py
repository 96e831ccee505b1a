"""Quality rules: fixed surface rules and a hashed n-gram log-likelihood ratio.

Tokens are lower-cased runs of word characters or of marks; unigrams and bigrams are hashed into
``buckets``. Two multinomials are estimated with add-one smoothing: the trusted target (a bounded sample of
documents labelled good) and the raw corpus (every document). A document's score is the sum of
log p_target - log p_raw over its n-grams, divided by their number plus ``shrink``. It is kept if no fixed
rule fails and its score is at least the threshold: the ``quantile`` of the scores of all documents labelled
good that took no part in the fit, for which half of the sample is used.

Defined results: null, empty and wordless texts have zero counts, score 0 and fail the rules; without
labels (none, or an empty table) every score is 0 and only the rules decide; repeated rows count and are
scored as rows of their own.

Scale: two passes over the texts and no shuffle of them; per task one count vector of ``buckets`` goes to the
sum, dealt by blocks of buckets. The sample of labels is at most ``sample`` rows, whatever the table's size;
the threshold comes from keys and scores joined with the labels and narrowed by counts of buckets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, map_rows, materialize, quantiles, utf8
from .textvec import LOWER, NOT_ALNUM, SPACES, mix, shingle_hashes, span_hashes, words

BUCKETS, BLOCKS = 1 << 14, 16
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_NEWLINE = np.zeros(256, bool)
_NEWLINE[10] = True
_LEAD = (np.arange(256) & 0xC0) != 0x80


def _per_doc(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def _repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys are there twice or more."""
    _, inverse, n = np.unique(keys, return_inverse=True, return_counts=True)
    return n[inverse] > 1


def surface(data: np.ndarray, offsets: np.ndarray, window: int = 5) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each document."""
    docs = np.arange(len(offsets) - 1)
    salt = mix(docs.astype(np.uint64) + np.uint64(1))
    starts, ends, n_words = words(data, offsets, SPACES)
    out = {"n_words": n_words, "word_chars": _per_doc(_LEAD[data] & ~SPACES[data], offsets), "n_symbols": _per_doc(_SYMBOL[data], offsets)}
    a, b, n_lines = words(data, offsets, _NEWLINE)
    dup = np.zeros(len(docs), np.int64)
    if len(a):
        filled = np.zeros(len(data) + 1, np.int64)
        np.cumsum(~SPACES[data], out=filled[1:])
        some = filled[b] > filled[a]
        owner = np.repeat(docs, n_lines)[some]
        keys = span_hashes(data, a, b)[some] ^ salt[owner]
        _, first = np.unique(keys, return_index=True)
        dup = np.bincount(owner, minlength=len(docs)) - np.bincount(owner[first], minlength=len(docs))
    out["n_dup_lines"] = dup
    cover = np.zeros(len(starts) + 1, np.int64)
    if len(starts):
        at = np.arange(len(starts))
        owner = np.repeat(docs, n_words)
        last = np.repeat(np.cumsum(n_words), n_words)
        at = at[at + window <= last]
        if len(at):
            full = np.where(n_words >= window, n_words, 0)
            inside = np.repeat(n_words >= window, n_words)
            keys, _ = shingle_hashes(span_hashes(data, starts, ends)[inside], full, window)
            at = at[_repeated(keys ^ salt[owner[at]])]
            np.add.at(cover, at, 1)
            np.add.at(cover, at + window, -1)
    out["n_repeat_words"] = _per_doc(np.cumsum(cover[:-1]) > 0, np.concatenate([[0], np.cumsum(n_words)]))
    return out


def ngrams(data: np.ndarray, offsets: np.ndarray, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all unigrams and bigrams, document by document, and the document of each."""
    low = LOWER[data]
    marks = NOT_ALNUM & ~SPACES
    marks[:32] = False
    a, b, n1 = words(low, offsets, NOT_ALNUM)
    c, d, n2 = words(low, offsets, ~marks)
    starts, ends = np.concatenate([a, c]), np.concatenate([b, d])
    order = np.argsort(starts, kind="stable")
    h = span_hashes(low, starts[order], ends[order])
    n = n1 + n2
    docs = np.repeat(np.arange(len(n)), n)
    pair = docs[1:] == docs[:-1]
    both = mix(h[:-1] * np.uint64(0x9E6C63D0876A9A47) + h[1:])[pair] if len(h) else h
    keys = np.concatenate([h, both])
    owner = np.concatenate([docs, docs[1:][pair]]) if len(h) else docs
    return (keys >> np.uint64(64 - (buckets - 1).bit_length())).astype(np.int64), owner


def target_sample(labels: DataFrame, label_id: str, label: str, sample: int) -> np.ndarray:
    """Key hashes of at most ``sample`` rows labelled 1, those with the smallest hashes."""
    good = labels.where(F.col(label) == 1).select(F.xxhash64(F.col(label_id).cast("string")).alias("h")).distinct()
    return np.sort(np.array([r.h for r in good.orderBy("h").limit(sample).collect()], np.int64))


def fit(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label_id: str, label: str, sample: int, buckets: int) -> tuple[np.ndarray | None, np.ndarray]:
    """log p_target - log p_raw for each bucket (None without labels), and the keys fitted."""
    chosen = target_sample(labels, label_id, label, sample)
    if not len(chosen):
        return None, chosen
    fitted = np.sort(chosen[mix(chosen.view(np.uint64)) % np.uint64(2) == 0])
    width = buckets // BLOCKS

    def count(batches):
        both = np.zeros((2, buckets), np.int64)
        for b in batches:
            data, offsets = utf8(b.column(1))
            good = np.isin(np.asarray(b.column(0)), fitted)
            for i, j in chunks(offsets):
                keys, owner = ngrams(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], buckets)
                both[0] += np.bincount(keys, minlength=buckets)
                if good[i:j].any():
                    both[1] += np.bincount(keys[good[i:j][owner]], minlength=buckets)
        if both[0].any():
            yield pa.RecordBatch.from_arrays([pa.array(range(BLOCKS), pa.int32()), pa.array([both[:, k * width : (k + 1) * width].tobytes() for k in range(BLOCKS)], pa.binary())], ["block", "n"])

    def add(batches):
        total = {}
        for b in batches:
            for k, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                total[k] = total.get(k, 0) + np.frombuffer(n, np.int64)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([n.tobytes() for n in total.values()], pa.binary())], ["block", "n"])

    key = F.xxhash64(F.col(doc_id).cast("string")).alias("h")
    summed = docs.select(key, F.col(text)).mapInArrow(count, "block int, n binary").repartition(BLOCKS, "block").mapInArrow(add, "block int, n binary")
    both = np.zeros((2, buckets), np.int64)
    for r in summed.collect():  # BLOCKS rows
        both[:, r.block * width : (r.block + 1) * width] = np.frombuffer(r.n, np.int64).reshape(2, width)
    if not both[1].any():
        return None, fitted
    p = np.log(both + 1.0) - np.log(both.sum(1, keepdims=True) + buckets)
    return p[1] - p[0], fitted


def scores(data: np.ndarray, offsets: np.ndarray, ratio: np.ndarray | None, shrink: float) -> np.ndarray:
    n = len(offsets) - 1
    if ratio is None:
        return np.zeros(n)
    keys, owner = ngrams(data, offsets, len(ratio))
    return np.bincount(owner, ratio[keys], n) / (np.bincount(owner, minlength=n) + shrink)


def rate(
    docs: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    label_id: str = "doc_id",
    label: str = "quality",
    sample: int = 4000,
    buckets: int = BUCKETS,
    shrink: float = 20.0,
    quantile: float = 0.005,
    keep: list[str] | None = None,
) -> DataFrame:
    """``keep`` columns with the surface counts, base_failed, score and kept."""
    spark = docs.sparkSession
    ratio, fitted = fit(docs, labels, doc_id, text, label_id, label, sample, buckets)
    shared = spark.sparkContext.broadcast(ratio)  # `buckets` numbers
    outside = spark.sparkContext.broadcast(fitted)  # at most `sample` numbers

    def make():
        def run(columns):
            data, offsets = utf8(columns[0])
            parts = []
            for i, j in chunks(offsets):
                d, o = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                parts.append({**surface(d, o), "score": scores(d, o, shared.value, shrink)})
            x = {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}
            failed = (x["n_words"] < 10) | (100 * x["n_repeat_words"] > 20 * x["n_words"])
            names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
            return [*[pa.array(x[k], pa.int64()) for k in names], pa.array(failed), pa.array(x["score"]), pa.array(~failed), pa.array(~np.isin(np.asarray(columns[1]), outside.value))]

        return run

    made = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, score double, kept boolean, _free boolean"
    keyed = docs.withColumn("_key", F.xxhash64(F.col(doc_id).cast("string")))
    rated = map_rows(keyed, [text, "_key"], made, make, [*(docs.columns if keep is None else keep), "_key"])
    if ratio is None:
        return rated.drop("_key", "_free")
    rated = materialize(rated, "rated")
    good = labels.where(F.col(label) == 1).select(F.xxhash64(F.col(label_id).cast("string")).alias("_key")).distinct()
    held = rated.where("_free").select("_key", "score").join(good, "_key", "left_semi").withColumn("all", F.lit(""))
    threshold = quantiles(materialize(held.select("all", "score"), "held-scores"), "all", "score", quantile).get("", -np.inf)
    return rated.withColumn("kept", F.col("kept") & (F.col("score") >= float(threshold))).drop("_key", "_free")
