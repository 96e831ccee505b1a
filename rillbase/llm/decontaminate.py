"""Benchmark decontamination: one Aho-Corasick automaton over normalised benchmark texts.

Normalised text: A-Z lower-cased, words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` with one space between. Each
item gives its windows of ``ngram`` consecutive words (one window for a shorter item with words). A
document is scanned once; a match ends at a character of the normalised text and is mapped to the words
it covers, and those to code points of the original text.

Defined results: a null or wordless text has no words, no hits and is not contaminated; a null, empty or
wordless item, and an item with null id, give no window; equal windows of several items name all of them;
repeated rows give repeated rows; empty tables give empty results. Columns made here replace input
columns of the same name.

Scale: no shuffle. The automaton is built in each Python worker from broadcast items of at most
``block_bytes``; a larger benchmark is split into blocks and the documents are scanned once for each,
with the same result.
"""

from __future__ import annotations

import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

#: Bytes of benchmark text in one automaton, and so in one broadcast.
BLOCK_BYTES = 8 << 20

_automata: dict[str, object] = {}
_LOWER = {c: c + 32 for c in range(65, 91)}


def normal_words(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def build(items: list[tuple[str, str]], ngram: int):
    """The automaton over all windows, or None without any; its values are (words in the window, items)."""
    import ahocorasick

    found: dict[str, tuple[int, set[str]]] = {}
    for item, text in items:
        w = normal_words(text.encode())
        for i in range(max(1, len(w) - ngram + 1) if w else 0):
            part = w[i : i + ngram]
            found.setdefault(f" {b' '.join(part).decode()} ", (len(part), set()))[1].add(item)
    if not found:
        return None
    out = ahocorasick.Automaton()
    for key, value in found.items():
        out.add_word(key, value)
    out.make_automaton()
    return out


def scan(automaton, words: list[bytes]) -> tuple[np.ndarray, set[str]]:
    """Which words are inside an occurrence, and the items that occur."""
    hit, items = np.zeros(len(words) + 1, np.int32), set()
    if automaton is None or not words:
        return hit[:-1] > 0, items
    text = f" {b' '.join(words).decode()} "
    ends = None
    for end, (n, names) in automaton.iter(text):
        if ends is None:
            ends = np.cumsum([len(w) + 1 for w in text[1:-1].split(" ")])
        last = int(np.searchsorted(ends, end))
        hit[last + 1 - n] += 1
        hit[last + 1] -= 1
        items |= names
    return np.cumsum(hit[:-1]) > 0, items


def spans_of(text: str, hit: np.ndarray) -> list[dict]:
    """Runs of hit words as code points of the original text, end exclusive."""
    if not hit.any():
        return []
    at = [m.span() for m in WORD.finditer(text.translate(_LOWER))]
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return [{"start": at[i][0], "end": at[j - 1][1]} for i, j in zip(edge[::2], edge[1::2], strict=True)]


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    ngram: int = 13,
    percent: int = 5,
    keep: list[str] | None = None,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``keep`` columns of docs (all by default) with n_words, n_hit, items (sorted), spans and contaminated.

    contaminated: at least one hit word, and ``percent`` of the words or more are hit.
    """
    spark = docs.sparkSession
    rows = benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(item_text).alias("t")).where("i is not null and t is not null")
    total = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    kept = docs.columns if keep is None else keep
    state = "n_words long, n_hit long, hit_words binary, items array<string>, spans array<struct<start:int,end:int>>"
    out = docs.withColumn("items", F.array().cast("array<string>")).withColumn("hit_words", F.lit(None).cast("binary")) if n > 1 else docs
    for k in range(n):
        block = [(r.i, r.t) for r in rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k).collect()]
        shared = spark.sparkContext.broadcast(block)

        def make(shared=shared, name=uuid.uuid4().hex, more=n > 1):
            if name not in _automata:
                _automata.clear()
                _automata[name] = build(shared.value, ngram)
            automaton = _automata[name]

            def run(columns):
                old_hit, old_items = (columns[1].to_pylist(), columns[2].to_pylist()) if more else (None, None)
                n_words, n_hit, bits, items, spans = [], [], [], [], []
                for row, s in enumerate(columns[0]):
                    t = s.as_py() or ""
                    words = normal_words(t.encode())
                    hit, names = scan(automaton, words)
                    if more and old_hit[row] is not None:
                        hit = hit | np.unpackbits(np.frombuffer(old_hit[row], np.uint8), count=len(words)).astype(bool)
                        names |= set(old_items[row])
                    n_words.append(len(words))
                    n_hit.append(int(hit.sum()))
                    bits.append(np.packbits(hit).tobytes() if hit.any() else None)
                    items.append(sorted(names))
                    spans.append(spans_of(t, hit))
                return [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(bits, pa.binary()), pa.array(items, pa.list_(pa.string())), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))]

            return run

        last = k == n - 1
        out = map_rows(out, [text, *(["hit_words", "items"] if n > 1 else [])], state, make, kept if last else [*dict.fromkeys([*kept, text])])
    return out.drop("hit_words").withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * 100 >= F.col("n_words") * percent))


def excise(spans: str = "spans", text: str = "text"):
    """The text without its spans (each replaced by one space)."""
    length = F.length(text)
    joined = F.aggregate(
        F.col(spans),
        F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda a, s: F.struct(F.concat(a["out"], F.substr(F.col(text), a["at"] + 1, s["start"] - a["at"]), F.lit(" ")).alias("out"), s["end"].alias("at")),
        lambda a: F.concat(a["out"], F.substr(F.col(text), a["at"] + 1, length - a["at"])),
    )
    return F.when(F.size(spans) > 0, joined).otherwise(F.col(text))
