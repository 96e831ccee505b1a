"""Language identification by interpolated Kneser-Ney character language models.

Letters are lower-cased; a run of other characters is one break; text begins after a break. For each
language an order-4 model with one discount per order is estimated from a bounded sample: three quarters of the
labelled documents whose key hash is below a share that holds about 1.2 ``sample`` of them. Letters are numbered by 16 bits: of a sample with
more than 65,534 different ones (most of Unicode) the rarest share a symbol. The models' n-grams are in sorted hash arrays shared by
all languages, one column of log-probabilities (and back-off weights) per language. A document's language is
the one with the lowest cross-entropy per letter. Rejection is calibrated on all labelled documents that took
no part in the fit: a document is rejected when its lowest cross-entropy is above the ``quantile`` of those
labelled with its language plus ``margin`` (the highest of all languages where its own has none), or when it
has no letter (``und``).

Defined results: a null text, or one without letters, is ``und`` with score 0 and rejected; rows whose label
is null or not allowed teach nothing; without any labelled row everything is ``und``; ties go to the
language that sorts first; repeated rows are predicted as rows of their own; empty tables give no rows.

Scale: no shuffle of texts; what is broadcast are the models, whose size the sample bounds. The limits come from
counts of buckets over the stored result, which has the ``keep`` columns.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, map_rows, materialize, quantiles, utf8
from .textvec import mix

ORDER = 4
#: Letters with a symbol of their own.
LETTERS = (1 << 16) - 2
_fold: dict[str, np.ndarray] = {}


def fold_table() -> np.ndarray:
    """The lower-case letter of each code point, 0 for what is no letter."""
    if "t" not in _fold:
        out = np.zeros(0x110000, np.uint32)
        for i in range(0x110000):
            c = chr(i)
            if c.isalpha():
                out[i] = ord(c.lower()[0])
        _fold["t"] = out
    return _fold["t"]


def letters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Folded letters with one 0 before each run of them (so each text with letters begins by 0), and each document's end."""
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    lead = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=lead[1:])
    at = lead[offsets]
    s = fold_table()[points]
    letter = s > 0
    begins = letter.copy()
    begins[1:] &= ~letter[:-1]
    first = at[:-1][at[:-1] < len(s)]
    begins[first] |= letter[first]
    take = letter.astype(np.int64) + begins
    end = np.zeros(len(s) + 1, np.int64)
    np.cumsum(take, out=end[1:])
    out = np.zeros(end[-1], np.uint32)
    out[end[1:][letter] - 1] = s[letter]
    return out, end[at]


class Models:
    """Kneser-Ney models of several languages over 16-bit symbols."""

    def __init__(self, languages: list[str], alphabet: np.ndarray):
        self.languages, self.alphabet = languages, alphabet  # sorted letters; symbol i + 2; 1 is any other, 0 a break

    def symbols(self, s: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.alphabet, s), len(self.alphabet) - 1)
        return np.where(s == 0, 0, np.where(self.alphabet[at] == s, at + 2, 1)).astype(np.uint64)

    @staticmethod
    def keys(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The last ORDER symbols at each place, 16 bits each; none before a document's start is seen."""
        k, since = x.copy(), np.arange(len(x)) - np.repeat(starts[:-1], np.diff(starts))
        for j in range(1, ORDER):
            prior = np.zeros(len(x), np.uint64)
            prior[j:] = x[:-j]
            prior[since < j] = 0
            k |= prior << np.uint64(16 * j)
        return k

    def fit(self, keys: list[np.ndarray], counts: list[np.ndarray]) -> None:
        """From each language's counts of ORDER-grams."""
        n, size = len(self.languages), len(self.alphabet) + 2
        self.floor = np.full(n, -np.log(size), np.float64)
        tables: list[list] = [[] for _ in range(ORDER)]
        for k, c in zip(keys, counts, strict=True):
            grams, weight = k, c.astype(np.float64)
            for order in range(ORDER, 0, -1):
                tables[order - 1].append((grams, weight))
                low = grams & np.uint64((1 << 16 * (order - 1)) - 1)  # continuation counts: distinct symbols before
                grams, inverse = np.unique(low, return_inverse=True)
                weight = np.bincount(inverse, minlength=len(grams)).astype(np.float64)
        self.table = []
        for order in range(1, ORDER + 1):
            union = np.unique(np.concatenate([g for g, _ in tables[order - 1]]))
            contexts = np.unique(union >> np.uint64(16))
            logp, back = np.zeros((len(union), n)), np.zeros((len(contexts), n))
            for i, (grams, weight) in enumerate(tables[order - 1]):
                ones, twos = (weight == 1).sum(), (weight == 2).sum()
                discount = ones / (ones + 2 * twos) if ones and twos else 0.5
                context, inverse = np.unique(grams >> np.uint64(16), return_inverse=True)
                total = np.bincount(inverse, weight)
                kinds = np.bincount(inverse)
                at = np.searchsorted(contexts, context)
                back[at, i] = np.log(discount * kinds / total)
                p = np.zeros(len(union))
                p[np.searchsorted(union, grams)] = np.maximum(weight - discount, 0) / total[inverse]
                rest = np.exp(back[np.searchsorted(contexts, union >> np.uint64(16)), i])
                logp[:, i] = np.log(p + rest * np.exp(self.logp_lower(union, order, i)))
            self.add(order, union, logp, contexts, back)

    def logp_lower(self, grams: np.ndarray, order: int, i: int) -> np.ndarray:
        if order == 1:
            return np.full(len(grams), self.floor[i])
        return self.look(grams & np.uint64((1 << 16 * (order - 1)) - 1), order - 1)[:, i]

    def add(self, order: int, grams: np.ndarray, logp: np.ndarray, contexts: np.ndarray, back: np.ndarray) -> None:
        def hashed(k, v):
            h = mix(k + np.uint64(0x9E3779B97F4A7C15))
            o = np.argsort(h)
            bits = max(8, int(len(h)).bit_length() + 1)
            return h[o], v[o].astype(np.float32), np.searchsorted(h[o], np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)), bits

        self.table.append((hashed(grams, logp), hashed(contexts, back)))

    @staticmethod
    def find(table, keys: np.ndarray) -> np.ndarray:
        """Places of the keys in a sorted hash array, -1 for those not in it; a radix index shortens the search."""
        h, _, index, bits = table
        q = mix(keys + np.uint64(0x9E3779B97F4A7C15))
        at = np.minimum(index[(q >> np.uint64(64 - bits)).astype(np.int64)], len(h) - 1)
        there = h[at]
        left = np.flatnonzero(there < q)
        while len(left):
            at[left] += 1
            left = left[at[left] < len(h)]
            left = left[h[at[left]] < q[left]]
        at = np.minimum(at, len(h) - 1)
        return np.where(h[at] == q, at, -1)

    def look(self, keys: np.ndarray, order: int = ORDER) -> np.ndarray:
        """log p of the last symbol after the order - 1 before it, in each language."""
        grams, contexts = self.table[order - 1]
        at = self.find(grams, keys)
        out = grams[1][at]
        miss = np.flatnonzero(at < 0)
        if len(miss):
            low = keys[miss]
            context = self.find(contexts, low >> np.uint64(16))
            back = np.where(context[:, None] >= 0, contexts[1][context], np.float32(0))
            out[miss] = back + (self.look(low & np.uint64((1 << 16 * (order - 1)) - 1), order - 1) if order > 1 else self.floor.astype(np.float32))
        return out

    def entropies(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy (nats per symbol) of each document in each language, and its number of symbols."""
        s, ends = letters(data, offsets)
        n = np.diff(ends)
        total = np.zeros((len(n), len(self.languages)))
        if len(s):
            logp = self.look(self.keys(self.symbols(s), ends))
            some = np.flatnonzero(n)
            total[some] = np.add.reduceat(logp, ends[some], 0, dtype=np.float64)
        return -total / np.maximum(n, 1)[:, None], n


def sampled(docs: DataFrame, lang: str, sample: int) -> Column:
    """Whether a row with a label is among about ``sample`` (at most twice that) of its language with the smallest key hashes."""
    share = F.shiftrightunsigned("_key", 11).cast("double") / float(1 << 53)
    n = {r[0]: r[1] for r in docs.where("_learn").groupBy(F.col(lang).cast("string")).count().collect()}  # a row per language
    if not n:
        return F.lit(False)
    limit = F.create_map(*[F.lit(x) for k, v in n.items() for x in (k, 1.2 * sample / v)])
    return F.col("_learn") & (share < F.element_at(limit, F.col(lang).cast("string")))


def train(docs: DataFrame, text: str, lang: str) -> Models | None:
    """Models of three quarters of the rows with ``_sampled``."""
    rows = docs.where("_sampled").select(F.col("_key").alias("h"), F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))

    def count(batches):
        for b in batches:
            data, offsets = utf8(b.column(2))
            s, ends = letters(data, offsets)
            names = np.asarray(b.column(1).to_pylist(), object)
            fitted = mix(np.asarray(b.column(0)).view(np.uint64)) % np.uint64(4) != 0
            names, inverse = np.unique(names.astype(str), return_inverse=True)
            owner = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
            parts = [[], [], [], []]
            four = np.zeros((4, len(s)), np.uint32)
            since = np.arange(len(s)) - np.repeat(ends[:-1], np.diff(ends))
            for j in range(ORDER):
                four[j, j:] = s[: len(s) - j]
                four[j, since < j] = 0
            for k, name in enumerate(names):
                mine = (inverse[owner] == k) & fitted[owner]
                grams, n = np.unique(four[:, mine], axis=1, return_counts=True)
                parts[0] += [str(name)] * len(n)
                parts[1].append(grams[0].astype(np.int64) << 32 | grams[1])
                parts[2].append(grams[2].astype(np.int64) << 32 | grams[3])
                parts[3].append(n)
            if parts[0]:
                yield pa.RecordBatch.from_arrays([pa.array(parts[0]), *[pa.array(np.concatenate(p), pa.int64()) for p in parts[1:]]], ["lang", "a", "b", "n"])

    grams = rows.mapInArrow(count, "lang string, a long, b long, n long").groupBy("lang", "a", "b").agg(F.sum("n").alias("n")).toPandas()  # bounded by the sample
    if not len(grams):
        return None
    languages = sorted(grams["lang"].unique())
    a, b = grams["a"].to_numpy(), grams["b"].to_numpy()
    raw = [a >> 32, a & 0xFFFFFFFF, b >> 32, b & 0xFFFFFFFF]  # from the last letter back
    seen, inverse = np.unique(raw[0], return_inverse=True)
    times = np.bincount(inverse, grams["n"].to_numpy()) * (seen > 0)
    if not times.any():
        return None
    alphabet = np.sort(seen[np.lexsort((seen, -times))][: min((times > 0).sum(), LETTERS)]).astype(np.uint32)
    models = Models(languages, alphabet)
    keys = np.zeros(len(a), np.uint64)
    for j in range(ORDER):
        keys |= models.symbols(raw[j].astype(np.uint32)) << np.uint64(16 * j)
    per = []
    for name in languages:
        mine = (grams["lang"] == name).to_numpy()
        k, inverse = np.unique(keys[mine], return_inverse=True)
        per.append((k, np.bincount(inverse, grams["n"].to_numpy()[mine])))
    models.fit([k for k, _ in per], [n for _, n in per])
    return models


def identify(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    allowed: Column | None = None,
    sample: int = 300,
    quantile: float = 0.999,
    margin: float = 0.7,
    sharpness: float = 12.0,
    keep: list[str] | None = None,
) -> DataFrame:
    """``keep`` columns with lang_pred, score (0 to 1), entropy and rejected.

    Learns from ``allowed`` rows with a label. score: the softmax of ``sharpness`` times the entropies' distance.
    """
    learn = (F.lit(True) if allowed is None else allowed) & F.col(lang).isNotNull() & F.col(text).isNotNull()
    keyed = docs.withColumn("_key", F.xxhash64(F.col(doc_id).cast("string"))).withColumn("_learn", F.coalesce(learn, F.lit(False)))
    keyed = keyed.withColumn("_sampled", sampled(keyed, lang, sample)).withColumn("_label", F.when(F.col("_learn"), F.col(lang).cast("string")))
    models = train(keyed, text, lang)
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def make():
        def run(columns):
            m = shared.value
            data, offsets = utf8(columns[0])
            if m is None:
                k = len(offsets) - 1
                return [pa.array(["und"] * k), pa.array(np.zeros(k)), pa.array(np.zeros(k)), pa.array(np.ones(k, bool)), pa.array(np.zeros(k, bool))]
            parts = [m.entropies(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in chunks(offsets, 1 << 20)]
            h, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            best = h.argmin(1)
            low = h.min(1)
            score = np.where(n > 0, 1 / np.exp(-sharpness * (h - low[:, None])).sum(1), 0.0)
            names = np.where(n > 0, np.array([str(x) for x in m.languages], object)[best], "und")
            fitted = columns[2].to_numpy(zero_copy_only=False) & (mix(np.asarray(columns[1]).view(np.uint64)) % np.uint64(4) != 0)
            return [pa.array(names.tolist(), pa.string()), pa.array(score), pa.array(low), pa.array(n == 0), pa.array(~fitted & (n > 0))]

        return run

    kept = docs.columns if keep is None else keep
    found = map_rows(keyed, [text, "_key", "_sampled"], "lang_pred string, score double, entropy double, rejected boolean, _free boolean", make, [*kept, "_label"])
    if models is None:
        return found.drop("_label", "_free")
    found = materialize(found, "languages")
    limits = quantiles(found.where("_free"), "_label", "entropy", quantile)  # a number per language
    if limits:
        limit = F.create_map(*[F.lit(x) for k, v in limits.items() for x in (k, v + margin)])
        most = F.lit(max(limits.values()) + margin)
        found = found.withColumn("rejected", F.col("rejected") | (F.col("entropy") > F.coalesce(F.element_at(limit, F.col("lang_pred")), most)))
    return found.drop("_label", "_free")
