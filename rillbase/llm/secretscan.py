"""Secret scans with corpus-wide ownership frequency.

Base spans by three patterns (assign, access, hex). Each candidate value (group 2 of assign, else the whole
span) is counted over the whole corpus: by how many distinct repositories and owners it is used, and in how
many distinct texts, so that copies of a text count once. A value with ``copied_owners`` or more of each is a
widely copied example; any other that looks like a credential is live-looking, and its value gets a further
span of kind ``live``. Base spans stay as they are.

Access keys always look like one; hex runs do with 8 distinct characters, a digit and a letter; assigned values
with 8 distinct characters, or, of 6 to 11 characters, with 5 distinct ones of two classes (lower, upper, digit,
other), so plain short words do not.

Here documents stand for repositories and ``source`` for their owner.

Defined results: a null text is empty and has no spans; a null owner or repository counts as one of its own
name; repeated rows are rows of their own and count as one repository; empty tables give empty results.

Scale: texts are read once, in place; what is shuffled are candidate values (hashes), and the rows that have spans.
Counting distinct owners is aggregated before it is dealt. Counts are joined back in two ways: those of values
with more than one of ``HOT`` candidates, fewer than ``HOT`` values at any size, are broadcast, so such a value's
rows stay where they are; the others are shuffled by value.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, materialize

KINDS = ("assign", "access", "hex", "live")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a run is matched whole, so this drops the shorter runs
_KEYWORD = re.compile(rb"passw|secret|token|api_?key")
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))

#: A value with more than one of so many candidates is hot.
HOT = 10_000


def find_spans(text: str) -> list[tuple[int, int, int, int, int]]:
    """(start, kind, end, start of value, end of value), by start and then kind; code points."""
    out = []
    raw = text.encode("utf-8", "surrogatepass").translate(_LOWER)
    if _KEYWORD.search(raw):
        out += [(m.start(), 0, m.end(), *m.span(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end(), *m.span()) for m in HEX.finditer(text)]
    return sorted(out)


def looks_live(value: str, kind: int) -> bool:
    """Whether a value can be a credential: any access key, a varied hex run, an assigned value that is varied for its length."""
    letter, digit = any(c.isalpha() for c in value), any(c.isdigit() for c in value)
    if kind == 0 and len(value) < 12:
        classes = (any(c.islower() for c in value), any(c.isupper() for c in value), digit, not value.isalnum())
        return len(set(value)) >= 5 and sum(classes) >= 2
    return kind == 1 or len(set(value)) >= 8 and (kind == 0 or letter and digit)


SPAN = "array<struct<kind:int,start:int,end:int,value_start:int,value_end:int,value:binary,strong:boolean>>"


def candidates(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """``keep`` columns with rid (a row number within the task's numbers) and base spans."""
    kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("value_start", pa.int32()), ("value_end", pa.int32()), ("value", pa.binary()), ("strong", pa.bool_())]))

    def make():
        from pyspark import TaskContext

        at = TaskContext.get().partitionId() << 40

        def run(columns):
            nonlocal at
            spans = []
            for s in columns[0]:
                t = s.as_py() or ""
                spans.append([{"kind": k, "start": a, "end": b, "value_start": c, "value_end": d, "value": hashlib.sha256(t[c:d].encode()).digest()[:16], "strong": looks_live(t[c:d], k)} for a, k, b, c, d in find_spans(t)])
            rid = range(at, at + len(spans))
            at += len(spans)
            return [pa.array(rid, pa.int64()), pa.array(spans, kind)]

        return run

    return map_rows(docs, [text], f"rid long, spans {SPAN}", make, keep)


def ownership(found: DataFrame, owner: str, repository: str, copy: str) -> DataFrame:
    """value, n_repositories, n_owners, n_texts and n (candidates) over all of them; rows of the same ``copy`` have the same text."""
    each = found.select(F.explode("spans.value").alias("value"), F.col(owner).cast("string").alias("o"), F.col(repository).cast("string").alias("r"), F.col(copy).alias("t"))
    owners = each.select("value", "o").distinct().groupBy("value").agg(F.count("*").alias("n_owners"))
    repositories = each.groupBy("value", "r").agg(F.count("*").alias("n")).groupBy("value").agg(F.count("*").alias("n_repositories"), F.sum("n").alias("n"))
    texts = each.select("value", "t").distinct().groupBy("value").agg(F.count("*").alias("n_texts"))
    return owners.join(repositories, "value").join(texts, "value")


def scan_secrets(docs: DataFrame, text: str = "text", owner: str = "source", repository: str = "doc_id", keep: list[str] | None = None, copied_owners: int = 4) -> DataFrame:
    """``keep`` columns with secrets: array of (kind, start, end, n_repositories, n_owners), by start and kind.

    Kinds are the positions in KINDS; live spans cover the value alone.
    """
    kept = [c for c in (docs.columns if keep is None else keep) if c != "secrets"]
    source = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(kept)], F.col(text).alias("scan_text"), F.col(owner).alias("scan_owner"), F.col(repository).alias("scan_repository"), F.xxhash64(text).alias("scan_copy"))
    names = [f"c{i}" for i in range(len(kept))]
    found = materialize(candidates(source, "scan_text", [*names, "scan_owner", "scan_repository", "scan_copy"]), "secret-candidates")
    some = found.where(F.size("spans") > 0)
    each = some.select("rid", F.explode("spans").alias("s")).withColumn("value", F.col("s.value"))
    counts = materialize(ownership(some, "scan_owner", "scan_repository", "scan_copy"), "secret-owners")
    hot = F.col("n") * HOT > (counts.agg(F.sum("n")).first()[0] or 0)
    wide = F.broadcast(counts.where(hot))  # fewer than HOT values
    cold = each.join(F.broadcast(counts.where(hot).select("value")), "value", "left_anti").join(counts.where(~hot), "value")
    known = each.join(wide, "value").unionByName(cold)
    span = lambda kind, start, end: F.struct(F.col(start).alias("start"), kind.alias("kind"), F.col(end).alias("end"), "n_repositories", "n_owners")
    base = span(F.col("s.kind"), "s.start", "s.end")
    live = F.when(F.col("s.strong") & (F.least("n_owners", "n_repositories", "n_texts") < copied_owners), span(F.lit(KINDS.index("live")), "s.value_start", "s.value_end"))
    spans = known.select("rid", base.alias("base"), live.alias("live")).groupBy("rid").agg(F.sort_array(F.concat(F.collect_list("base"), F.collect_set("live"))).alias("secrets"))
    none = F.array().cast(spans.schema["secrets"].dataType)
    out = lambda rows, secrets: rows.select(*[F.col(n).alias(c) for n, c in zip(names, kept, strict=True)], secrets.alias("secrets"))
    return out(some.join(spans, "rid"), F.col("secrets")).unionByName(out(found.where(F.size("spans") == 0), none))


def joined_spans(spans):
    """kind:start:end, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: str = "text", secrets: str = "secrets", mark: str = "[secret]"):
    """The text with each live span replaced by ``mark``; overlapping spans count once."""
    live = F.filter(F.col(secrets), lambda s: s["kind"] == KINDS.index("live"))
    joined = F.aggregate(
        live,
        F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda a, s: F.when(s["start"] < a["at"], a).otherwise(F.struct(F.concat(a["out"], F.substr(F.col(text), a["at"] + 1, s["start"] - a["at"]), F.lit(mark)).alias("out"), s["end"].alias("at"))),
        lambda a: F.concat(a["out"], F.substr(F.col(text), a["at"] + 1, F.length(text) - a["at"])),
    )
    return F.when(F.size(live) > 0, joined).otherwise(F.col(text))
