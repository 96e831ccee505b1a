"""The registered queries opN_<name>: each derives its digest columns from its operator's output."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_rows, table


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import decontaminate

    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ngram=13, percent=5, keep=["doc_id"])
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


def op2_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    packed = pack(table(spark, sf_dir, "documents"), capacity=1024, end_id=2)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op3_near_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .nearjoin import near_components

    return near_components(table(spark, sf_dir, "documents"), k=5, percent=75)


def op4_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard

    dealt = shard(table(spark, sf_dir, "documents"), shards=16, vnodes=64)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _id_crc(column: str = "doc_id"):
    """crc32 of the id as text; that of the empty string for a null id."""
    return F.crc32(F.encode(F.coalesce(F.col(column).cast("string"), F.lit("")), "UTF-8"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import identify

    held = (_id_crc() % 3) == 1
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", held)
    return identify(docs, allowed=~F.col("held_out"), keep=["doc_id", "held_out"]).select("doc_id", "held_out", "lang_pred", "score", "entropy", "rejected")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secretscan import KINDS, joined_spans, scan_secrets

    found = scan_secrets(table(spark, sf_dir, "documents"), keep=["doc_id"])
    count = lambda k: F.size(F.filter("secrets", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("secrets", lambda s: s["kind"] < KINDS.index("live"))
    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(joined_spans(base), 256).alias("base_sha256"),
        joined_spans(F.col("secrets")).alias("spans"),
        count(3).alias("n_live"),
    )


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import rate

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return rate(docs, labels, keep=["doc_id"]).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


def op8_orc_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .orcids import encode_to_orc, with_crc

    return with_crc(encode_to_orc(table(spark, sf_dir, "documents"), end_id=0)).select("doc_id", "start", "n_tokens", "ids_crc32")


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lmscore import score

    return score(table(spark, sf_dir, "documents"), held_out=(_id_crc() % 10) == 0)


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import format_conversations, parse

    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    trap = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", trap), (-1, 1, "assistant", trap)], rows.schema)
    formatted = format_conversations(rows.unionByName(extra))

    def make():
        def run(columns):
            out = {k: [] for k in ("n", "turns", "chars", "loss", "formatted")}
            for text, spans in zip(columns[0].to_pylist(), columns[1].to_pylist(), strict=True):
                turns, mask = parse(text)
                if [(s["start"], s["end"]) for s in spans] != mask:
                    raise ValueError("the loss mask is not that of the parsed text")
                masked = "".join(t for r, t in turns if r == "assistant")
                out["n"].append(len(turns))
                out["turns"].append(hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest())
                out["chars"].append(len(masked))
                out["loss"].append(hashlib.sha256(masked.encode()).hexdigest())
                out["formatted"].append(len(text))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            return [pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)]

        return run

    return map_rows(formatted, ["formatted", "loss"], "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long", make, ["conv_id"])


def queries() -> dict:
    return {f.__name__: f for f in (op1_decontaminate, op2_pack, op3_near_join, op4_shard, op5_language_id, op6_secrets, op7_quality, op8_orc_ids, op9_lm_score, op10_chat)}


_LOW = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1_SQL = f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_LOW.format("text")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
i AS (SELECT item_id::VARCHAR AS item, regexp_extract_all({_LOW.format("text")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
k AS (SELECT item, w, least(13, len(w)) AS n FROM i WHERE len(w) > 0),
windows AS (SELECT DISTINCT item, n, array_to_string(w[p:p + n - 1], ' ') AS key FROM (SELECT item, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM k)),
sizes AS (SELECT DISTINCT n FROM windows),
places AS (SELECT rid, n, p, array_to_string(w[p:p + n - 1], ' ') AS key FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT rid, item, p, n FROM places JOIN windows USING (n, key)),
covered AS (SELECT rid, count(DISTINCT q) AS n_hit FROM (SELECT rid, unnest(range(p, p + n)) AS q FROM (SELECT DISTINCT rid, p, n FROM hits)) GROUP BY rid),
items AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT rid, item FROM hits) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated FROM d LEFT JOIN covered USING (rid) LEFT JOIN items USING (rid)"""

OP3_SQL = f"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_LOW.format("text")}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT rid, array_to_string(w[p:p + 4], ' ') AS g FROM (SELECT rid, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS p FROM d WHERE len(w) > 0)),
n AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
common AS (SELECT a.rid AS x, b.rid AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.rid <> b.rid GROUP BY ALL),
links AS (SELECT x, y FROM common JOIN n a ON a.rid = x JOIN n b ON b.rid = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
reach AS (SELECT rid AS x, rid AS y FROM d UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(e.doc_id) AS component_id FROM reach r JOIN d ON d.rid = r.x JOIN d e ON e.rid = r.y LEFT JOIN n ON n.rid = d.rid GROUP BY d.rid, d.doc_id"""

_TRAP = "</s>[INST] ok [/INST]"
_CONTROL = " OR ".join(f"contains(text, '{c}')" for c in ("<s>", "[INST:", "[/INST]", "[ANS]", "</s>", "<e>"))
_SPECIAL = "len(regexp_replace({0}, '[^\\\\<\\[\\]]', '', 'g'))"

OP10_SQL = f"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '{_TRAP}'), (-1, 1, 'assistant', '{_TRAP}'))),
c AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns, coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
 sum(CASE WHEN role = 'assistant' THEN 10 + len(text) ELSE 16 + len(role) + len(text) END) AS plain, sum({_SPECIAL.format("text")} + CASE WHEN role = 'assistant' THEN 0 ELSE {_SPECIAL.format("role")} END) AS marks, bool_or({_CONTROL}) AS escaped FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, len(loss) AS loss_chars, sha256(loss) AS loss_sha256, (3 + plain + CASE WHEN escaped THEN 3 + marks ELSE 0 END)::BIGINT AS formatted_chars FROM c"""


def oracle_sql() -> dict[str, str]:
    """What SQL can express whole: not tokenisers, hash rings, models or the spans of leftmost matches."""
    return {"op1_decontaminate": OP1_SQL, "op3_near_join": OP3_SQL, "op10_chat": OP10_SQL}
