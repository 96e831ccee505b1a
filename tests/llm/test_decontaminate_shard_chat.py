import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from rillbase.llm import chat
from rillbase.llm.decontaminate import decontaminate, excise
from rillbase.llm.queries import op1_decontaminate, op4_shard, op10_chat
from rillbase.llm.sharding import points, shard, walk

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def brute(docs, items, n=13):
    windows = [(str(i), w[k : k + n]) for i, t in items if i is not None and t is not None for w in [WORD.findall(low(t))] if w for k in range(max(1, len(w) - n + 1))]
    by = defaultdict(list)
    for i, w in windows:
        by[w[0]].append((i, w))
    out = []
    for d, t in docs:
        words, hit, names = WORD.findall(low(t)), set(), set()
        for k, x in enumerate(words):
            for i, w in by.get(x, ()):
                if words[k : k + len(w)] == w:
                    hit |= set(range(k, k + len(w)))
                    names.add(i)
        out.append((d, len(words), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(words)))
    return out


def rows1(df):
    return sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in df.collect()), key=str)


LONG = " ".join(f"w{i}" for i in range(20))
DOCS = [(1, LONG), (2, f"Pre, {LONG.upper()}! post"), (3, None), (4, ""), (None, "w0 w1"), (6, "short ITEM here"), (7, "shorter item"), (8, " ".join(f"w{i}" for i in range(13))), (9, "é日 x1"), (9, "é日 x1"), (10, "x " * 5000 + LONG), (11, " ".join(f"w{i}" for i in range(12)))]
ITEMS = [(1, LONG), (2, "short item"), (3, None), (4, "..."), (None, "w0 w1"), (5, "é日"), (6, LONG + " more"), (10, "Short, item")]


@pytest.mark.parametrize("block", [None, 40])
def test_op1_edges(spark, tmp_path, block):
    spark.createDataFrame([(*d, "1", "2") for d in DOCS], "doc_id long, text string, item_id string, n_hit string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    if block is None:
        assert rows1(op1_decontaminate(spark, str(tmp_path))) == sorted(brute(DOCS, ITEMS), key=str)
    else:
        docs, items = spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/benchmark.parquet")
        found = decontaminate(docs, items, block_bytes=block).select("doc_id", "n_words", "n_hit", "items").collect()
        want = {(d, a, b, c) for d, a, b, c, _, _ in brute(DOCS, ITEMS)}
        assert {(r.doc_id, r.n_words, r.n_hit, len(r["items"])) for r in found} == want


def test_op1_whole_table(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert rows1(op1_decontaminate(spark, sf)) == sorted(brute(docs, items), key=str)


def test_spans_are_of_the_original(spark):
    docs = spark.createDataFrame([(1, "É before -- SHORT,\n item; after short item")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "short item")], "item_id long, text string")
    r = decontaminate(docs, items).withColumn("cut", excise()).first()
    assert [r.text[s.start : s.end] for s in r.spans] == ["SHORT,\n item", "short item"]
    assert r.cut == "É before --  ; after  "


def test_op1_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert op1_decontaminate(spark, str(tmp_path)).collect() == []


def check_shards(rows, docs, shards=16):
    n = Counter(r.shard for r in rows)
    assert sum(n.values()) == len(docs)
    if docs:
        assert max(n[s] for s in range(shards)) - min(n[s] for s in range(shards)) <= 1
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in docs)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == want


def test_op4(spark, sf, tmp_path):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    check_shards(op4_shard(spark, sf).collect(), docs)
    odd = [*DOCS, *[(77, "same")] * 40]
    spark.createDataFrame([(*d, 1, 2) for d in odd], "doc_id long, text string, shard long, arc long").write.parquet(f"{tmp_path}/documents.parquet")
    check_shards(op4_shard(spark, str(tmp_path)).collect(), odd)


def test_op4_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert op4_shard(spark, str(tmp_path)).collect() == []


def test_walk_moves_few_keys():
    rng = random.Random(3)
    keys = [rng.randrange(1 << 16) for _ in range(8000)]

    def placed(k):
        ring = points(k, 64)
        counts, rank = Counter(), []
        for key in keys:
            arc = next((i for i, (p, _) in enumerate(ring) if p >= key), 0)
            rank.append((arc, counts[arc]))
            counts[arc] += 1
        where = {(a, r): s for a, b, e, s, _ in walk(counts, ring, k) for a, r in [(a, r) for r in range(b, e)]}
        return [where[x] for x in rank]

    a, b = placed(8), placed(9)
    assert sum(x != y for x, y in zip(a, b, strict=True)) < 0.5 * len(keys)


def test_chat_round_trip():
    rng = random.Random(4)
    bits = ["<s>", "</s>", "[INST:", "] ", " [/INST]", "[ANS] ", "\\", "<e>", "ok", " ", "\n", "é", "[", "<", "/INST]"]
    for _ in range(3000):
        turns = [(rng.choice(["user", "assistant", "system", "", "a] b", "x[\\"]), "".join(rng.choices(bits, k=rng.randint(0, 6)))) for _ in range(rng.randint(1, 4))]
        text, mask = chat.format_turns(turns)
        assert chat.parse(text) == (turns, mask)
    assert chat.format_turns([("user", "hi"), ("assistant", "yo")])[0] == "<s>[INST:user] hi [/INST][ANS] yo</s>"
    with pytest.raises(chat.BadGrammar):
        chat.parse("<s>what")


def want_chat(rows):
    by = defaultdict(list)
    for c, n, r, t in rows:
        by[c].append((n is not None, n, r or "", t or ""))
    out = []
    for c, x in by.items():
        turns = [(r, t) for _, _, r, t in sorted(x, key=lambda y: (y[0], y[1] or 0, y[2], y[3]))]
        loss = "".join(t for r, t in turns if r == "assistant")
        out.append((c, len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()))
    return sorted(out, key=str)


TRAP = "</s>[INST] ok [/INST]"


def test_op10(spark, sf, tmp_path):
    def got(d):
        return sorted(((r.conv_id, r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in op10_chat(spark, d).collect()), key=str)

    extra = [(-1, 0, "user", TRAP), (-1, 1, "assistant", TRAP)]
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(sf) == want_chat([*rows, *extra])
    odd = [(1, 0, "user", None), (1, 1, "assistant", None), (2, None, None, "x"), (None, 0, "user", "n"), (None, 1, "assistant", "m" * 300_000), (3, 1, "assistant", "b"), (3, 1, "assistant", "b"), (3, 1, "assistant", "a")]
    spark.createDataFrame([(*r, "f", "l") for r in odd], "conv_id long, turn long, role string, text string, formatted string, loss string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert got(str(tmp_path)) == want_chat([*odd, *extra])


def ring_twin(docs, shards, vnodes=64):
    """Keys one by one: each goes to the next point clockwise of its position, and on while the shard there is full; keys of earlier arcs first."""
    ring = points(shards, vnodes)
    room = {s: len(docs) // shards + (s < len(docs) % shards) for s in range(shards)}
    waiting = [[] for _ in ring]
    for position, turn, name in sorted(docs):
        waiting[next((i for i, (p, _) in enumerate(ring) if p >= position), 0)].append((position, turn, name))
    placed, carry = {}, []
    for turn in range(2 * len(ring)):
        if turn < len(ring):
            carry += sorted(waiting[turn])
        shard, rest = ring[turn % len(ring)][1], []
        for key in carry:
            if room[shard]:
                room[shard] -= 1
                placed[key[2]] = shard
            else:
                rest.append(key)
        carry = rest
    return placed


def test_shards_are_those_of_a_walk_key_by_key(spark):
    rows = [(i, f"text {i % 17}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    placed = {r.doc_id: (r.position, r.sub, r.turn) for r in df.selectExpr("doc_id", "cast(shiftrightunsigned(xxhash64(cast(doc_id as string)), 48) as int) AS position", "xxhash64(cast(doc_id as string), crc32(encode(text, 'UTF-8')), cast(octet_length(text) + 1 as bigint)) AS turn").selectExpr("*", "cast(shiftrightunsigned(turn, 52) as int) AS sub").collect()}
    got = {}
    for files in (1, 5):
        got[files] = {r.doc_id: (r.shard, r.slot) for r in shard(df.repartition(files), shards=7).collect()}
    assert got[1] == got[5]  # whatever the files
    want = ring_twin([(p, (s, t), d) for d, (p, s, t) in placed.items()], 7)
    assert {d: s for d, (s, _) in got[1].items()} == want


def test_few_keys_move_when_a_shard_is_added(spark):
    df = spark.range(20_000).selectExpr("id AS doc_id", "cast(id as string) AS text")
    a, b = ({r.doc_id: r.shard for r in shard(df, shards=k).collect()} for k in (16, 17))
    moved = sum(a[i] != b[i] for i in a) / len(a)
    assert 1 / 17 <= moved < 2.2 / 17


def test_a_hot_key(spark):
    rows = [(5, f"text {i}") for i in range(400)] + [(5, "same")] * 300 + [(i, "x") for i in range(500)] + [(None, "x")] * 3
    made = shard(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), shards=4).collect()
    per = Counter(r.shard for r in made)
    assert len(made) == len(rows) and max(per.values()) - min(per.values()) <= 1
    assert all(sorted(r.slot for r in made if r.shard == s) == list(range(per[s])) for s in per)
