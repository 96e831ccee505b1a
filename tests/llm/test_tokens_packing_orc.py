import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from rillbase.llm.common import utf8
from rillbase.llm.packing import CapacityTree, pack, plan
from rillbase.llm.queries import op2_pack, op8_orc_ids
from rillbase.llm.tokens import default_path, encoder

ROWS = [(1, "hello big world"), (2, None), (3, ""), (None, "no id"), (5, "word " * 3000), (6, "hello big world"), (6, "hello big world"), (7, "x" * 5000), (8, "  \n\t "), (9, "it's 12a b3 é× 日本 <|endoftext|>")]
SCHEMA = "doc_id long, text string, ids string, length string, part string, task string, rank string"


def ids_of(text):
    return encoder(default_path()).tokenizer.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.fixture
def folder(spark, tmp_path):
    def make(rows):
        spark.createDataFrame([(*r, *[None] * 5) for r in rows], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
        return str(tmp_path)

    return make


def test_units_give_the_ids_of_the_whole_text():
    rng = random.Random(5)
    texts = ["", " ", "a  b", "don't 's 're", "x  　y\n\n z", "a1b2 c3.4,,5", "×2 ÷ 3é1", "日本 語", "ª1 º b", "１２ 3", "é éx", "\U0001f600 \U0001f600a"]
    texts += ["".join(rng.choices("ab1 '.\n\té×  日²_sR", k=rng.randint(1, 24))) for _ in range(3000)]
    data, offsets = utf8(pa.array(texts))
    ids, n = encoder(default_path()).encode(data, offsets)
    at = 0
    for text, k in zip(texts, n.tolist(), strict=True):
        assert ids[at : at + k].tolist() == ids_of(text), text
        at += k


def test_tree_finds_the_tightest():
    tree, there, rng = CapacityTree(64), set(), random.Random(1)
    for _ in range(2000):
        c = rng.randint(0, 64)
        tree.set(c, c not in there)
        there ^= {c}
        least = rng.randint(1, 64)
        assert tree.tightest(least) == min((x for x in there if x >= least), default=-1)


def one_by_one(lengths, capacity):
    room = []
    for n in sorted(lengths, reverse=True):
        fits = [(r, i) for i, r in enumerate(room) if r >= n]
        if fits:
            room[min(fits)[1]] -= n
        else:
            room.append(capacity - n)
    return len(room)


def test_plan_is_best_fit_decreasing():
    rng = random.Random(2)
    for capacity in (7, 10, 100):
        for _ in range(60):
            lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 200))]
            counts = defaultdict(int)
            for n in lengths:
                counts[n] += 1
            runs, bins = plan(counts, capacity)
            assert bins == one_by_one(lengths, capacity)


def check_packed(rows, docs, capacity):
    by_seq, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        by_seq[r.sequence_id].append((r.offset, r.length))
        by_doc[r.doc_id].append(r)
    for spans in by_seq.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert at <= capacity
    want = defaultdict(list)
    for i, text in docs:
        ids = [*ids_of(text), 2]
        k = -(-len(ids) // capacity)
        head = len(ids) - (k - 1) * capacity
        for p in range(k):
            s, e = (0, head) if not p else (head + (p - 1) * capacity, head + p * capacity)
            want[i].append((p, s, e - s, crc(ids[s:e])))
    assert {i: sorted((r.piece, r.start, r.length, r.ids_crc32) for r in x) for i, x in by_doc.items()} == {i: sorted(x) for i, x in want.items()}
    assert len(by_seq) == one_by_one([n for x in want.values() for _, _, n, _ in x], capacity)


def test_op2_edge_rows(spark, folder):
    check_packed(op2_pack(spark, folder(ROWS)).collect(), ROWS, 1024)


def test_op2_whole_table(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    check_packed(op2_pack(spark, sf).collect(), docs, 1024)


def test_ids_of_pieces(spark):
    df = spark.createDataFrame([(1, "one two three four")], "doc_id long, text string")
    rows = sorted(pack(df, capacity=2, end_id=2).collect(), key=lambda r: r.piece)
    assert np.concatenate([np.frombuffer(r.ids, "<u4") for r in rows]).tolist() == [*ids_of("one two three four"), 2]


def test_empty_tables(spark, folder):
    d = folder([])
    assert op2_pack(spark, d).collect() == [] and op8_orc_ids(spark, d).collect() == []


def want_orc(docs):
    out, at = [], 0
    for i, t in sorted(docs, key=lambda x: (x[0] is not None, x[0] or 0)):
        ids = [*ids_of(t), 0]
        out.append((i, at, len(ids), crc(ids)))
        at += len(ids)
    return out


@pytest.mark.parametrize("parts", ["1", "4"])
def test_op8(spark, folder, sf, parts):
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        rows = op8_orc_ids(spark, folder(ROWS)).collect()
        key = lambda r: (r[0] is not None, r[0] or 0, r[1])
        assert sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in rows), key=key) == want_orc(ROWS)
        docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
        assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in op8_orc_ids(spark, sf).collect()) == want_orc(docs)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_orc_files_have_indexes_and_bloom_filters_and_are_pruned(spark, tmp_path):
    import os

    from rillbase.llm.orcids import lookup, write_ids

    docs = spark.range(0, 120_000, 3).selectExpr("id AS doc_id", "concat('text ', id % 50) AS text")
    path = f"{tmp_path}/ids"
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        schema = write_ids(docs, path)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    orc, hadoop = spark._jvm.org.apache.orc.OrcFile, spark._jvm.org.apache.hadoop.fs.Path
    files = [f for f in os.listdir(path) if f.endswith(".orc")]
    for f in files:
        reader = orc.createReader(hadoop(f"file://{path}/{f}"), orc.readerOptions(spark._jsc.hadoopConfiguration()))
        assert reader.getRowIndexStride() == 10_000
        column = list(reader.getSchema().getFieldNames()).index("doc_id") + 1
        rows = reader.rows()
        for stripe in reader.getStripes():
            footer = rows.readStripeFooter(stripe)
            kinds = {x.getKind().toString() for x in footer.getStreamsList() if x.getColumn() == column}
            assert "ROW_INDEX" in kinds and any(k.startswith("BLOOM_FILTER") for k in kinds)
            assert footer.getColumns(column).getKind().toString() == "DIRECT_V2"  # run lengths, second version
        rows.close()

    def read(ids):
        found = lookup(spark, schema, path, ids)
        rows = found.collect()
        plan = found._jdf.queryExecution().executedPlan()
        scan = plan.collectLeaves().head()
        return rows, scan.metrics().apply("numOutputRows").value()

    rows, seen = read([60_000])
    assert [r.doc_id for r in rows] == [60_000] and 0 < seen <= 10_000
    rows, seen = read([60_001])  # within the statistics of a row group, but in no Bloom filter
    assert rows == [] and seen <= 10_000
    assert read([10**9])[1] == 0


def test_packing_without_a_broadcast(spark, sf, monkeypatch):
    from rillbase.llm import packing

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    monkeypatch.setattr(packing, "BROADCAST_ROWS", 0)
    check_packed(op2_pack(spark, sf).collect(), docs, 1024)
