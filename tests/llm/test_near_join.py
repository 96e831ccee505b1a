import random
import re
from collections import defaultdict

import numpy as np
import pytest

from rillbase.llm import nearjoin
from rillbase.llm.components import connected_components, least_reached
from rillbase.llm.nearjoin import near_components
from rillbase.llm.queries import op3_near_join
from rillbase.llm.rtree import RTree, Union, count_vectors, links

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(t):
    w = SPACE.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(docs):
    sets = [shingles(t) for _, t in docs]
    union, by = Union(len(docs)), defaultdict(set)
    for i, s in enumerate(sets):
        for x in s:
            by[x].add(i)
    for i, s in enumerate(sets):
        for j in {j for x in s for j in by[x] if j > i}:
            n = len(s & sets[j])
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                union.join(i, j)
    least = {}
    for i, (d, _) in enumerate(docs):
        r = union.find(i)
        least[r] = min((x for x in (least.get(r), d) if x is not None), default=None)
    return sorted(((d, len(sets[i]), least[union.find(i)] if sets[i] else d) for i, (d, _) in enumerate(docs)), key=str)


def rows3(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=str)


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert rows3(op3_near_join(spark, sf)) == brute(docs)


def family(rng, base, n, change):
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, change)):
            w[rng.randrange(len(w))] = f"z{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("block", [7, 400])
def test_families_passages_and_edges(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(nearjoin, "BLOCK_NODES", block)
    if block == 7:
        monkeypatch.setattr(nearjoin, "SPREAD_ROWS", 5)
    rng = random.Random(block)
    word = lambda: f"w{rng.randrange(500)}"
    passage = " ".join(word() for _ in range(30))
    texts = [None, "", "  \n", "", None, "one", "ONE", "one two", "a b c d", "a  b\tc d", "A b c d e", "x" * 100_000, "é È é è a"]
    for size, n, change in ((60, 40, 4), (40, 25, 3), (12, 10, 1), (200, 12, 9)):
        texts += family(rng, [word() for _ in range(size)], n, change)
    texts += [f"{passage} {' '.join(word() for _ in range(rng.choice([0, 1, 3, 8, 30, 90])))}" for _ in range(40)]
    texts += ["same text of many rows in one group"] * 30
    ids = [*range(1000, 1000 + len(texts))]
    rng.shuffle(ids)
    docs = [(None if i in (3, 20) else d, t) for i, (d, t) in enumerate(zip(ids, texts, strict=True))]
    docs += [docs[30], docs[30]]
    spark.createDataFrame([(*d, "1", "2", "3") for d in docs], "doc_id long, text string, n string, cell string, th string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    assert rows3(op3_near_join(spark, str(tmp_path))) == brute(docs)


@pytest.mark.parametrize("least, hot", [(1000, 10_000), (3, 10_000), (3, 2)])
def test_spread_is_a_join(spark, monkeypatch, least, hot):
    """No cell, every cell and the largest alone dealt in parts; keys of one side only go."""
    monkeypatch.setattr(nearjoin, "SPREAD_ROWS", least)
    monkeypatch.setattr(nearjoin, "HOT", hot)
    rows = [(c, s, f"n{c}{s}{i}") for c, s, n in ((1, 0, 90), (1, 1, 6), (2, 0, 4), (3, 0, 5)) for i in range(n)]
    few = [(1, 0, 7), (1, 0, 8), (1, 1, 9), (2, 0, 7), (4, 0, 1)]
    many = spark.createDataFrame(rows, "cell long, s int, node string")
    cells = nearjoin.hot_cells(many.groupBy("cell").count().withColumnRenamed("count", "m"), len(rows))
    assert {1000: 0, 3: 3 if hot > 2 else 1}[least] == (cells.count() if cells is not None else 0)
    for most in (2, 10_000):
        got = nearjoin._spread(many, spark.createDataFrame(few, "cell long, s int, h int"), ["cell", "s"], cells, most)
        assert sorted((r.cell, r.s, r.node, r.h) for r in got.collect()) == sorted((c, s, n, h) for c, s, n in rows for d, t, h in few if (c, s) == (d, t))


def test_many_units(spark, monkeypatch):
    monkeypatch.setattr(nearjoin, "UNIT_BYTES", 500)
    rng = random.Random(9)
    docs = [(i, t) for i, t in enumerate(family(rng, [f"w{k}" for k in range(50)], 30, 5))]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert rows3(near_components(df)) == brute(docs)


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert op3_near_join(spark, str(tmp_path)).collect() == []


@pytest.mark.parametrize("task_edges", [7, None])
def test_components_of_a_path(spark, task_edges):
    edges = [(i, i + 1) for i in range(100, 140)] + [(1, 2), (7, 7)]
    rng = random.Random(1)
    rng.shuffle(edges)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long").repartition(5), task_edges=task_edges).collect()}
    assert got == {1: 1, 2: 1} | {i: 100 for i in range(100, 141)}


@pytest.mark.parametrize("kind", ["long", "string"])
def test_components_of_long_chains_with_random_ids(spark, kind):
    """Chains of thousands of nodes, their ids at random and their edges dealt over many tasks, and a hub that is no minimum."""
    rng = random.Random(4)
    ids = rng.sample(range(10**6), 4000)
    chains = [ids[:2500], ids[2500:3400]]
    edges = [(a, b) for c in chains for a, b in zip(c[:-1], c[1:], strict=True)] + [(ids[3400], x) for x in ids[3401:]]
    rng.shuffle(edges)
    name = (lambda x: x) if kind == "long" else (lambda x: f"{x:07d}")
    df = spark.createDataFrame([(name(a), name(b)) for a, b in edges], f"src {kind}, dst {kind}").repartition(8)
    got = {r.node: r.component for r in connected_components(df, task_edges=400).collect()}
    assert got == {name(x): name(min(c)) for c in [*chains, ids[3400:]] for x in c}


def test_least_reached():
    rng = random.Random(8)
    for n in (1, 5, 60):
        pairs = [(rng.randrange(n), rng.randrange(n)) for _ in range(n)]
        union = Union(n)
        for a, b in pairs:
            union.join(a, b)
        nodes, least = least_reached(np.array([a for a, _ in pairs]), np.array([b for _, b in pairs]))
        assert least.tolist() == [union.find(int(i)) for i in nodes]


def test_tree_loses_no_pair():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 17, 150, 300):
        base = [rng.integers(0, 2**63, int(rng.integers(1, 60)), dtype=np.uint64) for _ in range(max(1, n // 8))]
        sets = []
        for _ in range(n):
            b = base[int(rng.integers(0, len(base)))].copy()
            k = int(rng.integers(0, len(b) // 4 + 1))
            b[rng.choice(len(b), k, replace=False)] = rng.integers(0, 2**63, k, dtype=np.uint64)
            sets.append(np.unique(b))

        def linked(a, b):
            c = len(np.intersect1d(a, b))
            return 100 * c >= 75 * (len(a) + len(b) - c)

        true = {(i, j) for i in range(n) for j in range(i + 1, n) if linked(sets[i], sets[j])}
        tree = RTree(count_vectors(sets, 64), np.array([len(s) for s in sets], np.int64))
        pairs = [(int(min(a, b)), int(max(a, b))) for x, y, _ in tree.candidates(tree, 75) for a, b in zip(x, y, strict=True)]
        assert true <= set(pairs) and len(pairs) == len(set(pairs))
        union = Union(n)
        for i, j in true:
            union.join(i, j)
        assert [union.find(i) for i in range(n)] == [links(sets, 75)[1].find(i) for i in range(n)]
