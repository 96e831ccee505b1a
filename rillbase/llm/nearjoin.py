"""N-gram Jaccard join: documents whose sets of word shingles have a Jaccard similarity of ``percent`` or more.

Exact, in four steps.

1. Cells. A document of which more than n - ceil(percent n / 100) shingles are in no other document is
   linked with none; this settles most documents from a hash sample of their shingles, in one pass. The others'
   shingles are ordered by their number of documents (its exponent), then by hash. Two linked documents share
   one of the first n - ceil(percent n / 100) + 1 shingles of each, so a cell is a connected component of
   documents over those; no link crosses cells. A shingle's documents are tied to one of them, first within a
   unit and then over all, so a common shingle sends one entry per unit.
2. In a cell, a packed R-tree over count vectors (how many shingles fall in each of ``groups`` hash groups)
   bounds the overlap of two documents, or two nodes, by the sum of coordinate-wise minima; pairs and nodes
   that can't reach the needed overlap are cut.
3. Surviving pairs are verified on the shingle sets, most promising first; pairs already connected are
   skipped, as they can't change a component.
4. A cell too large for one task is cut into blocks by size class and hash. First each block is joined with
   itself and with one block of its own and the neighbouring size class; then the documents outside their
   cell's largest component are joined with all blocks. Two documents that were never compared are in one
   component by then, so no link is lost.

Equal texts are one node from the start. Defined results: null, empty and wordless texts have no shingles and
are linked with nothing, not with each other; a document of fewer words than ``k`` has its whole sequence
as one shingle; a null id never becomes a component's id unless all ids in it are null; repeated rows are
rows of their own; an empty table gives no rows.

Scale: a sample of the shingles is shuffled, 6 bytes each, packed in few rows; only texts of unsettled documents
are shuffled, which a Bloom filter of bounded size finds. Tasks hold one hash range or one unit at a time.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, materialize, read_scratch, utf8, write_scratch
from .components import connected_components
from .counting import by_first, hash_parts
from .rtree import links
from .textvec import LOWER, SPACES, mix, shingle_hashes, span_hashes, words

#: A cell of more nodes or bytes is cut into blocks of about this many nodes.
BLOCK_NODES, BLOCK_BYTES = 400, 16 << 20
#: Of 256 shingles so many, by hash, are looked at to settle documents.
SAMPLED = np.uint64(104)
#: The document number that stands for several; so many documents a unit has at most.
SHARED = 65535
#: Text bytes of a unit of unsettled documents.
UNIT_BYTES = 4 << 20
#: Bits of the largest filter of open documents, 32 MB.
FILTER_BITS = 1 << 28
#: A cell of more nodes than this, and of more than one of ``HOT`` of all, is dealt in parts of so many.
SPREAD_ROWS, HOT = 1_000, 10_000


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each document."""
    out = []
    for i, j in chunks(offsets):
        d = LOWER[data[offsets[i] : offsets[j]]]
        s, e, n = words(d, offsets[i : j + 1] - offsets[i], SPACES)
        h, per = shingle_hashes(span_hashes(d, s, e), n, k)
        at = np.concatenate([[0], np.cumsum(per)]).tolist()
        for a, b in zip(at[:-1], at[1:], strict=True):
            x = np.sort(h[a:b])
            out.append(x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x)
    return out


def takes(n, percent: int):
    """How many first shingles of a set of n hold one that any linked set shares."""
    return n - -(-percent * n // 100) + 1


def short_keys(hashes: np.ndarray, parts: int) -> np.ndarray:
    """The hash range and the next 32 bits; equal shingles have equal keys, and different ones may."""
    return hashes >> np.uint64(33 - parts.bit_length())


def _cut(keys: np.ndarray, parts: int) -> tuple[list[int], list[int]]:
    """Ranges that ascending keys fall in, and the edges of all ranges."""
    edge = np.searchsorted(keys, np.arange(parts + 1, dtype=np.uint64) << np.uint64(32)).tolist()
    return [p for p in range(parts) if edge[p + 1] > edge[p]], edge


def _low(keys: np.ndarray) -> np.ndarray:
    return (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def shingled(texts: DataFrame, k: int, parts: int) -> DataFrame:
    """Rows of documents (doc_id, th, th2, n, unit, idx) and of their sampled shingles by hash range (p, unit, keys, docs).

    A unit is a batch of documents, idx a distinct text in it. Of the shingles the ``SAMPLED`` share by hash is
    sent; one that several texts of the unit hold is sent once, for document SHARED.
    """
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("doc_id", texts.schema["doc_id"].dataType), *T.StructType.fromDDL("th long, th2 long, n long, unit long, idx int, p int, keys binary, docs binary").fields])

    def run(batches):
        from pyspark import TaskContext

        unit = TaskContext.get().partitionId() << 20
        for batch in batches:
            for b in (batch.slice(i, SHARED) for i in range(0, batch.num_rows, SHARED)):
                th, at, inverse = np.unique(np.asarray(b.column(1)), return_index=True, return_inverse=True)
                sets = shingle_sets(*utf8(b.column(3).take(pa.array(at))), k)
                n = np.array([len(s) for s in sets], np.int64)
                rows, binary = b.num_rows, pa.binary()
                nulls = [pa.nulls(rows, t) for t in (pa.int32(), binary, binary)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(n[inverse]), pa.array(np.full(rows, unit)), pa.array(inverse.astype(np.int32)), *nulls], schema.names)
                every, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), n)
                chosen = (every & np.uint64(255)) < SAMPLED
                key, owner = short_keys(every[chosen], parts), owner[chosen]
                order = np.argsort(key, kind="stable")
                key, owner = key[order], owner[order]
                first = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
                many = np.diff(np.append(np.flatnonzero(first), len(key))) > 1
                key, owner = key[first], np.where(many, SHARED, owner[first]).astype(np.uint16)
                some, edge = _cut(key, parts)
                blob = lambda x: pa.array([x[edge[p] : edge[p + 1]].tobytes() for p in some], binary)
                m = len(some)
                nulls = [pa.nulls(m, t) for t in (b.schema.field(0).type, pa.int64(), pa.int64(), pa.int64())]
                yield pa.RecordBatch.from_arrays([*nulls, pa.array(np.full(m, unit)), pa.nulls(m, pa.int32()), pa.array(some, pa.int32()), blob(_low(key)), blob(owner)], schema.names)
                unit += 1

    return texts.select("doc_id", "th", "th2", "text").mapInArrow(run, schema)


def unique_shingles(sent: DataFrame) -> DataFrame:
    """unit, idx, m: how many sampled shingles of a document no other document has."""

    def over_all(batches):
        for _, group in by_first(batches, 4):
            rows = [(unit, np.frombuffer(keys, np.uint32), np.frombuffer(docs, np.uint16)) for _, unit, keys, docs in group]
            keys = np.concatenate([k for _, k, _ in rows])
            docs = np.concatenate([d for _, _, d in rows]).astype(np.int64)
            owner = np.repeat(np.arange(len(rows)), [len(k) for _, k, _ in rows])
            order = np.argsort(keys)
            keys = keys[order]
            differ = keys[1:] != keys[:-1]
            alone = np.concatenate([[True], differ]) & np.concatenate([differ, [True]])
            mine = order[alone]
            mine = mine[docs[mine] != SHARED]
            pair, m = np.unique(owner[mine] << 16 | docs[mine], return_counts=True)
            edge = np.searchsorted(pair >> 16, np.arange(len(rows) + 1)).tolist()
            some = [i for i in range(len(rows)) if edge[i + 1] > edge[i]]
            if some:
                blob = lambda x: pa.array([x[edge[i] : edge[i + 1]].tobytes() for i in some], pa.binary())  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([pa.array([rows[i][0] for i in some], pa.int64()), blob((pair & 0xFFFF).astype(np.uint16)), blob(m.astype(np.uint32))], ["unit", "docs", "m"])

    def of_unit(batches):
        for unit, group in by_first(batches, 3):
            total = np.zeros(SHARED, np.int64)
            for _, docs, m in group:
                total[np.frombuffer(docs, np.uint16)] += np.frombuffer(m, np.uint32)
            idx = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(idx), unit)), pa.array(idx, pa.int32()), pa.array(total[idx])], ["unit", "idx", "m"])

    counted = sent.repartition("p").sortWithinPartitions("p").mapInArrow(over_all, "unit long, docs binary, m binary")
    return counted.repartition("unit").sortWithinPartitions("unit").mapInArrow(of_unit, "unit long, idx int, m long")


def _unit_sets(rows: list, k: int, parts: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]:
    """Nodes, key sets, distinct keys and their number of documents in a unit; rows: unit, th, text."""
    node = np.array([r[1] for r in rows], np.int64)
    sets = [np.unique(short_keys(s, parts)) for s in shingle_sets(*utf8(pa.array([r[2] for r in rows], pa.large_string())), k)]
    keys, n = np.unique(np.concatenate(sets), return_counts=True)
    return node, sets, keys, n


def levels(units: DataFrame, k: int, parts: int) -> DataFrame:
    """unit, p, levels: for each of a unit's distinct keys in a range, ascending, the exponent of its number of documents."""

    def ask(batches):
        for unit, rows in by_first(batches, 3):
            _, _, keys, n = _unit_sets(rows, k, parts)
            some, edge = _cut(keys, parts)
            blob = lambda x: pa.array([x[edge[p] : edge[p + 1]].tobytes() for p in some], pa.binary())  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(np.full(len(some), unit)), blob(_low(keys)), blob(n.astype(np.uint32))], ["p", "unit", "keys", "n"])

    def answer(batches):
        for p, group in by_first(batches, 4):
            rows = [(unit, np.frombuffer(keys, np.uint32), np.frombuffer(n, np.uint32)) for _, unit, keys, n in group]
            _, inverse = np.unique(np.concatenate([x for _, x, _ in rows]), return_inverse=True)
            total = np.bincount(inverse, np.concatenate([n for _, _, n in rows]))
            level = np.floor(np.log2(total)).astype(np.uint8)[inverse]
            at = np.concatenate([[0], np.cumsum([len(x) for _, x, _ in rows])]).tolist()
            yield pa.RecordBatch.from_arrays([pa.array([u for u, _, _ in rows], pa.int64()), pa.array(np.full(len(rows), p, np.int32)), pa.array([level[s:e].tobytes() for s, e in zip(at[:-1], at[1:], strict=True)], pa.binary())], ["unit", "p", "levels"])

    asked = units.repartition("unit").sortWithinPartitions("unit").mapInArrow(ask, "p int, unit long, keys binary, n binary")
    return asked.repartition("p").sortWithinPartitions("p").mapInArrow(answer, "unit long, p int, levels binary")


def _ties(key: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, the least node of each, and the distinct ties (node, least node) of the others."""
    order = np.lexsort((node, key))
    key, node = key[order], node[order]
    first = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
    least = node[np.maximum.accumulate(np.where(first, np.arange(len(key)), 0))] if len(key) else node
    differ = node != least
    pairs = np.unique(np.stack([node[differ], least[differ]], 1), axis=0) if differ.any() else np.zeros((0, 2), np.int64)
    return key[first], node[first], pairs[:, 0], pairs[:, 1]


def _edges(src, dst):
    return pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], ["src", "dst"])


def cells(units: DataFrame, k: int, percent: int) -> DataFrame:
    """th, cell: texts tied by a first shingle, directly or by others; units: unit, th, text."""
    parts = hash_parts(units.sparkSession)
    known = levels(units, k, parts).select("unit", F.lit(0).cast("long").alias("th"), F.lit(None).cast("string").alias("text"), "p", "levels")
    both = units.select("unit", "th", "text", F.lit(-1).alias("p"), F.lit(None).cast("binary").alias("levels")).unionByName(known)

    def first(batches):
        for _, rows in by_first(batches, 5):
            node, sets, keys, _ = _unit_sets([r for r in rows if r[3] < 0], k, parts)
            level = np.frombuffer(b"".join(r[4] for r in rows if r[3] >= 0), np.uint8)  # by p, as the keys are
            firsts = []
            for s in sets:
                mine = level[np.searchsorted(keys, s)]
                firsts.append(s[np.argsort(mine, kind="stable")[: takes(len(s), percent)]])
            key, least, src, dst = _ties(np.concatenate(firsts), np.repeat(node, [len(f) for f in firsts]))
            some, edge = _cut(key, parts)
            blob = lambda x: pa.array([x[edge[p] : edge[p + 1]].tobytes() for p in some], pa.binary())  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([pa.array([*some, None], pa.int32()), pa.concat_arrays([blob(key), pa.array([src.tobytes()], pa.binary())]), pa.concat_arrays([blob(least), pa.array([dst.tobytes()], pa.binary())])], ["p", "a", "b"])

    def over_all(batches):
        keys, nodes = [], []
        for b in batches:
            keys += [np.frombuffer(x, np.uint64) for x in b.column(1).to_pylist()]
            nodes += [np.frombuffer(x, np.int64) for x in b.column(2).to_pylist()]
        if keys:
            _, _, src, dst = _ties(np.concatenate(keys), np.concatenate(nodes))
            yield _edges(src, dst)

    def in_units(batches):
        for b in batches:
            for s, d in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                yield _edges(np.frombuffer(s, np.int64), np.frombuffer(d, np.int64))

    signed = materialize(both.repartition("unit").sortWithinPartitions("unit", "p", "th").mapInArrow(first, "p int, a binary, b binary"), "near-signatures")
    wide = signed.where("p is not null").repartition("p").mapInArrow(over_all, "src long, dst long")
    near = signed.where("p is null").select("a", "b").mapInArrow(in_units, "src long, dst long")
    return connected_components(wide.unionByName(near)).select(F.col("node").alias("th"), F.col("component").alias("cell"))


def solve(tasks: DataFrame, k: int, percent: int, groups: int) -> DataFrame:
    """Links (a, b) of each task (task, side, node, text): within side -1, across sides 0 and 1."""
    dealt = tasks.select("task", "side", "node", "text").repartition("task").sortWithinPartitions("task", "side", "node")

    def run(batches):
        now, sides, nodes, texts = None, [], [], []

        def flush():
            split = None if sides[0] < 0 else sides.count(0)
            if split is not None and not 0 < split < len(sides):
                return None
            sets = shingle_sets(*utf8(pa.array(texts, pa.large_string())), k)
            found, _ = links(sets, percent, groups, split)
            found = [(nodes[i], nodes[j]) for i, j in found if nodes[i] != nodes[j]]
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.string()), pa.array([b for _, b in found], pa.string())], ["a", "b"]) if found else None

        for batch in batches:
            for task, side, node, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if task != now and texts:
                    if (out := flush()) is not None:
                        yield out
                    sides, nodes, texts = [], [], []
                now = task
                sides.append(side)
                nodes.append(node)
                texts.append(text)
        if texts and (out := flush()) is not None:
            yield out

    return dealt.mapInArrow(run, "a string, b string")


def _task(*parts):
    return F.concat_ws("/", *[p.cast("string") if not isinstance(p, str) else F.lit(p) for p in parts])


def hot_cells(sizes: DataFrame, total: int) -> DataFrame | None:
    """cell, parts: for each large share of all ``total`` nodes, in how many parts it is dealt; sizes: cell, m. None if there is none."""
    least = max(SPREAD_ROWS, total / HOT)
    found = sizes.where(F.col("m") > least).select("cell", F.ceil(F.col("m") / least).cast("int").alias("parts")).toArrow()  # fewer than HOT rows
    return sizes.sparkSession.createDataFrame(found) if found.num_rows else None


def _spread(rows: DataFrame, few: DataFrame, keys: list[str], hot: DataFrame | None, most: int = HOT) -> DataFrame:
    """A join of many rows of one key with that key's few rows; the rows of hot cells are dealt by a salt as well, to ``most`` parts."""
    if hot is None:
        return rows.join(few, keys)
    last = F.least(F.coalesce("parts", F.lit(1)), F.lit(most)) - 1
    dealt = rows.join(F.broadcast(hot), "cell", "left").withColumn("salt", F.pmod(F.xxhash64("node"), last + 1).cast("int")).drop("parts")
    more = few.join(F.broadcast(hot), "cell", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), last))).drop("parts")
    return dealt.join(more, [*keys, "salt"]).drop("salt")


def large_links(members: DataFrame, k: int, percent: int, groups: int, hot: DataFrame | None = None) -> DataFrame:
    """Links of cells too large for one task; members: cell, node, n, text; hot: as from ``hot_cells``."""
    ratio = math.log(100 / percent)
    sized = members.withColumn("s", F.floor(F.log(F.col("n").cast("double")) / ratio + 1e-9).cast("int"))
    per = sized.groupBy("cell", "s").agg(F.greatest(F.ceil(F.count("*") / BLOCK_NODES), F.ceil(F.sum(F.octet_length("text")) / BLOCK_BYTES)).cast("int").alias("blocks"))
    blocked = _spread(sized, per, ["cell", "s"], hot).withColumn("h", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    blocked = materialize(blocked.select("cell", "node", "n", "text", "s", "h", "blocks"), "near-blocks")
    cell, s, h = F.col("cell"), F.col("s"), F.col("h")
    own = blocked.select(_task("own", cell, s, h).alias("task"), F.lit(-1).alias("side"), "node", "text")
    steps = per.select("cell", "s", "blocks")
    pieces = [own]
    for name, d in (("same", 0), ("up", 1), ("down", -1)):  # each block with the first block of its class and of its neighbours
        first = blocked.where("h = 0").select("cell", (F.col("s") - d).alias("s"), "node", "text")
        target = steps.withColumn("h", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        target = target if d > 0 else target.where("h > 0")  # the first blocks meet each other once
        hub = _spread(first, target.select("cell", "s", "h"), ["cell", "s"], hot, BLOCK_NODES).select(_task(name, cell, s, h).alias("task"), F.lit(1).alias("side"), "node", "text")
        block = blocked.where("h > 0") if d <= 0 else blocked
        pieces += [hub, block.select(_task(name, cell, s, h).alias("task"), F.lit(0).alias("side"), "node", "text")]
    tasks = pieces[0]
    for p in pieces[1:]:
        tasks = tasks.unionByName(p)
    known = materialize(solve(tasks, k, percent, groups), "near-links")
    labels = blocked.select("cell", "node").join(connected_components(known, "a", "b"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    counted = labels.groupBy("cell", "component").agg(F.count("*").alias("m"))
    main = counted.groupBy("cell").agg(F.max_by("component", F.struct("m", "component")).alias("main"))
    rest = _spread(labels, main, ["cell"], hot).where("component <> main").select("cell", "node")
    rest = materialize(blocked.drop("blocks", "h").join(rest.select("node"), "node", "left_semi"), "near-rest")
    groups_of = rest.groupBy("cell", "s").agg(F.ceil(F.count("*") / BLOCK_NODES).cast("int").alias("g"))
    rest = _spread(rest, groups_of, ["cell", "s"], hot).withColumn("r", F.pmod(F.xxhash64("node"), F.col("g")).cast("int"))
    asked = groups_of.withColumn("r", F.explode(F.sequence(F.lit(0), F.col("g") - 1))).select("cell", F.col("s").alias("rs"), "r")
    near = asked.withColumn("s", F.explode(F.array(F.col("rs") - 1, F.col("rs"), F.col("rs") + 1)))
    key = _task("rest", cell, F.col("rs"), F.col("r"), s, h)
    left = _spread(blocked, near, ["cell", "s"], hot).select(key.alias("task"), F.lit(0).alias("side"), "node", "text")
    blocks = steps.withColumn("h", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("cell", "s", "h")
    right = _spread(rest.withColumnRenamed("s", "rs"), near.join(blocks, ["cell", "s"]), ["cell", "rs", "r"], hot, BLOCK_NODES).select(key.alias("task"), F.lit(1).alias("side"), "node", "text")
    return known.unionByName(solve(left.unionByName(right), k, percent, groups))


def _places(th: np.ndarray, bits: int) -> np.ndarray:
    h = mix(th.view(np.uint64))
    return np.stack([(h >> np.uint64(21 * i)) % np.uint64(bits) for i in range(3)]).astype(np.int64)


def might_hold(nodes: DataFrame, column: str):
    """A test of a column: false only for hashes that ``nodes`` (th) surely has not.

    A Bloom filter of about eight bits for each node, at most ``FILTER_BITS``; beyond that more rows pass it, which
    costs time and loses none. Tasks send the blocks of it that they set, and a block's copies meet in one task.
    """
    spark, block = nodes.sparkSession, 1 << 13
    n = nodes.count()
    bits = min(FILTER_BITS, 1 << max(16, (8 * n).bit_length()))

    def build(batches):
        data = np.zeros(bits // 8, np.uint8)
        for b in batches:
            at = _places(np.asarray(b.column(0)), bits).ravel()
            np.bitwise_or.at(data, at >> 3, (1 << (at & 7)).astype(np.uint8))
        for i in np.flatnonzero(np.bitwise_or.reduceat(data, np.arange(0, len(data), block))).tolist():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([data[i * block : (i + 1) * block].tobytes()], pa.binary())], ["i", "x"])

    def merge(batches):
        for i, rows in by_first(batches, 2):
            x = np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for _, x in rows])
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([x.tobytes()], pa.binary())], ["i", "x"])

    data = np.zeros(bits // 8, np.uint8)
    for r in nodes.select("th").mapInArrow(build, "i long, x binary").repartition("i").sortWithinPartitions("i").mapInArrow(merge, "i long, x binary").toLocalIterator():
        data[r.i * block : (r.i + 1) * block] = np.frombuffer(r.x, np.uint8)
    shared = spark.sparkContext.broadcast(data)  # at most FILTER_BITS

    @F.arrow_udf("boolean")
    def there(th: pa.Array) -> pa.Array:
        at = _places(np.asarray(th), bits)
        return pa.array(((shared.value[at >> 3] >> (at & 7)) & 1).all(0))

    return there(F.col(column))


def near_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 5, percent: int = 75, groups: int = 64) -> DataFrame:
    """doc_id, n_shingles and component_id of every row."""
    spark = docs.sparkSession
    parts = hash_parts(spark)
    t = F.coalesce(F.col(text), F.lit(""))
    texts = docs.select(F.col(doc_id).alias("doc_id"), t.alias("text"), F.xxhash64(t).alias("th"), F.xxhash64(t, F.lit(1)).alias("th2"))
    made = shingled(texts, k, parts)
    made = read_scratch(spark, write_scratch(made, "near-shingles"), made.schema)
    rows = made.where("n is not null").select("doc_id", "th", "th2", "n", "unit", "idx")
    alone = unique_shingles(made.where("p is not null").select("p", "unit", "keys", "docs"))
    take = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    open_rows = rows.where("n > 0").join(alone, ["unit", "idx"], "left").where(F.coalesce("m", F.lit(0)) < take)
    open_nodes = materialize(open_rows.groupBy("th", "th2").agg(F.max("n").alias("n")), "near-open-nodes")
    name = F.concat(F.hex("th"), F.lit("."), F.hex("th2"))
    wanted = texts.select("th", "th2", "text").where(might_hold(open_nodes, "th"))
    distinct = wanted.groupBy("th", "th2").agg(F.first("text").alias("text"))
    open_texts = materialize(open_nodes.join(distinct, ["th", "th2"]).withColumn("node", name).select("node", "th", "n", "text"), "near-open")
    size = open_texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    units = open_texts.select(F.pmod(F.xxhash64("th", F.lit(2)), F.lit(max(1, size // UNIT_BYTES))).alias("unit"), "th", "text")
    inside = materialize(cells(units, k, percent), "near-cells")
    sizes = inside.join(open_texts.select("th", "node", F.octet_length("text").alias("bytes")), "th")
    per = sizes.groupBy("cell").agg(F.count("*").alias("m"), F.sum("bytes").alias("bytes"))
    per = materialize(per.select("cell", "m", ((F.col("m") > BLOCK_NODES) | (F.col("bytes") > BLOCK_BYTES)).alias("large")), "near-sizes")
    hot = hot_cells(per, inside.count())
    of_node = _spread(sizes.select("cell", "node"), per.drop("m"), ["cell"], hot)
    kept = materialize(open_texts.select("node", "n", "text").join(of_node, "node").select("cell", "node", "n", "text", "large"), "near-members")
    found = solve(kept.where("not large").select(F.col("cell").cast("string").alias("task"), F.lit(-1).alias("side"), "node", "text"), k, percent, groups)
    if kept.where("large").limit(1).count():
        found = found.unionByName(large_links(kept.where("large").drop("large"), k, percent, groups, hot))
    component = connected_components(found, "a", "b")
    nodes = rows.where("n > 0").groupBy("th", "th2").agg(F.min("doc_id").alias("first_id"))
    labelled = nodes.withColumn("node", name).join(component, "node", "left").withColumn("component", F.coalesce("component", "node"))
    labelled = materialize(labelled.select("th", "th2", "first_id", "component"), "near-labels")
    least = labelled.groupBy("component").agg(F.min("first_id").alias("component_id"))
    of_text = labelled.join(least, "component").select("th", "th2", "component_id")
    linked = rows.where("n > 0").join(of_text, ["th", "th2"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return linked.unionByName(rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 5, percent: int = 75) -> DataFrame:
    """The rows of docs with one of each group of linked rows: that with the smallest id (nulls last), then the first.

    Rows without words belong to no group and stay.
    """
    numbered = materialize(docs.withColumn("near_row", F.monotonically_increasing_id()), "near-rows")
    key = F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("id"), "near_row")
    found = near_components(numbered.select(key.alias("key"), F.col(text).alias("text")), "key", "text", k, percent)
    kept = found.where((F.col("n_shingles") == 0) | (F.col("doc_id") == F.col("component_id"))).select(F.col("doc_id.near_row").alias("near_row"))
    return numbered.join(kept, "near_row").select(*docs.columns)
