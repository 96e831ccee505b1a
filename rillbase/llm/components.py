"""Connected components of an edge table; nothing is collected to the driver.

First every task solves its own edges, at most about ``TASK_EDGES`` of them, and gives back one edge per node to
the least node it reaches there. Where one task held all, that is the answer. Otherwise large and small stars
alternate on the much smaller rest (each ties a node's neighbours to the least of them) until no edge changes,
which takes a number of rounds that grows with the square of the logarithm of the nodes, whatever their order.
Tables between rounds are in the shared folder.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_path, read_scratch, write_scratch

#: Edges that one task solves in its memory.
TASK_EDGES = 1_000_000


def least_reached(src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All nodes of the edges, ascending, and the least node each reaches."""
    nodes, at = np.unique(np.concatenate([src, dst]), return_inverse=True)
    a, b = at[: len(src)], at[len(src) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)  # roots take the least label that an edge brings them
        np.minimum.at(new, label[b], low)
        new = new[new]
        while (new != new[new]).any():
            new = new[new]
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def _solve_tasks(edges: DataFrame, tasks: int) -> DataFrame:
    kind = edges.schema["a"].dataType.simpleString()

    def run(batches):
        src, dst, type_ = [], [], None
        for batch in batches:
            type_ = batch.schema.field(0).type
            src.append(batch.column(0).to_numpy(zero_copy_only=False))
            dst.append(batch.column(1).to_numpy(zero_copy_only=False))
        if src:
            as_keys = lambda x: np.concatenate(x).astype(str) if pa.types.is_string(type_) else np.concatenate(x)
            nodes, least = least_reached(as_keys(src), as_keys(dst))
            for i in range(0, len(nodes), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(nodes[i : i + 100_000], type_), pa.array(least[i : i + 100_000], type_)], ["a", "b"])

    return edges.coalesce(tasks).mapInArrow(run, f"a {kind}, b {kind}")


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours, tied to the least of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours, tied to the least of these; edges go from the larger node to the smaller."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    near = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return near.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", task_edges: int | None = None) -> DataFrame:
    """(node, component): the least node that links reach, for every node of an edge but those with none to others."""
    spark = edges.sparkSession
    pairs = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a <> b")
    path = write_scratch(pairs, "edges")
    pairs = read_scratch(spark, path, pairs.schema)
    tasks = max(1, -(-pairs.count() // (task_edges or TASK_EDGES)))
    solved = _solve_tasks(pairs, tasks)
    if tasks == 1:
        return solved.select(F.col("a").alias("node"), F.col("b").alias("component"))
    schema, before = solved.schema, None
    forest_path = write_scratch(solved.where("a <> b"), "forest")
    drop_path(spark, path)
    path = forest_path
    while True:
        now = read_scratch(spark, path, schema)
        state = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a").cast("decimal(20,0)"))).first()
        if state == before:
            break
        before = state
        large = write_scratch(_large_star(now), "stars")
        small = write_scratch(_small_star(read_scratch(spark, large, schema)), "stars")
        drop_path(spark, large)
        drop_path(spark, path)
        path = small
    roots = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
