"""Shared helpers: scratch tables in the cluster's shared folder, Arrow column access, row-wise maps."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Scratch tables of this driver that were not dropped yet.
_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. Where it is unset a local session (tests) gets a private one; a cluster an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="rillbase-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    _written.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _written[-1]


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[list[str]]:
    """Drops the scratch tables written inside, at its end, but those put in the list it gives."""
    outer, kept = _written[:], []
    try:
        yield kept
    finally:
        for path in [p for p in _written if p not in outer and p not in kept]:
            drop_path(spark, path)


def drop_path(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    if path in _written:
        _written.remove(path)


def materialize(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` to a scratch table and read it back: cuts the lineage in storage every executor shares."""
    return read_scratch(df.sparkSession, write_scratch(df, name, codec), df.schema)


def write_scratch(df: DataFrame, name: str, codec: str = "zstd") -> str:
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return path


def read_scratch(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and len+1 offsets of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
    return raw, at - at[0]


def chunks(offsets: np.ndarray, limit: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of whole documents of about ``limit`` bytes each."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def list_array(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from concatenated values and the length of each list."""
    at = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=at[1:])
    return pa.ListArray.from_arrays(pa.array(at), pa.array(values, kind))


def map_rows(
    df: DataFrame,
    inputs: list[str],
    outputs: str,
    make: Callable[[], Callable[[list[pa.Array]], list[pa.Array]]],
    carry: list[str] | None = None,
) -> DataFrame:
    """Add columns made in Arrow batches, one row out for each row in, without a shuffle.

    ``make`` runs once for each task and returns the function from input columns to output columns.
    ``carry`` are the columns kept (all by default); a made column replaces a kept one of that name.
    """
    made = T.StructType.fromDDL(outputs)
    kept = [c for c in (df.columns if carry is None else carry) if c not in made.names]
    source = df.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(kept)], *[F.col(f"`{c}`").alias(f"x{i}") for i, c in enumerate(inputs)])
    schema = T.StructType([T.StructField(c, df.schema[c].dataType) for c in kept] + made.fields)
    n, names = len(kept), [*kept, *made.names]

    def run(batches):
        f = make()
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([*b.columns[:n], *f(b.columns[n:])], names)

    return source.mapInArrow(run, schema)


def quantiles(rows: DataFrame, group: str, value: str, q: float, buckets: int = 1024) -> dict[str, float]:
    """Each group's exact interpolated quantile; only counts of buckets come to the driver, narrowed until one value is left.

    ``rows`` is read several times, so it should be a stored table.
    """
    rows = rows.where(F.col(group).isNotNull() & F.col(value).isNotNull()).select(F.col(group).cast("string").alias("g"), F.col(value).alias("v"))
    places, left, found = {}, {}, {}
    for r in rows.groupBy("g").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect():  # a row per group
        places[r.g] = q * (r.n - 1)
        for k in {int(np.floor(places[r.g])), int(np.ceil(places[r.g]))}:
            left[r.g, k] = (r.lo, r.hi, 0)
    while True:
        found |= {t: lo for t, (lo, hi, _) in left.items() if lo == hi}
        left = {t: x for t, x in left.items() if x[0] < x[1]}
        if not left:
            break
        targets = rows.sparkSession.createDataFrame([(g, k, lo, hi) for (g, k), (lo, hi, _) in left.items()], "g string, k long, lo double, hi double")
        bucket = F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * buckets), F.lit(buckets - 1)).alias("b")
        inside = rows.join(F.broadcast(targets), "g").where("v >= lo and v <= hi").select("g", "k", "v", bucket)
        counts: dict = {}
        for r in inside.groupBy("g", "k", "b").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect():
            counts.setdefault((r.g, r.k), []).append((r.b, r.n, r.lo, r.hi))
        for t, got in counts.items():
            below = left[t][2]
            for _, n, lo, hi in sorted(got):
                if below + n > t[1]:
                    left[t] = (lo, hi, below)
                    break
                below += n
    out = {}
    for g, x in places.items():
        a, b = found[g, int(np.floor(x))], found[g, int(np.ceil(x))]
        out[g] = a + (b - a) * (x - np.floor(x))
    return out
