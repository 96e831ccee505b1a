"""Token ids in ORC files: integer run-length encoding, row indexes and Bloom filters on document ids.

Documents are put in ascending doc_id order by ranges (ties by a hash of the text, so one id on many rows
does not fill one range), encoded where they land and written as one file per range. Each row holds the
document's ids and its place in the file; places in the whole follow from the files' totals. ORC's column
statistics, row indexes and Bloom filters let a reader skip files, stripes and row groups for a doc_id.

Defined results: a null text is empty and has the end id alone; null ids come first; rows of equal id and
text are in any order among themselves, which their result does not show; an empty table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, list_array, map_rows, scratch_path, utf8
from .tokens import default_path, encoder

OPTIONS = {
    "orc.compress": "ZSTD",
    "orc.stripe.size": str(64 << 20),
    "orc.row.index.stride": "10000",
    "orc.create.index": "true",
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
}


def schema_for(id_type: T.DataType) -> T.StructType:
    return T.StructType([T.StructField("doc_id", id_type), *T.StructType.fromDDL("part int, local_start long, n_tokens long, ids array<int>").fields])


def write_ids(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", end_id: int = 0, tokenizer: str | None = None) -> T.StructType:
    """Write ids of all documents under ``path``; the schema of the files."""
    schema, model = schema_for(docs.schema[doc_id].dataType), tokenizer or default_path()
    order = [F.col("doc_id").asc_nulls_first(), F.col("tie")]
    ranged = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("tie"), F.col(text).alias("t")).repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches):
        from pyspark import TaskContext

        part, at = TaskContext.get().partitionId(), 0
        for b in batches:
            data, offsets = utf8(b.column(1))
            for i, j in chunks(offsets):
                ids, n = encoder(model).encode(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                ids = np.insert(ids, np.cumsum(n), end_id).astype(np.int32)
                n = n + 1
                starts = at + np.cumsum(n) - n
                at += int(n.sum())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(np.full(j - i, part, np.int32)), pa.array(starts), pa.array(n), list_array(ids, n, pa.int32())], schema.names)

    ranged.select("doc_id", "t").mapInArrow(run, schema).write.options(**OPTIONS).orc(path)
    return schema


def read_ids(docs_schema: T.StructType, spark, path: str) -> DataFrame:
    """Documents of the files with start, the number of ids of all documents before."""
    files = spark.read.schema(docs_schema).orc(path)
    totals = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    base = totals.withColumn("base", F.sum("n").over(Window.orderBy("part")) - F.col("n")).drop("n")  # a row per file
    return files.join(F.broadcast(base), "part").withColumn("start", F.col("base") + F.col("local_start")).drop("base", "local_start", "part")


def lookup(spark, docs_schema: T.StructType, path: str, ids: list) -> DataFrame:
    """The rows of some doc_ids: files, stripes and row groups that can't hold one are not read (statistics, row indexes, Bloom filters)."""
    return spark.read.schema(docs_schema).orc(path).where(F.col("doc_id").isin(ids))


def encode_to_orc(docs: DataFrame, path: str | None = None, doc_id: str = "doc_id", text: str = "text", end_id: int = 0, tokenizer: str | None = None) -> DataFrame:
    """Write the files and read them back: doc_id, n_tokens, ids, start."""
    spark = docs.sparkSession
    path = path or scratch_path(spark, "token-ids")
    return read_ids(write_ids(docs, path, doc_id, text, end_id, tokenizer), spark, path)


def with_crc(ids: DataFrame) -> DataFrame:
    """ids_crc32 from the ids read back (little-endian unsigned 32-bit), and their number."""

    def make():
        def run(columns):
            lists = columns[0]
            raw = np.asarray(lists.flatten()).astype("<u4")
            n = np.asarray(lists.value_lengths()).astype(np.int64)
            at = np.concatenate([[0], np.cumsum(n)])
            return [pa.array([zlib.crc32(raw[s:e].tobytes()) for s, e in zip(at[:-1], at[1:], strict=True)], pa.int64()), pa.array(n)]

        return run

    return map_rows(ids, ["ids"], "ids_crc32 long, n_tokens long", make, ["doc_id", "start"])
