"""A corpus pipeline: five stages from raw documents to packed sequences, each on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillbase.llm.common import drop_path, read_scratch, scratch_scope, table, write_scratch
from rillbase.llm.decontaminate import decontaminate
from rillbase.llm.langid import identify
from rillbase.llm.nearjoin import keep_one
from rillbase.llm.packing import pack
from rillbase.llm.secretscan import redact, scan_secrets


def private(docs: DataFrame):
    """docs under names that no operator makes, the new name of each column, and the way back."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names, lambda df: df.select(*[F.col(new).alias(old) for old, new in names.items()])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language models reject (no letters, or like no language they know) go."""
    inner, c, back = private(docs)
    return back(identify(inner, c["doc_id"], c["text"], c["lang"]).where("not rejected"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    inner, c, back = private(docs)
    return back(keep_one(inner, c["doc_id"], c["text"]))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with any whole window of a benchmark item go, however long they are."""
    inner, c, back = private(docs)
    return back(decontaminate(inner, table(spark, sf_dir, "benchmark"), c["text"], percent=0).where("not contaminated"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Live-looking secrets are replaced in the text; widely copied examples and all documents stay."""
    inner, c, back = private(docs)
    text, n = c["text"], c["n_chars"]
    clean = scan_secrets(inner, text, c["source"], c["doc_id"]).withColumn(text, redact(text))
    return back(clean.withColumn(n, F.when(F.col(text).isNull(), F.col(n)).otherwise(F.length(text).cast(docs.schema["n_chars"].dataType))))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of all documents in sequences of at most 1024."""
    return pack(docs)


STAGES = [("language", language), ("near_copies", near_copies), ("benchmark", benchmark), ("secrets", secrets), ("packing", packing)]

#: Language models and tokenisation are not in SQL; tests/llm/test_pipeline.py holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Scratch tables of a stage, and the stage before, go when it is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with scratch_scope(spark) as kept:
            made = stage(spark, docs, sf_dir)
            path = write_scratch(made, f"pipeline-{name}")
            kept.append(path)
        if before:
            drop_path(spark, before)
        docs, before = read_scratch(spark, path, made.schema), path
    return docs
