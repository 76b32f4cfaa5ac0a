"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the docs of the
next one.  All but the last return the columns of docs.  Each works on all that its predecessor kept.

quality: documents scored under 0.7 by nearest-neighbour voting go (no shuffle).
exact: of documents equal but for white space the longest, then the one with the smallest id, stays.
near: one document of each group linked by 5-word shingles at a similarity of 0.8 or more stays, that with the smallest id.
decontaminate: documents that hold a passage of the benchmark, words replaced or not, go (no shuffle).
pack: what is left becomes pieces of at most 1024 tokens in as few sequences as best fit finds.

Cases, beside those of the operators: an empty table passes through all stages; null and empty texts are one group of copies,
scored like any text (with the bank's share of good labels), never leak, and pack as their end; of repeated rows one stays; rows with
a null id are one id, that sorts first; texts of any length go through whole; ties go by the operators' rules; other columns,
whatever their names, come through unchanged up to the last stage, which reads id and text only.

run() removes what a stage stored, and its input, once the stage's result is written.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from quern.llm import decontaminate, exact_dedup, near_dedup, packing, quality
from quern.llm.common import table
from quern.operators.store import removed, scope, shared_folder


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_quality(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_exact_duplicates(docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.drop_near_duplicates(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality", classify_quality),
    ("exact", drop_exact),
    ("near", drop_near),
    ("decontaminate", drop_benchmark),
    ("pack", pack),
]

#: Tokens, trained models and approximate hashing have no SQL form; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage."""
    docs, before = table(spark, sf_dir, "documents"), None
    folder = f"{shared_folder(spark)}/quern-pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        with scope(spark):
            out = stage(spark, docs, sf_dir)
            out.write.parquet(path)
        if before:
            removed(spark, before)
        docs, before = spark.read.schema(out.schema).parquet(path), path
    return docs
