"""Intermediate tables in the folder that driver and executors share: they cut lineage and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Whether adaptive execution prefers many small partitions to few of the advisory size.
PARALLEL = "spark.sql.adaptive.coalescePartitions.parallelismFirst"
_made: list[list[str]] = []
_temporary: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder on a single machine without that setting."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        named = _temporary[app] = _temporary.get(app) or "file://" + tempfile.mkdtemp(prefix="quern-")
    return named


def stored(df: DataFrame, name: str, few: bool = False) -> DataFrame:
    """df written once and read back; unlike a checkpoint its plan runs once only.

    few: for tables of ids, labels and links, whose last step costs little: files of the advisory size of adaptive execution
    instead of one for each core, so that many rounds over a small table don't start many tasks."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/quern-{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(PARALLEL)
    try:
        if few:
            spark.conf.set(PARALLEL, "false")
        df.write.parquet(path)
    finally:
        spark.conf.set(PARALLEL, before)
    if _made:
        _made[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Tables stored inside are removed at the end: for a result that has been written elsewhere by then."""
    _made.append([])
    try:
        yield
    finally:
        for path in _made.pop():
            removed(spark, path)


def removed(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
