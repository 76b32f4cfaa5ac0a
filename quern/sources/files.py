"""Folder scan and checked readers: each file with kind, hash, size, sidecar and parent page; and readers for whole JSON and line JSON."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from quern.functions.text import stable_id
from quern.sources.sinks import file_system, resolved

MOST_BYTES = 25_000_000
SIDECAR = "SOURCE_INFO.md"


def _kind(path: Column) -> Column:
    low = F.lower(path)
    json = low.endswith(".json")
    return F.when(low.endswith(".html") | low.endswith(".htm"), "html").when(json & low.contains("video"), "video_analysis").when(json & (low.contains("image") | low.contains("photo")), "image_analysis")


def scan(spark: SparkSession, folder: str, most_bytes: int = MOST_BYTES) -> DataFrame:
    """One row for each file of a known kind below the folder, in the order of paths: manifest_id, path, kind, size_bytes, sha256,
    sidecar, parent (the first page beside an image analysis), warnings.

    The hash is taken where the file is read; contents never leave their task.  Files over the limit stay, with a warning.
    """
    root = folder.rstrip("/")
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    name = F.regexp_replace(F.col("path"), "^[a-z]+:/+", "/")
    files = listed.select(name.alias("full"), F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"))
    start = F.instr(F.col("full"), root.split("://", 1)[-1].rstrip("/").rsplit("/", 1)[-1] + "/")
    files = files.withColumn("path", F.substr("full", start + len(root.rsplit("/", 1)[-1]) + 1)).withColumn("folder", F.regexp_extract("path", "^(.*/)?[^/]*$", 1))
    kept = files.withColumn("kind", _kind(F.col("path"))).where("kind IS NOT NULL")
    listing = listed.where(F.col("path").endswith("/" + SIDECAR)).select(name.alias("full"))  # of the same listing, without contents
    sidecars = listing.withColumn("path", F.substr("full", start + len(root.rsplit("/", 1)[-1]) + 1)).select(F.regexp_extract("path", "^(.*/)?[^/]*$", 1).alias("folder"), F.col("path").alias("sidecar"))
    parents = kept.where("kind = 'html'").groupBy("folder").agg(F.min("path").alias("_page"))
    joined = kept.join(sidecars, "folder", "left").join(parents, "folder", "left")
    warning = F.when(F.col("size_bytes") > most_bytes, F.concat(F.lit("file exceeds configured size limit ("), F.col("size_bytes").cast("string"), F.lit(" bytes)")))
    return joined.select(
        stable_id("file", "path", "sha256").alias("manifest_id"), "path", "kind", "size_bytes", "sha256", "sidecar",
        F.when(F.col("kind") == "image_analysis", F.col("_page")).alias("parent"), F.array_compact(F.array(warning)).alias("warnings"),
    ).orderBy("path")


def read_lines(spark: SparkSession, path: str, schema: StructType | str, strict: bool = True) -> DataFrame:
    """JSON lines: a bad line fails the read, or becomes nulls if not strict."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "PERMISSIVE").json(path)


def read_document(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Whole JSON documents, one row each; no rows if there is none."""
    try:
        return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def content_lock(spark: SparkSession, folder: str) -> DataFrame:
    """Path, hash and size of every file below the folder, but for locks."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.where(~F.col("path").contains("/locks/")).select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("size_bytes")).orderBy("path")


def artifacts(rows: DataFrame, folder: str) -> DataFrame:
    """rows (path, sha256 expected or null) -> path, status (ok, unsafe, missing, changed), size_bytes: no path or link leads out."""

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, root = file_system(folder)
        for b in batches:
            out = []
            for path, expected in zip(b.path, b.sha256, strict=True):
                full = resolved(system, root, path)
                if full is None:
                    out.append((path, "unsafe", -1))
                elif (info := system.get_file_info(full)).type != fs.FileType.File:
                    out.append((path, "missing", -1))
                else:
                    with system.open_input_stream(full) as f:
                        same = expected is None or hashlib.sha256(f.read()).hexdigest() == expected
                    out.append((path, "ok" if same else "changed", info.size))
            yield pd.DataFrame(out, columns=["path", "status", "size_bytes"])

    return rows.select("path", "sha256").mapInPandas(check, "path string, status string, size_bytes long")


def strict_rows(spark: SparkSession, folder: str, glob: str, schema: str, required: list[str], lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """Documents, or lines, of JSON of exactly that schema, and issues (where, code) that name path and line.

    An unknown field, a missing required one and text that is no object of the schema are issues; their rows are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder)
    root = folder.rstrip("/").split("://", 1)[-1]
    texts = files.select(F.expr(f"substring(regexp_replace(path, '^[a-z]+:/+', '/'), length('{root}') + 2)").alias("path"), F.decode("content", "utf-8").alias("text"))
    if lines:
        texts = texts.select("path", F.posexplode(F.split("text", "\n")).alias("k", "text")).where("trim(text) != ''").withColumn("where", F.concat_ws(":", "path", (F.col("k") + 1).cast("string")))
    else:
        texts = texts.withColumn("where", F.col("path"))
    fields = [f.name for f in _parse_datatype_string(schema).fields]
    read = texts.select("where", F.from_json("text", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"), F.from_json("text", "map<string, string>", {"mode": "PERMISSIVE"}).alias("_all"))
    bad = F.col("r").isNull() | F.col("r._bad").isNotNull() | F.col("_all").isNull()
    unknown = F.size(F.array_except(F.map_keys("_all"), F.array(*map(F.lit, fields)))) > 0
    lacks = F.exists(F.array(*(F.col(f"r.{c}").isNull() for c in required)), lambda x: x)
    code = F.when(bad, "not_valid").when(unknown, "unknown_field").when(lacks, "missing_field")
    told = read.withColumn("code", code)
    return told.where("code IS NULL").select("where", *(F.col(f"r.{f}").alias(f) for f in fields)), told.where("code IS NOT NULL").select("where", "code")
