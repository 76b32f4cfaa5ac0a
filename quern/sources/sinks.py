"""Writers: sorted-key JSON lines, quoted CSV, GeoJSON, reports, append-only ledgers, schemas, and publishing by pointer."""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def write_lines(df: DataFrame, path: str, append: bool = False) -> None:
    """JSON lines with keys in alphabetical order and nulls kept."""
    df.select(*sorted(df.columns)).write.mode("append" if append else "overwrite").option("ignoreNullFields", False).json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').option("lineSep", "\n").csv(path)


def canonical_json(df: DataFrame) -> DataFrame:
    """Adds json: the row with sorted keys, without white space."""
    return df.withColumn("json", F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}))


def write_features(df: DataFrame, feature_col: str, path: str) -> None:
    """GeoJSON features, one on a line, in part files: a collection of any size without a single writer."""
    df.where(F.col(feature_col).isNotNull()).select(feature_col).write.mode("overwrite").text(path)


def feature_collection(df: DataFrame, feature_col: str, most: int = 100_000) -> str:
    """One GeoJSON document of a bounded result; more features than that are an error and belong in write_features."""
    rows = df.where(F.col(feature_col).isNotNull()).select(feature_col).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} features")
    return json.dumps({"type": "FeatureCollection", "features": [json.loads(r[0]) for r in rows]}, ensure_ascii=False)


def incident_markdown(df: DataFrame) -> DataFrame:
    """Adds markdown to fused records, with the evidence that each fact cites."""
    fact = lambda f: F.concat(F.lit("- "), f["field"], F.lit(": "), F.coalesce(f["value"].cast("string"), F.lit("not reported")), F.when(F.size(f["alternatives"]) > 0, F.concat(F.lit(" vs "), F.array_join(F.transform(f["alternatives"], lambda a: a.cast("string")), " vs "))).otherwise(F.lit("")), F.array_join(F.transform(f["support"], lambda e: F.concat(F.lit(" ["), e, F.lit("]"))), ""))
    facts = F.array_join(F.transform(F.coalesce("facts", F.array()), fact), "\n")
    return df.withColumn("markdown", F.concat_ws("\n", F.concat(F.lit("# "), F.coalesce("title", F.lit("Untitled"))), F.concat(F.lit("Record "), "incident_id"), F.concat(F.lit("Independent sources: "), F.col("source_count").cast("string")), F.concat(F.lit("Place: "), F.coalesce("place", F.lit("not resolved"))), facts, F.concat(F.lit("\n"), "summary")))


def markdown_table(df: DataFrame, order: str) -> DataFrame:
    """line and ord: a small result as the lines of a Markdown table, bars in values escaped, in the order of a column."""
    cell = lambda c: F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"\|", r"\\|")
    spark = df.sparkSession
    rows = df.withColumn("ord", F.row_number().over(Window.orderBy(order)).cast("int")).select("ord", F.concat(F.lit("| "), F.concat_ws(" | ", *(cell(c) for c in df.columns)), F.lit(" |")).alias("line"))
    head = spark.createDataFrame([(-1, "| " + " | ".join(df.columns) + " |"), (0, "|" + "---|" * len(df.columns))], "ord int, line string")
    return head.unionByName(rows)


def issue_report(issues: DataFrame) -> DataFrame:
    """line and ord: how many issues of each code there are and their first subject, or that there are none."""
    per = issues.groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.min("subject").alias("first"))
    lines = per.select("code", F.concat(F.lit("- "), "code", F.lit(": "), F.col("n").cast("string"), F.lit(", first "), F.coalesce("first", F.lit("-"))).alias("line"))
    ranked = lines.withColumn("ord", F.row_number().over(Window.orderBy("code")).cast("int")).select("ord", "line")
    total = issues.agg(F.count(F.lit(1)).alias("n")).select(F.lit(0).alias("ord"), F.when(F.col("n") == 0, "No issues.").otherwise(F.concat(F.col("n").cast("string"), F.lit(" issues"))).alias("line"))
    return total.unionByName(ranked)


def write_schemas(tables: dict[str, DataFrame], path: str, spark: SparkSession) -> None:
    spark.createDataFrame([(n, d.schema.json()) for n, d in sorted(tables.items())], "name string, schema string").coalesce(1).write.mode("overwrite").json(path)


def publish(df: DataFrame, root: str, name: str) -> str:
    """Write a new version and then point to it: readers see the old or the new one, whole; a failed write changes nothing."""
    version = f"{root}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(version)
    number = 1 + (_last(df.sparkSession, root, name) or (0, None))[0]
    df.sparkSession.createDataFrame([(name, version, number)], "name string, version string, number long").withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{root}/_pointers")
    return version


def _last(spark: SparkSession, root: str, name: str) -> tuple[int, str] | None:
    """Number and folder of the newest version; of two writers that took one number, the one whose folder comes last."""
    try:
        row = spark.read.parquet(f"{root}/_pointers").where(F.col("name") == name).orderBy(F.desc("number"), F.desc("version")).first()
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None
    return (row["number"], row["version"]) if row else None


def published(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(_last(spark, root, name)[1])


FILED = "path string, sha256 string, size_bytes long, outcome string"


def file_system(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder and the folder's path in it."""
    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:/") else (fs.LocalFileSystem(), folder)


def below(path: str) -> bool:
    """Whether a path stays below its folder, as urls.safe_relative_path tells it."""
    parts = path.split("/")
    return bool(path) and "\\" not in path and all(p not in ("", ".", "..") for p in parts)


def resolved(system: fs.FileSystem, root: str, path: str) -> str | None:
    """The file's full path, None if it is unsafe or, on a local disk, a link leads out of the folder."""
    if not below(path):
        return None
    full = f"{root.rstrip('/')}/{path}"
    if isinstance(system, fs.LocalFileSystem):
        inside = os.path.realpath(root)
        if os.path.islink(full) or os.path.commonpath([inside, os.path.realpath(full)]) != inside:
            return None
    return full


def write_files(rows: DataFrame, folder: str) -> DataFrame:
    """rows (path, content) as files below the folder: one row for each with its hash and outcome: written, same, conflict (a file
    with other content is there and stays) or unsafe.

    A file appears whole, by a rename; a task that runs again finds its files and tells same."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, root = file_system(folder)
        for b in batches:
            out = []
            for path, content in zip(b.path, b.content, strict=True):
                body = bytes(content)
                digest, full = hashlib.sha256(body).hexdigest(), resolved(system, root, path)
                if full is None:
                    out.append((path, digest, len(body), "unsafe"))
                elif system.get_file_info(full).type == fs.FileType.File:
                    with system.open_input_stream(full) as f:
                        out.append((path, digest, len(body), "same" if hashlib.sha256(f.read()).hexdigest() == digest else "conflict"))
                else:
                    system.create_dir(full.rsplit("/", 1)[0], recursive=True)
                    part = f"{full.rsplit('/', 1)[0]}/.{uuid.uuid4().hex}.part"
                    with system.open_output_stream(part) as f:
                        f.write(body)
                    system.move(part, full)
                    out.append((path, digest, len(body), "written"))
            yield pd.DataFrame(out, columns=[x.split()[0] for x in FILED.split(", ")])

    return rows.select("path", F.col("content").cast("binary").alias("content")).mapInPandas(write, FILED)


def remove_files(rows: DataFrame, folder: str) -> DataFrame:
    """rows (path): the files below the folder that are removed, and those that weren't there."""

    def remove(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, root = file_system(folder)
        for b in batches:
            out = []
            for path in b.path:
                full = resolved(system, root, path)
                there = full is not None and system.get_file_info(full).type == fs.FileType.File
                if there:
                    system.delete_file(full)
                out.append((path, "removed" if there else "unsafe" if full is None else "absent"))
            yield pd.DataFrame(out, columns=["path", "outcome"])

    return rows.select("path").mapInPandas(remove, "path string, outcome string")
