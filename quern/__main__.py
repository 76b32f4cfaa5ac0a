"""Commands: python -m quern COMMAND ..., or the same under spark-submit."""

from __future__ import annotations

import argparse
import getpass
import hashlib
import secrets

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.evaluation import source_catalog
from quern.plans import corpus_build, pipeline, registry, selection
from quern.plans.tables import page_titles
from quern.sources import files, metadata, sinks
from quern.streaming import uploads

CANDIDATES = "country_iso2 string, canonical_url string, title string, excerpt string, domain string, languages array<string>, access_status string, incident_key string, pair_confidence double"
ALIASES = "alias string, anchor string, family string, priority int, ord int, display string, granularity string, lat double, lon double, radius_km double"
#: Costs of the key derivation of passwords.
SCRYPT = {"n": 2**14, "r": 8, "p": 1}


def password_hash(password: str, salt: bytes | None = None) -> str:
    salt = salt or secrets.token_bytes(16)
    return f"scrypt${SCRYPT['n']}${salt.hex()}${hashlib.scrypt(password.encode(), salt=salt, **SCRYPT).hex()}"


def password_matches(password: str, stored: str) -> bool:
    return secrets.compare_digest(password_hash(password, bytes.fromhex(stored.split("$")[2])), stored)


def _shown(df: DataFrame, order: str | None = None) -> None:
    (df.orderBy(order) if order else df).show(200, truncate=False)


def _gazetteer(spark: SparkSession, path: str) -> DataFrame:
    """A gazetteer from CSV with a header: the columns of ALIASES that it has, at least the first five."""
    found = spark.read.option("header", True).csv(path)
    kinds = dict(x.split() for x in ALIASES.split(", "))
    return found.select(*(F.col(c).cast(kinds[c]).alias(c) for c in found.columns if c in kinds))


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quern", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, what: str, *args: str) -> argparse.ArgumentParser:
        c = sub.add_parser(name, help=what)
        for a in args:
            c.add_argument(a)
        return c

    command("run", "evidence and incidents of a folder, written as tables", "folder", "out", "aliases", "countries")
    command("report", "Markdown of the records of a run, one file each", "run", "out")
    command("map", "GeoJSON features of the records of a run", "run", "out")
    command("scan", "list the files of a folder", "folder")
    command("lock", "hash every file of a folder", "folder")
    command("profiles", "show country profiles", "folder")
    command("sidecars", "show sidecar metadata", "folder")
    command("query", "run a query over a folder of tables", "name", "tables")
    command("evaluate", "the measures of the engine over a folder of tables, as JSON lines and Markdown", "tables", "out")
    command("catalog", "sources of a folder of tables by language", "tables")
    command("validate", "issues of a file of candidates", "candidates")
    command("build", "a corpus from candidates: sources, incidents, issues", "candidates", "countries", "out")
    command("schemas", "schemas of the tables of a run", "run", "out")
    command("uploads", "check uploaded packages", "folder")
    command("land", "land approved packages (a file of submission_id lines) below a folder", "folder", "approved", "out")
    command("password", "hash a password for the reviewers' list")
    return p


def main(args: list[str] | None = None) -> None:
    a = _parser().parse_args(args)
    if a.command == "password":
        print(password_hash(getpass.getpass()))
        return
    if a.command == "query" and a.name not in registry.QUERIES:
        raise SystemExit(f"no query is named {a.name}")
    spark = SparkSession.builder.appName(f"quern {a.command}").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if a.command == "run":
        result = pipeline.run(spark, a.folder, _gazetteer(spark, a.aliases), metadata.by_either_code(metadata.country_profiles(spark, a.countries)))
        pipeline.write_run(result, a.out)
        pipeline.summary(result).show(truncate=False)
    elif a.command == "report":
        told = sinks.incident_markdown(spark.read.parquet(f"{a.run}/incidents"))
        _shown(sinks.write_files(told.select(F.concat("incident_id", F.lit(".md")).alias("path"), F.col("markdown").alias("content")), a.out).groupBy("outcome").count())
    elif a.command == "map":
        records = spark.read.parquet(f"{a.run}/incidents")
        from quern.operators.querying import feature

        sinks.write_features(records.withColumn("feature", feature(["incident_id", "title", "kind", "date", "place", "granularity", "method", "is_incident_location", "confidence", "radius_km", "source_count", "n_sentiments"])), "feature", a.out)
    elif a.command == "query":
        registry.QUERIES[a.name](spark, a.tables).show(50, truncate=80)
    elif a.command == "evaluate":
        rows = selection.q_evaluation_manifest(spark, a.tables)
        sinks.write_lines(rows, f"{a.out}/metrics")
        sinks.markdown_table(rows, "name").coalesce(1).orderBy("ord").select("line").write.mode("overwrite").text(f"{a.out}/metrics.md")
        _shown(rows, "name")
    elif a.command == "catalog":
        _shown(source_catalog(page_titles(spark, a.tables).select("lang", "url", "title", F.col("host").alias("domain"))), "lang")
    elif a.command == "validate":
        _shown(sinks.issue_report(corpus_build.candidate_issues(files.read_lines(spark, a.candidates, CANDIDATES))), "ord")
    elif a.command == "build":
        made = corpus_build.build(files.read_lines(spark, a.candidates, CANDIDATES), metadata.country_profiles(spark, a.countries))
        for name, df in vars(made).items():
            sinks.write_lines(df, f"{a.out}/{name}")
        _shown(sinks.issue_report(made.issues), "ord")
    elif a.command == "schemas":
        sinks.write_schemas({n: spark.read.parquet(f"{a.run}/{n}") for n in ("sources", "evidence", "mentions", "incidents")}, a.out, spark)
    elif a.command in ("uploads", "land"):
        found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(a.folder)
        if a.command == "uploads":
            _shown(uploads.checked_uploads(found).select("submission_id", "status", "reason"))
        else:
            _shown(uploads.landed(found, spark.read.text(a.approved).toDF("submission_id"), a.out), "path")
    else:
        made = {"scan": files.scan, "lock": files.content_lock, "profiles": metadata.country_profiles, "sidecars": metadata.read_sidecars}
        made[a.command](spark, a.folder).show(100, truncate=60)


if __name__ == "__main__":
    main()
