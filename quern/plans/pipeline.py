"""The whole run: a folder of saved pages and media analyses to fused, checked incident records."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.dates import FIRST_BLOCKS, told_in_text
from quern.functions.text import folded, lexical_features, stable_id
from quern.operators import evidence as E
from quern.operators import fusing, matching, validation
from quern.operators.store import stored
from quern.sources import files, media, metadata
from quern.sources.html_pages import page_blocks

#: Words that don't tell reports apart.
STOPWORDS = ["about", "after", "against", "article", "before", "collision", "country", "crash", "incident", "injured", "killed", "metadata", "original", "people", "publisher", "report", "reported", "road", "source", "traffic", "vehicle"]
#: Vehicles that a claim's words tell where no analysis names any, and what a blockade means for traffic.
VEHICLE_WORDS = ("bus", "truck", "motorcycle", "car")
BLOCKED = "road blockade or associated congestion reported"


@dataclass
class Run:
    manifest: DataFrame
    sources: DataFrame
    evidence: DataFrame
    mentions: DataFrame
    decisions: DataFrame
    clusters: DataFrame
    incidents: DataFrame
    sentiments: DataFrame
    issues: DataFrame


def _no_pairs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "a string, b string")


def read_sources(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Manifest, sources (with sidecar values and dependency groups) and contents of files within the size limit."""
    manifest = files.scan(spark, folder)
    root = folder.rstrip("/").split("://", 1)[-1]
    contents = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).where(F.col("length") <= files.MOST_BYTES)
    contents = contents.select(F.expr(f"substring(regexp_replace(path, '^[a-z]+:/+', '/'), length('{root}') + 2)").alias("path"), F.decode("content", "utf-8").alias("content"))
    said = metadata.read_sidecars(spark, folder).withColumn("sidecar", F.expr(f"substring(regexp_replace(path, '^[a-z]+:/+', '/'), length('{root}') + 2)")).drop("path", "warnings")
    sources = manifest.join(said, "sidecar", "left").withColumn("source_id", stable_id("src", "path", "sha256")).withColumn("dependency_group", F.lower("publisher"))
    return manifest, E.duplicate_groups(sources, "sha256"), contents


def collect_evidence(sources: DataFrame, contents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Evidence of all kinds of sources, and the title of each source with the first date in its first blocks."""
    joined = sources.join(contents, "path").select("source_id", "kind", "content", "traffic_keywords", "traffic_incident")
    blocks = page_blocks(joined.where("kind = 'html'"), "source_id", "content", F.col("traffic_keywords"), F.col("traffic_incident")).withColumn("author", F.lit(None).cast("string"))
    titles = blocks.where("kind = 'headline'").groupBy("source_id").agg(F.min_by("text", "ord").alias("title"))
    day = told_in_text(F.col("text"))
    titles = titles.join(blocks.where(F.col("ord") < FIRST_BLOCKS).where(day.isNotNull()).groupBy("source_id").agg(F.min_by(day, "ord").alias("told_on")), "source_id", "full")
    pages = E.block_evidence(sources, blocks).select("evidence_id", "source_id", "evidence_kind", "claim_text", "normalized_claim", "claimant", "casualties", "extraction_confidence", F.array().cast("array<string>").alias("vehicles"))
    parts = [pages]
    for kind, modality in (("video_analysis", "video"), ("image_analysis", "image")):
        found = media.media_evidence(joined.where(F.col("kind") == kind).select("source_id", F.col("content").alias("json")), modality)
        parts.append(found.select(*pages.columns))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out, titles


def gazetteer_places(aliases: DataFrame) -> DataFrame:
    """One row for each anchor: display, granularity, lat, lon, radius_km, as far as the aliases tell."""
    said = {"display": F.col("anchor"), "granularity": F.lit("area"), "lat": F.lit(None).cast("double"), "lon": F.lit(None).cast("double"), "radius_km": F.lit(None).cast("double")}
    return aliases.groupBy("anchor").agg(*(F.first(F.col(c) if c in aliases.columns else other, True).alias(c) for c, other in said.items()))


def mention_places(mentions: DataFrame, aliases: DataFrame, countries: DataFrame) -> DataFrame:
    """mention_id and its place: of the gazetteer, or the centre of its country, which is no place of an incident."""
    named = mentions.where("place = 'named'").join(gazetteer_places(aliases), "anchor").select(
        "mention_id", F.col("display").alias("place_name"), "granularity", "lat", "lon", "radius_km",
        F.when(F.col("priority") >= 20, 0.75).when(F.col("granularity").isin("area", "city"), 0.68).otherwise(0.55).alias("place_confidence"), F.lit("named by a source, at the centre of the gazetteer's place").alias("reason"),
    )
    said = {"name": F.col("iso3"), "lat": F.lit(None).cast("double"), "lon": F.lit(None).cast("double")}
    centres = countries.select("iso3", *(F.col(c) if c in countries.columns else other.alias(c) for c, other in said.items())).dropDuplicates(["iso3"])
    rest = mentions.where("place = 'country'").withColumn("iso3", F.substring_index("anchor", ":", -1)).join(centres, "iso3").select(
        "mention_id", F.concat(F.col("name"), F.lit(" (collection country; the place is not resolved)")).alias("place_name"), F.lit("country").alias("granularity"), "lat", "lon", F.lit(None).cast("double").alias("radius_km"),
        F.lit(0.12).alias("place_confidence"), F.lit("the country that the source was collected for").alias("reason"),
    )
    return named.unionByName(rest)


def mention_features(mentions: DataFrame, evidence: DataFrame, sources: DataFrame, titles: DataFrame, aliases: DataFrame, countries: DataFrame) -> DataFrame:
    """Mentions in the shape that matching and fusing take: time, places, vehicles, effects and terms."""
    claims = mentions.select("mention_id", F.explode("evidence_ids").alias("evidence_id")).join(evidence, "evidence_id")
    date = F.regexp_extract("claim_text", r"(?i)\b(\d{1,2}) (December|August) (20\d\d)\b", 0)
    told = F.try_to_timestamp(F.initcap(F.nullif(date, F.lit(""))), F.lit("d MMMM yyyy")).cast("timestamp_ntz")
    says = lambda w: F.max(F.contains("normalized_claim", F.lit(w)))
    per = claims.groupBy("mention_id").agg(
        F.min_by(told, F.when(told.isNotNull(), F.col("evidence_id"))).alias("told"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("vehicles")))).alias("vehicles"),
        F.array_compact(F.array(*(F.when(says(w), F.lit(w)) for w in VEHICLE_WORDS))).alias("_said"), (says("blockade") | says("অবরোধ")).alias("_blocked"),
    )
    keywords = F.array_union(F.array(*map(F.lit, STOPWORDS)), F.array_compact(F.flatten(F.array(F.regexp_extract_all(folded(F.coalesce("publisher", F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), F.transform(F.coalesce("traffic_keywords", F.array().cast("array<string>")), folded)))))
    joined = mentions.join(sources.select("source_id", "country_code", "published_at", "publisher", "dependency_group", "traffic_keywords"), "source_id").join(per, "mention_id", "left").join(titles, "source_id", "left")
    joined = joined.join(mention_places(mentions, aliases, countries), "mention_id", "left")
    named, none = F.col("place") == "named", F.array().cast("array<string>")
    return joined.select(
        "mention_id", "source_id", F.col("country_code").alias("country"), F.coalesce("told", F.substring("published_at", 1, 19).try_cast("timestamp_ntz"), "told_on").alias("event_time"),
        F.when(named, F.array("anchor")).otherwise(none).alias("locations"), F.when(F.size("vehicles") > 0, F.col("vehicles")).otherwise(F.coalesce("_said", none)).alias("vehicles"),
        F.when(named, F.array(folded("anchor"))).otherwise(lexical_features(F.coalesce("title", F.lit("")), keywords)).alias("terms"), F.lit(True).alias("primary"),
        F.when(F.col("_blocked"), F.array(F.lit(BLOCKED))).otherwise(none).alias("effects"),
        F.coalesce("title", "anchor").alias("title"), "dependency_group", "fatalities", "injuries", "evidence_ids", "place_name", "granularity", "lat", "lon", "radius_km", "place_confidence", "reason",
    )


def run(spark: SparkSession, folder: str, aliases: DataFrame, countries: DataFrame, must: DataFrame | None = None, cannot: DataFrame | None = None) -> Run:
    manifest, sources, contents = read_sources(spark, folder)
    evidence, titles = collect_evidence(sources, contents)
    evidence = stored(evidence, "evidence")
    incident = F.coalesce("traffic_incident", F.lit(False)) | F.col("normalized_claim").rlike(E.INCIDENT) | (F.col("evidence_kind") == "traffic_incident")
    rows = evidence.join(sources.select("source_id", "country_code", "traffic_incident"), "source_id").withColumn("incident", incident)
    mentions = stored(mention_features(E.split_mentions(rows, aliases, countries), evidence, sources, titles, aliases, countries), "mentions")
    must, cannot = (x if x is not None else _no_pairs(spark) for x in (must, cannot))
    found = matching.shared_key_pairs(mentions).union(matching.override_pairs(mentions, must.select("a", "b").union(cannot.select("a", "b")))).distinct()
    pairs = matching.candidates(matching.scored(found, mentions))
    decisions = stored(matching.decided(pairs, must, cannot), "decisions")
    merged = matching.constrained_clusters(decisions, mentions)
    clusters = stored(mentions.select("mention_id").join(merged.withColumnRenamed("node", "mention_id"), "mention_id", "left").select("mention_id", F.coalesce("cluster", "mention_id").alias("cluster")), "clusters")
    sentiments = E.sentiment(evidence)
    incidents = stored(fusing.fuse_clusters(clusters, mentions, sentiments), "incidents")
    cites = mentions.select(F.col("mention_id").alias("record_id"), F.lit("mention").alias("field"), F.lit(1).alias("value"), F.col("evidence_ids").alias("support"))
    facts = incidents.select(F.col("incident_id").alias("record_id"), F.explode("facts").alias("f")).select("record_id", "f.field", "f.value", "f.support")
    issues = validation.every(validation.uncited_support(cites, evidence), validation.uncited_support(facts, evidence))
    return Run(manifest, sources, evidence, mentions, decisions, clusters, incidents, sentiments, issues)


def write_run(result: Run, folder: str) -> None:
    """All tables of a run as Parquet, and the summary: a table replaces itself whole."""
    for name, df in vars(result).items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def summary(result: Run) -> DataFrame:
    """One row: what was read and made."""
    count = lambda d, n: d.agg(F.count(F.lit(1)).alias(n))
    parts = [count(getattr(result, n), n) for n in ("manifest", "sources", "evidence", "mentions", "decisions", "incidents", "issues")]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(F.broadcast(p))
    return out.withColumn("status", F.when(F.col("issues") > 0, "partial").otherwise("completed"))


