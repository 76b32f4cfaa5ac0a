"""Building a corpus from candidates: validated rows, selection by country, incident groups, issues, an accepted-only view."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import content_hash, stable_id
from quern.functions.urls import canonical_url, hostname
from quern.operators import ranking, titles, validation


@dataclass
class Corpus:
    sources: DataFrame
    incidents: DataFrame
    issues: DataFrame


def candidate_issues(candidates: DataFrame) -> DataFrame:
    """Rows whose address isn't canonical, whose domain isn't its host, whose languages repeat, or that have a key without confidence."""
    checks = {
        "url_not_canonical": ~canonical_url("canonical_url").eqNullSafe(F.col("canonical_url")), "domain_mismatch": hostname("canonical_url") != F.col("domain"),
        "languages_repeat": F.size(F.array_distinct("languages")) != F.size("languages"), "key_without_confidence": F.col("incident_key").isNotNull() & F.col("pair_confidence").isNull(),
    }
    return validation.every(*(validation.issue(candidates.where(test), code, "canonical_url") for code, test in checks.items()))


def compiled(candidates: DataFrame, overrides: DataFrame) -> DataFrame:
    """Candidates (candidate_id, grp, domain, title, published, terms) with incident_key and pair_confidence: of the pair that
    overrides (grp, l_id, r_id) name, if both are there, else of the group's plausible pair with most title terms shared."""
    once = candidates.dropDuplicates(["grp", "candidate_id"])
    there = overrides.join(once.select("grp", F.col("candidate_id").alias("l_id")), ["grp", "l_id"], "left_semi").join(once.select("grp", F.col("candidate_id").alias("r_id")), ["grp", "r_id"], "left_semi")
    told = titles.plausible_pairs(titles.title_pairs(once.withColumnRenamed("candidate_id", "report_id"), 3))
    best = told.groupBy("grp").agg(F.min(F.struct((-F.col("jaccard")).alias("less"), "l_id", "r_id")).alias("b")).join(there, "grp", "left_anti")
    pairs = there.select("grp", "l_id", "r_id", F.lit(0.95).alias("c")).unionByName(best.select("grp", "b.l_id", "b.r_id", F.least(F.lit(0.95), 0.55 - F.col("b.less") / 2).alias("c")))
    key = F.concat(F.lower("grp"), F.lit("_pair_"), content_hash(F.least("l_id", "r_id").cast("string"), F.greatest("l_id", "r_id").cast("string"), length=12))
    keyed = pairs.select("grp", F.explode(F.array("l_id", "r_id")).alias("candidate_id"), key.alias("incident_key"), F.col("c").alias("pair_confidence"))
    return once.join(keyed, ["grp", "candidate_id"], "left")


def build(candidates: DataFrame, countries: DataFrame, per_country: int = 10) -> Corpus:
    """Sources selected pair first, incidents of two sources and two domains or more, and what falls short."""
    eligible = candidates.where("access_status IN ('captured', 'available', 'ok')").withColumn("pair_confidence", F.coalesce("pair_confidence", F.lit(0.0)))
    chosen = ranking.quota_selection(eligible, "country_iso2", "incident_key", "domain", "pair_confidence", "canonical_url", per_country)
    sources = chosen.withColumn("source_id", stable_id("src", "country_iso2", "canonical_url")).withColumn("content_hash", content_hash("title", "excerpt", length=64))
    groups = sources.where("pair").groupBy("country_iso2", "incident_key").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("domain").alias("domains"), F.sort_array(F.collect_set("source_id")).alias("source_ids")).where("n >= 2 AND domains >= 2")
    number = F.row_number().over(Window.partitionBy("country_iso2").orderBy("incident_key"))
    incidents = groups.select(F.concat("country_iso2", F.lit("-"), F.lpad(number.cast("string"), 3, "0")).alias("incident_id"), "country_iso2", "incident_key", "source_ids")
    issues = validation.every(
        candidate_issues(candidates), validation.duplicate_keys(sources, "canonical_url", "accepted_duplicate_url"), validation.duplicate_keys(sources, "content_hash", "accepted_duplicate_payload"),
        validation.below_quota(countries.select(F.col("iso2").alias("country_iso2")), "country_iso2", sources, per_country, "source_quota"),
        validation.missing_references(sources, "country_iso2", countries, "iso2", "unknown_country"),
    )
    return Corpus(sources, incidents, issues)


def accepted(sources: DataFrame, reviews: DataFrame, protected: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sources that their last review accepts, and leaks of protected texts into them, which must be empty before they are used."""
    last = reviews.groupBy("source_id").agg(F.max_by("decision", "reviewed_at").alias("decision"))
    kept = sources.join(last.where("decision = 'accepted'").select("source_id"), "source_id", "left_semi")
    return kept, validation.leaks_of(kept.withColumn("_all", F.concat_ws(" ", "title", "excerpt")), "source_id", "_all", protected, "item_id", "text")
