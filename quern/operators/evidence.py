"""From blocks and texts to evidence: relevance, gazetteer places, identifiers, dependency groups, sentiment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import alias_pattern, ascii_digits, casualty_counts, folded, normalized, stable_id

#: Words that tell a traffic report and an incident report.
TRAFFIC = r"(?i)\b(?:accident|crash|collision|killed|injured|road|highway|traffic|blockade|congestion|vehicle|motorcycle|bus|truck)\b|সড়ক|দুর্ঘটনা|নিহত|আহত|মহাসড়ক|যানজট|অবরোধ"
INCIDENT = r"(?i)\b(?:accident|crash|collision|killed|injured|fatal)\b|দুর্ঘটনা|নিহত|আহত|সংঘর্ষ"
BLOCK_KINDS = ("headline", "article", "post", "caption", "comment")
SENTIMENT_WORDS = ("justice", "protest", "demand", "ভোগান্তি")
CONGESTION_WORDS = ("traffic", "যানজট", "ভোগান্তি")
#: Rows of the gazetteer that are broadcast; more are joined.
MOST_ALIASES = 100_000
#: Rows of the gazetteer whose first words are written into the plan.
MOST_BEGINNINGS = 1_000


def relevant(text: Column, keywords: Column, declared: Column, pattern: str = TRAFFIC) -> Column:
    """Declared, or a word of the lexicon, or any keyword inside the folded text."""
    return declared | text.rlike(pattern) | F.exists(keywords, lambda k: F.contains(folded(text), k))


def block_evidence(sources: DataFrame, blocks: DataFrame) -> DataFrame:
    """blocks (block_id, source_id, kind, text, author) of sources (source_id, publisher, traffic_keywords, traffic_incident) that
    can be evidence, as claims with identifier, assertion, confidence and counts."""
    joined = blocks.where(F.col("kind").isin(*BLOCK_KINDS)).join(sources.select("source_id", "publisher", "traffic_keywords", "traffic_incident"), "source_id")
    kept = joined.where(relevant(F.col("text"), F.coalesce("traffic_keywords", F.array().cast("array<string>")), F.coalesce("traffic_incident", F.lit(False))))
    claims = kept.withColumn("claim_text", normalized(ascii_digits("text")))
    comment = F.col("kind") == "comment"
    return claims.select(
        stable_id("ev", "source_id", "block_id", "claim_text").alias("evidence_id"), "source_id", "block_id", F.col("kind").alias("evidence_kind"),
        F.when(comment, "opinion").otherwise("reported").alias("assertion_type"), "claim_text", folded("claim_text").alias("normalized_claim"),
        F.coalesce("author", "publisher").alias("claimant"), casualty_counts("claim_text").alias("casualties"), F.when(comment, 0.65).otherwise(0.82).alias("extraction_confidence"),
    )


def matching_anchors(texts: DataFrame, id_col: str, text_col: str, aliases: DataFrame) -> DataFrame:
    """Best anchor of each family in each text: aliases (alias, anchor, family, priority, ord) stand at word boundaries.

    The alias table is a dimension, broadcast up to MOST_ALIASES rows.  Up to MOST_BEGINNINGS rows its first words are written into
    the plan, so that a text is repeated for the words only that some alias begins with.  Each such text meets the aliases that
    begin with its word by an equi-join: the work grows with the words and not with texts times aliases.
    """
    first = F.regexp_extract(folded("alias"), r"[\p{L}\p{N}]+", 0)
    dimension = aliases.select("anchor", "family", "priority", "ord", "alias", first.alias("_first"), alias_pattern(F.col("alias")).alias("_pattern"))
    held = F.array_distinct(F.regexp_extract_all("_text", F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))
    size = dimension.count()
    if size <= MOST_BEGINNINGS:
        held = F.array_intersect(held, F.array(*(F.lit(r[0]) for r in dimension.select("_first").distinct().collect())).cast("array<string>"))
    rows = texts.select(F.col(id_col), folded(text_col).alias("_text")).withColumn("_first", F.explode(held))
    hits = rows.join(F.broadcast(dimension) if size <= MOST_ALIASES else dimension, "_first").where(F.expr("_text rlike _pattern")).select(id_col, "anchor", "family", "priority", "ord").distinct()
    own = F.coalesce("family", F.concat(F.lit("="), "anchor"))
    rank = F.row_number().over(Window.partitionBy(id_col, own).orderBy(F.desc("priority"), "ord"))
    return hits.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def duplicate_groups(sources: DataFrame, hash_col: str, group_col: str = "dependency_group") -> DataFrame:
    """Sources whose content occurs more than once share a group named after it and count as reposts."""
    copies = sources.groupBy(hash_col).agg(F.count(F.lit(1)).alias("_copies")).where("_copies > 1")
    joined = sources.join(copies, hash_col, "left")
    repeated = F.col("_copies").isNotNull()
    return joined.withColumns({
        group_col: F.when(repeated, F.concat(F.lit("duplicate:"), F.substring(hash_col, 1, 12))).otherwise(F.col(group_col)),
        "independence": F.when(repeated, F.lit("repost")).otherwise(F.lit("original")),
    }).drop("_copies")


def sentiment(evidence: DataFrame) -> DataFrame:
    """Evidence (evidence_id, source_id, evidence_kind, normalized_claim, claimant, extraction_confidence) that tells a mood."""
    text = F.col("normalized_claim")
    told = F.lit(False)
    for w in SENTIMENT_WORDS:
        told = told | F.contains(text, F.lit(w))
    jam = F.lit(False)
    for w in CONGESTION_WORDS:
        jam = jam | F.contains(text, F.lit(w))
    return evidence.where((F.col("evidence_kind") == "sentiment") | told).select(
        stable_id("sent", "evidence_id").alias("sentiment_id"), "evidence_id", "source_id", F.coalesce("claimant", F.lit("source audience or participant")).alias("holder"),
        F.when(jam, "congestion_delay").otherwise("road_safety").alias("aspect"), F.when(jam, "frustration").otherwise("concern").alias("emotion"),
        F.lit("negative").alias("polarity"), F.least("extraction_confidence", F.lit(0.75)).alias("confidence"),
    )


def split_mentions(evidence: DataFrame, aliases: DataFrame, countries: DataFrame) -> DataFrame:
    """Mentions of a source's incidents: one for each anchor family that its claims name.

    evidence: evidence_id, source_id, normalized_claim, casualties, country_code, incident (whether the source is one of an
    incident).  Claims that name one family only count for it, if there are any; else all that name it.  Without an anchor a
    source of an incident becomes a mention at its country, or at an unknown place, over all its claims.
    """
    named = matching_anchors(evidence, "evidence_id", "normalized_claim", aliases).withColumn("family", F.coalesce("family", "anchor"))
    families = named.withColumn("_families", F.size(F.collect_set("family").over(Window.partitionBy("evidence_id"))))
    own = evidence.join(families.select("evidence_id", "family", "anchor", "priority", "ord", "_families"), "evidence_id")
    alone = F.max((F.col("_families") == 1).cast("int")).over(Window.partitionBy("source_id", "family"))
    related = own.withColumn("_alone", alone).where("_alone = 0 OR _families = 1")
    best = F.max(F.struct("priority", (-F.col("ord")).alias("o"), "anchor"))
    counts = [F.when(F.count_distinct(f"casualties.{f}") == 1, F.max(f"casualties.{f}")).alias(f) for f in ("fatalities", "injuries")]
    placed = related.groupBy("source_id", "family").agg(best.alias("_best"), F.sort_array(F.collect_set("evidence_id")).alias("evidence_ids"), *counts)
    placed = placed.select("source_id", F.col("_best.anchor").alias("anchor"), F.col("_best.priority").alias("priority"), "evidence_ids", "fatalities", "injuries", F.lit("named").alias("place"))
    rest = evidence.where("incident").join(placed.select("source_id").distinct(), "source_id", "left_anti").join(countries.select("country_code", "iso3"), "country_code", "left")
    unplaced = rest.groupBy("source_id").agg(F.first("iso3", True).alias("iso3"), F.sort_array(F.collect_set("evidence_id")).alias("evidence_ids"), *counts)
    unplaced = unplaced.select("source_id", F.coalesce(F.concat(F.lit("country-fallback:"), "iso3"), F.lit("unknown")).alias("anchor"), F.lit(-100).alias("priority"), "evidence_ids", "fatalities", "injuries", F.when(F.col("iso3").isNotNull(), "country").otherwise("unknown").alias("place"))
    return placed.unionByName(unplaced).withColumn("mention_id", stable_id("men", "source_id", "anchor")).withColumn("completeness", F.least(F.lit(0.9), 0.35 + F.size("evidence_ids") * 0.05))


