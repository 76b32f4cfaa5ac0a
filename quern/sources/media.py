"""Video and image analysis documents as evidence rows, through VARIANT columns: unknown fields are kept."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.rules import assertion, clamped_confidence
from quern.functions.text import folded, normalized, stable_id

#: Sections of the documents and the kind of their items; keys of the text of an item, the first that isn't blank.
VIDEO = {"claims": "claim", "traffic_incidents": "traffic_incident", "traffic_conditions": "traffic_condition", "traffic_affecting_events": "traffic_event", "locations": "location", "predicted_or_possible_impacts": "predicted_impact"}
IMAGE = {"observations": "visual_observation", "textual_claims": "textual_claim", "inferences": "inference", "traffic_incidents": "traffic_incident", "traffic_conditions": "traffic_condition", "traffic_affecting_events": "traffic_event", "visible_text": "visible_text"}
MOODS = {"video": "aspect_sentiments", "image": "sentiment_expressions"}
TEXT_KEYS = ("claim", "observation", "description", "inference", "event", "condition", "original_text", "normalized_text", "traffic_relevance")
DEFAULT_ASSERTION = {"inference": "inferred", "predicted_impact": "predicted", "sentiment": "opinion", "visual_observation": "observed"}
PLACES = ("area", "city", "district", "country")


def _text(v: str, path: str) -> Column:
    return F.expr(f"try_variant_get({v}, '$.{path}', 'string')")


def _section(docs: DataFrame, path: str, kind: str) -> DataFrame:
    items = F.expr(f"try_variant_get(doc, '$.{path}', 'array<variant>')")
    return docs.select("source_id", "modality", F.posexplode(items).alias("pos", "item")).where("schema_of_variant(item) LIKE 'OBJECT%'").select(
        "source_id", "modality", F.lit(kind).alias("evidence_kind"), F.concat(F.lit(f"$.{path}["), F.col("pos").cast("string"), F.lit("]")).alias("locator"), "item"
    )


def media_evidence(documents: DataFrame, modality: str) -> DataFrame:
    """documents (source_id, json text) -> one row for each item with a text: evidence_id, kind, locator, claim, confidence, counts,
    vehicles, places, and the item itself."""
    docs = documents.select("source_id", F.lit(modality).alias("modality"), F.expr("try_parse_json(json)").alias("doc")).where("doc IS NOT NULL")
    sections = VIDEO if modality == "video" else IMAGE
    parts = [_section(docs, s, kind) for s, kind in sections.items()]
    parts.append(_section(docs, f"sentiment_analysis.{MOODS[modality]}", "sentiment"))
    if modality == "image":
        parts.append(docs.where("try_variant_get(doc, '$.location_evidence', 'variant') IS NOT NULL").select("source_id", "modality", F.lit("location").alias("evidence_kind"), F.lit("$.location_evidence").alias("locator"), F.expr("variant_get(doc, '$.location_evidence', 'variant')").alias("item")))
    rows = reduce(DataFrame.unionByName, parts)
    names = F.array_compact(F.array(*(F.nullif(_text("item", k), F.lit("")) for k in PLACES)))
    told = F.coalesce(*(F.nullif(normalized(_text("item", k)), F.lit("")) for k in TEXT_KEYS))
    mood = F.coalesce(_text("item", "evidence_text"), _text("item", "aspect"))
    bare = F.concat_ws("; ", *(F.nullif(_text("item", k), F.lit("")) for k in ("incident_type", "location", "date")), F.concat(F.lit("fatalities="), _text("item", "fatalities")), F.concat(F.lit("injuries="), _text("item", "injuries")))
    place = F.array_join(names, ", ")
    claim = F.when(F.col("evidence_kind") == "sentiment", F.coalesce(normalized(mood), told)).when(F.col("locator") == "$.location_evidence", F.nullif(place, F.lit("")))
    claim = claim.when(F.col("evidence_kind") == "traffic_incident", F.coalesce(told, F.nullif(bare, F.lit("")))).otherwise(told)
    rows = rows.withColumn("claim_text", claim).where("claim_text IS NOT NULL")
    default = F.lit("reported")
    for kind, label in DEFAULT_ASSERTION.items():
        default = F.when(F.col("evidence_kind") == kind, label).otherwise(default)
    kind_of = F.when(F.col("evidence_kind") == "sentiment", F.lit("opinion")).otherwise(F.coalesce(_text("item", "evidence_type"), _text("item", "observation_type")))
    stated = assertion(kind_of, "")
    vehicles = F.expr("transform(filter(coalesce(try_variant_get(item, '$.vehicles', 'array<variant>'), array()), v -> try_variant_get(v, '$.vehicle_type', 'string') IS NOT NULL), v -> variant_get(v, '$.vehicle_type', 'string'))")
    counts = F.struct(*(_text("item", k).try_cast("int").alias(k) for k in ("fatalities", "injuries")))
    return rows.select(
        stable_id("ev", "source_id", "locator", "claim_text").alias("evidence_id"), "source_id", "modality", "evidence_kind", F.when(stated == "", default).otherwise(stated).alias("assertion_type"), "claim_text",
        folded("claim_text").alias("normalized_claim"), _text("item", "claimant").alias("claimant"), "locator", clamped_confidence(F.coalesce(_text("item", "confidence_in_extraction"), _text("item", "confidence"))).alias("extraction_confidence"),
        counts.alias("casualties"), vehicles.alias("vehicles"), F.when(F.col("locator") == "$.location_evidence", names).otherwise(F.array_compact(F.array(_text("item", "location")))).alias("location_mentions"), F.to_json("item").alias("extensions"),
    )


