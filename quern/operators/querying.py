"""Filters, paging and map output over fused records."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Filter:
    """Optional conditions, all of which must hold.  Rows without coordinates pass the box; rows without a date fail from and to;
    dates compare as ISO strings."""

    kind: str | None = None
    severity: str | None = None
    confidence: float | None = None
    source_count: int | None = None
    search: str | None = None
    date_from: str | None = None
    date_to: str | None = None
    box: tuple[float, float, float, float] | None = None  # west, south, east, north
    sentiment: str | None = None

    def apply(self, rows: DataFrame) -> DataFrame:
        c = F.col
        if self.kind is not None:
            rows = rows.where(c("kind") == self.kind)
        if self.severity is not None:
            rows = rows.where(c("severity") == self.severity)
        if self.confidence is not None:
            rows = rows.where(c("confidence") >= self.confidence)
        if self.source_count is not None:
            rows = rows.where(c("source_count") >= self.source_count)
        if self.search is not None:
            rows = rows.where(F.contains(F.lower("text"), F.lit(self.search.lower())))
        if self.date_from is not None:
            rows = rows.where(c("date") >= self.date_from)
        if self.date_to is not None:
            rows = rows.where(c("date") <= self.date_to)
        if self.sentiment is not None:
            rows = rows.where(F.array_contains("polarities", self.sentiment))
        return rows.where(in_box(c("lat"), c("lon"), self.box)) if self.box else rows


def in_box(lat: Column, lon: Column, box: tuple[float, float, float, float]) -> Column:
    west, south, east, north = box
    return lat.isNull() | lon.isNull() | (lon.between(west, east) & lat.between(south, north))


def page(rows: DataFrame, order: str | Column, number: int, size: int) -> DataFrame:
    """Rows of one page, counted from 1, by an explicit order."""
    return rows.orderBy(order).offset((number - 1) * size).limit(size)


def feature(properties: list[str], lat: str = "lat", lon: str = "lon") -> Column:
    """A GeoJSON point as text; null without coordinates."""
    body = F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates")).alias("geometry"), F.struct(*properties).alias("properties")))
    return F.when(F.col(lat).isNotNull() & F.col(lon).isNotNull(), body)


def inverted_links(records: DataFrame, id_col: str, list_col: str, members: DataFrame, member_col: str) -> DataFrame:
    """Each member with the sorted ids of the records that list it; an empty list for the others."""
    links = records.select(F.col(id_col).alias("_r"), F.explode(list_col).alias(member_col)).groupBy(member_col).agg(F.sort_array(F.collect_set("_r")).alias("record_ids"))
    return members.join(links, member_col, "left").withColumn("record_ids", F.coalesce("record_ids", F.array().cast(links.schema["record_ids"].dataType)))


def cited(evidence: DataFrame, records: DataFrame, record_id: object, id_col: str = "incident_id", list_col: str = "evidence_ids") -> DataFrame:
    """The evidence that a record cites."""
    ids = records.where(F.col(id_col) == F.lit(record_id)).select(F.explode(list_col).alias("evidence_id"))
    return evidence.join(ids, "evidence_id", "left_semi")


def lookup(rows: DataFrame, key: str, value: object) -> DataFrame:
    """The row of that key, or none."""
    return rows.where(F.col(key) == F.lit(value)).limit(1)


def newest(rows: DataFrame, status: str | None = None, at: str = "submitted_at") -> DataFrame:
    """Rows of a status, or all, the newest first by their time as text."""
    return (rows if status is None else rows.where(F.col("status") == status)).orderBy(F.desc(at))
