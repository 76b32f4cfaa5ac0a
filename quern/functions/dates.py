"""Dates that pages, sidecars and feeds tell, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: How dates are written in texts and in feeds, the first that fits.
WRITTEN = r"(?i)\b(\d{1,2}) (January|February|March|April|May|June|July|August|September|October|November|December) (20\d\d)\b"
FEED = ("yyyyMMdd'T'HHmmssX", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyyMMddHHmmss", "yyyy-MM-dd")
MAIL = ("d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm:ss zzz", "d MMM yyyy HH:mm Z")
#: Blocks at the start of a page that may tell its date.
FIRST_BLOCKS = 15


def _in_zone(local: Column, zone: Column) -> Column:
    """A time without zone as one of that zone; UTC where none is told."""
    return F.convert_timezone(F.coalesce(zone, F.lit("UTC")), F.lit("UTC"), local.cast("timestamp_ntz"))


def told_in_text(text: Column) -> Column:
    """The first date written out in a text, at midnight without zone; null without one."""
    return F.try_to_timestamp(F.initcap(F.nullif(F.regexp_extract(text, WRITTEN, 0), F.lit(""))), F.lit("d MMMM yyyy")).cast("timestamp_ntz")


def told_in_metadata(value: Column, zone: Column) -> Column:
    """An ISO time as UTC, its own offset before the source's zone; null if it is none."""
    v = F.trim(value)
    offset = v.rlike(r"(Z|[+-]\d\d:?\d\d)$") & v.contains("T")
    with_offset = F.to_utc_timestamp(F.try_to_timestamp(F.when(offset, v)), F.current_timezone()).cast("timestamp_ntz")
    return F.coalesce(with_offset, _in_zone(F.when(~offset, v).try_cast("timestamp_ntz"), zone))


def published(metadata: Column, zone: Column, blocks: Column) -> Column:
    """When a source was published, UTC: what its metadata tells, else the first date in its first blocks."""
    dates = F.filter(F.transform(F.slice(blocks, 1, FIRST_BLOCKS), told_in_text), lambda d: d.isNotNull())
    return F.coalesce(told_in_metadata(metadata, zone), _in_zone(F.try_element_at(dates, F.lit(1)), zone))


def feed_date(value: Column) -> Column:
    """A feed's date, as mail or ISO writes it, as UTC ISO text; null if it is none."""
    v = F.trim(value)
    mail = F.regexp_replace(v, r"^[A-Za-z]{3},\s*", "")
    when = F.coalesce(*(F.try_to_timestamp(mail, F.lit(p)) for p in MAIL), *(F.try_to_timestamp(v, F.lit(p)) for p in FEED))
    return F.date_format(F.to_utc_timestamp(when, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
