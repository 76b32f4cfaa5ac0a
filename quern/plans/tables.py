"""The stand-ins: tables of the test data in the shapes that the operators take, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.text import lexical_features
from quern.functions.urls import hostname


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, lang, title of each page."""
    return load(spark, sf_dir, "pages").select(
        "page_id", "url", hostname("url").alias("host"), F.regexp_extract("html", r'<html lang="([a-z]*)"', 1).alias("lang"), F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1).alias("title")
    )


TITLES = r"""titles AS (SELECT page_id, url, regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '^www\.', '') AS host,
  regexp_extract(html, '<html lang="([a-z]*)"', 1) AS lang, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title FROM pages)"""


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as mentions: title terms, host as source, language as country; time, place and vehicles follow from the id."""
    return page_titles(spark, sf_dir).selectExpr(
        "page_id AS mention_id", "host AS source_id", "lang AS country", "title",
        "timestampadd(HOUR, cast(page_id % 500 AS int), timestamp_ntz'2024-01-01 00:00:00') AS event_time",
        "CASE WHEN page_id % 3 = 0 THEN array() ELSE array(concat('place', page_id % 50)) END AS locations",
        "CASE page_id % 4 WHEN 0 THEN array() WHEN 1 THEN array('bus') WHEN 2 THEN array('bus', 'truck') ELSE array('car') END AS vehicles", "page_id % 5 <> 0 AS primary",
    ).withColumn("terms", lexical_features("title", ["crash", "people", "road"]))


MENTIONS = TITLES + r""",
m AS (SELECT page_id AS id, host AS src, lang AS country, timestamp '2024-01-01' + to_hours(page_id % 500) AS t,
  CASE WHEN page_id % 3 = 0 THEN []::VARCHAR[] ELSE ['place' || (page_id % 50)] END AS loc,
  CASE page_id % 4 WHEN 0 THEN []::VARCHAR[] WHEN 1 THEN ['bus'] WHEN 2 THEN ['bus', 'truck'] ELSE ['car'] END AS veh, page_id % 5 <> 0 AS prim,
  list_filter(list_distinct(regexp_extract_all(replace(lower(title), 'ß', 'ss'), '[\p{L}\p{N}]+')), lambda x: length(x) >= 4 AND x NOT IN ('crash', 'people', 'road')) AS terms FROM titles),
jac AS (SELECT a.id AS l_id, b.id AS r_id, a.t AS lt, b.t AS rt, a.prim AND b.prim AS prim, a.src AS ls, b.src AS rs, a.country AS lc, b.country AS rc, a.loc AS ll, b.loc AS rl,
  len(list_intersect(a.loc, b.loc)) AS li, len(list_intersect(a.veh, b.veh)) AS vi, len(list_intersect(a.terms, b.terms)) AS ti, len(a.loc) AS la, len(b.loc) AS lb, len(a.veh) AS va, len(b.veh) AS vb, len(a.terms) AS ta, len(b.terms) AS tb
  FROM m a JOIN m b ON a.id < b.id AND a.src <> b.src AND a.country = b.country),
s1 AS (SELECT *, greatest(0.0::DOUBLE, 1 - (epoch_us(greatest(lt, rt)) - epoch_us(least(lt, rt))) / 86400000000.0::DOUBLE / 3) AS time_score,
  CASE WHEN la = 0 OR lb = 0 THEN 0.0::DOUBLE ELSE li / (la + lb - li) END AS location_score, CASE WHEN va = 0 OR vb = 0 THEN 0.0::DOUBLE ELSE vi / (va + vb - vi) END AS vehicle_score,
  CASE WHEN ta = 0 OR tb = 0 THEN 0.0::DOUBLE ELSE ti / (ta + tb - ti) END AS lexical_score,
  CASE WHEN prim AND la > 0 AND lb > 0 AND li = 0 THEN 'location' WHEN prim AND abs(epoch_us(lt) - epoch_us(rt)) > 3 * 86400000000 THEN 'time' END AS hard_guard FROM jac),
s2 AS (SELECT *, 0.30::DOUBLE * time_score + 0.35::DOUBLE * location_score + 0.05::DOUBLE * vehicle_score + 0.15::DOUBLE * lexical_score AS w FROM s1),
s3 AS (SELECT *, CASE WHEN location_score = 1 AND lexical_score > 0 THEN greatest(w, 0.74::DOUBLE) ELSE w END AS w1 FROM s2),
scored AS (SELECT *, CASE WHEN hard_guard IS NOT NULL THEN 0.0::DOUBLE ELSE least(1.0::DOUBLE, CASE WHEN lexical_score >= 0.5 OR ti > 0 THEN greatest(w1, 0.62::DOUBLE) ELSE w1 END) END AS total_score FROM s3)"""

#: Links between mentions for the cluster queries.
DECIDED = (
    MENTIONS
    + r""",
cand AS (SELECT * FROM scored WHERE (li > 0 OR ti > 0) AND (hard_guard IS NOT NULL OR total_score >= 0.45)),
dec AS (SELECT l_id, r_id, total_score, CASE WHEN (l_id + r_id) % 97 = 0 THEN 'same_incident' WHEN (l_id + r_id) % 89 = 0 OR hard_guard IS NOT NULL THEN 'different_incident'
    WHEN (location_score = 1 AND time_score >= 0.65) OR (lexical_score >= 0.3 AND total_score >= 0.6) THEN 'same_incident' ELSE 'uncertain' END AS decision,
  CASE WHEN (l_id + r_id) % 97 = 0 THEN 1.0::DOUBLE WHEN (l_id + r_id) % 89 = 0 THEN 1.0::DOUBLE WHEN hard_guard IS NOT NULL THEN 0.95::DOUBLE
    WHEN (location_score = 1 AND time_score >= 0.65) OR (lexical_score >= 0.3 AND total_score >= 0.6) THEN greatest(total_score, 0.82::DOUBLE) ELSE total_score END AS confidence FROM cand)"""
)
