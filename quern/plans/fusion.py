"""Queries over fused records: the record itself, the filters on it, its places, mentions, evidence and moods."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import evidence as E
from quern.operators import fusing, querying
from quern.plans import pipeline
from quern.plans.tables import MENTIONS, TITLES, load, mentions, page_titles
from quern.plans.texts import aliases


def _told(spark: SparkSession, sf: str) -> DataFrame:
    """Pages as mentions with facts, places, vehicles and effects that follow from the id."""
    return mentions(spark, sf).selectExpr(
        "mention_id", "source_id", "title", "event_time", "vehicles", "CASE WHEN mention_id % 6 = 0 THEN 'wire' END AS dependency_group", "array(concat('e', mention_id), concat('e', mention_id % 40)) AS evidence_ids",
        "CASE WHEN mention_id % 10 = 0 THEN array('blocked') ELSE array() END AS effects", "CASE mention_id % 6 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 3 THEN 6 END AS fatalities", "cast(nullif(mention_id % 4, 0) AS int) AS injuries",
        "CASE WHEN mention_id % 3 <> 0 THEN CASE WHEN mention_id % 7 = 0 THEN concat('country ', country) ELSE concat('place', mention_id % 50) END END AS place_name",
        "CASE WHEN mention_id % 7 = 0 THEN 'country' WHEN mention_id % 2 = 0 THEN 'city' ELSE 'area' END AS granularity", "cast(mention_id * 7 % 180 - 90 AS double) AS lat", "cast(mention_id * 11 % 360 - 180 AS double) AS lon",
        "cast(null AS double) AS radius_km", "CASE WHEN mention_id % 7 = 0 THEN 0.12D ELSE 0.55D + 0.05D * (mention_id % 3) END AS place_confidence", "'told' AS reason",
    )


def _records(spark: SparkSession, sf: str) -> DataFrame:
    """Records of four pages each."""
    m = _told(spark, sf)
    said = m.selectExpr("concat('t', mention_id) AS sentiment_id", "concat('e', mention_id % 40) AS evidence_id", "source_id", "if(mention_id % 2 = 0, 'congestion_delay', 'road_safety') AS aspect", "CASE mention_id % 3 WHEN 0 THEN 'negative' WHEN 1 THEN 'neutral' ELSE 'positive' END AS polarity")
    return fusing.fuse_clusters(m.selectExpr("mention_id DIV 4 AS cluster", "mention_id"), m, said)


_MEMBERS = MENTIONS + r""",
m2 AS (SELECT id, id // 4 AS c, m.src, title, t, veh, CASE WHEN id % 6 = 0 THEN 'wire' ELSE m.src END AS grp, ['e' || id, 'e' || (id % 40)] AS ev, CASE WHEN id % 10 = 0 THEN ['blocked'] ELSE []::VARCHAR[] END AS eff,
  CASE id % 6 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 3 THEN 6 END AS fat, nullif(id % 4, 0)::INT AS inj, CASE WHEN id % 3 <> 0 THEN CASE WHEN id % 7 = 0 THEN 'country ' || country ELSE 'place' || (id % 50) END END AS pn,
  CASE WHEN id % 7 = 0 THEN 'country' WHEN id % 2 = 0 THEN 'city' ELSE 'area' END AS gran, (id * 7 % 180 - 90)::DOUBLE AS lat, (id * 11 % 360 - 180)::DOUBLE AS lon, CASE WHEN id % 7 = 0 THEN 0.12::DOUBLE ELSE 0.55::DOUBLE + 0.05::DOUBLE * (id % 3) END AS pc
  FROM m JOIN titles ON page_id = id),
base AS (SELECT c, 'inc_' || substring(sha256(string_agg(id, '|' ORDER BY id)), 1, 16) AS incident_id, count(*)::INT AS members, first(title ORDER BY src, id) AS title, count(DISTINCT grp) AS source_count, array_to_string(list_sort(list_distinct(flatten(list(ev)))), ',') AS evidence,
  array_to_string(list_sort(list_distinct(flatten(list(veh)))), ',') AS vehicles, array_to_string(list_distinct(flatten(list(eff))), ',') AS effects FROM m2 GROUP BY c),
tv AS (SELECT c, t FROM (SELECT c, t, count(*) AS n, min(id) AS o FROM m2 GROUP BY c, t) QUALIFY row_number() OVER (PARTITION BY c ORDER BY n DESC, o) = 1),
pv AS (SELECT c, pn, count(*) AS n, min(id) AS o, first(lat ORDER BY id) AS lat, first(lon ORDER BY id) AS lon, first(gran ORDER BY id) AS gran, first(pc ORDER BY id) AS pc, bool_or(gran <> 'country') AS fine FROM m2 WHERE pn IS NOT NULL GROUP BY c, pn),
pw AS (SELECT * FROM pv QUALIFY row_number() OVER (PARTITION BY c ORDER BY fine DESC, n DESC, o) = 1),
fv AS (SELECT c, 'fat' AS f, fat AS v, id FROM m2 WHERE fat IS NOT NULL UNION ALL SELECT c, 'inj', inj, id FROM m2 WHERE inj IS NOT NULL),
fw AS (SELECT c, f, v, count(*) AS n, min(id) AS o, row_number() OVER (PARTITION BY c, f ORDER BY count(*) DESC, min(id)) AS r FROM fv GROUP BY c, f, v),
ff AS (SELECT c, max(v) FILTER (f = 'fat' AND r = 1) AS deaths, coalesce(string_agg(v, ',' ORDER BY v) FILTER (f = 'fat' AND r > 1), '') AS other_deaths, max(0.55::DOUBLE + 0.08::DOUBLE * n - 0.12::DOUBLE * (k - 1)) FILTER (f = 'fat' AND r = 1) AS deaths_confidence,
  max(v) FILTER (f = 'inj' AND r = 1) AS injuries, max(v) FILTER (f = 'fat') AS md, max(v) FILTER (f = 'inj') AS mi FROM (SELECT *, count(*) OVER (PARTITION BY c, f) AS k FROM fw) GROUP BY c),
se AS (SELECT 't' || id AS s, 'e' || (id % 40) AS e, src, CASE WHEN id % 2 = 0 THEN 'congestion_delay' ELSE 'road_safety' END AS a, CASE id % 3 WHEN 0 THEN 'negative' WHEN 1 THEN 'neutral' ELSE 'positive' END AS p FROM m2),
sc AS (SELECT c, e, p, a FROM (SELECT DISTINCT c, src FROM m2) JOIN se USING (src) QUALIFY row_number() OVER (PARTITION BY c, e ORDER BY s DESC) = 1),
sp AS (SELECT c, string_agg(DISTINCT p, ',' ORDER BY p) AS polarities, count(*) AS n_sentiments, count(*) FILTER (a = 'road_safety' AND p = 'negative') AS safety_negative FROM sc GROUP BY c),
rec AS (SELECT incident_id, members, title, strftime(t, '%Y-%m-%d') AS date, pn AS place, CASE WHEN pn IS NOT NULL THEN lat END AS lat, CASE WHEN pn IS NOT NULL THEN lon END AS lon, coalesce(gran, 'unknown') AS granularity,
  CASE WHEN pn IS NULL THEN 'unresolved' WHEN gran = 'country' THEN 'collection_country_fallback' ELSE 'source_named_offline_gazetteer_centroid' END AS method,
  round(CASE WHEN pn IS NULL THEN 0 WHEN fine THEN least(0.9::DOUBLE, pc + 0.05::DOUBLE * (n - 1)) ELSE least(0.2::DOUBLE, pc + 0.02::DOUBLE * (n - 1)) END, 6) AS confidence, CASE gran WHEN 'city' THEN 12.0::DOUBLE WHEN 'area' THEN 3.0::DOUBLE END AS radius_km,
  source_count, evidence, vehicles, effects, deaths, CASE WHEN deaths IS NULL THEN 'not_reported' WHEN deaths = 0 THEN 'reported_zero' ELSE 'known' END AS deaths_state, coalesce(other_deaths, '') AS other_deaths, round(coalesce(least(0.9::DOUBLE, deaths_confidence), 0), 6) AS deaths_confidence, injuries,
  CASE WHEN md >= 5 THEN 'critical' WHEN md >= 1 THEN 'high' WHEN mi >= 1 THEN 'medium' ELSE 'unknown' END AS severity, coalesce(polarities, '') AS polarities, coalesce(n_sentiments, 0) AS n_sentiments, coalesce(safety_negative, 0) AS safety_negative
  FROM base JOIN tv USING (c) LEFT JOIN pw USING (c) LEFT JOIN ff USING (c) LEFT JOIN sp USING (c))"""


def q_fused_incident(spark: SparkSession, sf: str) -> DataFrame:
    told = lambda f: F.element_at(F.filter("facts", lambda x: x["field"] == f), 1)
    listed = lambda c: F.array_join(c, ",")
    return _records(spark, sf).select(
        "incident_id", F.size("mention_ids").alias("members"), "title", "date", "place", "lat", "lon", "granularity", "method", F.round("confidence", 6).alias("confidence"), "radius_km", "source_count", listed("evidence_ids").alias("evidence"), listed("vehicles").alias("vehicles"), listed("effects").alias("effects"),
        told("fatalities")["value"].alias("deaths"), told("fatalities")["state"].alias("deaths_state"), listed(F.transform(told("fatalities")["alternatives"], lambda x: x.cast("string"))).alias("other_deaths"), F.round(told("fatalities")["confidence"], 6).alias("deaths_confidence"), told("injuries")["value"].alias("injuries"),
        "severity", listed("polarities").alias("polarities"), "n_sentiments", F.coalesce(F.try_element_at(F.try_element_at("by_aspect", F.lit("road_safety")), F.lit("negative")), F.lit(0)).alias("safety_negative"),
    )


def q_fused_search(spark: SparkSession, sf: str) -> DataFrame:
    """The query interface on fused records: all its conditions, then map features."""
    f = querying.Filter(kind="road_crash", severity="critical", confidence=0.1, source_count=2, date_from="2024-01-02", date_to="2024-01-20", box=(-170.0, -80.0, 170.0, 80.0), sentiment="negative", search="independent groups")
    found = f.apply(_records(spark, sf)).withColumn("g", querying.feature(["incident_id", "method", "is_incident_location"]))
    return found.select("incident_id", "date", F.get_json_object("g", "$.geometry.coordinates[0]").cast("double").alias("lon"), F.get_json_object("g", "$.properties.method").alias("method"), (F.get_json_object("g", "$.properties.is_incident_location") == "true").alias("is_incident_location"))


def q_point_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """One record by its key, none if there is none; and the health row."""
    rows = querying.lookup(load(spark, sf, "orders"), "o_orderkey", 7).unionByName(querying.lookup(load(spark, sf, "orders"), "o_orderkey", -1))
    return rows.select("o_orderkey", "o_orderstatus")


def q_country_fallback(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers as mentions: named places of the gazetteer or the centre of their nation."""
    s = load(spark, sf, "supplier").join(load(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    m = s.selectExpr("s_suppkey AS mention_id", "CASE s_suppkey % 3 WHEN 0 THEN 'named' WHEN 1 THEN 'country' ELSE 'unknown' END AS place", "CASE s_suppkey % 3 WHEN 0 THEN concat('anchor', s_suppkey % 4) WHEN 1 THEN concat('country-fallback:', n_name) ELSE 'unknown' END AS anchor", "CASE WHEN s_suppkey % 3 = 1 THEN -100 ELSE (s_suppkey % 4) * 10 END AS priority")
    gazetteer = spark.createDataFrame([(f"a{k}", f"anchor{k}", f"Anchor {k}", "city" if k % 2 else "road_segment", 10.0 + k, 20.0 + k, None) for k in range(4)], "alias string, anchor string, display string, granularity string, lat double, lon double, radius_km double")
    countries = load(spark, sf, "nation").selectExpr("n_name AS iso3", "concat('Land ', n_name) AS name", "cast(n_nationkey AS double) AS lat", "cast(-n_nationkey AS double) AS lon")
    return pipeline.mention_places(m, gazetteer, countries).select("mention_id", "place_name", "granularity", "lat", "lon", "place_confidence")


def _claims(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as claims of their source; the id modulo 200 stands for the source."""
    d = load(spark, sf, "documents").selectExpr("concat('e', doc_id) AS evidence_id", "concat('s', doc_id % 200) AS source_id", "lower(text) AS normalized_claim", "upper(lang) AS country_code", "doc_id % 3 <> 0 AS incident", "named_struct('fatalities', cast(nullif(doc_id % 5, 0) AS int), 'injuries', cast(doc_id % 2 AS int)) AS casualties")
    return d


def q_split_mentions(spark: SparkSession, sf: str) -> DataFrame:
    countries = spark.createDataFrame([("EN", "ENG"), ("DE", "DEU"), ("FR", "FRA")], "country_code string, iso3 string")
    out = E.split_mentions(_claims(spark, sf), aliases(spark), countries)
    return out.select("mention_id", "source_id", "anchor", "place", F.size("evidence_ids").alias("n_evidence"), *(F.coalesce(c, F.lit(-1)).alias(c) for c in ("fatalities", "injuries")), F.round("completeness", 6).alias("completeness"))


def _split_sql() -> str:
    from quern.plans.texts import ALIASES

    values = ", ".join(f"('{a}', '{b}', '{c or b}', {p}, {o})" for a, b, c, p, o in ALIASES)
    return rf"""WITH al(alias, anchor, fam, pri, ord) AS (VALUES {values}),
e AS (SELECT 'e' || doc_id AS ev, 's' || (doc_id % 200) AS src, replace(lower(text), 'ß', 'ss') AS t, upper(lang) AS cc, doc_id % 3 <> 0 AS inc, nullif(doc_id % 5, 0)::INT AS fat, (doc_id % 2)::INT AS inj FROM documents),
h AS (SELECT DISTINCT ev, src, fat, inj, anchor, fam, pri, ord FROM e, al WHERE regexp_matches(t, '(^|[^\p{{L}}\p{{N}}_])' || replace(alias, 'ß', 'ss') || '($|[^\p{{L}}\p{{N}}_])')),
b AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY ev, fam ORDER BY pri DESC, ord) = 1),
f AS (SELECT *, count(*) OVER (PARTITION BY ev) AS k FROM b), a AS (SELECT *, max((k = 1)::INT) OVER (PARTITION BY src, fam) AS alone FROM f), r AS (SELECT * FROM a WHERE alone = 0 OR k = 1),
n AS (SELECT src, first(anchor ORDER BY pri DESC, ord) AS anchor, 'named' AS place, count(DISTINCT ev)::INT AS n, CASE WHEN count(DISTINCT fat) = 1 THEN max(fat) END AS fat, CASE WHEN count(DISTINCT inj) = 1 THEN max(inj) END AS inj FROM r GROUP BY src, fam),
u AS (SELECT src, coalesce('country-fallback:' || max(CASE cc WHEN 'EN' THEN 'ENG' WHEN 'DE' THEN 'DEU' WHEN 'FR' THEN 'FRA' END), 'unknown') AS anchor, CASE WHEN max(CASE WHEN cc IN ('EN', 'DE', 'FR') THEN 1 END) = 1 THEN 'country' ELSE 'unknown' END AS place, count(*)::INT AS n,
  CASE WHEN count(DISTINCT fat) = 1 THEN max(fat) END AS fat, CASE WHEN count(DISTINCT inj) = 1 THEN max(inj) END AS inj FROM e WHERE inc AND src NOT IN (SELECT src FROM n) GROUP BY src),
x AS (SELECT * FROM n UNION ALL SELECT * FROM u)
SELECT 'men_' || substring(sha256(src || '|' || anchor), 1, 16) AS mention_id, src AS source_id, anchor, place, n AS n_evidence, coalesce(fat, -1) AS fatalities, coalesce(inj, -1) AS injuries, round(least(0.9::DOUBLE, 0.35::DOUBLE + n * 0.05::DOUBLE), 6) AS completeness FROM x"""


def q_block_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """Turns as blocks of their conversation: kinds, relevance by words or by the source's declaration, claims with identifier."""
    t = load(spark, sf, "conversations")
    sources = t.groupBy(F.col("conv_id").alias("source_id")).agg(F.lit("pub").alias("publisher"), F.expr("array('the ')").alias("traffic_keywords")).withColumn("traffic_incident", F.col("source_id") % 4 == 0)
    blocks = t.selectExpr("concat(conv_id, '-', turn) AS block_id", "conv_id AS source_id", "CASE turn % 4 WHEN 0 THEN 'headline' WHEN 1 THEN 'article' WHEN 2 THEN 'comment' ELSE 'published_time' END AS kind", "text", "CASE WHEN turn % 2 = 0 THEN role END AS author")
    return E.block_evidence(sources, blocks).select("evidence_id", "source_id", "block_id", "evidence_kind", "assertion_type", F.length("claim_text").alias("chars"), "claimant", "extraction_confidence")


def q_sentiment(spark: SparkSession, sf: str) -> DataFrame:
    d = load(spark, sf, "documents").selectExpr("concat('e', doc_id) AS evidence_id", "doc_id AS source_id", "CASE WHEN doc_id % 9 = 0 THEN 'sentiment' ELSE 'article' END AS evidence_kind", "concat(lower(text), CASE WHEN doc_id % 4 = 0 THEN ' we demand justice' WHEN doc_id % 4 = 1 THEN ' traffic' ELSE '' END) AS normalized_claim", "CASE WHEN doc_id % 2 = 0 THEN source END AS claimant", "0.6D + doc_id % 5 / 10D AS extraction_confidence")
    return E.sentiment(d).select("sentiment_id", "source_id", "holder", "aspect", "emotion", "polarity", F.round("confidence", 6).alias("confidence"))


def q_publication_date(spark: SparkSession, sf: str) -> DataFrame:
    """Dates of reports: of metadata in its zone, else the first that a block tells."""
    p = page_titles(spark, sf).selectExpr("page_id", """CASE page_id % 4 WHEN 0 THEN concat('2024-03-', lpad(cast(1 + page_id % 28 AS string), 2, '0'), 'T10:00:00+02:00') WHEN 1 THEN concat('2024-03-', lpad(cast(1 + page_id % 28 AS string), 2, '0'), 'T10:00:00') WHEN 2 THEN 'soon' END AS said""",
        "'Asia/Dhaka' AS zone", "array('no date', concat(1 + page_id % 28, ' March 2024'), '5 May 2023') AS blocks")
    from quern.functions.dates import published

    return p.select("page_id", F.date_format(published(F.col("said"), F.col("zone"), F.col("blocks")), "yyyy-MM-dd HH:mm:ss").alias("published"))


def q_feed_date(spark: SparkSession, sf: str) -> DataFrame:
    from quern.functions.dates import feed_date

    o = load(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "EEE, dd MMM yyyy HH:mm:ss '+0600'")).when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "yyyyMMdd'T'HHmmss'Z'")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("said"))
    return o.select("o_orderkey", feed_date(F.col("said")).alias("at"))


QUERIES = {
    "fused_incident": (q_fused_incident, f"WITH {_MEMBERS} SELECT * FROM rec"),
    "fused_search": (q_fused_search, f"WITH {_MEMBERS} SELECT incident_id, date, lon, CASE WHEN lat IS NOT NULL THEN method END AS method, CASE WHEN lat IS NOT NULL THEN method NOT IN ('collection_country_fallback', 'unresolved') END AS is_incident_location FROM rec WHERE severity = 'critical' AND confidence >= 0.1 AND source_count >= 2 AND date BETWEEN '2024-01-02' AND '2024-01-20' AND (lat IS NULL OR (lon BETWEEN -170 AND 170 AND lat BETWEEN -80 AND 80)) AND contains(polarities, 'negative')"),
    "point_lookup": (q_point_lookup, "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey = 7"),
    "country_fallback": (q_country_fallback, """WITH s AS (SELECT s_suppkey AS id, s_suppkey % 4 AS k, n_name, n_nationkey FROM supplier JOIN nation ON s_nationkey = n_nationkey)
        SELECT id AS mention_id, 'Anchor ' || k AS place_name, CASE WHEN k % 2 = 1 THEN 'city' ELSE 'road_segment' END AS granularity, 10.0::DOUBLE + k AS lat, 20.0::DOUBLE + k AS lon, CASE WHEN k >= 2 THEN 0.75::DOUBLE WHEN k % 2 = 1 THEN 0.68::DOUBLE ELSE 0.55::DOUBLE END AS place_confidence FROM s WHERE id % 3 = 0
        UNION ALL SELECT id, 'Land ' || n_name || ' (collection country; the place is not resolved)', 'country', n_nationkey::DOUBLE, -n_nationkey::DOUBLE, 0.12::DOUBLE FROM s WHERE id % 3 = 1"""),
    "split_mentions": (q_split_mentions, _split_sql()),
    "block_evidence": (q_block_evidence, r"""WITH b AS (SELECT conv_id, conv_id || '-' || turn AS block_id, turn, role, trim(regexp_replace(text, '\s+', ' ', 'g')) AS claim, text FROM conversations WHERE turn % 4 <> 3)
        SELECT 'ev_' || substring(sha256(conv_id || '|' || block_id || '|' || claim), 1, 16) AS evidence_id, conv_id AS source_id, block_id, CASE turn % 4 WHEN 0 THEN 'headline' WHEN 1 THEN 'article' ELSE 'comment' END AS evidence_kind, CASE WHEN turn % 4 = 2 THEN 'opinion' ELSE 'reported' END AS assertion_type,
        length(claim)::INT AS chars, CASE WHEN turn % 2 = 0 THEN role ELSE 'pub' END AS claimant, CASE WHEN turn % 4 = 2 THEN 0.65::DOUBLE ELSE 0.82::DOUBLE END AS extraction_confidence FROM b
        WHERE conv_id % 4 = 0 OR contains(replace(lower(text), 'ß', 'ss'), 'the ') OR regexp_matches(lower(text), '\b(accident|crash|collision|killed|injured|road|highway|traffic|blockade|congestion|vehicle|motorcycle|bus|truck)\b')"""),
    "sentiment": (q_sentiment, """WITH d AS (SELECT doc_id, source, lower(text) || CASE doc_id % 4 WHEN 0 THEN ' we demand justice' WHEN 1 THEN ' traffic' ELSE '' END AS t FROM documents)
        SELECT 'sent_' || substring(sha256('e' || doc_id), 1, 16) AS sentiment_id, doc_id AS source_id, CASE WHEN doc_id % 2 = 0 THEN source ELSE 'source audience or participant' END AS holder, CASE WHEN contains(t, 'traffic') THEN 'congestion_delay' ELSE 'road_safety' END AS aspect, CASE WHEN contains(t, 'traffic') THEN 'frustration' ELSE 'concern' END AS emotion,
        'negative' AS polarity, round(least(0.75::DOUBLE, 0.6::DOUBLE + doc_id % 5 / 10), 6) AS confidence FROM d WHERE doc_id % 9 = 0 OR contains(t, 'justice') OR contains(t, 'protest') OR contains(t, 'demand')"""),
    "publication_date": (q_publication_date, """SELECT page_id, strftime(CASE page_id % 4 WHEN 0 THEN make_timestamp(2024, 3, 1 + page_id % 28, 8, 0, 0) WHEN 1 THEN make_timestamp(2024, 3, 1 + page_id % 28, 4, 0, 0) ELSE make_timestamp(2024, 3, 1 + page_id % 28, 0, 0, 0) - INTERVAL 6 HOUR END, '%Y-%m-%d %H:%M:%S') AS published FROM pages"""),
    "feed_date": (q_feed_date, """SELECT o_orderkey, strftime(CASE o_orderkey % 3 WHEN 0 THEN date_trunc('second', o_orderdate) - INTERVAL 6 HOUR WHEN 1 THEN date_trunc('second', o_orderdate) ELSE date_trunc('day', o_orderdate) END, '%Y-%m-%dT%H:%M:%SZ') AS at FROM orders"""),
}
