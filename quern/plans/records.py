"""Queries over records: votes, agreement, conflicts, filters, paging, map output, links, coverage, distributions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.rules import default_radius, haversine_km, severity, uncertainty_ring
from quern.operators import fusing, metrics, querying
from quern.plans.tables import load


def _incidents(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as incidents: items as facts, customer's nation for a place; one in seven has no place, one in eleven no date."""
    facts = load(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.max(F.when(F.col("l_returnflag") == "A", F.expr("cast(l_quantity AS int) % 9"))).alias("deaths"), F.max(F.when(F.col("l_returnflag") == "R", F.expr("cast(l_quantity AS int) % 7"))).alias("injuries"), F.count_distinct("l_suppkey").alias("source_count"))
    o = load(spark, sf, "orders").join(facts, "o_orderkey", "left")
    place = lambda m, k, lo: F.when(F.col("o_orderkey") % 7 != 0, ((F.col("o_custkey") * m) % k).cast("double") / 10 + lo)
    return o.select(
        "o_orderkey", F.col("o_orderpriority").alias("kind"), severity(F.coalesce("deaths", F.lit(0)), F.coalesce("injuries", F.lit(0))).alias("severity"), (F.col("o_orderkey") % 100 / 100).alias("confidence"), F.coalesce("source_count", F.lit(0)).alias("source_count"),
        F.when(F.col("o_orderkey") % 11 != 0, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("date"), F.concat_ws(" ", "o_orderpriority", "o_orderstatus").alias("text"), place(37, 1800, -90).alias("lat"), place(91, 3600, -180).alias("lon"),
    )


INCIDENTS = """f AS (SELECT l_orderkey, max(CASE WHEN l_returnflag = 'A' THEN l_quantity::INT % 9 END) AS deaths, max(CASE WHEN l_returnflag = 'R' THEN l_quantity::INT % 7 END) AS injuries, count(DISTINCT l_suppkey) AS source_count FROM lineitem GROUP BY l_orderkey),
i AS (SELECT o_orderkey, o_orderpriority AS kind, CASE WHEN deaths >= 5 THEN 'critical' WHEN deaths >= 1 THEN 'high' WHEN injuries >= 1 THEN 'medium' ELSE 'unknown' END AS severity, o_orderkey % 100 / 100 AS confidence, coalesce(source_count, 0) AS source_count,
  CASE WHEN o_orderkey % 11 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS date, o_orderpriority || ' ' || o_orderstatus AS text, CASE WHEN o_orderkey % 7 <> 0 THEN ((o_custkey * 37) % 1800)::DOUBLE / 10 - 90 END AS lat, CASE WHEN o_orderkey % 7 <> 0 THEN ((o_custkey * 91) % 3600)::DOUBLE / 10 - 180 END AS lon
  FROM orders LEFT JOIN f ON l_orderkey = o_orderkey)"""


def q_plurality_vote(spark: SparkSession, sf: str) -> DataFrame:
    out = fusing.plurality(load(spark, sf, "events"), ["user_id"], "event_type", "event_id")
    return out.select("user_id", "value", "votes", F.array_join("alternatives", ",").alias("alternatives"), "contradiction", F.round("confidence", 8).alias("confidence"), "reports")


def q_agreement_value(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "lineitem").groupBy("l_orderkey").agg(fusing.agreement("l_returnflag").alias("flag"), fusing.agreement("l_linestatus").alias("status"))


def q_conflict_alternatives(spark: SparkSession, sf: str) -> DataFrame:
    e = load(spark, sf, "events").select("user_id", "event_id", F.to_date("ts").alias("day"), F.get_json_object("props", "$.k").cast("int").alias("k"))
    return fusing.plurality(e, ["user_id", "day"], "k", "event_id").where("contradiction").select("user_id", "day", "value", F.array_join(F.transform("alternatives", lambda x: x.cast("string")), ",").alias("alternatives"), fusing.fact_state(F.col("value")).alias("state"))


def q_modal_time(spark: SparkSession, sf: str) -> DataFrame:
    e = load(spark, sf, "events").select("user_id", "event_id", "event_type", F.date_trunc("HOUR", "ts").cast("timestamp_ntz").alias("t"))
    return fusing.modal_time(e, ["user_id"], "t", "event_id", ["event_type"]).select("user_id", F.col("start").cast("string").alias("start"), F.col("end").cast("string").alias("end"), "event_type")


def q_fused_place(spark: SparkSession, sf: str) -> DataFrame:
    c = load(spark, sf, "customer").join(load(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).withColumns({"g": F.when(F.col("c_custkey") % 3 == 0, "country").otherwise("city"), "conf": 0.5 + F.col("c_custkey") % 4 / 20})
    return fusing.fused_place(c, ["c_mktsegment"], "n_name", "g", "conf", "c_custkey").select("c_mktsegment", "place", F.round("confidence", 6).alias("confidence"), F.size("alternatives").alias("n_alternatives"))


def q_aspect_polarity_map(spark: SparkSession, sf: str) -> DataFrame:
    e = load(spark, sf, "events").withColumn("polarity", F.when(F.col("value") < 50, "negative").when(F.col("value") < 150, "neutral").otherwise("positive"))
    nested = fusing.nested_counts(e, ["user_id"], "event_type", "polarity")
    flat = nested.select("user_id", F.explode("counts").alias("aspect", "m")).select("user_id", "aspect", F.explode("m").alias("polarity", "n"))
    return flat


def q_last_wins_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return fusing.last_wins(load(spark, sf, "events").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], "event_id")


def q_severity_case(spark: SparkSession, sf: str) -> DataFrame:
    return _incidents(spark, sf).groupBy("severity").agg(F.count(F.lit(1)).alias("n"), F.sum("source_count").alias("sources"))


def q_incident_filter(spark: SparkSession, sf: str) -> DataFrame:
    f = querying.Filter(severity="critical", confidence=0.3, source_count=2, search="high", date_from="1994-01-01", date_to="1999-12-31", box=(-120.0, -60.0, 120.0, 60.0))
    return f.apply(_incidents(spark, sf)).select("o_orderkey", "kind", "date", "lat", "lon")


def q_bbox_null_pass(spark: SparkSession, sf: str) -> DataFrame:
    return querying.Filter(box=(0.0, 0.0, 60.0, 60.0)).apply(_incidents(spark, sf)).select("o_orderkey", F.col("lat").isNull().alias("unmapped"))


def q_page_slice(spark: SparkSession, sf: str) -> DataFrame:
    rows = querying.Filter(severity="high").apply(_incidents(spark, sf))
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    return querying.page(rows.select("o_orderkey", "kind"), "o_orderkey", 3, 20).join(F.broadcast(total))


def q_geojson_feature(spark: SparkSession, sf: str) -> DataFrame:
    i = _incidents(spark, sf).select("o_orderkey", querying.feature(["severity", "source_count"]).alias("g"))
    return i.select("o_orderkey", F.get_json_object("g", "$.type").alias("type"), F.get_json_object("g", "$.geometry.coordinates[0]").cast("double").alias("lon"), F.get_json_object("g", "$.geometry.coordinates[1]").cast("double").alias("lat"), F.get_json_object("g", "$.properties.severity").alias("severity"))


def q_evidence_semi_join(spark: SparkSession, sf: str) -> DataFrame:
    p = load(spark, sf, "part").withColumnRenamed("p_partkey", "evidence_id")
    records = load(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("incident_id")).agg(F.collect_set("l_partkey").alias("evidence_ids"))
    return querying.cited(p, records, 7).select("evidence_id", "p_name", "p_brand")


def q_inverted_links(spark: SparkSession, sf: str) -> DataFrame:
    records = load(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_suppkey").alias("suppliers"))
    s = load(spark, sf, "supplier").select(F.col("s_suppkey").alias("member"))
    out = querying.inverted_links(records, "l_orderkey", "suppliers", s, "member")
    return out.select("member", F.size("record_ids").alias("n"), F.coalesce(F.array_min("record_ids"), F.lit(-1)).alias("first"), F.coalesce(F.array_max("record_ids"), F.lit(-1)).alias("last"))


def q_orphan_anti_join(spark: SparkSession, sf: str) -> DataFrame:
    used = load(spark, sf, "orders").where("o_totalprice > 150000").select("o_custkey")
    return load(spark, sf, "customer").join(used, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


def q_composite_top3(spark: SparkSession, sf: str) -> DataFrame:
    i = _incidents(spark, sf).withColumn("score", F.col("source_count") + F.when(F.col("severity") == "critical", 2).otherwise(0) + F.when(F.col("lat").isNotNull(), 2).otherwise(0))
    return i.orderBy(F.desc("score"), "o_orderkey").limit(3).select("o_orderkey", "score")


def q_distribution_stats(spark: SparkSession, sf: str) -> DataFrame:
    out = metrics.distribution(load(spark, sf, "orders"), "o_totalprice", ["o_orderstatus"])
    return out.select("o_orderstatus", "n", *(F.round(c, 4).alias(c) for c in ("mean", "pstdev", "least", "most", "q1", "median", "q3", "p90")))


def q_gapped_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.gapped_histogram(load(spark, sf, "lineitem").withColumn("v", F.expr("(l_partkey % 1000) / 1000")), "v")


def q_field_modality_matrix(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "lineitem").join(load(spark, sf, "part").select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    return metrics.support_matrix(rows, "l_orderkey", "p_type", "l_returnflag")


def q_completeness_gain(spark: SparkSession, sf: str) -> DataFrame:
    """Known fields of the best single supplier of an order against those of all together, orders of two suppliers or more."""
    facts = load(spark, sf, "lineitem").select("l_orderkey", "l_suppkey", F.col("l_returnflag").alias("f")).distinct()
    single = facts.groupBy("l_orderkey", "l_suppkey").agg(F.count(F.lit(1)).alias("k")).groupBy("l_orderkey").agg(F.max("k").alias("best"), F.count(F.lit(1)).alias("sources"))
    fused = facts.groupBy("l_orderkey").agg(F.count_distinct("f").alias("fused"))
    return single.where("sources > 1").join(fused, "l_orderkey").groupBy("sources").agg(F.count(F.lit(1)).alias("n"), F.sum("best").alias("best"), F.sum("fused").alias("fused"), F.count_if(F.col("fused") > F.col("best")).alias("gained"))


def q_provenance_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Whether each item's part and supplier can be resolved, with parts of some brands taken away."""
    known = load(spark, sf, "part").where("p_brand <> 'Brand#13'").select("p_partkey")
    items = load(spark, sf, "lineitem").join(known, F.col("l_partkey") == F.col("p_partkey"), "left")
    return items.groupBy("l_linestatus").agg(F.count(F.lit(1)).alias("facts"), F.count("p_partkey").alias("resolved"), F.round(F.count("p_partkey") / F.count(F.lit(1)), 8).alias("ratio"))


def q_haversine(spark: SparkSession, sf: str) -> DataFrame:
    i = _incidents(spark, sf).where("lat IS NOT NULL")
    return i.select("o_orderkey", F.round(haversine_km(F.col("lat"), F.col("lon"), F.lit(23.8), F.lit(90.4)), 5).alias("km"))


def q_uncertainty_ring(spark: SparkSession, sf: str) -> DataFrame:
    i = _incidents(spark, sf).where("lat IS NOT NULL").withColumn("g", F.when(F.col("o_orderkey") % 2 == 0, "area").otherwise("city"))
    ring = uncertainty_ring(F.col("lat"), F.col("lon"), default_radius(F.col("g"), F.lit(None).cast("double")))
    side = lambda f, k: (F.round(f(F.transform("r", lambda p: p[k])), 6) + 0.0)
    i = i.withColumn("r", ring)
    return i.select("o_orderkey", F.size("r").alias("points"), side(F.array_min, 0).alias("west"), side(F.array_max, 0).alias("east"), side(F.array_min, 1).alias("south"), side(F.array_max, 1).alias("north"))


def q_daily_spend(spark: SparkSession, sf: str) -> DataFrame:
    e = load(spark, sf, "events").where("event_type = 'purchase'")
    return e.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("calls"), F.round(F.sum("value"), 4).alias("cost"))


def q_bootstrap_ci(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.bootstrap_ci(load(spark, sf, "labels"), "quality")


_PLUR = """v AS (SELECT {k}, {v} AS value, count(*) AS n, min(event_id) AS o FROM {t} WHERE {v} IS NOT NULL GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY n DESC, o) AS r FROM v)"""
QUERIES = {
    "plurality_vote": (q_plurality_vote, "WITH " + _PLUR.format(k="user_id", v="event_type", t="events") + """, a AS (SELECT user_id, max(value) FILTER (r = 1) AS value, max(n) FILTER (r = 1) AS votes, coalesce(string_agg(value, ',' ORDER BY value) FILTER (r > 1), '') AS alternatives, count(*) - 1 AS k, sum(n)::BIGINT AS reports FROM b GROUP BY user_id)
        SELECT user_id, value, votes, alternatives, k > 0 AS contradiction, round(greatest(0, least(0.9::DOUBLE, 0.55::DOUBLE + 0.08::DOUBLE * votes - 0.12::DOUBLE * k)), 8) AS confidence, reports FROM a"""),
    "agreement_value": (q_agreement_value, "SELECT l_orderkey, CASE WHEN min(l_returnflag) = max(l_returnflag) THEN max(l_returnflag) END AS flag, CASE WHEN min(l_linestatus) = max(l_linestatus) THEN max(l_linestatus) END AS status FROM lineitem GROUP BY l_orderkey"),
    "conflict_alternatives": (q_conflict_alternatives, "WITH e AS (SELECT user_id, event_id, ts::DATE AS day, (props::JSON->>'k')::INT AS k FROM events), " + _PLUR.format(k="user_id, day", v="k", t="e") + """
        SELECT user_id, day, max(value) FILTER (r = 1) AS value, string_agg(value, ',' ORDER BY value) FILTER (r > 1) AS alternatives, CASE WHEN max(value) FILTER (r = 1) = 0 THEN 'reported_zero' ELSE 'known' END AS state FROM b GROUP BY user_id, day HAVING count(*) > 1"""),
    "modal_time": (q_modal_time, "WITH e AS (SELECT user_id, event_id, event_type, date_trunc('hour', ts)::TIMESTAMP AS t FROM events), " + _PLUR.format(k="user_id", v="t", t="e") + """, f AS (SELECT user_id, min_by(event_type, event_id) AS event_type FROM e GROUP BY user_id)
        SELECT user_id, strftime(value, '%Y-%m-%d %H:%M:%S') AS start, strftime(value + INTERVAL 1 DAY, '%Y-%m-%d %H:%M:%S') AS "end", event_type FROM b JOIN f USING (user_id) WHERE r = 1"""),
    "fused_place": (q_fused_place, """WITH c AS (SELECT c_mktsegment, n_name, c_custkey, c_custkey % 3 <> 0 AS fine, 0.5::DOUBLE + c_custkey % 4 / 20 AS conf, max((c_custkey % 3 <> 0)::INT) OVER (PARTITION BY c_mktsegment) AS gate FROM customer JOIN nation ON c_nationkey = n_nationkey),
        v AS (SELECT c_mktsegment, n_name, count(*) AS n, min(c_custkey) AS o, first(conf ORDER BY c_custkey) AS c, gate FROM c WHERE gate = 0 OR fine GROUP BY c_mktsegment, n_name, gate)
        SELECT c_mktsegment, n_name AS place, round(CASE WHEN gate = 1 THEN least(0.9::DOUBLE, c + 0.05::DOUBLE * (n - 1)) ELSE least(0.2::DOUBLE, c + 0.02::DOUBLE * (n - 1)) END, 6) AS confidence, (SELECT count(DISTINCT n_name) FROM c d WHERE d.c_mktsegment = v.c_mktsegment)::INT - 1 AS n_alternatives FROM v QUALIFY row_number() OVER (PARTITION BY c_mktsegment ORDER BY n DESC, o) = 1"""),
    "aspect_polarity_map": (q_aspect_polarity_map, "SELECT user_id, event_type AS aspect, CASE WHEN value < 50 THEN 'negative' WHEN value < 150 THEN 'neutral' ELSE 'positive' END AS polarity, count(*) AS n FROM events GROUP BY ALL"),
    "last_wins_dedup": (q_last_wins_dedup, "SELECT user_id, event_type, max(event_id) AS event_id, max_by(value, event_id) AS value, min(event_id) AS first_order FROM events GROUP BY ALL"),
    "severity_case": (q_severity_case, f"WITH {INCIDENTS} SELECT severity, count(*) AS n, sum(source_count)::BIGINT AS sources FROM i GROUP BY severity"),
    "incident_filter": (q_incident_filter, f"WITH {INCIDENTS} SELECT o_orderkey, kind, date, lat, lon FROM i WHERE severity = 'critical' AND confidence >= 0.3 AND source_count >= 2 AND contains(lower(text), 'high') AND date >= '1994-01-01' AND date <= '1999-12-31' AND (lat IS NULL OR lon IS NULL OR (lon BETWEEN -120 AND 120 AND lat BETWEEN -60 AND 60))"),
    "bbox_null_pass": (q_bbox_null_pass, f"WITH {INCIDENTS} SELECT o_orderkey, lat IS NULL AS unmapped FROM i WHERE lat IS NULL OR lon IS NULL OR (lon BETWEEN 0 AND 60 AND lat BETWEEN 0 AND 60)"),
    "page_slice": (q_page_slice, f"WITH {INCIDENTS}, h AS (SELECT * FROM i WHERE severity = 'high') SELECT o_orderkey, kind, (SELECT count(*) FROM h) AS total FROM h ORDER BY o_orderkey LIMIT 20 OFFSET 40"),
    "geojson_feature": (q_geojson_feature, f"WITH {INCIDENTS} SELECT o_orderkey, CASE WHEN lat IS NOT NULL THEN 'Feature' END AS type, lon, lat, CASE WHEN lat IS NOT NULL THEN severity END AS severity FROM i"),
    "evidence_semi_join": (q_evidence_semi_join, "SELECT p_partkey AS evidence_id, p_name, p_brand FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_orderkey = 7)"),
    "inverted_links": (q_inverted_links, "SELECT s_suppkey AS member, count(DISTINCT l_orderkey)::INT AS n, coalesce(min(l_orderkey), -1) AS first, coalesce(max(l_orderkey), -1) AS last FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY ALL"),
    "orphan_anti_join": (q_orphan_anti_join, "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 150000)"),
    "composite_top3": (q_composite_top3, f"WITH {INCIDENTS} SELECT o_orderkey, source_count + CASE WHEN severity = 'critical' THEN 2 ELSE 0 END + CASE WHEN lat IS NOT NULL THEN 2 ELSE 0 END AS score FROM i ORDER BY score DESC, o_orderkey LIMIT 3"),
    "distribution_stats": (q_distribution_stats, "SELECT o_orderstatus, count(*) AS n, round(avg(o_totalprice), 4) AS mean, round(stddev_pop(o_totalprice), 4) AS pstdev, round(min(o_totalprice), 4) AS least, round(max(o_totalprice), 4) AS most, round(quantile_cont(o_totalprice, 0.25), 4) AS q1, round(quantile_cont(o_totalprice, 0.5), 4) AS median, round(quantile_cont(o_totalprice, 0.75), 4) AS q3, round(quantile_cont(o_totalprice, 0.9), 4) AS p90 FROM orders GROUP BY o_orderstatus"),
    "gapped_histogram": (q_gapped_histogram, "SELECT count(*) FILTER (v BETWEEN 0 AND 0.49) AS low, count(*) FILTER (v BETWEEN 0.5 AND 0.69) AS possible, count(*) FILTER (v BETWEEN 0.7 AND 0.84) AS likely, count(*) FILTER (v BETWEEN 0.85 AND 1) AS strong, count(*) AS n FROM (SELECT (l_partkey % 1000) / 1000 AS v FROM lineitem)"),
    "field_modality_matrix": (q_field_modality_matrix, """WITH o AS (SELECT DISTINCT l_orderkey, p_type, l_returnflag FROM lineitem JOIN part ON l_partkey = p_partkey), m AS (SELECT p_type, count(*) FILTER (k > 1) AS multi_modal FROM (SELECT l_orderkey, p_type, count(*) AS k FROM o GROUP BY ALL) GROUP BY p_type)
        SELECT p_type, l_returnflag, count(*) AS records, multi_modal FROM o JOIN m USING (p_type) GROUP BY ALL"""),
    "completeness_gain": (q_completeness_gain, """WITH f AS (SELECT DISTINCT l_orderkey, l_suppkey, l_returnflag AS f FROM lineitem), s AS (SELECT l_orderkey, max(k) AS best, count(*) AS sources FROM (SELECT l_orderkey, l_suppkey, count(*) AS k FROM f GROUP BY ALL) GROUP BY l_orderkey), u AS (SELECT l_orderkey, count(DISTINCT f) AS fused FROM f GROUP BY l_orderkey)
        SELECT sources, count(*) AS n, sum(best)::BIGINT AS best, sum(fused)::BIGINT AS fused, count(*) FILTER (fused > best) AS gained FROM s JOIN u USING (l_orderkey) WHERE sources > 1 GROUP BY sources"""),
    "provenance_coverage": (q_provenance_coverage, "SELECT l_linestatus, count(*) AS facts, count(p_partkey) AS resolved, round(count(p_partkey) / count(*), 8) AS ratio FROM lineitem LEFT JOIN part ON l_partkey = p_partkey AND p_brand <> 'Brand#13' GROUP BY l_linestatus"),
    "haversine": (q_haversine, f"WITH {INCIDENTS}, a AS (SELECT o_orderkey, pow(sin(radians(23.8::DOUBLE - lat) / 2), 2) + cos(radians(lat)) * cos(radians(23.8::DOUBLE)) * pow(sin(radians(90.4::DOUBLE - lon) / 2), 2) AS a FROM i WHERE lat IS NOT NULL) SELECT o_orderkey, round(2 * 6371.0088::DOUBLE * atan2(sqrt(a), sqrt(1 - a)), 5) AS km FROM a"),
    "uncertainty_ring": (q_uncertainty_ring, f"""WITH {INCIDENTS}, r AS (SELECT *, CASE WHEN o_orderkey % 2 = 0 THEN 3.0::DOUBLE ELSE 12.0::DOUBLE END / 111.32::DOUBLE AS d FROM i WHERE lat IS NOT NULL), k AS (SELECT unnest(range(0, 65))::INT AS k),
        p AS (SELECT o_orderkey, lon + cos(k * 2 * pi() / 64) * (d / greatest(0.2::DOUBLE, cos(radians(lat)))) AS x, lat + sin(k * 2 * pi() / 64) * d AS y FROM r, k)
        SELECT o_orderkey, count(*)::INT AS points, round(min(x), 6) + 0.0::DOUBLE AS west, round(max(x), 6) + 0.0::DOUBLE AS east, round(min(y), 6) + 0.0::DOUBLE AS south, round(max(y), 6) + 0.0::DOUBLE AS north FROM p GROUP BY o_orderkey"""),
    "daily_spend": (q_daily_spend, "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS calls, round(sum(value), 4) AS cost FROM events WHERE event_type = 'purchase' GROUP BY ALL"),
    "bootstrap_ci": (q_bootstrap_ci, None),
}
