"""Queries over corpora: quotas, references, differences, selection by rank, leaks, coverage, submissions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import ranking, validation
from quern.plans.tables import TITLES, load, page_titles
from quern.streaming import submissions


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    """Pages as candidates: a key for some, a confidence from the id."""
    return page_titles(spark, sf).select("page_id", "lang", "host", "url", F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("key"), (F.col("page_id") % 8).cast("string"))).alias("key"), ((F.col("page_id") * 37) % 100 / 100).alias("confidence"))


PAGES = TITLES + ", c AS (SELECT page_id, lang, host, url, CASE WHEN page_id % 3 = 0 THEN 'key' || (page_id % 8) END AS key, (page_id * 37) % 100 / 100 AS confidence FROM titles)"


def q_quota_issues(spark: SparkSession, sf: str) -> DataFrame:
    return validation.below_quota(load(spark, sf, "nation"), "n_nationkey", load(spark, sf, "supplier").withColumnRenamed("s_nationkey", "n_nationkey"), 5, "source_quota")


def q_duplicate_ids(spark: SparkSession, sf: str) -> DataFrame:
    return validation.duplicate_keys(load(spark, sf, "pages").withColumn("bare", F.regexp_extract("url", r"^[a-z]+://[^/?#]*/[^/?#]*", 0)), "bare", "duplicate_url")


def q_manifest_difference(spark: SparkSession, sf: str) -> DataFrame:
    listed = load(spark, sf, "customer").where("c_acctbal > 0").select("c_custkey")
    found = load(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return validation.difference(listed, found, "c_custkey", ("listed_only", "found_only"))


def q_reference_issues(spark: SparkSession, sf: str) -> DataFrame:
    items, part, supplier = load(spark, sf, "lineitem"), load(spark, sf, "part").where("p_size <> 10"), load(spark, sf, "supplier").where("s_acctbal > 0")
    return validation.every(validation.missing_references(items, "l_partkey", part, "p_partkey", "unknown_part"), validation.missing_references(items, "l_suppkey", supplier, "s_suppkey", "unknown_supplier"))


def q_support_issues(spark: SparkSession, sf: str) -> DataFrame:
    facts = load(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("record_id")).agg(F.lit("parts").alias("field"), F.max("l_quantity").alias("value"), F.collect_set(F.when(F.col("l_returnflag") != "N", F.col("l_partkey"))).alias("support"))
    issues = validation.uncited_support(facts, load(spark, sf, "part").where("p_size <> 10").select(F.col("p_partkey").alias("evidence_id")))
    return issues.groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("subject").alias("subjects"))


def q_topk_per_group(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.top_per_group(load(spark, sf, "documents"), ["source"], [F.desc("n_chars"), F.col("doc_id")], 3).select("source", "doc_id", "n_chars", "rank")


def q_domain_cap(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.capped(_pages(spark, sf), ["lang"], "host", [F.desc("confidence"), F.col("page_id")], 2, 20, F.col("page_id") % 25 == 0).select("lang", "host", "page_id", "rank")


def q_priority_order(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.priority_order(_pages(spark, sf), ["lang"], "host", F.col("page_id") % 25 == 0, [F.desc("confidence"), F.col("page_id")]).select("lang", "page_id", "position")


def q_quota_selection(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.quota_selection(_pages(spark, sf), "lang", "key", "host", "confidence", "url", 10).select("lang", "url", "pair", "rank")


def q_leak_check(spark: SparkSession, sf: str) -> DataFrame:
    return validation.leaks_of(load(spark, sf, "documents"), "doc_id", "text", load(spark, sf, "benchmark"), "item_id", "text")


def q_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Counts of suppliers and customers joined into every nation."""
    n = load(spark, sf, "nation")
    s = load(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("suppliers"))
    c = load(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("customers"))
    out = n.join(s, "n_nationkey", "left").join(c, "n_nationkey", "left").fillna(0, ["suppliers", "customers"])
    return out.select("n_nationkey", "n_name", "suppliers", "customers", (F.col("suppliers") >= 5).alias("target_met"), F.greatest(F.lit(0), 5 - F.col("suppliers")).cast("long").alias("deficit"))


def q_country_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates, hosts, keyed pairs and outcomes of each language."""
    return _pages(spark, sf).groupBy("lang").agg(F.count(F.lit(1)).alias("candidates"), F.count_distinct("host").alias("hosts"), F.count_distinct("key").alias("keys"), F.count_if(F.col("confidence") >= 0.85).alias("strong"))


def q_submission_state(spark: SparkSession, sf: str) -> DataFrame:
    return submissions.run_available(spark, sf)


_RANK = "row_number() OVER (PARTITION BY {} ORDER BY confidence DESC, page_id)"
_EVENTS = """WITH RECURSIVE e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, CASE event_type WHEN 'signup' THEN 'submit' WHEN 'view' THEN 'review' WHEN 'purchase' THEN 'approve' WHEN 'click' THEN 'reject' ELSE 'fail' END AS a FROM events),
s AS (SELECT user_id, 0::BIGINT AS k, 'none' AS status, 0::BIGINT AS applied, 0::BIGINT AS refused FROM (SELECT DISTINCT user_id FROM events)
  UNION ALL SELECT s.user_id, e.k, CASE WHEN ok THEN t ELSE status END, applied + ok::INT, refused + (NOT ok)::INT FROM (SELECT s.*, e.a, CASE
    WHEN a = 'submit' AND status IN ('none', 'rejected') THEN 'pending' WHEN a = 'review' AND status IN ('pending', 'ingest_failed') THEN 'processing' WHEN a = 'approve' AND status = 'processing' THEN 'approved' WHEN a = 'reject' AND status IN ('pending', 'ingest_failed') THEN 'rejected' WHEN a = 'fail' AND status = 'processing' THEN 'ingest_failed' END AS t,
    t IS NOT NULL AS ok, e.k AS ek FROM s JOIN e ON e.user_id = s.user_id AND e.k = s.k + 1) s JOIN e ON e.user_id = s.user_id AND e.k = s.ek)
SELECT user_id AS submission_id, status, applied, refused FROM s QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY k DESC) = 1"""
QUERIES = {
    "quota_issues": (q_quota_issues, "SELECT 'source_quota' AS code, n_nationkey::VARCHAR AS subject, count(s_suppkey)::VARCHAR AS detail FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_nationkey HAVING count(s_suppkey) < 5"),
    "duplicate_ids": (q_duplicate_ids, "SELECT 'duplicate_url' AS code, regexp_extract(url, '^[a-z]+://[^/?#]*/[^/?#]*') AS subject, count(*)::VARCHAR AS detail FROM pages GROUP BY 2 HAVING count(*) > 1"),
    "manifest_difference": (q_manifest_difference, "SELECT 'listed_only' AS code, c_custkey::VARCHAR AS subject, NULL::VARCHAR AS detail FROM customer WHERE c_acctbal > 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT DISTINCT 'found_only', o_custkey::VARCHAR, NULL FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)"),
    "reference_issues": (q_reference_issues, "SELECT DISTINCT 'unknown_part' AS code, l_partkey::VARCHAR AS subject, NULL::VARCHAR AS detail FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <> 10) UNION ALL SELECT DISTINCT 'unknown_supplier', l_suppkey::VARCHAR, NULL FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)"),
    "support_issues": (q_support_issues, """WITH f AS (SELECT * FROM lineitem), u AS (SELECT DISTINCT l_orderkey, l_partkey FROM f WHERE l_returnflag <> 'N' AND l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <> 10)), b AS (SELECT l_orderkey FROM f GROUP BY l_orderkey HAVING count(*) FILTER (l_returnflag <> 'N') = 0)
        SELECT 'unknown_evidence' AS code, count(*) AS n, count(DISTINCT l_orderkey) AS subjects FROM u HAVING count(*) > 0 UNION ALL SELECT 'value_without_support', count(*), count(DISTINCT l_orderkey) FROM b HAVING count(*) > 0"""),
    "topk_per_group": (q_topk_per_group, "SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id)::INT AS rank FROM documents QUALIFY rank <= 3"),
    "domain_cap": (q_domain_cap, f"WITH {PAGES}, k AS (SELECT * FROM c QUALIFY {_RANK.format('lang, host')} <= 2 OR page_id % 25 = 0) SELECT lang, host, page_id, ({_RANK.format('lang')})::INT AS rank FROM k QUALIFY rank <= 20"),
    "priority_order": (q_priority_order, f"WITH {PAGES}, k AS (SELECT *, {_RANK.format('lang, host')} = 1 AS f FROM c) SELECT lang, page_id, (row_number() OVER (PARTITION BY lang ORDER BY CASE WHEN page_id % 25 = 0 THEN 0 WHEN f THEN 1 ELSE 2 END, confidence DESC, page_id))::INT AS position FROM k"),
    "quota_selection": (q_quota_selection, f"""WITH {PAGES}, o AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY lang, url ORDER BY key IS NULL, confidence DESC, host, url) = 1),
        b AS (SELECT lang, key, max(confidence) AS mc FROM o WHERE key IS NOT NULL GROUP BY ALL HAVING count(DISTINCT host) >= 2), b1 AS (SELECT lang, key FROM b QUALIFY row_number() OVER (PARTITION BY lang ORDER BY mc DESC, key) = 1),
        d AS (SELECT o.* FROM o JOIN b1 USING (lang, key) QUALIFY row_number() OVER (PARTITION BY lang, host ORDER BY confidence DESC, url) = 1), p AS (SELECT lang, url FROM d QUALIFY row_number() OVER (PARTITION BY lang ORDER BY confidence DESC, host, url) <= 2)
        SELECT o.lang, o.url, p.url IS NOT NULL AS pair, (row_number() OVER (PARTITION BY o.lang ORDER BY p.url IS NOT NULL DESC, key IS NULL, confidence DESC, host, o.url))::INT AS rank FROM o LEFT JOIN p ON p.lang = o.lang AND p.url = o.url QUALIFY rank <= 10"""),
    "leak_check": (q_leak_check, r"WITH d AS (SELECT doc_id, ' ' || trim(regexp_replace(lower(text), '[ \t\n\r\f\x0B]+', ' ', 'g')) || ' ' AS t FROM documents), b AS (SELECT item_id, ' ' || trim(regexp_replace(lower(text), '[ \t\n\r\f\x0B]+', ' ', 'g')) || ' ' AS p FROM benchmark) SELECT doc_id, item_id FROM d JOIN b ON contains(t, p)"),
    "coverage": (q_coverage, "WITH s AS (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1), c AS (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1) SELECT n_nationkey, n_name, coalesce(s.n, 0) AS suppliers, coalesce(c.n, 0) AS customers, coalesce(s.n, 0) >= 5 AS target_met, greatest(0, 5 - coalesce(s.n, 0)) AS deficit FROM nation LEFT JOIN s ON s.k = n_nationkey LEFT JOIN c ON c.k = n_nationkey"),
    "country_summary": (q_country_summary, f"WITH {PAGES} SELECT lang, count(*) AS candidates, count(DISTINCT host) AS hosts, count(DISTINCT key) AS keys, count(*) FILTER (confidence >= 0.85) AS strong FROM c GROUP BY lang"),
    "submission_state": (q_submission_state, _EVENTS),
}
