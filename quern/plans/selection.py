"""Queries over scalars, predicates, selections, measures and repairs that need no files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import rules, text, urls
from quern.operators import evaluation, fusing, metrics, querying, ranking, validation
from quern.plans import corpus_build
from quern.plans.fusion import _MEMBERS, _records
from quern.plans.matching import _scored
from quern.plans.records import INCIDENTS, _incidents
from quern.plans.tables import MENTIONS, TITLES, load, mentions, page_titles
from quern.sources import feeds, sinks
from quern.streaming import uploads

_KINDS = "CASE o_orderkey % 8 WHEN 0 THEN 'Direct view' WHEN 1 THEN 'alleged claim' WHEN 2 THEN 'police CLAIM' WHEN 3 THEN 'public sentiment' WHEN 4 THEN 'inferred' WHEN 5 THEN 'possible jam' WHEN 6 THEN 'report' END"


def q_assertion_enum(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "orders").select("o_orderkey", rules.assertion(F.expr(_KINDS)).alias("assertion"))


_HOSTS = "CASE c_custkey % 9 WHEN 0 THEN '10.0.0.{k}' WHEN 1 THEN '8.8.8.{k}' WHEN 2 THEN 'localhost' WHEN 3 THEN 'a.local' WHEN 4 THEN 'news{k}.example' WHEN 5 THEN '192.168.1.{k}' WHEN 6 THEN '127.0.0.1' WHEN 7 THEN '172.16.0.{k}' ELSE '93.184.216.{k}' END"


def q_public_hosts(spark: SparkSession, sf: str) -> DataFrame:
    host = _HOSTS.replace("'10.0.0.{k}'", "concat('10.0.0.', c_custkey % 200)").replace("'8.8.8.{k}'", "concat('8.8.8.', c_custkey % 200)").replace("'news{k}.example'", "concat('news', c_custkey, '.example')").replace("'192.168.1.{k}'", "concat('192.168.1.', c_custkey % 200)").replace("'172.16.0.{k}'", "concat('172.16.0.', c_custkey % 200)").replace("'93.184.216.{k}'", "concat('93.184.216.', c_custkey % 200)")
    return load(spark, sf, "customer").selectExpr("c_custkey", f"{host} AS host").select("c_custkey", urls.public_host("host").alias("public"))


_PATHS = "CASE p_partkey % 7 WHEN 0 THEN 'a/b.html' WHEN 1 THEN '/abs' WHEN 2 THEN 'a/../b' WHEN 3 THEN './a' WHEN 4 THEN '' WHEN 5 THEN 'a//b' ELSE 'deep/er/x.json' END"
_ADDRESSES = "CASE p_partkey % 6 WHEN 0 THEN 'https://a.example/x' WHEN 1 THEN 'ftp://a.example' WHEN 2 THEN 'http://u:p@a.example/' WHEN 3 THEN 'HTTP://B.example:80?q' WHEN 4 THEN 'https:///x' ELSE 'a.example/x' END"
_CODES = "CASE p_partkey % 4 WHEN 0 THEN 'BGD' WHEN 1 THEN 'bgd' WHEN 2 THEN 'ZZZ' ELSE 'US' END"


def q_domain_predicates(spark: SparkSession, sf: str) -> DataFrame:
    p = load(spark, sf, "part").selectExpr("p_partkey", f"{_PATHS} AS path", f"{_ADDRESSES} AS url", f"{_CODES} AS code")
    return p.select("p_partkey", urls.safe_relative_path("path").alias("safe"), urls.web_url("url").alias("web"), urls.country_code("code", ["BGD", "USA"]).alias("iso3"))


def q_access_outcome(spark: SparkSession, sf: str) -> DataFrame:
    e = load(spark, sf, "events").selectExpr("element_at(array(200, 301, 403, 404, 410, 429, 451, 500, 418, 302, cast(null AS int)), cast(event_id % 11 + 1 AS int)) AS status")
    return e.groupBy(urls.access_class("status").alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def q_relevance_terms(spark: SparkSession, sf: str) -> DataFrame:
    d = load(spark, sf, "documents")
    return d.select("doc_id", text.matches_terms("text", ["Große", "que", "THE and"], ["!! ", "***"]).alias("relevant"))


def q_accepted_cap(spark: SparkSession, sf: str) -> DataFrame:
    p = page_titles(spark, sf)
    out = ranking.accepted(p, "lang", "host", F.lower("title"), F.col("page_id") % 4 != 0, [F.col("page_id")], 3, 20)
    return out.select("page_id", "lang", "host", "position")


def q_normalized_text(spark: SparkSession, sf: str) -> DataFrame:
    d = load(spark, sf, "documents")
    return d.select("doc_id", F.sha2(text.normalized(F.concat("text", F.lit("​ ͏ x y "))), 256).alias("h"), F.sha2(text.ascii_digits(F.concat("text", F.lit(" ১২৩"))), 256).alias("digits"))


def q_claim_date(spark: SparkSession, sf: str) -> DataFrame:
    from quern.functions.dates import told_in_text

    o = load(spark, sf, "orders").selectExpr("o_orderkey", "CASE o_orderkey % 3 WHEN 0 THEN concat('On ', date_format(add_months(o_orderdate, 120), 'd MMMM yyyy'), ' a bus') WHEN 1 THEN concat('seen ', upper(date_format(add_months(o_orderdate, 120), 'd MMMM yyyy'))) ELSE 'no date' END AS t")
    return o.select("o_orderkey", F.date_format(told_in_text(F.col("t")), "yyyy-MM-dd").alias("day"))


def q_field_alias(spark: SparkSession, sf: str) -> DataFrame:
    e = load(spark, sf, "events").selectExpr("event_id", "element_at(array(' Death_Count', 'injured_count', 'fatality_count ', 'vehicles', 'INJURIES_COUNT'), cast(event_id % 5 + 1 AS int)) AS field", "element_at(array('High', 'low', '0.4', '7', 'none', '-1'), cast(event_id % 6 + 1 AS int)) AS said")
    return e.select("event_id", rules.canonical_field(F.col("field")).alias("field"), rules.clamped_confidence(F.col("said")).alias("confidence"))


def q_half_coordinates(spark: SparkSession, sf: str) -> DataFrame:
    i = _incidents(spark, sf).selectExpr("severity", "if(o_orderkey % 13 = 0, null, lat) AS lat", "if(o_orderkey % 17 = 0, null, lon) AS lon")
    return i.groupBy("severity").agg(F.count_if(rules.half_coordinates(F.col("lat"), F.col("lon"))).alias("halves"), F.count_if(F.col("lat").isNotNull() & F.col("lon").isNotNull()).alias("pairs"))


def q_estimated_cost(spark: SparkSession, sf: str) -> DataFrame:
    li = load(spark, sf, "lineitem").selectExpr("l_orderkey", "l_linenumber", "cast(l_partkey AS long) AS i", "cast(l_suppkey AS long) * 10 AS o")
    return li.select("l_orderkey", "l_linenumber", rules.estimated_cost(F.col("i"), F.col("o"), 0.27, 1.1).alias("cost"))


def q_smoke_sample(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.smoke_sample(load(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_custkey", "o_orderkey")


def q_resolved_gold(spark: SparkSession, sf: str) -> DataFrame:
    """Gold members by path and required terms against mentions: the one that holds all terms, or the issue."""
    c = load(spark, sf, "customer")
    gold = c.where("c_custkey % 3 <> 0").selectExpr("c_custkey AS gold_id", "concat('p', c_custkey % 40) AS path", "array(c_mktsegment, concat('n', c_nationkey)) AS terms")
    m = c.selectExpr("c_custkey AS mention_id", "concat('p', c_custkey % 40) AS path", "concat(lower(c_mktsegment), ' at n', c_nationkey) AS place")
    found, issues = evaluation.resolved_gold(gold, m)
    return found.select("gold_id", "path", F.lit("found").alias("what"), "mention_id").unionByName(issues.select("gold_id", "path", F.col("issue").alias("what"), F.lit(-1).cast("long").alias("mention_id")))


def q_layered_union(spark: SparkSession, sf: str) -> DataFrame:
    o = load(spark, sf, "orders")
    layer = lambda k: o.where(F.col("o_orderkey") % k == 0).select(F.col("o_orderkey").alias("path"), F.lit(k).alias("layer"), "o_totalprice")
    return uploads.layered(layer(1), layer(2), layer(3), key="path")


def q_direct_url(spark: SparkSession, sf: str) -> DataFrame:
    links = load(spark, sf, "pages").selectExpr("page_id", "CASE WHEN page_id % 2 = 0 THEN concat('https://feed.example/go?x=1&url=', url_encode(url), '&k=2') ELSE url END AS link")
    return links.select("page_id", urls.direct_url("link").alias("url"))


def q_page_publisher(spark: SparkSession, sf: str) -> DataFrame:
    t = page_titles(spark, sf).withColumn("publisher", F.concat(F.lit("The "), "host"))
    suffix = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit(" - the "), F.upper("host"))).when(F.col("page_id") % 3 == 1, F.lit(" - Other")).otherwise("")
    return t.select("page_id", text.strip_publisher(F.concat("title", suffix), "publisher").alias("title"))


def q_newest_submissions(spark: SparkSession, sf: str) -> DataFrame:
    e = load(spark, sf, "events").select("event_id", F.col("event_type").alias("status"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("submitted_at"))
    return querying.page(querying.newest(e, "signup"), F.desc("submitted_at"), 1, 50).select("event_id", "submitted_at")


def q_conflict_examples(spark: SparkSession, sf: str) -> DataFrame:
    """The first five records with contradicted facts."""
    facts = _records(spark, sf).select("incident_id", F.explode("facts").alias("f")).where("f.contradiction")
    return facts.orderBy("incident_id", "f.field").limit(5).select("incident_id", F.col("f.field").alias("field"), F.col("f.value").alias("value"))


def q_conflict_preservation(spark: SparkSession, sf: str) -> DataFrame:
    """Conflicts of fused facts, times and places, and the share that keeps its alternatives."""
    r = _records(spark, sf)
    facts = r.select(F.explode("facts").alias("f")).where("f.contradiction").select(F.lit("fact").alias("kind"), F.col("f.field").alias("field"), (F.size("f.alternatives") > 0).alias("kept"))
    times = r.where(F.size("other_times") > 0).select(F.lit("time").alias("kind"), F.lit("event_time").alias("field"), F.lit(True).alias("kept"))
    places = r.where(F.size("other_places") > 0).select(F.lit("place").alias("kind"), F.lit("location").alias("field"), F.lit(True).alias("kept"))
    return facts.unionByName(times).unionByName(places).groupBy("kind", "field").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("kept").cast("int")).alias("preserved"))


def q_geolocation_detail(spark: SparkSession, sf: str) -> DataFrame:
    r = _records(spark, sf)
    out = metrics.distribution(r, "confidence", ["granularity", "method"]).join(r.groupBy("granularity", "method").agg(F.count("lat").alias("mapped"), F.avg("radius_km").alias("radius")), ["granularity", "method"])
    return out.select("granularity", "method", "n", "mapped", F.coalesce("radius", F.lit(-1.0)).alias("radius"), *(F.round(c, 6).alias(c) for c in ("mean", "least", "median", "most")))


def q_corpus_composition(spark: SparkSession, sf: str) -> DataFrame:
    """Long rows of what a corpus holds: distinct values, types, map state, sources of a record."""
    r, t = _records(spark, sf), page_titles(spark, sf)
    distinct = t.agg(F.count_distinct("lang").alias("languages"), F.count_distinct("host").alias("domains"), F.count(F.lit(1)).alias("sources"))
    state = r.agg(F.count("lat").alias("mapped"), F.count_if(F.col("method") == "collection_country_fallback").alias("fallback"), F.count_if(F.size("source_ids") > 1).alias("multi_source"), F.max("source_count").alias("most_sources"))
    wide = distinct.join(F.broadcast(state))  # one row each
    return wide.select(F.explode(F.create_map(*(x for c in wide.columns for x in (F.lit(c), F.col(c).cast("long"))))).alias("name", "value"))


def q_cluster_quality(spark: SparkSession, sf: str) -> DataFrame:
    o = load(spark, sf, "orders").selectExpr("o_custkey AS gold", "concat(o_custkey, o_orderstatus) AS found")
    return metrics.cluster_quality(o, "gold", "found").select(*(F.round(c, 8).alias(c) for c in ("precision", "recall", "f1")), "fragmented", "over_merged", "singletons")


def q_gold_location(spark: SparkSession, sf: str) -> DataFrame:
    """Place agreement by required terms, coordinate error, and categories of error."""
    i = _incidents(spark, sf).withColumns({"terms": F.array(F.lower(F.substring("kind", 3, 4))), "place": F.when(F.col("lat").isNotNull(), F.col("kind")), "glat": F.lit(10.0), "glon": F.lit(20.0)})
    rows = evaluation.place_comparison(i, "terms", "place", ("glat", "glon"), ("lat", "lon"))
    return rows.groupBy("severity", "error").agg(F.count(F.lit(1)).alias("n"), F.count_if("agrees").alias("agree"), F.round(F.coalesce(F.avg("km"), F.lit(-1.0)), 4).alias("km"))


def q_evaluation_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """Measures of the engine on the tables as one long table, with the rules they break."""
    r, t = _records(spark, sf), page_titles(spark, sf)
    share = lambda d, c: d.agg(F.avg(c.cast("int")).alias("value"), F.count(F.lit(1)).alias("n"))
    number = lambda d: d.agg(F.count(F.lit(1)).alias("value"), F.count(F.lit(1)).alias("n"))
    facts = r.select("incident_id", F.explode("facts").alias("f"))
    labelled = load(spark, sf, "labels")
    rows = metrics.manifest({
        "corpus_sources": (number(t), "source records", "descriptive"), "corpus_languages": (t.agg(F.count_distinct("lang").alias("value"), F.count(F.lit(1)).alias("n")), "language tags", "descriptive"),
        "corpus_publishers": (t.agg(F.count_distinct("host").alias("value"), F.count(F.lit(1)).alias("n")), "publishers", "descriptive"), "corpus_incidents": (number(r), "incidents", "descriptive"),
        "multi_source_incidents": (r.agg(F.count_if(F.size("source_ids") > 1).alias("value"), F.count(F.lit(1)).alias("n")), "incident records", "descriptive"),
        "geolocation_coverage": (share(r, F.col("is_incident_location")), "proportion", "descriptive"), "map_marker_coverage": (share(r, F.col("lat").isNotNull()), "proportion", "descriptive"),
        "provenance_coverage": (share(facts.where("f.value IS NOT NULL"), F.size("f.support") > 0), "proportion", "structural"), "conflict_incident_rate": (share(r, F.exists("facts", lambda f: f["contradiction"])), "proportion", "structural"),
        "unknown_zero_violations": (facts.agg(F.count_if((F.col("f.value") == 0) != (F.col("f.state") == "reported_zero")).alias("value"), F.count(F.lit(1)).alias("n")), "violations", "structural"),
        "median_uncertainty_radius_km": (r.where("is_incident_location").agg(F.percentile("radius_km", F.lit(0.5)).alias("value"), F.count("radius_km").alias("n")), "km", "descriptive"),
        "gold_quality_share": (share(labelled, F.col("quality") == 1), "proportion", "gold_accuracy"), "labelled_accuracy": (labelled.agg(F.sum("quality").alias("value"), F.count(F.lit(1)).alias("n")), "proportion", "descriptive"),
    })
    broken = metrics.manifest_issues(rows).groupBy("name").agg(F.array_join(F.sort_array(F.collect_list("issue")), ",").alias("issues"))
    return rows.join(broken, "name", "left").select("name", F.round("value", 8).alias("value"), "n", "unit", "kind", F.coalesce("issues", F.lit("")).alias("issues"))


def q_candidate_issues(spark: SparkSession, sf: str) -> DataFrame:
    p = page_titles(spark, sf).selectExpr("CASE WHEN page_id % 5 = 0 THEN concat(url, '#x') ELSE concat('https://', host, '/p', page_id) END AS canonical_url", "CASE WHEN page_id % 7 = 0 THEN 'else.example' ELSE host END AS domain", "if(page_id % 4 = 0, array(lang, lang), array(lang)) AS languages", "if(page_id % 3 = 0, 'k', null) AS incident_key", "if(page_id % 6 = 0, 0.5D, null) AS pair_confidence")
    return corpus_build.candidate_issues(p).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


def q_coverage_features(spark: SparkSession, sf: str) -> DataFrame:
    n = load(spark, sf, "nation")
    profiles = n.selectExpr("n_name AS iso2", "initcap(n_name) AS name", "n_nationkey + 0.5D AS lat", "-n_nationkey - 0.5D AS lon")
    counts = load(spark, sf, "supplier").where("s_nationkey % 4 <> 0").join(n, F.col("s_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("iso2")).agg(F.count(F.lit(1)).alias("sources"))
    return evaluation.coverage_features(profiles, counts)


def q_summary_text(spark: SparkSession, sf: str) -> DataFrame:
    return _records(spark, sf).select("incident_id", "summary")


def q_social_posts(spark: SparkSession, sf: str) -> DataFrame:
    """Turns as posts: those that tell of a crash in a nation, at most three of each."""
    t = load(spark, sf, "conversations").selectExpr(
        "concat('at://did/app/feed/post/', conv_id, '-', turn) AS uri", "if(conv_id % 11 = 0, 'x', concat('did:', conv_id)) AS author_did", "role AS handle", "conv_id * 100 + turn AS ord", "if(turn % 2 = 0, 'https://l.example/x', 'no') AS link",
        "concat(CASE turn % 3 WHEN 0 THEN 'Bus crash in ' WHEN 1 THEN 'Accident: truck and CAR in ' ELSE 'A walk in ' END, element_at(array('France', 'Germany', 'South Korea', 'korea'), cast(conv_id % 4 + 1 AS int)), if(conv_id % 5 = 0, ' video game', ''), ', two killed https://t.example/', conv_id, ' ', left(text, 20)) AS text")
    countries = spark.createDataFrame([("FR", "France"), ("DE", "germany"), ("KR", "South Korea")], "iso2 string, alias string")
    return feeds.social_posts(t, countries).select("iso2", "post_url", "handle", F.coalesce("external_link", F.lit("")).alias("external_link"))


def q_reconcile(spark: SparkSession, sf: str) -> DataFrame:
    """Records of a model held to their mentions' places."""
    o = load(spark, sf, "orders").selectExpr("o_orderkey AS id", "CASE WHEN o_orderkey % 5 = 0 THEN 'near brand brass market' ELSE 'standard place' END AS place", "if(o_orderkey % 3 = 0, null, 1.0D) AS lat", "if(o_orderkey % 3 = 0, null, 2.0D) AS lon", "0.7D AS confidence")
    c = load(spark, sf, "lineitem").join(load(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).selectExpr("l_orderkey AS id", "p_type AS name", "if(l_partkey % 4 = 0, 'country', 'city') AS granularity", "if(l_partkey % 3 = 0, null, cast(l_partkey AS double)) AS lat", "if(l_partkey % 3 = 0, null, cast(l_partkey + 1 AS double)) AS lon", "l_quantity / 100 AS confidence")
    return fusing.reconciled(o, c, "id").select("id", "place", F.coalesce("lat", F.lit(-1.0)).alias("lat"), "granularity", F.round("confidence", 6).alias("confidence"), "method")


def q_unanimous_facts(spark: SparkSession, sf: str) -> DataFrame:
    told = load(spark, sf, "lineitem").selectExpr("l_orderkey AS id", "if(l_linenumber % 2 = 0, 'fatalities', 'injuries') AS field", "cast(l_quantity AS int) % 3 AS value")
    known = load(spark, sf, "orders").where("o_orderkey % 4 = 0").selectExpr("o_orderkey AS id", "'fatalities' AS field")
    return fusing.unanimous_facts(told, known, "id")


def q_compiled_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates of a language with the key of its pair: the overridden one, else the one with most title terms shared."""
    m = mentions(spark, sf).select(F.col("mention_id").alias("candidate_id"), F.col("country").alias("grp"), F.col("source_id").alias("domain"), "title", F.col("event_time").alias("published"), "terms")
    override = spark.createDataFrame([("de", 1, 2)], "grp string, l_id long, r_id long")
    return corpus_build.compiled(m, override).select("candidate_id", "grp", "incident_key", F.round("pair_confidence", 3).alias("pair_confidence"))


def q_incident_markdown(spark: SparkSession, sf: str) -> DataFrame:
    return sinks.incident_markdown(_records(spark, sf)).select("incident_id", "markdown")


def q_markdown_table(spark: SparkSession, sf: str) -> DataFrame:
    return sinks.markdown_table(load(spark, sf, "nation").selectExpr("n_nationkey", "concat(n_name, if(n_nationkey % 3 = 0, '|x', '')) AS name", "nullif(n_regionkey, 2) AS region"), "n_nationkey")


def q_issue_report(spark: SparkSession, sf: str) -> DataFrame:
    c = load(spark, sf, "customer")
    found = validation.every(validation.issue(c.where("c_acctbal < 0"), "negative_balance", "c_name"), validation.issue(c.where("c_nationkey % 5 = 0"), "fifth_nation", "c_custkey", "c_name"))
    return sinks.issue_report(found).unionByName(sinks.issue_report(found.where("code = 'none'")))


def q_ablation(spark: SparkSession, sf: str) -> DataFrame:
    """All gold pairs of orders' customers against decisions: a missing decision is a negative one; and a fixed threshold of 0.72."""
    pairs = _scored(spark, sf).select("l_id", "r_id", "total_score", F.when(F.col("hard_guard").isNull() & (F.col("total_score") >= 0.62), "same_incident").otherwise("uncertain").alias("decision"))
    members = mentions(spark, sf).select("mention_id", F.concat_ws("|", "country", F.element_at(F.concat("terms", F.array(F.lit(""))), 1)).alias("gold"))
    return metrics.ablation(metrics.gold_pairs(members, pairs, "mention_id", "gold"), 0.72).select("method", "tp", "fp", "fn", *(F.round(F.coalesce(c, F.lit(-1.0)), 8).alias(c) for c in ("precision", "recall", "f1")))


def q_corpus_built(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates to sources, incidents of two sources and domains, and issues."""
    c = load(spark, sf, "customer").join(load(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).selectExpr(
        "n_name AS country_iso2", "concat('https://d', c_custkey % 9, '.example/', c_custkey) AS canonical_url", "c_name AS title", "c_mktsegment AS excerpt", "concat('d', c_custkey % 9, '.example') AS domain", "array('en') AS languages",
        "if(c_custkey % 4 = 0, 'blocked', 'captured') AS access_status", "if(c_custkey % 3 = 0, concat('key', c_custkey % 2), null) AS incident_key", "if(c_custkey % 3 = 0, (c_custkey % 50) / 100D, null) AS pair_confidence")
    built = corpus_build.build(c, load(spark, sf, "nation").selectExpr("n_name AS iso2"), 10)
    told = built.sources.groupBy("country_iso2").agg(F.count(F.lit(1)).alias("sources"), F.count_if("pair").alias("pairs"), F.count_distinct(F.when(F.col("pair"), F.col("domain"))).alias("pair_domains"))
    ids = built.incidents.select("country_iso2", "incident_key", F.size("source_ids").alias("incident_sources"))
    short = built.issues.where("code = 'source_quota'").select(F.col("subject").alias("country_iso2"), F.col("detail").cast("long").alias("short"))
    return told.join(ids, "country_iso2", "left").join(short, "country_iso2", "left").select("country_iso2", "sources", "pairs", "pair_domains", F.coalesce("incident_key", F.lit("")).alias("incident_key"), F.coalesce("incident_sources", F.lit(0)).alias("incident_sources"), F.coalesce("short", F.lit(-1)).alias("short"))


_HOST_SQL = "c_custkey % 9 IN (1, 4, 8)"
QUERIES = {
    "assertion_enum": (q_assertion_enum, "SELECT o_orderkey, CASE o_orderkey % 8 WHEN 0 THEN 'observed' WHEN 1 THEN 'attributed_claim' WHEN 2 THEN 'attributed_claim' WHEN 3 THEN 'opinion' WHEN 4 THEN 'inferred' WHEN 5 THEN 'predicted' ELSE 'reported' END AS assertion FROM orders"),
    "public_hosts": (q_public_hosts, f"SELECT c_custkey, {_HOST_SQL} AS public FROM customer"),
    "domain_predicates": (q_domain_predicates, "SELECT p_partkey, p_partkey % 7 IN (0, 6) AS safe, p_partkey % 6 IN (0, 3) AS web, p_partkey % 4 = 0 AS iso3 FROM part"),
    "access_outcome": (q_access_outcome, "SELECT CASE event_id % 11 WHEN 0 THEN 'accessible' WHEN 1 THEN 'accessible' WHEN 9 THEN 'accessible' WHEN 2 THEN 'blocked' WHEN 5 THEN 'blocked' WHEN 6 THEN 'blocked' WHEN 8 THEN 'blocked' WHEN 3 THEN 'unavailable' WHEN 4 THEN 'unavailable' WHEN 10 THEN 'request_error' ELSE 'http_error' END AS outcome, count(*) AS n FROM events GROUP BY 1"),
    "relevance_terms": (q_relevance_terms, "WITH d AS (SELECT doc_id, strip_accents(replace(lower(text), 'ß', 'ss')) AS t FROM documents) SELECT doc_id, (contains(t, 'grosse') OR contains(t, 'que') OR contains(t, 'the and')) AND NOT contains(t, '!! ') AND NOT contains(t, '***') AS relevant FROM d"),
    "accepted_cap": (q_accepted_cap, f"WITH {TITLES}, o AS (SELECT * FROM titles WHERE page_id % 4 <> 0 QUALIFY row_number() OVER (PARTITION BY lang, lower(title) ORDER BY page_id) = 1), d AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY lang, host ORDER BY page_id) <= 3) SELECT page_id, lang, host, row_number() OVER (PARTITION BY lang ORDER BY page_id)::INT AS position FROM d QUALIFY position <= 20"),
    "normalized_text": (q_normalized_text, r"SELECT doc_id, sha256(trim(regexp_replace(text || '  x y ', '\s+', ' ', 'g'))) AS h, sha256(text || ' 123') AS digits FROM documents"),
    "claim_date": (q_claim_date, "SELECT o_orderkey, CASE WHEN o_orderkey % 3 < 2 THEN strftime(o_orderdate + INTERVAL 120 MONTH, '%Y-%m-%d') END AS day FROM orders"),
    "field_alias": (q_field_alias, "SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'fatalities' WHEN 1 THEN 'injuries' WHEN 2 THEN 'fatalities' WHEN 3 THEN 'vehicles' ELSE 'injuries' END AS field, CASE event_id % 6 WHEN 0 THEN 0.9::DOUBLE WHEN 1 THEN 0.35::DOUBLE WHEN 2 THEN 0.4::DOUBLE WHEN 3 THEN 1.0::DOUBLE WHEN 4 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS confidence FROM events"),
    "half_coordinates": (q_half_coordinates, f"WITH {INCIDENTS}, j AS (SELECT severity, CASE WHEN o_orderkey % 13 <> 0 THEN lat END AS lat, CASE WHEN o_orderkey % 17 <> 0 THEN lon END AS lon FROM i) SELECT severity, count(*) FILTER ((lat IS NULL) <> (lon IS NULL)) AS halves, count(*) FILTER (lat IS NOT NULL AND lon IS NOT NULL) AS pairs FROM j GROUP BY severity"),
    "estimated_cost": (q_estimated_cost, "SELECT l_orderkey, l_linenumber, round((l_partkey * 0.27::DOUBLE + l_suppkey * 10 * 1.1::DOUBLE) / 1000000, 8) AS cost FROM lineitem"),
    "smoke_sample": (q_smoke_sample, "WITH f AS (SELECT o_custkey, min(o_orderkey) AS o FROM orders GROUP BY o_custkey HAVING count(*) >= 2 ORDER BY o LIMIT 1) SELECT o_custkey, o_orderkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM f) ORDER BY o_orderkey LIMIT 2"),
    "resolved_gold": (q_resolved_gold, """WITH g AS (SELECT c_custkey AS gold_id, 'p' || (c_custkey % 40) AS path, lower(c_mktsegment) AS a, 'n' || c_nationkey AS b FROM customer WHERE c_custkey % 3 <> 0), m AS (SELECT c_custkey AS id, 'p' || (c_custkey % 40) AS path, lower(c_mktsegment) || ' at n' || c_nationkey AS place FROM customer),
        f AS (SELECT gold_id, g.path, count(*) FILTER (contains(place, a) AND contains(place, b)) AS n, max(id) FILTER (contains(place, a) AND contains(place, b)) AS id FROM g JOIN m ON g.path = m.path GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY gold_id, path) AS r FROM f WHERE n = 1)
        SELECT gold_id, path, CASE WHEN r = 1 THEN 'found' ELSE 'claimed_twice' END AS what, CASE WHEN r = 1 THEN id ELSE -1 END AS mention_id FROM o UNION ALL SELECT gold_id, path, CASE WHEN n = 0 THEN 'missing' ELSE 'ambiguous' END, -1 FROM f WHERE n <> 1"""),
    "layered_union": (q_layered_union, "SELECT o_orderkey AS path, CASE WHEN o_orderkey % 3 = 0 THEN 3 WHEN o_orderkey % 2 = 0 THEN 2 ELSE 1 END::INT AS layer, o_totalprice FROM orders"),
    "direct_url": (q_direct_url, "SELECT page_id, url FROM pages"),
    "page_publisher": (q_page_publisher, f"WITH {TITLES} SELECT page_id, CASE page_id % 3 WHEN 0 THEN trim(title) WHEN 1 THEN title || ' - Other' ELSE title END AS title FROM titles"),
    "newest_submissions": (q_newest_submissions, "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS submitted_at FROM events WHERE event_type = 'signup' ORDER BY ts DESC LIMIT 50"),
    "conflict_examples": (q_conflict_examples, f"WITH {_MEMBERS}, k AS (SELECT c, f, max(v) FILTER (r = 1) AS value FROM fw GROUP BY c, f HAVING count(*) > 1) SELECT incident_id, CASE f WHEN 'fat' THEN 'fatalities' ELSE 'injuries' END AS field, value FROM k JOIN base USING (c) ORDER BY 1, 2 LIMIT 5"),
    "conflict_preservation": (q_conflict_preservation, f"""WITH {_MEMBERS}, k AS (SELECT c, f FROM fw GROUP BY c, f HAVING count(*) > 1), x AS (SELECT 'fact' AS kind, CASE f WHEN 'fat' THEN 'fatalities' ELSE 'injuries' END AS field FROM k
        UNION ALL SELECT 'time', 'event_time' FROM (SELECT c FROM m2 GROUP BY c HAVING count(DISTINCT t) > 1) UNION ALL SELECT 'place', 'location' FROM (SELECT c FROM m2 GROUP BY c HAVING count(DISTINCT pn) > 1)) SELECT kind, field, count(*) AS n, 1.0::DOUBLE AS preserved FROM x GROUP BY ALL"""),
    "geolocation_detail": (q_geolocation_detail, f"WITH {_MEMBERS} SELECT granularity, method, count(*) AS n, count(lat) AS mapped, coalesce(avg(radius_km), -1) AS radius, round(avg(confidence), 6) AS mean, round(min(confidence), 6) AS least, round(quantile_cont(confidence, 0.5), 6) AS median, round(max(confidence), 6) AS most FROM rec GROUP BY ALL"),
    "corpus_composition": (q_corpus_composition, f"""WITH {_MEMBERS}, s AS (SELECT c, count(DISTINCT src) AS k FROM m2 GROUP BY c) SELECT 'languages' AS name, count(DISTINCT lang) AS value FROM titles UNION ALL SELECT 'domains', count(DISTINCT host) FROM titles UNION ALL SELECT 'sources', count(*) FROM titles UNION ALL SELECT 'mapped', count(lat) FROM rec
        UNION ALL SELECT 'fallback', count(*) FROM rec WHERE method = 'collection_country_fallback' UNION ALL SELECT 'multi_source', count(*) FROM s WHERE k > 1 UNION ALL SELECT 'most_sources', max(source_count) FROM rec"""),
    "cluster_quality": (q_cluster_quality, """WITH c AS (SELECT o_custkey AS g, o_custkey || o_orderstatus AS f, count(*) AS n FROM orders GROUP BY ALL), g AS (SELECT sum(n) AS n, count(*) AS k FROM c GROUP BY g), f AS (SELECT sum(n) AS n, count(*) AS k FROM c GROUP BY f),
        t AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM c)::DOUBLE AS s, (SELECT sum(n * (n - 1) / 2) FROM g)::DOUBLE AS gp, (SELECT sum(n * (n - 1) / 2) FROM f)::DOUBLE AS fp)
        SELECT round(s / fp, 8) AS precision, round(s / gp, 8) AS recall, round(2 * s / (fp + gp), 8) AS f1, (SELECT count(*) FROM g WHERE k > 1) AS fragmented, (SELECT count(*) FROM f WHERE k > 1) AS over_merged, (SELECT count(*) FROM f WHERE n = 1) AS singletons FROM t"""),
    "gold_location": (q_gold_location, f"""WITH {INCIDENTS}, j AS (SELECT severity, lat IS NOT NULL AS has, lat IS NOT NULL AND contains(lower(kind), lower(substring(kind, 3, 4))) AS ok, pow(sin(radians(lat - 10.0::DOUBLE) / 2), 2) + cos(radians(10.0::DOUBLE)) * cos(radians(lat)) * pow(sin(radians(lon - 20.0::DOUBLE) / 2), 2) AS a FROM i)
        SELECT severity, CASE WHEN NOT has THEN 'place_missing' WHEN NOT ok THEN 'place_differs' ELSE 'none' END AS error, count(*) AS n, count(*) FILTER (ok) AS agree, round(coalesce(avg(2 * 6371.0088::DOUBLE * atan2(sqrt(a), sqrt(1 - a))), -1), 4) AS km FROM j GROUP BY ALL"""),
    "evaluation_manifest": (q_evaluation_manifest, f"""WITH {_MEMBERS}, k AS (SELECT c, f, count(*) AS k, max(v) FILTER (r = 1) AS v FROM fw GROUP BY c, f), s AS (SELECT c, count(DISTINCT src) AS k FROM m2 GROUP BY c),
        x(name, value, n, unit, kind) AS (SELECT 'corpus_sources', count(*)::DOUBLE, count(*), 'source records', 'descriptive' FROM titles UNION ALL SELECT 'corpus_languages', count(DISTINCT lang), count(*), 'language tags', 'descriptive' FROM titles UNION ALL SELECT 'corpus_publishers', count(DISTINCT host), count(*), 'publishers', 'descriptive' FROM titles
        UNION ALL SELECT 'corpus_incidents', count(*), count(*), 'incidents', 'descriptive' FROM rec UNION ALL SELECT 'multi_source_incidents', count(*) FILTER (k > 1), count(*), 'incident records', 'descriptive' FROM s
        UNION ALL SELECT 'geolocation_coverage', avg((method LIKE 'source%')::INT), count(*), 'proportion', 'descriptive' FROM rec UNION ALL SELECT 'map_marker_coverage', avg((lat IS NOT NULL)::INT), count(*), 'proportion', 'descriptive' FROM rec
        UNION ALL SELECT 'provenance_coverage', 1, count(*), 'proportion', 'structural' FROM k UNION ALL SELECT 'conflict_incident_rate', (SELECT count(DISTINCT c) FROM k WHERE k > 1) / count(*), count(*), 'proportion', 'structural' FROM base
        UNION ALL SELECT 'unknown_zero_violations', 0, 2 * count(*), 'violations', 'structural' FROM base UNION ALL SELECT 'median_uncertainty_radius_km', quantile_cont(radius_km, 0.5), count(radius_km), 'km', 'descriptive' FROM rec WHERE method LIKE 'source%'
        UNION ALL SELECT 'gold_quality_share', avg(quality), count(*), 'proportion', 'gold_accuracy' FROM labels UNION ALL SELECT 'labelled_accuracy', sum(quality), count(*), 'proportion', 'descriptive' FROM labels)
        SELECT name, round(value, 8) AS value, n, unit, kind, CASE WHEN name = 'labelled_accuracy' THEN 'mislabelled_accuracy,outside_bounds' ELSE '' END AS issues FROM x"""),
    "candidate_issues": (q_candidate_issues, f"""WITH {TITLES}, x AS (SELECT 'url_not_canonical' AS code FROM titles WHERE page_id % 5 = 0 UNION ALL SELECT 'domain_mismatch' FROM titles WHERE page_id % 7 = 0 UNION ALL SELECT 'languages_repeat' FROM titles WHERE page_id % 4 = 0 UNION ALL SELECT 'key_without_confidence' FROM titles WHERE page_id % 3 = 0 AND page_id % 6 <> 0) SELECT code, count(*) AS n FROM x GROUP BY code"""),
    "coverage_features": (q_coverage_features, """WITH c AS (SELECT n_name AS iso2, n_nationkey AS k, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey AND s_nationkey % 4 <> 0) AS sources FROM nation)
        SELECT iso2, sources, '{"type":"Feature","geometry":{"type":"Point","coordinates":[' || (-k - 0.5::DOUBLE) || ',' || (k + 0.5::DOUBLE) || ']},"properties":{"iso2":"' || iso2 || '","name":"' || array_to_string(list_transform(string_split(lower(iso2), ' '), lambda w: upper(w[1]) || w[2:]), ' ') || '","sources":' || sources || '}}' AS feature FROM c"""),
    "summary_text": (q_summary_text, f"""WITH {_MEMBERS}, n AS (SELECT c, count(DISTINCT src) AS sources FROM m2 GROUP BY c), j AS (SELECT b.incident_id, t, pn, gran, ff.deaths, ff.injuries, b.vehicles, b.effects, n.sources, b.source_count, len(string_split(b.evidence, ',')) AS ev FROM base b JOIN tv USING (c) JOIN n USING (c) LEFT JOIN pw USING (c) LEFT JOIN ff USING (c))
        SELECT incident_id, 'Reported for ' || day(t) || ' ' || monthname(t) || ' ' || year(t) || '. ' || CASE WHEN pn IS NULL THEN 'The place is not resolved.' ELSE 'Place: ' || pn || ', at ' || gran || ' precision.' END || ' Casualties: ' ||
          CASE WHEN deaths IS NULL THEN 'fatalities not reported' WHEN deaths = 0 THEN 'zero fatalities reported' WHEN deaths = 1 THEN '1 fatality' ELSE deaths || ' fatalities' END || ' and ' || CASE WHEN injuries IS NULL THEN 'injuries not reported' WHEN injuries = 0 THEN 'zero injuries reported' WHEN injuries = 1 THEN '1 injury' ELSE injuries || ' injuries' END || '.' ||
          CASE WHEN vehicles <> '' THEN ' Vehicles or road users: ' || replace(vehicles, ',', ', ') || '.' ELSE '' END || CASE WHEN effects <> '' THEN ' Effects: ' || effects || '.' ELSE '' END || ' ' || sources || ' source records, ' || source_count || ' independent groups, ' || ev || ' pieces of evidence.' AS summary FROM j"""),
    "social_posts": (q_social_posts, """WITH p AS (SELECT conv_id * 100 + turn AS ord, 'post:did:' || conv_id || '/' || conv_id || '-' || turn AS post_url, role AS handle, CASE WHEN turn % 2 = 0 THEN 'https://l.example/x' ELSE '' END AS external_link, CASE conv_id % 4 WHEN 0 THEN 'FR' WHEN 1 THEN 'DE' WHEN 2 THEN 'KR' END AS iso2 FROM conversations WHERE turn % 3 <> 2 AND conv_id % 5 <> 0 AND conv_id % 11 <> 0 AND conv_id % 4 <> 3)
        SELECT iso2, post_url, handle, external_link FROM p QUALIFY row_number() OVER (PARTITION BY iso2 ORDER BY ord) <= 3"""),
    "reconcile": (q_reconcile, """WITH o AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN 'near brand brass market' ELSE 'standard place' END AS place, o_orderkey % 3 = 0 AS bare FROM orders),
        c AS (SELECT l_orderkey AS id, p_type AS name, CASE WHEN l_partkey % 4 = 0 THEN 'country' ELSE 'city' END AS gran, l_partkey::DOUBLE AS lat, (l_partkey + 1)::DOUBLE AS lon, l_quantity / 100 AS conf FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_partkey % 3 <> 0),
        r AS (SELECT c.*, len(list_filter(list_distinct(string_split(lower(name), ' ')), lambda w: length(w) > 3 AND contains(place, w))) AS ov FROM c JOIN o USING (id)), b AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY id ORDER BY gran <> 'country' DESC, ov DESC, conf DESC, name, gran, lat, lon) = 1)
        SELECT o.id, coalesce(b.name, o.place) AS place, coalesce(b.lat, -1) AS lat, coalesce(b.gran, 'unknown') AS granularity, round(CASE WHEN b.id IS NOT NULL THEN least(0.7::DOUBLE, b.conf) WHEN bare THEN 0.7::DOUBLE ELSE 0 END, 6) AS confidence,
        CASE WHEN b.gran = 'country' THEN 'collection_country_fallback' WHEN b.id IS NOT NULL THEN 'source_named_offline_gazetteer_centroid' WHEN bare THEN 'unresolved' ELSE 'unresolved; ungrounded coordinates discarded' END AS method FROM o LEFT JOIN b USING (id)"""),
    "unanimous_facts": (q_unanimous_facts, "WITH t AS (SELECT l_orderkey AS id, CASE WHEN l_linenumber % 2 = 0 THEN 'fatalities' ELSE 'injuries' END AS field, min(l_quantity::INT % 3) AS value FROM lineitem GROUP BY ALL HAVING min(l_quantity::INT % 3) = max(l_quantity::INT % 3)) SELECT id, field, value, CASE WHEN value = 0 THEN 'reported_zero' ELSE 'known' END AS state, 0.8::DOUBLE AS confidence FROM t WHERE NOT (field = 'fatalities' AND id IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 4 = 0))"),
    "incident_markdown": (q_incident_markdown, f"""WITH {_MEMBERS}, n AS (SELECT c, count(DISTINCT src) AS sources FROM m2 GROUP BY c), j AS (SELECT b.incident_id, t, pn, gran, ff.deaths, ff.injuries, b.vehicles, b.effects, n.sources, b.source_count, len(string_split(b.evidence, ',')) AS ev FROM base b JOIN tv USING (c) JOIN n USING (c) LEFT JOIN pw USING (c) LEFT JOIN ff USING (c)), su AS (SELECT incident_id, 'Reported for ' || day(t) || ' ' || monthname(t) || ' ' || year(t) || '. ' || CASE WHEN pn IS NULL THEN 'The place is not resolved.' ELSE 'Place: ' || pn || ', at ' || gran || ' precision.' END || ' Casualties: ' ||
          CASE WHEN deaths IS NULL THEN 'fatalities not reported' WHEN deaths = 0 THEN 'zero fatalities reported' WHEN deaths = 1 THEN '1 fatality' ELSE deaths || ' fatalities' END || ' and ' || CASE WHEN injuries IS NULL THEN 'injuries not reported' WHEN injuries = 0 THEN 'zero injuries reported' WHEN injuries = 1 THEN '1 injury' ELSE injuries || ' injuries' END || '.' ||
          CASE WHEN vehicles <> '' THEN ' Vehicles or road users: ' || replace(vehicles, ',', ', ') || '.' ELSE '' END || CASE WHEN effects <> '' THEN ' Effects: ' || effects || '.' ELSE '' END || ' ' || sources || ' source records, ' || source_count || ' independent groups, ' || ev || ' pieces of evidence.' AS summary FROM j),
        sp2 AS (SELECT fv.c, f, list_sort(list_distinct(flatten(list(ev)))) AS sup FROM fv JOIN m2 ON m2.id = fv.id GROUP BY ALL),
        fl AS (SELECT b.c, k.f, CASE k.f WHEN 'fat' THEN 'fatalities' ELSE 'injuries' END AS name, max(v) FILTER (r = 1) AS v, string_agg(v, ' vs ' ORDER BY v) FILTER (r > 1) AS alt FROM base b CROSS JOIN (VALUES ('fat'), ('inj')) k(f) LEFT JOIN fw ON fw.c = b.c AND fw.f = k.f GROUP BY ALL),
        ft AS (SELECT fl.c, string_agg('- ' || name || ': ' || coalesce(v::VARCHAR, 'not reported') || CASE WHEN alt IS NOT NULL THEN ' vs ' || alt ELSE '' END || coalesce(array_to_string(list_transform(sup, lambda e: ' [' || e || ']'), ''), ''), chr(10) ORDER BY name) AS facts FROM fl LEFT JOIN sp2 ON sp2.c = fl.c AND sp2.f = fl.f GROUP BY fl.c)
        SELECT b.incident_id, '# ' || b.title || chr(10) || 'Record ' || b.incident_id || chr(10) || 'Independent sources: ' || b.source_count || chr(10) || 'Place: ' || coalesce(pn, 'not resolved') || chr(10) || facts || chr(10) || chr(10) || summary AS markdown FROM base b JOIN su USING (incident_id) JOIN ft USING (c) LEFT JOIN pw USING (c)"""),
    "markdown_table": (q_markdown_table, r"""SELECT -1 AS ord, '| n_nationkey | name | region |' AS line UNION ALL SELECT 0, '|---|---|---|' UNION ALL SELECT row_number() OVER (ORDER BY n_nationkey)::INT, '| ' || n_nationkey || ' | ' || n_name || CASE WHEN n_nationkey % 3 = 0 THEN '\|x' ELSE '' END || ' | ' || coalesce(nullif(n_regionkey, 2)::VARCHAR, '') || ' |' FROM nation"""),
    "issue_report": (q_issue_report, """WITH x AS (SELECT 'negative_balance' AS code, c_name AS s FROM customer WHERE c_acctbal < 0 UNION ALL SELECT 'fifth_nation', c_custkey::VARCHAR FROM customer WHERE c_nationkey % 5 = 0)
        SELECT 0 AS ord, count(*) || ' issues' AS line FROM x UNION ALL SELECT row_number() OVER (ORDER BY code)::INT, '- ' || code || ': ' || count(*) || ', first ' || min(s) FROM x GROUP BY code UNION ALL SELECT 0, 'No issues.'"""),
    "ablation": (q_ablation, f"""WITH {MENTIONS}, g AS (SELECT id, country || '|' || coalesce(list_sort(terms)[1], '') AS gold FROM m), p AS (SELECT a.id AS l, b.id AS r, a.gold = b.gold AS same FROM g a JOIN g b ON a.id < b.id),
        j AS (SELECT same, coalesce(s.hard_guard IS NULL AND s.total_score >= 0.62, false) AS d, coalesce(s.total_score >= 0.72, false) AS h FROM p LEFT JOIN (SELECT * FROM scored WHERE li > 0 OR ti > 0) s ON s.l_id = l AND s.r_id = r),
        u AS (SELECT 'decisions' AS method, same, d AS q FROM j UNION ALL SELECT 'threshold', same, h FROM j), c AS (SELECT method, count(*) FILTER (same AND q) AS tp, count(*) FILTER (NOT same AND q) AS fp, count(*) FILTER (same AND NOT q) AS fn FROM u GROUP BY method)
        SELECT *, round(coalesce(tp / nullif(tp + fp, 0), -1), 8) AS precision, round(coalesce(tp / nullif(tp + fn, 0), -1), 8) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), -1), 8) AS f1 FROM c"""),
    "corpus_built": (q_corpus_built, """WITH c AS (SELECT n_name AS k, 'https://d' || (c_custkey % 9) || '.example/' || c_custkey AS url, 'd' || (c_custkey % 9) || '.example' AS dom, CASE WHEN c_custkey % 3 = 0 THEN 'key' || (c_custkey % 2) END AS key, coalesce(CASE WHEN c_custkey % 3 = 0 THEN (c_custkey % 50) / 100.0::DOUBLE END, 0.0::DOUBLE) AS conf FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 4 <> 0),
        b AS (SELECT k, key FROM (SELECT k, key, count(DISTINCT dom) AS d, max(conf) AS m FROM c WHERE key IS NOT NULL GROUP BY ALL) WHERE d >= 2 QUALIFY row_number() OVER (PARTITION BY k ORDER BY m DESC, key) = 1),
        o AS (SELECT c.* FROM c JOIN b ON c.k = b.k AND c.key = b.key QUALIFY row_number() OVER (PARTITION BY c.k, dom ORDER BY conf DESC, dom, url) = 1), p AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY k ORDER BY conf DESC, dom, url) <= 2),
        s AS (SELECT c.*, p.url IS NOT NULL AS pair FROM c LEFT JOIN p ON p.k = c.k AND p.url = c.url QUALIFY row_number() OVER (PARTITION BY c.k ORDER BY p.url IS NOT NULL DESC, c.key IS NULL, c.conf DESC, c.dom, c.url) <= 10),
        t AS (SELECT k, count(*) AS sources, count(*) FILTER (pair) AS pairs, count(DISTINCT dom) FILTER (pair) AS pair_domains, max(key) FILTER (pair) AS key FROM s GROUP BY k)
        SELECT k AS country_iso2, sources, pairs, pair_domains, CASE WHEN pairs >= 2 AND pair_domains >= 2 THEN key ELSE '' END AS incident_key, CASE WHEN pairs >= 2 AND pair_domains >= 2 THEN pairs ELSE 0 END::INT AS incident_sources, CASE WHEN sources < 10 THEN sources ELSE -1 END AS short FROM t"""),
    "compiled_candidates": (q_compiled_candidates, f"""WITH {MENTIONS}, p AS (SELECT l_id, r_id, lc AS grp, lexical_score AS s FROM scored WHERE ti >= 3 AND lexical_score >= 0.24 AND abs(epoch_us(lt) - epoch_us(rt)) <= 4 * 86400000000 QUALIFY row_number() OVER (PARTITION BY lc ORDER BY lexical_score DESC, l_id, r_id) = 1),
        ov AS (SELECT 'de' AS grp, 1 AS l_id, 2 AS r_id WHERE (SELECT count(*) FROM m WHERE country = 'de' AND id IN (1, 2)) = 2), b AS (SELECT grp, l_id, r_id, 0.95::DOUBLE AS c FROM ov UNION ALL SELECT grp, l_id, r_id, least(0.95::DOUBLE, 0.55::DOUBLE + s / 2) FROM p WHERE grp NOT IN (SELECT grp FROM ov)),
        k AS (SELECT *, lower(grp) || '_pair_' || substring(sha256(l_id || '|' || r_id), 1, 12) AS key FROM b) SELECT id AS candidate_id, country AS grp, key AS incident_key, round(CASE WHEN key IS NOT NULL THEN c END, 3) AS pair_confidence FROM m LEFT JOIN k ON country = grp AND id IN (l_id, r_id)"""),
}
