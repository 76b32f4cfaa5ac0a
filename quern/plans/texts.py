"""Queries over texts and pages: identifiers, duplicates, URLs, excerpts, relevance, gazetteer, counts, terms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.text import ascii_digits, casualty_counts, content_hash, excerpt, jaccard, lexical_features, stable_id, strip_publisher, terms
from quern.functions.urls import canonical_url, direct_url, hostname
from quern.operators import evidence, fusing, matching
from quern.plans.tables import TITLES, load, page_titles
from quern.sources.html_pages import page_blocks

#: A small gazetteer over words of the test data: (alias, anchor, family, priority, ord).
ALIASES = [
    ("the and", "and_street", "north", 30, 1), ("the", "the_town", "north", 10, 2), ("of the", "of_the_bridge", "north", 20, 3), ("der die", "die_platz", "south", 20, 4), ("der", "der_stadt", "south", 10, 5),
    ("que", "que_road", None, 15, 6), ("de la", "la_cross", "west", 25, 7), ("de", "de_area", "west", 5, 8), ("große", "grosse_allee", "south", 40, 9), ("ß", "eszett", None, 1, 10),
]
_VALUES = ", ".join(f"('{a}', '{b}', {repr(c) if c else 'NULL'}, {p}, {o})" for a, b, c, p, o in ALIASES)


def aliases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ALIASES, "alias string, anchor string, family string, priority int, ord int")


def q_stable_id(spark: SparkSession, sf: str) -> DataFrame:
    d = load(spark, sf, "documents")
    return d.select("doc_id", stable_id("src", F.col("source"), F.col("doc_id").cast("string")).alias("source_key"), content_hash("text", length=64).alias("content_hash"))


def q_exact_duplicate_groups(spark: SparkSession, sf: str) -> DataFrame:
    d = load(spark, sf, "documents").select("doc_id", "source", content_hash("text", length=64).alias("h")).withColumn("dependency_group", F.col("source"))
    return evidence.duplicate_groups(d, "h").select("doc_id", "dependency_group", "independence")


def q_independent_count(spark: SparkSession, sf: str) -> DataFrame:
    d = load(spark, sf, "documents").select("doc_id", "lang", "source", content_hash("text", length=64).alias("h")).withColumn("dependency_group", F.lit(None).cast("string"))
    grouped = evidence.duplicate_groups(d, "h")
    return fusing.independent_sources(grouped, ["lang"], "dependency_group", "doc_id")


def q_canonical_url(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "pages").select("page_id", canonical_url("url").alias("canonical"), direct_url("url").alias("direct"))


def q_hostname(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "pages").groupBy(hostname("url").alias("host")).agg(F.count(F.lit(1)).alias("pages"))


def q_page_title(spark: SparkSession, sf: str) -> DataFrame:
    t = page_titles(spark, sf)
    return t.select("page_id", "title", strip_publisher(F.concat("title", F.lit(" - "), F.upper("host")), "host").alias("plain"))


def q_page_lang(spark: SparkSession, sf: str) -> DataFrame:
    return page_titles(spark, sf).groupBy("lang").agg(F.count(F.lit(1)).alias("pages"), F.count_distinct("host").alias("hosts"))


def q_page_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return page_blocks(load(spark, sf, "pages"), "page_id", "html")


def q_relevance_filter(spark: SparkSession, sf: str) -> DataFrame:
    d = load(spark, sf, "documents")
    keywords = F.when(F.col("lang") == "fr", F.array(F.lit("eau"), F.lit("ment"))).when(F.col("lang") == "de", F.array(F.lit("strasse"), F.lit("ss"))).otherwise(F.array(F.lit("accident")))
    return d.where(evidence.relevant(F.col("text"), keywords, F.col("doc_id") % 17 == 0)).select("doc_id", "lang")


def q_alias_join_best_per_family(spark: SparkSession, sf: str) -> DataFrame:
    return evidence.matching_anchors(load(spark, sf, "documents"), "doc_id", "text", aliases(spark)).select("doc_id", "anchor", "priority")


def q_count_extract(spark: SparkSession, sf: str) -> DataFrame:
    p = load(spark, sf, "part").select("p_partkey", F.format_string("%d people were killed and %s more persons badly injured at %s, costs %d", F.col("p_size"), F.when(F.col("p_partkey") % 3 == 0, "twenty-four").otherwise("seven"), F.col("p_name"), F.col("p_partkey")).alias("t"))
    return p.select("p_partkey", casualty_counts("t").alias("c"), casualty_counts(F.concat(F.lit("a student was killed near "), "t")).alias("d")).select("p_partkey", "c.fatalities", "c.injuries", F.col("d.fatalities").alias("with_story"))


def q_word_excerpt(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "documents").select("doc_id", excerpt("text", 25).alias("excerpt"), ascii_digits(F.concat(F.lit("০১২৩৪৫৬৭৮৯ "), F.col("doc_id").cast("string"))).alias("digits"))


def q_token_set(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "documents").select("doc_id", F.size(terms("text")).alias("n_terms"), F.array_join(lexical_features("text", ["with", "that", "this"], 12), " ").alias("long_terms"))


def q_pair_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    t = page_titles(spark, sf).select(F.col("page_id").alias("mention_id"), F.col("host").alias("source_id"), F.col("lang").alias("country"), F.array().cast("array<string>").alias("locations"), lexical_features("title", []).alias("terms"))
    pairs = matching.shared_key_pairs(t)
    side = lambda p: t.select(F.col("mention_id").alias(f"{p}_id"), F.col("terms").alias(f"{p}t"))
    scored = pairs.join(side("l"), "l_id").join(side("r"), "r_id").withColumn("j", jaccard("lt", "rt"))
    return scored.where("j >= 0.2").select("l_id", "r_id", F.round("j", 9).alias("similarity"))


def q_title_terms(spark: SparkSession, sf: str) -> DataFrame:
    return page_titles(spark, sf).select("lang", F.explode(lexical_features("title", [])).alias("term")).groupBy("lang", "term").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents to fused records: exact copies, pairs of pages by title, clusters, independent sources, severity."""
    m = q_pair_jaccard(spark, sf_dir).where("similarity >= 0.5")
    parts = matching.components(m)
    pages = page_titles(spark, sf_dir)
    joined = pages.join(parts.withColumnRenamed("node", "page_id"), "page_id", "left").withColumn("component", F.coalesce("component", "page_id"))
    out = joined.groupBy("component").agg(F.count(F.lit(1)).alias("pages"), F.count_distinct("host").alias("independent"), F.min_by("title", "page_id").alias("title"))
    return out.withColumn("level", F.when(F.col("independent") >= 3, "high").when(F.col("independent") >= 2, "medium").otherwise("low"))


_SPACES = "[\\t\\n\\r\\f\\x0B ]+"
QUERIES = {
    "stable_id": (q_stable_id, "SELECT doc_id, 'src_' || substring(sha256(source || '|' || doc_id), 1, 16) AS source_key, sha256(text) AS content_hash FROM documents"),
    "exact_duplicate_groups": (q_exact_duplicate_groups, "SELECT doc_id, CASE WHEN n > 1 THEN 'duplicate:' || substring(h, 1, 12) ELSE source END AS dependency_group, CASE WHEN n > 1 THEN 'repost' ELSE 'original' END AS independence FROM (SELECT *, sha256(text) AS h, count(*) OVER (PARTITION BY text) AS n FROM documents)"),
    "independent_count": (q_independent_count, """WITH d AS (SELECT doc_id, lang, count(*) OVER (PARTITION BY text) AS n, sha256(text) AS h FROM documents),
        g AS (SELECT lang, CASE WHEN n > 1 THEN h ELSE doc_id::VARCHAR END AS g, count(*) AS k FROM d GROUP BY ALL)
        SELECT lang, sum(k)::BIGINT AS sources, count(*) AS independent, count(*) FILTER (k > 1) AS duplicate_groups FROM g GROUP BY lang"""),
    "canonical_url": (q_canonical_url, r"""WITH u AS (SELECT page_id, url, lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) AS s, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)) AS h, regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) AS p,
          list_sort(list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(lower(x), '^(utm_[^=]*|fbclid|gclid|mc_cid|mc_eid|ref|ref_src)(=|$)'))) AS q FROM pages)
        SELECT page_id, CASE WHEN s IN ('http', 'https') THEN s || '://' || h || CASE WHEN p = '' THEN '/' ELSE p END || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END END AS canonical, url AS direct FROM u"""),
    "hostname": (q_hostname, f"WITH {TITLES} SELECT host, count(*) AS pages FROM titles GROUP BY host"),
    "page_title": (q_page_title, f"WITH {TITLES} SELECT page_id, title, trim(title) AS plain FROM titles"),
    "page_lang": (q_page_lang, f"WITH {TITLES} SELECT lang, count(*) AS pages, count(DISTINCT host) AS hosts FROM titles GROUP BY lang"),
    "page_blocks": (q_page_blocks, None),
    "relevance_filter": (q_relevance_filter, r"""SELECT doc_id, lang FROM documents WHERE doc_id % 17 = 0 OR regexp_matches(text, '(?i)\b(?:accident|crash|collision|killed|injured|road|highway|traffic|blockade|congestion|vehicle|motorcycle|bus|truck)\b')
        OR CASE lang WHEN 'fr' THEN contains(lower(text), 'eau') OR contains(lower(text), 'ment') WHEN 'de' THEN contains(replace(lower(text), 'ß', 'ss'), 'ss') ELSE contains(lower(text), 'accident') END"""),
    "alias_join_best_per_family": (q_alias_join_best_per_family, rf"""WITH a(alias, anchor, family, priority, ord) AS (VALUES {_VALUES}),
        h AS (SELECT doc_id, anchor, coalesce(family, '=' || anchor) AS f, priority, ord FROM documents, a
          WHERE regexp_matches(replace(lower(text), 'ß', 'ss'), '(^|[^\p{{L}}\p{{N}}_])' || replace(lower(alias), 'ß', 'ss') || '([^\p{{L}}\p{{N}}_]|$)'))
        SELECT doc_id, anchor, priority FROM h QUALIFY row_number() OVER (PARTITION BY doc_id, f ORDER BY priority DESC, ord) = 1"""),
    "count_extract": (q_count_extract, "SELECT p_partkey, p_size AS fatalities, CASE WHEN p_partkey % 3 = 0 THEN 24 ELSE 7 END AS injuries, p_size AS with_story FROM part"),
    "word_excerpt": (q_word_excerpt, rf"""WITH w AS (SELECT doc_id, string_split(trim(regexp_replace(text, '{_SPACES}', ' ', 'g')), ' ') AS w FROM documents)
        SELECT doc_id, array_to_string(w[1:25], ' ') || CASE WHEN len(w) > 25 THEN '…' ELSE '' END AS excerpt, '0123456789 ' || doc_id AS digits FROM w"""),
    "token_set": (q_token_set, r"""WITH t AS (SELECT doc_id, list_distinct(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\p{L}\p{N}]+')) AS t FROM documents)
        SELECT doc_id, len(t)::INT AS n_terms, array_to_string(list_sort(list_filter(t, lambda x: length(x) >= 12 AND x NOT IN ('with', 'that', 'this'))), ' ') AS long_terms FROM t"""),
    "pair_jaccard": (q_pair_jaccard, rf"""WITH {TITLES}, t AS (SELECT page_id, host, lang, list_filter(list_distinct(regexp_extract_all(replace(lower(title), 'ß', 'ss'), '[\p{{L}}\p{{N}}]+')), lambda x: length(x) >= 4) AS t FROM titles),
        p AS (SELECT a.page_id AS l_id, b.page_id AS r_id, len(list_intersect(a.t, b.t)) AS k, len(a.t) AS x, len(b.t) AS y FROM t a JOIN t b ON a.page_id < b.page_id AND a.host <> b.host AND a.lang = b.lang)
        SELECT l_id, r_id, round(k / (x + y - k), 9) AS similarity FROM p WHERE x > 0 AND y > 0 AND k / (x + y - k) >= 0.2"""),
    "evidence_fusion": (flagship, rf"""WITH RECURSIVE {TITLES}, t AS (SELECT page_id, host, lang, list_filter(list_distinct(regexp_extract_all(replace(lower(title), 'ß', 'ss'), '[\p{{L}}\p{{N}}]+')), lambda x: length(x) >= 4) AS t FROM titles),
        p AS (SELECT a.page_id AS a, b.page_id AS b, len(list_intersect(a.t, b.t)) AS k, len(a.t) AS x, len(b.t) AS y FROM t a JOIN t b ON a.page_id < b.page_id AND a.host <> b.host AND a.lang = b.lang),
        e AS (SELECT a, b FROM p WHERE x > 0 AND y > 0 AND round(k / (x + y - k), 9) >= 0.5), m AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
        r AS (SELECT page_id, page_id AS c FROM titles UNION SELECT m.b, r.c FROM r JOIN m ON m.a = r.page_id), g AS (SELECT page_id, min(c) AS component FROM r GROUP BY page_id)
        SELECT component, count(*) AS pages, count(DISTINCT host) AS independent, min_by(title, page_id) AS title, CASE WHEN count(DISTINCT host) >= 3 THEN 'high' WHEN count(DISTINCT host) >= 2 THEN 'medium' ELSE 'low' END AS level FROM g JOIN titles USING (page_id) GROUP BY component"""),
    "title_terms": (q_title_terms, rf"""WITH {TITLES} SELECT lang, term, count(*) AS n FROM (SELECT lang, unnest(list_filter(list_distinct(regexp_extract_all(replace(lower(title), 'ß', 'ss'), '[\p{{L}}\p{{N}}]+')), lambda x: length(x) >= 4)) AS term FROM titles) GROUP BY ALL HAVING count(*) > 1"""),
}
