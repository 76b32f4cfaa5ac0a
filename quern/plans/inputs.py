"""Queries over sources, sinks, uploads and providers: files are made from the tables, read back and held against them."""

from __future__ import annotations

import io
import json
import uuid
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.store import shared_folder, stored
from quern.plans import providers
from quern.plans.matching import _scored
from quern.plans.records import INCIDENTS, _incidents
from quern.plans.tables import MENTIONS, TITLES, load, page_titles
from quern.sources import feeds, files, media, metadata, sinks, snapshots
from quern.streaming import uploads


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/quern-{name}-{uuid.uuid4().hex}"


def _written(spark: SparkSession, rows: DataFrame, name: str) -> str:
    """A folder with those files; the write runs here, once."""
    folder = _folder(spark, name)
    stored(sinks.write_files(rows, folder), "filed")
    return folder


def q_video_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as video analyses: turns as claims, first turns as bare incidents, moods."""
    t = load(spark, sf, "conversations")
    claim = F.struct(F.when(F.col("turn") % 2 == 0, F.col("text")).alias("claim"), F.when(F.col("turn") % 2 == 1, F.col("text")).alias("description"), F.when(F.col("turn") % 3 == 0, F.lit("directly observed")).alias("evidence_type"), F.when(F.col("turn") % 2 == 0, F.lit("high")).otherwise("0.3").alias("confidence"), F.col("role").alias("claimant"))
    per = t.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", claim.alias("c")))), lambda x: x["c"]).alias("claims"))
    doc = F.to_json(F.struct(
        "claims", F.array(F.struct(F.lit("collision").alias("incident_type"), F.concat(F.lit("road "), F.col("conv_id").cast("string")).alias("location"), F.lit("2").alias("fatalities"), F.array(F.struct(F.lit("bus").alias("vehicle_type"), F.lit("x").alias("colour"))).alias("vehicles"))).alias("traffic_incidents"),
        F.struct(F.array(F.struct(F.lit("delay").alias("aspect"), F.concat(F.lit("angry "), F.col("conv_id").cast("string")).alias("evidence_text"))).alias("aspect_sentiments")).alias("sentiment_analysis"),
    ))
    out = media.media_evidence(per.select(F.concat(F.lit("v"), F.col("conv_id").cast("string")).alias("source_id"), doc.alias("json")), "video")
    return out.select("source_id", "evidence_kind", "assertion_type", "locator", F.sha2("claim_text", 256).alias("claim"), F.coalesce("claimant", F.lit("")).alias("claimant"), "extraction_confidence", F.coalesce("casualties.fatalities", F.lit(-1)).alias("fatalities"), F.array_join("vehicles", ",").alias("vehicles"), F.array_join("location_mentions", ",").alias("places"))


def q_image_evidence(spark: SparkSession, sf: str) -> DataFrame:
    n = load(spark, sf, "customer")
    doc = F.to_json(F.struct(
        F.array(F.struct(F.concat(F.lit("saw "), "c_name").alias("observation"), F.lit("medium").alias("confidence"))).alias("observations"), F.array(F.struct(F.col("c_mktsegment").alias("inference")), F.struct(F.lit("  ").alias("inference"))).alias("inferences"),
        F.struct(F.when(F.col("c_custkey") % 2 == 0, F.lit("Old Town")).alias("area"), F.lit("City").alias("city"), F.col("c_nationkey").cast("string").alias("country")).alias("location_evidence"), F.lit("odd").alias("visible_text"),
    ))
    out = media.media_evidence(n.select(F.concat(F.lit("i"), F.col("c_custkey").cast("string")).alias("source_id"), doc.alias("json")), "image")
    return out.select("source_id", "evidence_kind", "assertion_type", "locator", "claim_text", "extraction_confidence", F.array_join("location_mentions", ",").alias("places"))


def q_sidecars(spark: SparkSession, sf: str) -> DataFrame:
    """Sidecars in both forms, with values that aren't valid."""
    p = page_titles(spark, sf).selectExpr("page_id", """CASE WHEN page_id % 2 = 0 THEN concat('{"languages": ["', lang, '", "?"], "timezone": "', if(page_id % 4 = 0, 'Asia/Dhaka', 'No/Where'), '", "country_code": "', if(page_id % 3 = 0, 'bgd', 'x1'), '", "traffic_incident": true, "other": 1}\nSource name: ', host, '\nhttps://', host, '/x)')
        ELSE concat('---\nlanguages: "', lang, ', en-GB"\n# no\ntraffic_keywords: ["Straße", "B"]\ntraffic_incident: yes\n---\nhttps://www.', host, '/y') END AS content""")
    out = metadata.sidecars(p.select(F.col("page_id").cast("string").alias("path"), F.col("content").cast("binary").alias("content")))
    return out.select(F.col("path").cast("long").alias("page_id"), "uri", "publisher", F.array_join("languages", ",").alias("languages"), F.coalesce("timezone", F.lit("")).alias("timezone"), F.coalesce("country_code", F.lit("")).alias("country_code"), F.coalesce("traffic_incident", F.lit(False)).alias("incident"), F.array_join("traffic_keywords", ",").alias("keywords"), F.size("warnings").alias("warnings"))


def _nation_files(spark: SparkSession, sf: str) -> DataFrame:
    n = load(spark, sf, "nation").join(load(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return n.selectExpr("n_nationkey", "concat(r_regionkey, '/', n_nationkey, element_at(array('/page.html', '/video.json', '/image_01.json', '/notes.txt'), cast(n_nationkey % 4 + 1 AS int))) AS path", "concat('<p>', n_name, '</p>') AS content")


def q_file_scan(spark: SparkSession, sf: str) -> DataFrame:
    return files.scan(spark, _written(spark, _nation_files(spark, sf), "scan")).select("path", "kind", "size_bytes", "sha256")


def q_content_lock(spark: SparkSession, sf: str) -> DataFrame:
    folder = _written(spark, _nation_files(spark, sf).select(F.concat(F.when(F.col("n_nationkey") % 5 == 0, F.lit("locks/")).otherwise(F.lit("")), "path").alias("path"), "content"), "lock")
    return files.content_lock(spark, folder).select(F.regexp_extract("path", "quern-lock-[0-9a-f]+/(.*)$", 1).alias("path"), "sha256", "size_bytes")


def q_materialized(spark: SparkSession, sf: str) -> DataFrame:
    """Files of accepted rows: written, told the same when written again, in conflict with other content, unsafe."""
    rows, folder = _nation_files(spark, sf).where("n_nationkey % 6 <> 0"), _folder(spark, "files")
    first = stored(sinks.write_files(rows.where("n_nationkey % 2 = 0"), folder), "filed")
    again = rows.select(F.when(F.col("n_nationkey") % 7 == 0, F.concat(F.lit("../"), "path")).otherwise(F.col("path")).alias("path"), F.when(F.col("n_nationkey") % 4 == 0, F.lit("other")).otherwise(F.col("content")).alias("content"))
    return first.select("path", "outcome", F.lit(1).alias("round")).unionByName(sinks.write_files(again, folder).select("path", "outcome", F.lit(2).alias("round")))


def q_artifact_check(spark: SparkSession, sf: str) -> DataFrame:
    rows = _nation_files(spark, sf)
    folder = _written(spark, rows.where("n_nationkey % 3 <> 0"), "artifacts")
    asked = rows.selectExpr("if(n_nationkey % 5 = 0, concat('/', path), path) AS path", "if(n_nationkey % 2 = 0, sha2(content, 256), 'no') AS sha256")
    return files.artifacts(asked, folder)


def q_removed_files(spark: SparkSession, sf: str) -> DataFrame:
    rows = _nation_files(spark, sf)
    return sinks.remove_files(rows, _written(spark, rows.where("n_nationkey % 2 = 0"), "removed"))


def q_json_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines with sorted keys, written, appended to and read back."""
    folder, n = _folder(spark, "lines"), load(spark, sf, "nation")
    sinks.write_lines(n.select("n_nationkey", "n_name", F.lit(None).cast("string").alias("a")), folder)
    sinks.write_lines(n.where("n_nationkey < 5").select("n_nationkey", "n_name", F.lit("again").alias("a")), folder, append=True)
    lines = spark.read.text(folder).select(F.col("value").alias("line"))
    back = files.read_lines(spark, folder, "n_nationkey int, n_name string, a string")
    return lines.withColumn("rows", F.lit(back.count()))


def q_rewritten_ledger(spark: SparkSession, sf: str) -> DataFrame:
    """A ledger rewritten without some rows: readers see the old or the new version whole."""
    root, n = _folder(spark, "ledger"), load(spark, sf, "nation")
    sinks.publish(n.select("n_nationkey", "n_name"), root, "ledger")
    sinks.publish(sinks.published(spark, root, "ledger").where("n_nationkey % 3 <> 0"), root, "ledger")
    return sinks.published(spark, root, "ledger")


def q_staged_recompute(spark: SparkSession, sf: str) -> DataFrame:
    """A version with issues isn't published: the one before stays."""
    root, r = _folder(spark, "staged"), load(spark, sf, "region")
    check = lambda d: d.where("r_regionkey < 0").selectExpr("'bad' AS code")
    uploads.recompute(spark, root, "t", lambda: r.select("r_regionkey", "r_name"), check)
    refused = 0
    try:
        uploads.recompute(spark, root, "t", lambda: r.selectExpr("r_regionkey - 3 AS r_regionkey", "r_name"), check)
    except ValueError:
        refused = 1
    return sinks.published(spark, root, "t").withColumn("refused", F.lit(refused))


def q_csv_sink(spark: SparkSession, sf: str) -> DataFrame:
    folder = _folder(spark, "csv")
    sinks.write_csv(load(spark, sf, "supplier").select("s_suppkey", F.concat("s_name", F.lit(' "x", y')).alias("s_name")), folder)
    return spark.read.text(folder, lineSep="\n").where("value <> '\"s_suppkey\",\"s_name\"'").select(F.col("value").alias("line"))


def q_canonical_json(spark: SparkSession, sf: str) -> DataFrame:
    return sinks.canonical_json(load(spark, sf, "supplier").select("s_suppkey", "s_name", F.when(F.col("s_nationkey") > 5, F.col("s_nationkey")).alias("a_nation"))).select("s_suppkey", "json")


def q_document_default(spark: SparkSession, sf: str) -> DataFrame:
    """Whole documents, and no rows where there are none."""
    folder = _written(spark, load(spark, sf, "region").selectExpr("concat('r', r_regionkey, '.json') AS path", "concat('{\n \"k\": ', r_regionkey, ',\n \"name\": \"', r_name, '\"\n}') AS content"), "documents")
    return files.read_document(spark, folder, "k int, name string").unionByName(files.read_document(spark, folder + "-none", "k int, name string"))


def q_strict_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of strict JSON: rows that fit, and issues by path and line."""
    n = load(spark, sf, "nation").selectExpr("n_regionkey", "n_nationkey", "CASE n_nationkey % 4 WHEN 0 THEN concat('{\"k\": ', n_nationkey, ', \"name\": \"', n_name, '\"}') WHEN 1 THEN 'no json' WHEN 2 THEN concat('{\"k\": ', n_nationkey, ', \"other\": 1}') ELSE concat('{\"name\": \"', n_name, '\"}') END AS line")
    per = n.groupBy("n_regionkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n_nationkey", "line"))), lambda x: x["line"]), "\n").alias("content"))
    found, issues = files.strict_rows(spark, _written(spark, per.selectExpr("concat('reviews/', n_regionkey, '.jsonl') AS path", "content"), "strict"), "*.jsonl", "k int, name string", ["k"], lines=True)
    return found.select("where", F.lit("row").alias("code"), "k").unionByName(issues.select("where", "code", F.lit(-1).alias("k")))


def q_country_profiles(spark: SparkSession, sf: str) -> DataFrame:
    n = load(spark, sf, "nation")
    entry = F.concat(F.lit('[[countries]]\niso2 = "'), F.concat(F.lit("a"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0")), F.lit('"\niso3 = "b'), F.lpad(F.col("n_nationkey").cast("string"), 2, "0"), F.lit('"\nname = "'), F.col("n_name"), F.lit('"\ncoverage_centroid = { latitude = '), (F.col("n_nationkey") + 0.5).cast("string"), F.lit(", longitude = "), F.col("n_regionkey").cast("string"), F.lit(' }\nlanguages = ["en", "x'), F.col("n_regionkey").cast("string"), F.lit('"]\n'))
    folder = _written(spark, n.agg(F.array_join(F.sort_array(F.collect_list(entry)), "\n").alias("content")).withColumn("path", F.lit("countries.toml")), "toml")
    return metadata.by_either_code(metadata.country_profiles(spark, f"{folder}/countries.toml")).select("country_code", "name", "lat", "lon", F.array_join("languages", ",").alias("languages"))


def _service(url: str, headers: dict[str, str]) -> tuple[int, bytes]:
    """A search service that answers by the country asked for."""
    from urllib.parse import parse_qs, urlsplit

    name = parse_qs(urlsplit(url).query)["query"][0].rsplit(":", 1)[1]
    return 200, json.dumps({"articles": [{"url": f"https://{name}{k % 3}.example/a?utm_source=q&k={k % 4}", "title": f"  {name}  {k}", "seendate": "20240101T000000Z", "language": "en", "sourcecountry": name} for k in range(6)] + [{"url": "ftp://no"}, "odd"]}).encode()


class NationSearch(feeds.ArticleSource):
    fetch = staticmethod(_service)

    @classmethod
    def name(cls) -> str:
        return "nation_search"


def q_article_search(spark: SparkSession, sf: str) -> DataFrame:
    """One partition for each nation; what a service answers, once for each address."""
    spark.dataSource.register(NationSearch)
    nations = [[f"N{r['n_nationkey']:02d}", r["n_name"], ["road accident", "crash"]] for r in load(spark, sf, "nation").select("n_nationkey", "n_name").orderBy("n_nationkey").collect()]
    found = spark.read.format("nation_search").option("endpoint", "https://s.example").option("countries", json.dumps(nations)).load()
    return feeds.discovered(found).select("country_iso2", "url", "title", "domain")


def q_feed_items(spark: SparkSession, sf: str) -> DataFrame:
    """Items of two queries' feeds, once for each address."""
    n = load(spark, sf, "nation")
    item = F.concat(F.lit("<item><title>"), "n_name", F.lit(" - Some Paper</title><link>https://agg.example/r?url=https%3A%2F%2Fp"), (F.col("n_nationkey") % 7).cast("string"), F.lit(".example%2Fx</link><pubDate>Mon, 01 Jan 2024 0"), (F.col("n_nationkey") % 10).cast("string"), F.lit(":00:00 +0600</pubDate></item>"))
    per = n.withColumn("q", F.col("n_nationkey") % 2).groupBy("q").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n_nationkey", item.alias("i")))), lambda x: x["i"]), "").alias("c"))
    folder = _written(spark, per.select(F.concat(F.lit("q"), F.col("q").cast("string"), F.lit(".xml")).alias("path"), F.concat(F.lit("<rss><channel>"), "c", F.lit("</channel></rss>")).alias("content")), "feeds")
    key = F.split("title", " - ")[0]
    parts = [feeds.read_feed(spark, f"{folder}/q{q}.xml").withColumn("query", F.lit(f"q{q}")) for q in (0, 1)]
    items = parts[0].unionByName(parts[1]).withColumn("_n", key).join(n.select(F.col("n_name").alias("_n"), F.col("n_nationkey").alias("ord"), F.col("n_regionkey").cast("string").alias("country_iso2")), "_n").drop("_n")
    return feeds.feed_candidates(items).select("country_iso2", "url", "domain", "title", "published_at")


def _site(url: str, headers: dict[str, str]) -> tuple[int, bytes]:
    """A web site that answers by the number in the address."""
    if url.endswith("/robots.txt"):
        k = sum(map(ord, url.split("/")[2])) % 4
        return {0: (404, b""), 1: (500, b""), 2: (200, b"User-agent: *\nDisallow: /private")}.get(k, (200, b"User-agent: *\nAllow: /"))
    k = int(url.rsplit("/", 1)[1])
    if k % 11 == 0:
        raise OSError("no route")
    return (410, b"") if k % 7 == 0 else (200, b"plain words" if k % 5 == 0 else b"<p>%d</p>" % k)


def q_capture_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    p = page_titles(spark, sf).selectExpr("concat(if(page_id % 13 = 0, 'ftp', 'https'), '://', if(page_id % 17 = 0, '10.0.0.1', host), if(page_id % 3 = 0, '/private/', '/x/'), page_id) AS url")
    return feeds.captured(p, _site).select("url", "outcome", F.coalesce("status", F.lit(-1)).alias("status"), F.coalesce(F.length("content"), F.lit(-1)).alias("chars"))


def q_snapshots(spark: SparkSession, sf: str) -> DataFrame:
    p = load(spark, sf, "pages").select(F.lit("XX").alias("country_iso2"), "url", F.col("html").cast("binary").alias("html"))
    s = snapshots.snapshots(p)
    return s.select("canonical_url", "domain", "content_sha256", (F.length("excerpt") <= snapshots.MOST_CHARS + 1).alias("short"), F.length("clean_html").alias("_c"), (F.contains("clean_html", F.lit("<script")) | F.contains("clean_html", F.lit(" class="))).alias("active")).drop("_c")


def q_schemas(spark: SparkSession, sf: str) -> DataFrame:
    folder = _folder(spark, "schemas")
    sinks.write_schemas({"region": load(spark, sf, "region"), "nation": load(spark, sf, "nation")}, folder, spark)
    return spark.read.json(folder).select("name", F.array_join(F.expr("transform(from_json(get_json_object(schema, '$.fields'), 'array<struct<name: string, type: string>>'), f -> concat(f.name, ' ', f.type))"), ", ").alias("fields"))


def q_source_files(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks of each conversation as Markdown, blocks and source files, one folder each."""
    from quern.operators.evaluation import source_files

    t = load(spark, sf, "conversations")
    blocks = t.select(F.col("conv_id").alias("source_id"), F.col("turn").alias("ord"), F.when(F.col("turn") == 0, "headline").otherwise("article").alias("kind"), "text")
    made = source_files(blocks, t.groupBy(F.col("conv_id").alias("source_id")).agg(F.count(F.lit(1)).alias("turns")))
    return files.content_lock(spark, _written(spark, made, "sources")).select(F.regexp_extract("path", "quern-sources-[0-9a-f]+/(.*)$", 1).alias("path"), "sha256")


def q_upload_checks(spark: SparkSession, sf: str) -> DataFrame:
    checked = uploads.checked_uploads(_uploads(spark, sf))
    return checked.groupBy("status", F.size("files").alias("files")).agg(F.count(F.lit(1)).alias("uploads"))


def _uploads(spark: SparkSession, sf: str) -> DataFrame:
    """A package for each nation, one in three of them wrong in some way."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, name in zip(b.n_nationkey, b.n_name, strict=True):
                if k % 5 == 4:
                    out.append((f"{k}.json", json.dumps({"claims": [{"claim": name}]} if k % 2 else {"x": name}).encode()))
                    continue
                body = io.BytesIO()
                with zipfile.ZipFile(body, "w") as z:
                    z.writestr("../up.html" if k % 5 == 1 else f"f/{k}.html", f"<p>{name}</p>")
                    z.writestr("f/image_01.json" if k % 5 != 2 else "f/run.exe", '{"observations": []}')
                out.append((f"{k}.zip", body.getvalue()))
            yield pd.DataFrame(out, columns=["path", "content"])

    return stored(load(spark, sf, "nation").select("n_nationkey", "n_name").mapInPandas(make, "path string, content binary"), "uploads")


def q_landed(spark: SparkSession, sf: str) -> DataFrame:
    """Approved packages land file by file, each in its folder."""
    rows = _uploads(spark, sf)
    approved = stored(uploads.checked_uploads(rows).where("status = 'pending'").select("submission_id"), "approved")
    out = stored(uploads.landed(rows, approved, _folder(spark, "landed")), "filed")
    return out.select(F.substring_index("path", "/", -1).alias("name"), "sha256", "size_bytes", "outcome")


def q_recorded_provider(spark: SparkSession, sf: str) -> DataFrame:
    pairs = _scored(spark, sf).where("hard_guard IS NULL AND total_score >= 0.45")
    return providers.provider("recorded").adjudicate(pairs).select("l_id", "r_id", "decision", F.round("confidence", 6).alias("confidence"))


def q_recorded_audit(spark: SparkSession, sf: str) -> DataFrame:
    pairs = _scored(spark, sf).where("hard_guard IS NULL AND total_score >= 0.45")
    runs = providers.provider("recorded").runs(pairs)
    return runs.groupBy("status", "decision").agg(F.count(F.lit(1)).alias("calls"), F.count_distinct("request_hash").alias("requests"), F.sum("tokens_in").alias("tokens"))


def _judge(request: str) -> str:
    said = json.loads(request)
    if float(said["time_score"]) == 0.0 and "repair" not in said:
        return '{"decision": "maybe"}'
    return json.dumps({"decision": "same_incident" if float(said["total_score"]) >= 0.7 else "uncertain", "confidence": 0.9, "tokens_in": 100, "tokens_out": 10})


def q_live_provider(spark: SparkSession, sf: str) -> DataFrame:
    """A service asked for each pair; wrong answers are repaired; a second run finds all in the cache."""
    pairs = stored(_scored(spark, sf, barred=False).where("hard_guard IS NULL AND total_score >= 0.45"), "pairs")
    first = stored(providers.Live(_judge, most_calls=10**9, pause=0.0).runs(pairs), "runs")
    cached = providers.Live(_judge, cache=first, most_calls=0, pause=0.0)
    return cached.adjudicate(pairs).select("l_id", "r_id", "decision", "confidence")


def q_live_audit(spark: SparkSession, sf: str) -> DataFrame:
    pairs = stored(_scored(spark, sf, barred=False).where("hard_guard IS NULL AND total_score >= 0.45"), "pairs")
    live = providers.Live(_judge, most_calls=10**9, pause=0.0)
    runs = stored(live.runs(pairs), "runs")
    return runs.groupBy("status", "retries").agg(F.count(F.lit(1)).alias("calls"), F.sum("tokens_in").alias("tokens_in")).join(F.broadcast(live.cost(runs).select(F.round("cost", 6).alias("cost"))))


def _teller(request: str) -> str:
    said = json.loads(request)
    return json.dumps({"title": "T " + said["kind"], "place": said["kind"], "lat": 1.0, "lon": 2.0, "confidence": 0.6, "tokens_in": 10, "tokens_out": 1})


def q_live_fusion(spark: SparkSession, sf: str) -> DataFrame:
    """Records told by a service, held to the places that their mentions tell: coordinates without one go."""
    from quern.operators.fusing import reconciled

    i = _incidents(spark, sf)
    bundles = i.select(F.col("o_orderkey").cast("string").alias("incident_id"), F.to_json(F.struct("kind")).alias("request"))
    told = stored(providers.Live(_teller, most_calls=10**9, pause=0.0).fuse(bundles), "told")
    own = i.where("lat IS NOT NULL").select(F.col("o_orderkey").cast("string").alias("incident_id"), F.col("kind").alias("name"), F.lit("city").alias("granularity"), "lat", "lon", F.lit(0.4).alias("confidence"))
    return reconciled(told, own, "incident_id").select("incident_id", "place", F.coalesce("lat", F.lit(-999.0)).alias("lat"), "confidence", "method")


_NF = "nf AS (SELECT n_nationkey AS k, r_regionkey || '/' || n_nationkey || (['/page.html', '/video.json', '/image_01.json', '/notes.txt'])[n_nationkey % 4 + 1] AS path, '<p>' || n_name || '</p>' AS content FROM nation JOIN region ON n_regionkey = r_regionkey)"
_PAIRS = f"WITH {MENTIONS}, p AS (SELECT * FROM scored WHERE hard_guard IS NULL AND total_score >= 0.45)"
QUERIES = {
    "video_evidence": (q_video_evidence, r"""WITH e AS (SELECT 'v' || conv_id AS source_id, 'claim' AS evidence_kind, CASE WHEN turn % 3 = 0 THEN 'observed' ELSE 'reported' END AS assertion_type, '$.claims[' || (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) || ']' AS locator, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t, role AS claimant, CASE WHEN turn % 2 = 0 THEN 0.9::DOUBLE ELSE 0.3::DOUBLE END AS extraction_confidence, -1 AS fatalities, '' AS vehicles, '' AS places FROM conversations
        UNION ALL SELECT DISTINCT 'v' || conv_id, 'traffic_incident', 'reported', '$.traffic_incidents[0]', 'collision; road ' || conv_id || '; fatalities=2', '', 0.5::DOUBLE, 2, 'bus', 'road ' || conv_id FROM conversations
        UNION ALL SELECT DISTINCT 'v' || conv_id, 'sentiment', 'opinion', '$.sentiment_analysis.aspect_sentiments[0]', 'angry ' || conv_id, '', 0.5::DOUBLE, -1, '', '' FROM conversations) SELECT source_id, evidence_kind, assertion_type, locator, sha256(t) AS claim, claimant, extraction_confidence, fatalities, vehicles, places FROM e WHERE t <> ''"""),
    "image_evidence": (q_image_evidence, """SELECT 'i' || c_custkey AS source_id, 'visual_observation' AS evidence_kind, 'observed' AS assertion_type, '$.observations[0]' AS locator, 'saw ' || c_name AS claim_text, 0.65::DOUBLE AS extraction_confidence, '' AS places FROM customer UNION ALL SELECT 'i' || c_custkey, 'inference', 'inferred', '$.inferences[0]', c_mktsegment, 0.5::DOUBLE, '' FROM customer
        UNION ALL SELECT 'i' || c_custkey, 'location', 'reported', '$.location_evidence', CASE WHEN c_custkey % 2 = 0 THEN 'Old Town, ' ELSE '' END || 'City, ' || c_nationkey, 0.5::DOUBLE, CASE WHEN c_custkey % 2 = 0 THEN 'Old Town,' ELSE '' END || 'City,' || c_nationkey FROM customer"""),
    "sidecars": (q_sidecars, f"""WITH {TITLES} SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'https://' || host || '/x' ELSE 'https://www.' || host || '/y' END AS uri, host AS publisher, CASE WHEN page_id % 2 = 0 THEN lang ELSE lang || ',en-GB' END AS languages, CASE WHEN page_id % 4 = 0 THEN 'Asia/Dhaka' ELSE '' END AS timezone,
        CASE WHEN page_id % 6 = 0 THEN 'BGD' ELSE '' END AS country_code, page_id % 2 = 0 AS incident, CASE WHEN page_id % 2 = 0 THEN '' ELSE 'strasse,b' END AS keywords, CASE WHEN page_id % 2 = 0 THEN 1 + (page_id % 4 <> 0)::INT + (page_id % 3 <> 0)::INT ELSE 0 END::INT AS warnings FROM titles"""),
    "file_scan": (q_file_scan, f"WITH {_NF} SELECT path, CASE k % 4 WHEN 0 THEN 'html' WHEN 1 THEN 'video_analysis' ELSE 'image_analysis' END AS kind, length(content)::BIGINT AS size_bytes, sha256(content) AS sha256 FROM nf WHERE k % 4 <> 3"),
    "content_lock": (q_content_lock, f"WITH {_NF} SELECT path, sha256(content) AS sha256, length(content)::BIGINT AS size_bytes FROM nf WHERE k % 5 <> 0"),
    "materialized": (q_materialized, f"WITH {_NF} SELECT path, 'written' AS outcome, 1 AS round FROM nf WHERE k % 6 <> 0 AND k % 2 = 0 UNION ALL SELECT CASE WHEN k % 7 = 0 THEN '../' ELSE '' END || path, CASE WHEN k % 7 = 0 THEN 'unsafe' WHEN k % 4 = 0 THEN 'conflict' WHEN k % 2 = 0 THEN 'same' ELSE 'written' END, 2 FROM nf WHERE k % 6 <> 0"),
    "artifact_check": (q_artifact_check, f"WITH {_NF} SELECT CASE WHEN k % 5 = 0 THEN '/' ELSE '' END || path AS path, CASE WHEN k % 5 = 0 THEN 'unsafe' WHEN k % 3 = 0 THEN 'missing' WHEN k % 2 = 0 THEN 'ok' ELSE 'changed' END AS status, CASE WHEN k % 5 = 0 OR k % 3 = 0 THEN -1 ELSE length(content) END::BIGINT AS size_bytes FROM nf"),
    "removed_files": (q_removed_files, f"WITH {_NF} SELECT path, CASE WHEN k % 2 = 0 THEN 'removed' ELSE 'absent' END AS outcome FROM nf"),
    "json_lines": (q_json_lines, """SELECT '{"a":null,"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || '}' AS line, (SELECT count(*) + count(*) FILTER (n_nationkey < 5) FROM nation)::INT AS rows FROM nation UNION ALL SELECT '{"a":"again","n_name":"' || n_name || '","n_nationkey":' || n_nationkey || '}', (SELECT count(*) + count(*) FILTER (n_nationkey < 5) FROM nation)::INT FROM nation WHERE n_nationkey < 5"""),
    "rewritten_ledger": (q_rewritten_ledger, "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey % 3 <> 0"),
    "staged_recompute": (q_staged_recompute, "SELECT r_regionkey, r_name, 1 AS refused FROM region"),
    "csv_sink": (q_csv_sink, """SELECT '"' || s_suppkey || '","' || s_name || ' ""x"", y"' AS line FROM supplier"""),
    "canonical_json": (q_canonical_json, """SELECT s_suppkey, '{"a_nation":' || coalesce(CASE WHEN s_nationkey > 5 THEN s_nationkey END::VARCHAR, 'null') || ',"s_name":"' || s_name || '","s_suppkey":' || s_suppkey || '}' AS json FROM supplier"""),
    "document_default": (q_document_default, "SELECT r_regionkey AS k, r_name AS name FROM region"),
    "strict_rows": (q_strict_rows, "SELECT 'reviews/' || n_regionkey || '.jsonl:' || row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS \"where\", CASE n_nationkey % 4 WHEN 0 THEN 'row' WHEN 1 THEN 'not_valid' WHEN 2 THEN 'unknown_field' ELSE 'missing_field' END AS code, CASE WHEN n_nationkey % 4 = 0 THEN n_nationkey ELSE -1 END AS k FROM nation"),
    "country_profiles": (q_country_profiles, "SELECT upper(p) || lpad(n_nationkey::VARCHAR, 2, '0') AS country_code, n_name AS name, n_nationkey + 0.5::DOUBLE AS lat, n_regionkey::DOUBLE AS lon, 'en,x' || n_regionkey AS languages FROM nation, (VALUES ('a'), ('b')) v(p)"),
    "article_search": (q_article_search, r"""WITH n AS (SELECT n_nationkey, lower(regexp_replace(n_name, '[^A-Za-z]', '', 'g')) AS s FROM nation), k AS (SELECT unnest(range(0, 6)) AS k), a AS (SELECT 'N' || lpad(n_nationkey::VARCHAR, 2, '0') AS country_iso2, 'https://' || s || (k % 3) || '.example/a?k=' || (k % 4) AS url, s || ' ' || k AS title, s || (k % 3) || '.example' AS domain, k FROM n, k)
        SELECT country_iso2, url, title, domain FROM a QUALIFY row_number() OVER (PARTITION BY country_iso2, url ORDER BY k) = 1"""),
    "feed_items": (q_feed_items, """SELECT n_regionkey::VARCHAR AS country_iso2, 'https://p' || (n_nationkey % 7) || '.example/x' AS url, 'p' || (n_nationkey % 7) || '.example' AS domain, n_name AS title, strftime(TIMESTAMP '2023-12-31 18:00:00' + to_hours((n_nationkey % 10)::INT), '%Y-%m-%dT%H:%M:%SZ') AS published_at FROM nation QUALIFY row_number() OVER (PARTITION BY n_regionkey, n_nationkey % 7 ORDER BY n_nationkey % 2, n_nationkey) = 1"""),
    "capture_outcomes": (q_capture_outcomes, rf"""WITH {TITLES}, u AS (SELECT page_id AS k, CASE WHEN page_id % 17 = 0 THEN '10.0.0.1' ELSE host END AS h FROM titles), r AS (SELECT *, list_sum(list_transform(string_split(h, ''), lambda c: ascii(c))) % 4 AS rule FROM u),
        o AS (SELECT *, CASE WHEN k % 13 = 0 OR k % 17 = 0 THEN 'bad' WHEN rule = 1 OR (rule = 2 AND k % 3 = 0) THEN 'robots' WHEN k % 11 = 0 THEN 'failed' WHEN k % 7 = 0 THEN 'gone' WHEN k % 5 = 0 THEN 'raw' ELSE 'ok' END AS x FROM r)
        SELECT CASE WHEN k % 13 = 0 THEN 'ftp' ELSE 'https' END || '://' || h || CASE WHEN k % 3 = 0 THEN '/private/' ELSE '/x/' END || k AS url, CASE x WHEN 'ok' THEN 'captured' WHEN 'robots' THEN 'robots_denied' WHEN 'failed' THEN 'failed' ELSE 'rejected' END AS outcome, CASE x WHEN 'ok' THEN 200 WHEN 'raw' THEN 200 WHEN 'gone' THEN 410 ELSE -1 END AS status, CASE WHEN x = 'ok' THEN length('<p>' || k || '</p>') ELSE -1 END::INT AS chars FROM o"""),
    "snapshots": (q_snapshots, "WITH c AS (SELECT page_id, url, html, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)) AS h, lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) AS s, regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) AS p, list_sort(list_filter(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(lower(x), '^(utm_[^=]*|fbclid|gclid|mc_cid|mc_eid|ref|ref_src)(=|$)'))) AS q FROM pages) SELECT s || '://' || h || CASE WHEN p = '' THEN '/' ELSE p END || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS canonical_url, regexp_replace(h, '^www\\.', '') AS domain, sha256(html) AS content_sha256, true AS short, false AS active FROM c"),
    "schemas": (q_schemas, "SELECT 'region' AS name, 'r_regionkey integer, r_name string' AS fields UNION ALL SELECT 'nation', 'n_nationkey integer, n_name string, n_regionkey integer'"),
    "source_files": (q_source_files, """WITH m AS (SELECT conv_id, string_agg(CASE WHEN turn = 0 THEN '## ' ELSE '' END || text, chr(10) || chr(10) ORDER BY turn) AS md, count(*) AS n FROM conversations GROUP BY conv_id)
        SELECT conv_id || '/content.md' AS path, sha256(md) AS sha256 FROM m UNION ALL SELECT conv_id || '/source.json', sha256('{"source_id":' || conv_id || ',"turns":' || n || '}') FROM m"""),
    "upload_checks": (q_upload_checks, "SELECT status, files, count(*) AS uploads FROM (SELECT CASE WHEN n_nationkey % 5 IN (0, 3) THEN 'pending' WHEN n_nationkey % 5 = 4 AND n_nationkey % 2 = 1 THEN 'pending' ELSE 'invalid' END AS status, CASE WHEN n_nationkey % 5 IN (0, 3) THEN 2 WHEN n_nationkey % 5 = 4 AND n_nationkey % 2 = 1 THEN 1 ELSE 0 END::INT AS files FROM nation) GROUP BY ALL"),
    "landed": (q_landed, """WITH n AS (SELECT n_nationkey AS k, n_name FROM nation), f AS (SELECT k || '.html' AS name, '<p>' || n_name || '</p>' AS c FROM n WHERE k % 5 IN (0, 3) UNION ALL SELECT 'image_01.json', '{"observations": []}' FROM n WHERE k % 5 IN (0, 3) UNION ALL SELECT 'video.json', '{"claims": [{"claim": "' || n_name || '"}]}' FROM n WHERE k % 5 = 4 AND k % 2 = 1)
        SELECT name, sha256(c) AS sha256, length(c)::BIGINT AS size_bytes, 'written' AS outcome FROM f"""),
    "recorded_provider": (q_recorded_provider, f"{_PAIRS} SELECT l_id, r_id, CASE WHEN (location_score = 1 AND time_score >= 0.65) OR (lexical_score >= 0.3 AND total_score >= 0.6) THEN 'same_incident' ELSE 'uncertain' END AS decision, round(CASE WHEN (location_score = 1 AND time_score >= 0.65) OR (lexical_score >= 0.3 AND total_score >= 0.6) THEN greatest(total_score, 0.82::DOUBLE) ELSE total_score END, 6) AS confidence FROM p"),
    "recorded_audit": (q_recorded_audit, f"{_PAIRS} SELECT 'ok' AS status, CASE WHEN (location_score = 1 AND time_score >= 0.65) OR (lexical_score >= 0.3 AND total_score >= 0.6) THEN 'same_incident' ELSE 'uncertain' END AS decision, count(*) AS calls, count(*) AS requests, 0::BIGINT AS tokens FROM p GROUP BY 2"),
    "live_provider": (q_live_provider, f"{_PAIRS} SELECT l_id, r_id, CASE WHEN total_score >= 0.7 THEN 'same_incident' ELSE 'uncertain' END AS decision, 0.9::DOUBLE AS confidence FROM p"),
    "live_audit": (q_live_audit, f"{_PAIRS}, a AS (SELECT CASE WHEN time_score = 0 THEN 1 ELSE 0 END AS retries FROM p) SELECT 'ok' AS status, retries, count(*) AS calls, 100 * count(*) AS tokens_in, round((SELECT count(*) FROM a) * (100 * 0.27::DOUBLE + 10 * 1.1::DOUBLE) / 1000000, 6) AS cost FROM a GROUP BY retries"),
    "live_fusion": (q_live_fusion, f"WITH {INCIDENTS} SELECT o_orderkey::VARCHAR AS incident_id, kind AS place, coalesce(lat, -999) AS lat, CASE WHEN lat IS NULL THEN 0 ELSE 0.4::DOUBLE END AS confidence, CASE WHEN lat IS NULL THEN 'unresolved; ungrounded coordinates discarded' ELSE 'source_named_offline_gazetteer_centroid' END AS method FROM i"),
}
