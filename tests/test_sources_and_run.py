import io
import json
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from quern.plans import corpus_build, pipeline, providers
from quern.sources import feeds, files, media, metadata, sinks, snapshots
from quern.streaming import uploads


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("in") / "scraps"
    page = "<html><h1>{}</h1><p>{}</p><script>no</script></html>"
    for name, title, text in (
        ("a", "Bus crash at North Ryde leaves two dead", "A bus crash at North Ryde: 2 people were killed and 5 injured."), ("b", "North Ryde collision", "Collision in north ryde, 3 people were killed."),
        ("c", "Harbour bridge crash", "A truck crash on the bridge on 1 December 2025, four injured."), ("d", "Cooking with rice", "Rice is nice."),
    ):
        d = root / name
        d.mkdir(parents=True)
        (d / "page.html").write_text(page.format(title, text))
        (d / "SOURCE_INFO.md").write_text(f'---\nlanguages: ["en"]\ncountry_code: au\ntimezone: {"Nowhere/X" if name == "d" else "Australia/Sydney"}\npublished_at: 2026-08-10T08:00:00\n---\nSource name: Paper {name}\nhttps://{name}.example/x')
    (root / "a" / "image_1.json").write_text(json.dumps({"observations": [{"observation": "a bus on its side", "confidence": "high"}], "location_evidence": {"area": "North Ryde", "country": "Australia"}}))
    (root / "note.txt").write_text("x")
    return str(root)


def test_scan(spark, folder):
    got = files.scan(spark, folder).collect()
    assert [(r.path, r.kind, r.sidecar, r.parent) for r in got][:2] == [("a/image_1.json", "image_analysis", "a/SOURCE_INFO.md", "a/page.html"), ("a/page.html", "html", "a/SOURCE_INFO.md", None)]
    assert len(got) == 5 and all(len(r.sha256) == 64 and r.warnings == [] for r in got)
    assert files.scan(spark, folder, most_bytes=10).where("size(warnings) = 1").count() == 5
    assert files.content_lock(spark, folder).count() == 10


def test_sidecars(spark, folder):
    got = {r.path.split("/")[-2]: r for r in metadata.read_sidecars(spark, folder).collect()}
    assert (got["a"].publisher, got["a"].country_code, got["a"].timezone, got["a"].uri) == ("Paper a", "AU", "Australia/Sydney", "https://a.example/x")
    assert got["d"].timezone is None and got["d"].warnings == ["Invalid timezone: Nowhere/X"]
    said = metadata.parse_sidecar('{"x": {"languages": "en, b@d", "traffic_incident": true, "secret": 1}} https://www.p.example/a')
    assert (said["languages"], said["traffic_incident"], said["publisher"]) == (["en"], True, "p.example") and len(said["warnings"]) == 1


def test_media(spark):
    doc = {
        "claims": [{"claim": " a  claim ", "confidence": 2, "evidence_type": "alleged"}, "skip", {"claim": ""}], "traffic_incidents": [{"location": "X road", "fatalities": 0, "vehicles": [{"vehicle_type": "bus"}, {}]}],
        "sentiment_analysis": {"aspect_sentiments": [{"aspect": "delay", "confidence": "low"}]}, "odd": 1,
    }
    got = media.media_evidence(spark.createDataFrame([("s", json.dumps(doc)), ("t", "not json")], "source_id string, json string"), "video")
    assert [(r.locator, r.claim_text, r.assertion_type, r.extraction_confidence, r.vehicles, r.casualties.fatalities) for r in got.orderBy("locator").collect()] == [
        ("$.claims[0]", "a claim", "attributed_claim", 1.0, [], None), ("$.sentiment_analysis.aspect_sentiments[0]", "delay", "opinion", 0.35, [], None), ("$.traffic_incidents[0]", "X road; fatalities=0", "reported", 0.5, ["bus"], 0),
    ]
    image = media.media_evidence(spark.createDataFrame([("s", json.dumps({"location_evidence": {"city": "C", "country": "D"}, "inferences": [{"inference": "wet"}]}))], "source_id string, json string"), "image")
    assert [(r.evidence_kind, r.claim_text, r.assertion_type, r.location_mentions) for r in image.orderBy("locator").collect()] == [("inference", "wet", "inferred", []), ("location", "C, D", "reported", ["C", "D"])]


def test_run_from_folder_to_incidents(spark, folder, tmp_path):
    aliases = spark.createDataFrame([("north ryde", "ryde", "north", 30, 1), ("bridge", "bridge", None, 5, 2)], "alias string, anchor string, family string, priority int, ord int")
    countries = spark.createDataFrame([("AU", "AUS", "Australia", -25.0, 133.0)], "country_code string, iso3 string, name string, lat double, lon double")
    result = pipeline.run(spark, folder, aliases, countries)
    got = {tuple(i.source_ids): i for i in result.incidents.collect()}
    title = {r.source_id: r.title for r in result.mentions.collect()}
    merged = next(i for s, i in got.items() if len(s) >= 2)
    assert {title[s] for s in merged.source_ids} >= {"Bus crash at North Ryde leaves two dead", "North Ryde collision"}
    assert merged.severity == "high" and [f for f in merged.facts if f.field == "fatalities"][0].contradiction
    assert len(got) == 2 and result.issues.count() == 0
    s = pipeline.summary(result).first()
    assert (s.manifest, s.incidents, s.status) == (5, 2, "completed")
    pipeline.write_run(result, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out" / "incidents")).count() == 2
    assert "vs" in sinks.incident_markdown(result.incidents).where(F.size("source_ids") >= 2).first().markdown


def test_live_provider(spark, tmp_path):
    pairs = spark.createDataFrame([(1, 2, 1.0, 1.0, 0.0, 0.7, None), (3, 4, 0.1, 0.0, 0.0, 0.5, None)], "l_id long, r_id long, time_score double, location_score double, lexical_score double, total_score double, hard_guard string")

    def ask(request):
        if json.loads(request)["left"] == "3":
            return '{"decision": "maybe"}'
        return '{"decision": "same_incident", "confidence": 0.9, "tokens_in": 1000000, "tokens_out": 0}'

    live = providers.provider("live", ask=ask, retries=1, pause=0, repairs=2)
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    runs = live.runs(pairs).cache()
    assert sorted((r.status, r.retries) for r in runs.collect()) == [("failed", 1), ("ok", 0)]
    assert live.cost(runs).first().cost == 0.27
    assert rows(live.adjudicate(pairs).select("l_id", "decision", "confidence"), "l_id") == [(1, "same_incident", 0.9), (3, "uncertain", 0.5)]
    assert providers.Live(ask, cache=runs, pause=0, retries=0).runs(pairs).count() == 1
    with pytest.raises(ValueError, match="more than"):
        providers.Live(ask, most_calls=1).runs(pairs)
    assert rows(providers.provider("recorded").adjudicate(pairs).select("l_id", "decision"), "l_id") == [(1, "same_incident"), (3, "uncertain")]


def test_live_provider_repairs_and_keeps_to_its_budget(spark):
    def ask(request):
        body = json.loads(request)
        if "repair" not in body:
            return '{"title": "T", "confidence": 0.5, "lat": 1.0}'
        assert "half a coordinate" in body["repair"]
        return '{"title": "T", "place": "P", "confidence": 0.5, "lat": 1.0, "lon": 2.0, "tokens_in": 3}'

    bundles = spark.createDataFrame([("i1", '{"x": 1}')], "incident_id string, request string")
    assert tuple(providers.Live(ask, pause=0).fuse(bundles).first())[1:] == ("T", "P", 1.0, 2.0, 0.5, 3, 0, 1, "ok", None)
    assert providers.Live(ask, pause=0, repairs=0).fuse(bundles).first().status == "failed"
    with pytest.raises(ValueError, match="budget"):
        providers.Live(ask, budget=0.01, spent=0.0095).fuse(bundles)


def test_files_below_a_folder(spark, tmp_path):
    root = str(tmp_path / "out")
    df = spark.createDataFrame([("a/x.txt", b"1"), ("../y", b"2"), ("b.txt", b"3")], "path string, content binary")
    outcome = lambda d: {r.path: r.outcome for r in sinks.write_files(d, root).collect()}
    assert outcome(df) == {"a/x.txt": "written", "../y": "unsafe", "b.txt": "written"}
    assert outcome(df.withColumn("content", F.lit(b"3"))) == {"a/x.txt": "conflict", "../y": "unsafe", "b.txt": "same"}
    (tmp_path / "secret").write_text("s")
    (tmp_path / "out" / "link").symlink_to(tmp_path / "secret")
    asked = spark.createDataFrame([("a/x.txt", None), ("link", None), ("none", None), ("b.txt", "0"), ("/etc/passwd", None)], "path string, sha256 string")
    assert {r.path: r.status for r in files.artifacts(asked, root).collect()} == {"a/x.txt": "ok", "link": "unsafe", "none": "missing", "b.txt": "changed", "/etc/passwd": "unsafe"}
    assert {r.path: r.outcome for r in sinks.remove_files(df, root).collect()} == {"a/x.txt": "removed", "../y": "unsafe", "b.txt": "removed"}


def test_strict_rows(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text('{"a": 1, "b": "x"}\nbad\n\n{"a": 2, "c": 3}\n{"b": "y"}\n')
    found, issues = files.strict_rows(spark, str(tmp_path), "*.jsonl", "a int, b string", ["a"], lines=True)
    assert rows(found) == [("r.jsonl:1", 1, "x")]
    assert rows(issues, "where") == [("r.jsonl:2", "not_valid"), ("r.jsonl:4", "unknown_field"), ("r.jsonl:5", "missing_field")]


def test_corpus_build(spark):
    made = []
    for c in ("AA", "BB", "CC"):
        for k in range(4 if c == "CC" else 12):
            made.append((c, f"https://d{k % 5}.example/{c}{k}", f"t{c}{k}", "e", f"d{k % 5}.example", ["en"], "captured", "key" if k in (1, 2) else None, 0.5 if k in (1, 2) else None))
    candidates = spark.createDataFrame(made, "country_iso2 string, canonical_url string, title string, excerpt string, domain string, languages array<string>, access_status string, incident_key string, pair_confidence double")
    countries = spark.createDataFrame([("AA",), ("BB",), ("CC",)], "iso2 string")
    corpus = corpus_build.build(candidates, countries)
    assert corpus.sources.count() == 24
    assert rows(corpus.incidents.select("incident_id", F.size("source_ids")), "incident_id") == [("AA-001", 2), ("BB-001", 2), ("CC-001", 2)]
    assert rows(corpus.issues) == [("source_quota", "CC", "4")]
    reviews = corpus.sources.select("source_id", F.lit("accepted").alias("decision"), F.lit(1).alias("reviewed_at")).union(corpus.sources.where("country_iso2 = 'AA'").select("source_id", F.lit("rejected"), F.lit(2)))
    kept, leaks = corpus_build.accepted(corpus.sources, reviews, spark.createDataFrame([(1, "tBB3 e")], "item_id long, text string"))
    assert kept.count() == 14 and leaks.count() == 1


def test_article_search(spark):
    def fetch(url, headers):
        rows_ = [{"url": "https://a.example/x?utm_source=1", "title": "first"}, {"url": "https://a.example/x", "title": "second"}, {"url": "ftp://no"}, "odd"]
        return 200, json.dumps({"articles": rows_}).encode()

    source = type("Fake", (feeds.ArticleSource,), {"fetch": staticmethod(fetch)})
    spark.dataSource.register(source)
    df = spark.read.format("article_search").option("endpoint", "https://s.example").option("countries", json.dumps([["US", "United States", ["road accident"]], ["CA", "Canada", []]])).load()
    assert rows(feeds.discovered(df).select("country_iso2", "url", "title"), "country_iso2") == [("CA", "https://a.example/x", "first"), ("US", "https://a.example/x", "first")]
    assert feeds.search_query("United States", ["road accident", "crash"]) == '("road accident" OR crash) sourcecountry:unitedstates'


def test_capture_rules(spark):
    def fetch(url, headers):
        host, _, path = url.split("//")[1].partition("/")
        if path == "robots.txt":
            return {"open": (404, b""), "closed": (500, b""), "rules": (200, b"User-agent: *\nDisallow: /private")}[host.split(".")[0]]
        if path == "boom":
            raise OSError("no route")
        return (200, b"<p>x</p>" if path != "raw" else b"x" * 10) if path != "gone" else (410, b"")

    urls = spark.createDataFrame([(f"https://{u}",) for u in ("open.example/a", "open.example/gone", "open.example/boom", "closed.example/a", "rules.example/a", "rules.example/private/x", "open.example/raw", "127.0.0.1/a")], "url string")
    got = {r.url.split("//")[1]: r.outcome for r in feeds.captured(urls, fetch).collect()}
    assert got == {"open.example/a": "captured", "open.example/gone": "rejected", "open.example/boom": "failed", "closed.example/a": "robots_denied", "rules.example/a": "captured", "rules.example/private/x": "robots_denied", "open.example/raw": "rejected", "127.0.0.1/a": "rejected"}
    assert {bytes(r.content) for r in feeds.captured(urls, fetch).where("outcome = 'captured'").collect()} == {b"<p>x</p>"}


def test_sinks_and_publishing(spark, tmp_path):
    df = spark.createDataFrame([(1, None, 'say "x"')], "b int, a string, c string")
    sinks.write_lines(df, str(tmp_path / "l"))
    assert spark.read.text(str(tmp_path / "l")).first()[0] == '{"a":null,"b":1,"c":"say \\"x\\""}'
    sinks.write_csv(df.coalesce(1), str(tmp_path / "c"))
    assert rows(spark.read.text(str(tmp_path / "c"))) == [('"b","a","c"',), ('"1","","say ""x"""',)]
    for k in (1, 2):
        sinks.publish(spark.range(k), str(tmp_path / "p"), "t")
    assert sinks.published(spark, str(tmp_path / "p"), "t").count() == 2
    feature = spark.createDataFrame([('{"type":"Feature"}',), (None,)], "f string")
    assert json.loads(sinks.feature_collection(feature, "f"))["features"] == [{"type": "Feature"}]
    with pytest.raises(ValueError, match="more than"):
        sinks.feature_collection(feature, "f", most=0)
    (tmp_path / "x.jsonl").write_text('{"a": 1}\nbad\n')
    assert files.read_lines(spark, str(tmp_path / "x.jsonl"), "a int", strict=False).count() == 2
    with pytest.raises(Exception, match="(?i)malformed|failfast"):
        files.read_lines(spark, str(tmp_path / "x.jsonl"), "a int").collect()
    assert files.read_document(spark, str(tmp_path / "none.json"), "a int").count() == 0


def test_profiles_and_feed(spark, tmp_path):
    (tmp_path / "c.toml").write_text('[[countries]]\niso2 = "us"\niso3 = "usa"\nname = "U"\ncoverage_centroid = { latitude = 1.5, longitude = 2 }\nlanguages = ["en"]\n')
    assert rows(metadata.by_either_code(metadata.country_profiles(spark, str(tmp_path / "c.toml"))).select("country_code", "lat"), "country_code") == [("US", 1.5), ("USA", 1.5)]
    (tmp_path / "f.xml").write_text("<rss><channel><item><title>T</title><link>https://a.example</link><pubDate>Mon, 01 Jan 2024 00:00:00 GMT</pubDate></item></channel></rss>")
    assert feeds.read_feed(spark, str(tmp_path / "f.xml")).first().title == "T"


def test_snapshots(spark):
    html = b'<html><head><link rel="canonical" href="/a?utm_source=x"><meta property="article:published_time" content="2026-01-02"><title>T</title></head><body><nav>menu</nav><article onclick="x()"><h1>Head  line</h1><p class="q">Text &amp; more</p><script>evil()</script></article></body></html>'
    rows_ = [("AA", "https://p.example/x", html), ("AA", "https://q.example/y", b'<link rel="canonical" href="https://other.example/z"><nav>only menu</nav>')]
    got = {r.domain: r for r in snapshots.snapshots(spark.createDataFrame(rows_, "country_iso2 string, url string, html binary")).collect()}
    p, q = got["p.example"], got["q.example"]
    assert (p.canonical_url, p.title, p.published_at, p.excerpt) == ("https://p.example/a", "Head line", "2026-01-02", "Head line Text & more")
    assert "evil" not in p.clean_html and "onclick" not in p.clean_html and "menu" not in p.clean_html and "Text &amp; more" in p.clean_html
    assert (q.canonical_url, q.status) == ("https://q.example/y", "empty")
    assert snapshots.shortened("aaa bbb ccc", 8) == "aaa bbb…" and "&lt;" in snapshots.evidence_stub("<t>", "x")


def test_uploads(spark, tmp_path):
    def archive(files_):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for name, content in files_.items():
                z.writestr(name, content)
        return out.getvalue()

    cases = {
        "ok.zip": archive({"f/page.html": "<p>x", "f/image_01.json": '{"observations": []}'}), "two.zip": archive({"a.html": "x", "b.html": "y"}), "up.zip": archive({"../a.html": "x"}), "odd.zip": archive({"a.html": "x", "run.exe": "y"}),
        "bad.zip": b"nope", "v.json": b'{"claims": []}', "w.json": b'{"x": 1}', "t.txt": b"x", "img.zip": archive({"a.html": "x", "image_01.json": "{}"}),
    }
    df = spark.createDataFrame(list(cases.items()), "path string, content binary")
    got = {cases_name: uploads.check_upload(cases_name, payload)[0] for cases_name, payload in cases.items()}
    assert {k for k, v in got.items() if v == "pending"} == {"ok.zip", "v.json"}
    assert uploads.checked_uploads(df).where("status = 'pending'").count() == 2
    layers = uploads.layered(spark.createDataFrame([("p", 1), ("q", 1)], "path string, v int"), spark.createDataFrame([("q", 2)], "path string, v int"))
    assert rows(layers, "path") == [("p", 1), ("q", 2)]
    root = str(tmp_path / "r")
    uploads.recompute(spark, root, "t", lambda: spark.range(3), lambda d: d.where("id > 5"))
    with pytest.raises(ValueError, match="not published"):
        uploads.recompute(spark, root, "t", lambda: spark.range(9), lambda d: d.where("id > 5"))
    assert sinks.published(spark, root, "t").count() == 3


def test_commands(spark, folder, tmp_path, capsys):
    from quern.__main__ import main, password_hash, password_matches

    (tmp_path / "a.csv").write_text("alias,anchor,family,priority,ord,display,granularity,lat,lon,radius_km\nnorth ryde,ryde,north,30,1,North Ryde,city,-33.8,151.1,\nbridge,bridge,,5,2,,,,,\n")
    (tmp_path / "c.toml").write_text('[[countries]]\niso2 = "AU"\niso3 = "AUS"\nname = "Australia"\ncoverage_centroid = { latitude = -25.0, longitude = 133.0 }\n')
    out = str(tmp_path / "run")
    main(["run", folder, out, str(tmp_path / "a.csv"), str(tmp_path / "c.toml")])
    merged = spark.read.parquet(f"{out}/incidents").where(F.size("source_ids") >= 2).first()
    assert (merged.place, merged.granularity, merged.lat, merged.radius_km, merged.method) == ("North Ryde", "city", -33.8, 12.0, "source_named_offline_gazetteer_centroid")
    main(["report", out, str(tmp_path / "md")])
    assert "North Ryde" in (tmp_path / "md" / f"{merged.incident_id}.md").read_text()
    main(["map", out, str(tmp_path / "map")])
    assert {json.loads(r[0])["geometry"]["type"] for r in spark.read.text(str(tmp_path / "map")).collect()} == {"Point"}
    main(["schemas", out, str(tmp_path / "schemas")])
    assert spark.read.json(str(tmp_path / "schemas")).count() == 4
    main(["evaluate", "/root/testdata/sf0.001", str(tmp_path / "eval")])
    assert spark.read.json(str(tmp_path / "eval" / "metrics")).count() == 13
    (tmp_path / "cand.jsonl").write_text('{"country_iso2": "AU", "canonical_url": "https://a.example/x", "title": "t", "domain": "b.example", "languages": ["en"], "access_status": "captured"}\n')
    main(["validate", str(tmp_path / "cand.jsonl")])
    main(["build", str(tmp_path / "cand.jsonl"), str(tmp_path / "c.toml"), str(tmp_path / "corpus")])
    assert spark.read.json(str(tmp_path / "corpus" / "sources")).count() == 1
    assert "domain_mismatch: 1" in capsys.readouterr().out
    (tmp_path / "up").mkdir()
    (tmp_path / "up" / "v.json").write_text('{"claims": []}')
    main(["uploads", str(tmp_path / "up")])
    sid = re.search("sub_[0-9a-f]+", capsys.readouterr().out)[0]
    (tmp_path / "ok.txt").write_text(sid + "\n")
    main(["land", str(tmp_path / "up"), str(tmp_path / "ok.txt"), str(tmp_path / "landed")])
    assert (tmp_path / "landed" / sid / "video.json").exists()
    for args in (["scan", folder], ["lock", folder], ["sidecars", folder], ["profiles", str(tmp_path / "c.toml")], ["catalog", "/root/testdata/sf0.001"], ["query", "point_lookup", "/root/testdata/sf0.001"]):
        main(args)
    stored = password_hash("secret")
    assert password_matches("secret", stored) and not password_matches("other", stored) and stored != password_hash("secret")
