import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quern.operators import evidence, fusing, matching, metrics, querying, ranking, validation
from quern.sources import html_pages
from quern.sources.html_pages import read_blocks
from quern.streaming.submissions import transition


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


ALIASES = [("north ryde", "ryde", "north", 30, 1), ("lane cove", "cove", "north", 10, 2), ("bridge", "bridge", None, 5, 3)]


def alias_table(spark):
    return spark.createDataFrame(ALIASES, "alias string, anchor string, family string, priority int, ord int")


def test_best_anchor_of_each_family(spark):
    t = spark.createDataFrame([(1, "Lane Cove and North Ryde near a bridge"), (2, "the lane cove"), (3, "abridge"), (4, None)], "id long, t string")
    assert rows(evidence.matching_anchors(t, "id", "t", alias_table(spark)).select("id", "anchor"), "id", "anchor") == [(1, "bridge"), (1, "ryde"), (2, "cove")]


def test_mentions_split_by_family_and_exclusive_claims(spark):
    e = spark.createDataFrame(
        [("e1", "s1", "both at north ryde and bridge, 16 killed", (16, 48), None, True), ("e2", "s1", "bridge, 7 killed", (7, None), None, True), ("e3", "s2", "somewhere", (1, None), "XX", True), ("e4", "s3", "elsewhere", (2, None), "ZZ", True), ("e5", "s4", "nowhere", (2, None), "XX", False)],
        "evidence_id string, source_id string, normalized_claim string, casualties struct<fatalities: int, injuries: int>, country_code string, incident boolean",
    )
    got = evidence.split_mentions(e, alias_table(spark), spark.createDataFrame([("XX", "XXX")], "country_code string, iso3 string"))
    assert rows(got.select("source_id", "anchor", "evidence_ids", "fatalities", "injuries", "place"), "source_id", "anchor") == [
        ("s1", "bridge", ["e2"], 7, None, "named"), ("s1", "ryde", ["e1"], 16, 48, "named"), ("s2", "country-fallback:XXX", ["e3"], 1, None, "country"), ("s3", "unknown", ["e4"], 2, None, "unknown"),
    ]


def test_block_evidence(spark):
    s = spark.createDataFrame([("s", "pub", ["tram"], False)], "source_id string, publisher string, traffic_keywords array<string>, traffic_incident boolean")
    b = spark.createDataFrame([("b1", "s", "article", "A crash killed ২ people", None), ("b2", "s", "comment", "the TRAM again", "ann"), ("b3", "s", "article", "cake", None), ("b4", "s", "published_time", "crash", None)], "block_id string, source_id string, kind string, text string, author string")
    got = evidence.block_evidence(s, b).select("block_id", "assertion_type", "claim_text", "claimant", "extraction_confidence")
    assert rows(got, "block_id") == [("b1", "reported", "A crash killed 2 people", "pub", 0.82), ("b2", "opinion", "the TRAM again", "ann", 0.65)]


def test_sentiment(spark):
    e = spark.createDataFrame([("e1", "s", "article", "they demand justice", None, 0.82), ("e2", "s", "article", "traffic protest", "x", 0.5), ("e3", "s", "article", "calm", "x", 0.5)], "evidence_id string, source_id string, evidence_kind string, normalized_claim string, claimant string, extraction_confidence double")
    assert rows(evidence.sentiment(e).select("evidence_id", "aspect", "emotion", "confidence"), "evidence_id") == [("e1", "road_safety", "concern", 0.75), ("e2", "congestion_delay", "frustration", 0.5)]


def mention_rows(n, seed):
    rng = random.Random(seed)
    return [(i, f"s{rng.randrange(6)}", rng.choice(["A", "B", None]), rng.choice([None, datetime(2024, 1, 1) + timedelta(hours=rng.randrange(200))]), rng.sample(["p", "q", "r"], rng.randrange(2)), rng.sample(["bus", "car"], rng.randrange(2)), rng.sample([f"t{k}" for k in range(12)], rng.randrange(4)), rng.random() < 0.8) for i in range(n)]


def test_blocking_loses_no_pair(spark, monkeypatch):
    """All pairs by brute force against the pairs from shared keys, with small blocks for hot keys."""
    monkeypatch.setattr(matching, "BLOCK", 7)
    m = mention_rows(80, 1)
    df = spark.createDataFrame(m, "mention_id long, source_id string, country string, event_time timestamp_ntz, locations array<string>, vehicles array<string>, terms array<string>, primary boolean")
    every = spark.createDataFrame([(a[0], b[0]) for a in m for b in m if a[0] < b[0] and a[1] != b[1] and (a[2] is None or b[2] is None or a[2] == b[2])], "l_id long, r_id long")
    pick = lambda d: {tuple(r) for r in matching.scored(d, df).where("hard_guard IS NULL AND total_score >= 0.45").select("l_id", "r_id").collect()}
    assert pick(matching.shared_key_pairs(df)) == pick(every) != set()


def plain_greedy(decisions):
    parent = {x: x for d in decisions for x in d[:2]}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    cannot = {frozenset(d[:2]) for d in decisions if d[2] == "different_incident"}
    for a, b, kind, _ in sorted(decisions, key=lambda d: (-d[3], d[0], d[1])):
        x, y = find(a), find(b)
        if kind == "same_incident" and x != y and not any(frozenset((p, q)) in cannot for p in parent if find(p) == x for q in parent if find(q) == y):
            parent[y] = x
    groups = defaultdict(set)
    for x in parent:
        groups[find(x)].add(x)
    return {frozenset(g) for g in groups.values() if any(d[2] == "same_incident" and g & set(d[:2]) for d in decisions)}


@pytest.mark.parametrize("seed", range(4))
def test_clusters_apart_match_one_global_greedy(spark, seed):
    rng = random.Random(seed)
    pairs = {(min(a, b), max(a, b)) for a, b in ((rng.randrange(40), rng.randrange(40)) for _ in range(70)) if a != b}
    decisions = [(a, b, rng.choice(["same_incident", "same_incident", "different_incident", "uncertain"]), rng.random()) for a, b in sorted(pairs)]
    got = defaultdict(set)
    for node, cluster in rows(matching.constrained_clusters(spark.createDataFrame(decisions, "l_id long, r_id long, decision string, confidence double"))):
        got[cluster].add(node)
    assert {frozenset(g) for g in got.values()} == {g for g in plain_greedy(decisions)}
    assert all(k == min(g) for k, g in got.items())


MENTION = "mention_id long, source_id string, country string, event_time timestamp_ntz, locations array<string>, vehicles array<string>, terms array<string>, primary boolean"


def decisions_over(spark, m, pairs, must=()):
    """Decisions of mentions m over the pairs, with must-links."""
    pair = lambda x: spark.createDataFrame(list(x), "a long, b long")
    return matching.decided(matching.candidates(matching.scored(pairs, spark.createDataFrame(m, MENTION))), pair(must), pair(()))


@pytest.mark.parametrize("seed", range(3))
def test_guards_without_a_shared_key_keep_clusters_apart(spark, seed):
    """Clusters from pairs with shared keys and the mentions, against one greedy over the decisions of all pairs."""
    m = mention_rows(70, seed)
    df = spark.createDataFrame(m, MENTION)
    every = [(a[0], b[0]) for a in m for b in m if a[0] < b[0] and a[1] != b[1] and (a[2] is None or b[2] is None or a[2] == b[2])]
    must = random.Random(seed).sample(every, 8)
    whole = decisions_over(spark, m, spark.createDataFrame(every, "l_id long, r_id long"), must)
    want = plain_greedy([(r.l_id, r.r_id, r.decision, r.confidence) for r in whole.select("l_id", "r_id", "decision", "confidence").collect()])
    keyed = matching.shared_key_pairs(df).union(matching.override_pairs(df, spark.createDataFrame(must, "a long, b long"))).distinct()
    few = decisions_over(spark, m, keyed, must).checkpoint()
    got = defaultdict(set)
    for node, cluster in rows(matching.constrained_clusters(few, df)):
        got[cluster].add(node)
    assert {g for g in want if len(g) > 1} == {frozenset(g) for g in got.values() if len(g) > 1} != set()


@pytest.mark.parametrize("seed", range(3))
def test_same_pairs_are_those_of_the_rule_and_each_is_told_once(spark, seed):
    m = mention_rows(120, seed)
    df = spark.createDataFrame(m, MENTION)
    decided = matching.decided(matching.candidates(matching.scored(matching.shared_key_pairs(df), df)), *(spark.createDataFrame([], "a long, b long") for _ in range(2)))
    want = sorted(rows(decided.where("decision = 'same_incident'").select("l_id", "r_id", "total_score")))
    assert sorted(rows(matching.same_pairs(df))) == want != []


def test_summing_pairs_are_those_of_shared_keys(spark):
    df = spark.createDataFrame(mention_rows(90, 1), MENTION)
    assert sorted(rows(matching.summing_pairs(df, 7))) == sorted(rows(matching.shared_key_pairs(df).where("(l_id + r_id) % 7 = 0"))) != []


def test_a_forest_has_the_components_of_its_edges(spark):
    rng = random.Random(4)
    edges = spark.createDataFrame([(rng.randrange(300), rng.randrange(300)) for _ in range(2000)] + [(400, 400)], "l_id long, r_id long").repartition(3)
    thin = matching.forest(edges).checkpoint()
    assert sorted(rows(matching.components(thin))) == sorted(rows(matching.components(edges))) and thin.count() <= 3 * 301


@pytest.mark.parametrize("stretch", [(1, 2), (64, 64), (2_000, 4_000)])
def test_stretches_of_links_do_not_change_clusters(monkeypatch, stretch):
    """Links tested together, with linked guards, unknown places and times, sets of places, and cannot-links, against one by one."""
    import pyarrow as pa

    monkeypatch.setattr(matching, "STRETCH", stretch)
    rng = random.Random(stretch[0])
    n, day = 60, 86_400_000_000.0
    told = [(i, rng.choice(["s", "t", "u", None]), rng.choice(["x", "x", None, "y"]), rng.choice([None, rng.random() * 8 * day]), rng.sample("pqr", rng.randrange(3)), rng.random() < 0.8) for i in range(n)]
    members = pa.table(dict(zip(("node", "source_id", "country", "micros", "locations", "primary"), zip(*told, strict=True), strict=True)))
    pairs = sorted({tuple(sorted(rng.sample(range(n), 2))) for _ in range(700)})
    links = [(a, b, rng.random() < 0.9, rng.choice([0.82, 0.9, 1.0])) for a, b in pairs]
    same = {(a, b) for a, b, s, _ in links if s}
    barred = {(a, b) for a, b, s, _ in links if not s}
    for a in told:
        for b in told:
            if a[0] < b[0] and a[5] and b[5] and None not in (a[1], b[1]) and a[1] != b[1] and (None in (a[2], b[2]) or a[2] == b[2]) and (a[0], b[0]) not in same:
                if (None not in (a[3], b[3]) and abs(a[3] - b[3]) > 3 * day) or (a[4] and b[4] and not set(a[4]) & set(b[4])):
                    barred.add((a[0], b[0]))
    cluster = {x: {x} for x in {x for a, b, _, _ in links for x in (a, b)}}
    for a, b, s, _ in sorted(links, key=lambda x: (-x[3], x[0], x[1])):
        x, y = cluster[a], cluster[b]
        if s and x is not y and not any((min(i, j), max(i, j)) in barred for i in x for j in y):
            x |= y
            for k in y:
                cluster[k] = x
    table = pa.table(dict(zip(("l_id", "r_id", "same", "confidence"), zip(*links, strict=True), strict=True)))
    got = matching._greedy(table, members)
    assert dict(zip(*(c.to_pylist() for c in got.columns), strict=True)) == {k: min(c) for k, c in cluster.items()}


def test_guarded_ends_of_a_chain_are_not_merged(spark):
    """A and B share a term, B and C a term, A and C nothing but their disjoint places; a must-link on them goes first."""
    at = datetime(2024, 1, 1)
    m = [(1, "s", None, at, ["p"], [], ["alpha"], True), (2, "t", None, at, [], [], ["alpha", "beta"], True), (3, "u", None, at, ["q"], [], ["beta"], True)]
    df = spark.createDataFrame(m, MENTION)
    linked = spark.createDataFrame([(1, 2, "same_incident", 0.9), (2, 3, "same_incident", 0.8)], "l_id long, r_id long, decision string, confidence double")
    assert rows(matching.constrained_clusters(linked, df), "node") == [(1, 1), (2, 1), (3, 3)]
    must = spark.createDataFrame([(3, 1)], "a long, b long")
    told = decisions_over(spark, m, matching.override_pairs(df, must), [(3, 1)]).select("l_id", "r_id", "decision", "confidence")
    assert rows(told) == [(1, 3, "same_incident", 1.0)]
    assert rows(matching.constrained_clusters(linked.union(told), df), "node") == [(1, 1), (2, 1), (3, 1)]


def test_signed_triangle(spark):
    d = [("a", "b", "same_incident", 0.9), ("b", "c", "same_incident", 0.8), ("a", "c", "different_incident", 0.95)]
    assert rows(matching.constrained_clusters(spark.createDataFrame(d, "l_id string, r_id string, decision string, confidence double")), "node") == [("a", "a"), ("b", "a"), ("c", "c")]


def test_overrides(spark):
    p = spark.createDataFrame([(1, 2, 0.1, 0.0, 0.0, 0.0, 0.0, 0.0, "time"), (3, 4, 1.0, 1.0, 0.0, 0.0, 0.0, 0.65, None), (5, 6, 1.0, 1.0, 0.0, 0.0, 0.0, 0.65, None)], "l_id long, r_id long, time_score double, location_score double, entity_score double, vehicle_score double, lexical_score double, total_score double, hard_guard string")
    pair = lambda *x: spark.createDataFrame(list(x), "a long, b long")
    got = matching.decided(p, pair((2, 1)), pair((4, 3), (1, 2)))
    assert rows(got.select("l_id", "decision", "confidence"), "l_id") == [(1, "same_incident", 1.0), (3, "different_incident", 1.0), (5, "same_incident", 0.82)]


def test_votes(spark):
    e = spark.createDataFrame([("k", 2, 1), ("k", 1, 2), ("k", 2, 3), ("k", None, 4), ("z", 0, 5), ("t", 7, 6), ("t", 8, 7)], "k string, v int, o long")
    got = {r[0]: tuple(r)[1:6] for r in fusing.plurality(e, ["k"], "v", "o").collect()}
    assert got["k"] == (2, 2, [1], True, pytest.approx(0.59)) and got["t"] == (7, 1, [8], True, pytest.approx(0.51)) and got["z"][0] == 0
    assert rows(e.groupBy("k").agg(fusing.agreement("v").alias("v")), "k") == [("k", None), ("t", None), ("z", 0)]


def test_fused_record(spark):
    clusters = spark.createDataFrame([("c", "m1"), ("c", "m2"), ("d", "m3")], "cluster string, mention_id string")
    rows_ = [("m1", "s1", "g", "first", ["e1"], ["bus"], [], 1, None, "Dhaka", "city", 23.8, 90.4, 0.68), ("m2", "s2", "g", None, ["e2"], [], ["jam"], 2, 3, "Bangladesh", "country", 23.0, 90.0, 0.12), ("m3", "s3", None, None, ["e3"], [], [], None, 0, "Bangladesh", "country", 23.0, 90.0, 0.12)]
    mentions = spark.createDataFrame(rows_, "mention_id string, source_id string, dependency_group string, title string, evidence_ids array<string>, vehicles array<string>, effects array<string>, fatalities int, injuries int, place_name string, granularity string, lat double, lon double, place_confidence double")
    mentions = mentions.selectExpr("*", "if(mention_id = 'm3', null, timestamp_ntz'2026-01-02 00:00:00') AS event_time", "cast(null AS double) AS radius_km", "'r' AS reason")
    moods = spark.createDataFrame([("t1", "e1", "s1", "road_safety", "negative"), ("t2", "e1", "s1", "road_safety", "positive")], "sentiment_id string, evidence_id string, source_id string, aspect string, polarity string")
    c, d = fusing.fuse_clusters(clusters, mentions, moods).orderBy("mention_ids").collect()
    assert (c.source_count, c.duplicate_groups, c.title, c.evidence_ids, c.place, c.confidence, c.other_places, c.radius_km) == (1, [["s1", "s2"]], "first", ["e1", "e2"], "Dhaka", 0.68, ["Bangladesh"], 12.0)
    assert [(f.field, f.value, f.state, f.alternatives, f.contradiction, f.support) for f in c.facts] == [("fatalities", 1, "known", [2], True, ["e1", "e2"]), ("injuries", 3, "known", [], False, ["e2"])]
    assert (c.date, c.polarities, c.n_sentiments, c.by_aspect, c.severity, c.method) == ("2026-01-02", ["positive"], 1, {"road_safety": {"positive": 1}}, "high", "source_named_offline_gazetteer_centroid")
    assert (d.title, d.date, d.place, d.method, d.is_incident_location, d.radius_km, d.n_sentiments) == (fusing.UNTITLED, None, "Bangladesh", "collection_country_fallback", False, None, 0)
    assert [(f.value, f.state) for f in d.facts] == [(None, "not_reported"), (0, "reported_zero")]
    assert "Dhaka" in c.text and "zero injuries reported" in d.summary


def test_filters_map_and_pages_take_fused_records(spark):
    from quern.plans.fusion import _records

    r = _records(spark, "/root/testdata/sf0.001")
    every = querying.Filter(kind="road_crash", severity="high", confidence=0.1, source_count=1, search="PLACE", date_from="2024-01-01", date_to="2024-12-31", box=(-180.0, -90.0, 180.0, 90.0), sentiment="negative").apply(r)
    assert 0 < every.count() < r.count()
    assert querying.page(every, "incident_id", 1, 2).count() == 2
    assert r.select(querying.feature(["incident_id"]).alias("f")).where("f IS NOT NULL").count() == r.where("lat IS NOT NULL").count() > 0


def test_place_vote_and_last_wins(spark):
    p = spark.createDataFrame([("c", "X", "country", 0.12, 1), ("c", "A", "city", 0.6, 2), ("c", "A", "city", 0.7, 3), ("d", "X", "country", 0.12, 4), ("d", "X", "country", 0.12, 5)], "k string, n string, g string, c double, o long")
    assert [(r.k, r.place, round(r.confidence, 6)) for r in fusing.fused_place(p, ["k"], "n", "g", "c", "o").orderBy("k").collect()] == [("c", "A", 0.65), ("d", "X", 0.14)]
    w = spark.createDataFrame([("e", 1, "a"), ("e", 3, "b"), ("f", 2, "c")], "k string, o long, v string")
    assert rows(fusing.last_wins(w, ["k"], "o").select("k", "v", "first_order"), "k") == [("e", "b", 1), ("f", "c", 2)]


def test_filter_lets_unmapped_rows_pass(spark):
    d = spark.createDataFrame([(1, 5.0, 5.0, "2024-01-01"), (2, None, None, "2024-01-01"), (3, 50.0, 5.0, "2024-01-01"), (4, 5.0, 5.0, None)], "id long, lat double, lon double, date string")
    assert [r.id for r in querying.Filter(box=(0, 0, 10, 10)).apply(d).orderBy("id").collect()] == [1, 2, 4]
    assert [r.id for r in querying.Filter(box=(0, 0, 10, 10), date_from="2023").apply(d).orderBy("id").collect()] == [1, 2]
    assert [r.id for r in querying.page(d, "id", 2, 3).collect()] == [4]


def test_validation(spark):
    a, b = spark.createDataFrame([(1,), (2,), (2,)], "k long"), spark.createDataFrame([(2,), (3,)], "k long")
    assert rows(validation.difference(a, b, "k", ("l", "r")), "code") == [("l", "1", None), ("r", "3", None)]
    assert rows(validation.duplicate_keys(a, "k", "dup")) == [("dup", "2", "2")]
    assert rows(validation.below_quota(b, "k", a, 2, "q"), "subject") == [("q", "3", "0")]
    facts = spark.createDataFrame([("r", "f", 1, ["e1", "e9"]), ("s", "f", 1, []), ("t", "f", None, [])], "record_id string, field string, value int, support array<string>")
    assert rows(validation.uncited_support(facts, spark.createDataFrame([("e1",)], "evidence_id string")), "code") == [("unknown_evidence", "r", "e9"), ("value_without_support", "s", "f")]


def test_pair_first_selection(spark):
    c = [("A", f"u{i}", f"d{i % 4}", "k" if i in (5, 6) else None, i / 10) for i in range(8)]
    got = ranking.quota_selection(spark.createDataFrame(c, "g string, url string, dom string, k string, conf double"), "g", "k", "dom", "conf", "url", 4)
    assert [(r.url, r.pair) for r in got.orderBy("rank").collect()] == [("u6", True), ("u5", True), ("u7", False), ("u4", False)]


def test_measures(spark):
    d = spark.createDataFrame([(True, True), (True, False), (False, False)], "a boolean, p boolean")
    r = metrics.confusion(d, F.col("a"), F.col("p")).first()
    assert (r.tp, r.fp, r.fn, r.tn, r.precision, r.recall) == (1, 0, 1, 1, 1.0, 0.5)
    g = spark.createDataFrame([("x", 1), ("x", 2), ("y", 3)], "g string, c long")
    b = metrics.b_cubed(g, "g", "c").first()
    assert (b.precision, round(b.recall, 6)) == (1.0, round(2 / 3, 6))
    h = metrics.gapped_histogram(spark.createDataFrame([(0.49,), (0.495,), (0.5,), (0.9,)], "v double"), "v").first()
    assert tuple(h) == (1, 1, 0, 1, 4)
    ci = metrics.bootstrap_ci(spark.createDataFrame([(float(i % 2),) for i in range(200)], "v double"), "v").first()
    assert 0.4 < ci.low < 0.5 < ci.high < 0.6


def test_page_blocks():
    got = read_blocks("<html><script>x</script><h1>Title here</h1><p>One two three.</p><p>One two three.</p><p>Share this</p><p>On 5 May 2024 it was.</p></html>")
    assert [(k, t) for k, _, t in got] == [("headline", "Title here"), ("article", "One two three."), ("published_time", "On 5 May 2024 it was.")]


def test_page_blocks_of_posts_in_spans(spark):
    long = "A bus went off the mountain road near the old bridge, {} people were killed."
    page = (
        f"<html><title>Somebody | Facebook</title><div><span><span>{long.format(3)}</span></span></div><span>Rice is nice, and this sentence about it is long enough to count.</span>"
        "<div role='article'><div dir='auto'><div dir='auto'>So sad</div></div></div>"
        f"<svg><text>{long.format(4)}</text></svg><span aria-label='Comment by A'>{long.format(5)}</span></html>"
    )
    got = [(k, t) for k, _, t in read_blocks(page)]
    assert got == [("post", "So sad"), ("post", long.format(3)), ("comment", long.format(5))]
    assert [t for k, _, t in read_blocks(page, ["rice"]) if k == "post"][-1].startswith("Rice is nice")
    assert any(t.startswith("Rice is nice") for _, _, t in read_blocks(page, declared=True))
    assert [k for k, _, _ in read_blocks(page.replace("Facebook", "News"))] == ["article", "article", "comment"]
    rows = spark.createDataFrame([(1, page, ["rice"]), (2, page, None)], "id long, html string, k array<string>")
    assert html_pages.page_blocks(rows, "id", "html", F.col("k")).groupBy("id").count().orderBy("id").collect() == [(1, 4), (2, 3)]


def test_transitions():
    assert [transition(*x) for x in (("none", "submit"), ("pending", "approve"), ("processing", "approve"), ("ingest_failed", "review"), ("approved", "reject"))] == ["pending", None, "approved", "processing", None]


def test_entities_are_scored_and_bring_pairs_together(spark):
    schema = "mention_id long, source_id string, country string, event_time timestamp_ntz, locations array<string>, vehicles array<string>, terms array<string>, primary boolean, entities array<string>"
    day = datetime(2026, 1, 1)
    rows_ = [(1, "a", None, day, [], ["bus"], [], True, ["Fahim", "BUET"]), (2, "b", None, day, [], ["bus"], [], True, ["Fahim", "BUET"]), (3, "c", None, day, [], [], [], True, None)]
    m = spark.createDataFrame(rows_, schema)
    got = matching.candidates(matching.scored(matching.shared_key_pairs(m), m)).collect()
    assert [(r.l_id, r.r_id, r.entity_score, round(r.total_score, 6)) for r in got] == [(1, 2, 1.0, 0.5)]


def test_guard_counts_match_all_pairs(spark):
    rng = random.Random(41)
    day = datetime(2026, 1, 1)
    rows_ = []
    for i in range(160):
        when = None if rng.random() < 0.1 else day + timedelta(days=rng.choice((0, 1, 3, 3, 4)), seconds=rng.choice((0, 0, 30, 86399)), microseconds=rng.choice((0, 1)))
        rows_.append((i, f"s{rng.randrange(12)}", rng.choice((None, "A", "A", "B")), when, rng.sample(["p", "q", "r"], rng.randrange(3)), [], [], rng.random() < 0.8))
    m = spark.createDataFrame(rows_, "mention_id long, source_id string, country string, event_time timestamp_ntz, locations array<string>, vehicles array<string>, terms array<string>, primary boolean")
    want = defaultdict(int)
    for i, a in enumerate(rows_):
        for b in rows_[i + 1 :]:
            if a[1] == b[1] or (a[2] and b[2] and a[2] != b[2]):
                continue
            both = a[7] and b[7]
            if both and a[4] and b[4] and not set(a[4]) & set(b[4]):
                want["location"] += 1
            elif both and a[3] and b[3] and abs(a[3] - b[3]) > timedelta(days=3):
                want["time"] += 1
            else:
                want["none"] += 1
    assert {r.hard_guard: r.pairs for r in matching.guard_counts(m).collect()} == dict(want)


def test_pairs_without_the_barred_ones(spark):
    """Those that a guard bars are left out as they are met; the others, and their scores, stay."""
    from quern.operators import matching
    from quern.plans.tables import mentions

    m = mentions(spark, "/root/testdata/sf0.001")
    odd = m.selectExpr("mention_id + 1000 AS mention_id", "source_id", "nullif(country, 'en') AS country", "title", "if(mention_id % 7 = 0, null, event_time) AS event_time", "if(mention_id % 5 = 0, null, locations) AS locations", "vehicles", "nullif(primary, mention_id % 4 = 0) AS primary", "terms")
    m = m.unionByName(odd)
    every = matching.scored(matching.shared_key_pairs(m), m).where("hard_guard IS NULL")
    free = matching.scored(matching.shared_key_pairs(m, barred=False), m)
    assert every.count() > 0 and free.where("hard_guard IS NOT NULL").count() == 0
    assert sorted(map(str, free.collect())) == sorted(map(str, every.collect()))


def test_a_provider_without_pause_does_not_sleep(monkeypatch):
    """Zero seconds of sleep cost more than the call itself."""
    from quern.plans import providers

    monkeypatch.setattr(providers.time, "sleep", lambda s: (_ for _ in ()).throw(AssertionError("slept")))
    answer = lambda said: '{"decision": "uncertain", "confidence": 0.5}' if "repair" in said else "{}"
    assert providers._asked(answer, "{}", 3, 0.0, 1, providers._decision)["retries"] == 1
