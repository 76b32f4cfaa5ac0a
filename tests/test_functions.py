import hashlib
import math

import pytest
from pyspark.sql import functions as F

from quern.functions import rules, text, urls


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values()) or (1,)], list(values) or ["x"])
    return row.select(column.alias("r")).first()[0]


def test_stable_id(spark):
    assert one(spark, text.stable_id("ev", F.lit("a"), F.lit("b"))) == "ev_" + hashlib.sha256(b"a|b").hexdigest()[:16]


def test_digits_and_normal_form(spark):
    assert one(spark, text.ascii_digits(F.lit("১৫ জন"))) == "15 জন"
    assert one(spark, text.normalized("t"), t=" ﬁne​ \n x ") == "fine x"
    assert one(spark, text.unaccented("t"), t="Straße Éa") == "strasse ea"


def test_terms_and_jaccard(spark):
    assert one(spark, text.terms(F.lit("Große, große x_y 12"))) == ["12", "grosse", "x", "y"]
    assert one(spark, text.lexical_features(F.lit("Crash on the Bridge bridge road"), ["crash"])) == ["bridge", "road"]
    pair = lambda a, b: one(spark, text.jaccard(F.array(*map(F.lit, a)), F.array(*map(F.lit, b))))
    assert pair(["a", "b"], ["b", "c"]) == pytest.approx(1 / 3)
    assert one(spark, text.jaccard(F.array().cast("array<string>"), F.array(F.lit("a")))) == 0.0


def test_excerpt(spark):
    assert one(spark, text.excerpt(F.lit(" a  b\nc d"), 3)) == "a b c…"
    assert one(spark, text.excerpt(F.lit("a b"), 3)) == "a b"


@pytest.mark.parametrize(
    ("said", "deaths", "injuries"),
    [
        ("16 people were killed and 48 injured", 16, 48), ("Seven dead", 7, None), ("a student was killed", 1, None), ("nothing happened", None, None), ("twenty-four others were badly injured", None, 24),
        ("0 deaths, three hurt", 0, 3), ("death of a rider", 1, None), ("5 killed, then 6 killed", 5, None),
    ],
)
def test_casualties(spark, said, deaths, injuries):
    assert tuple(one(spark, text.casualty_counts("t"), t=said)) == (deaths, injuries)


def test_alias_boundaries(spark):
    hit = lambda t, a: one(spark, F.regexp_like(text.folded(F.lit(t)), text.alias_pattern(F.lit(a))))
    assert hit("On Lane Cove Road.", "lane cove road") and not hit("Planes", "lane") and hit("a (b) c", "(b)")


def test_urls(spark):
    canon = lambda u: one(spark, urls.canonical_url("u"), u=u)
    assert canon("HTTPS://News.Example/a?b=2&utm_source=x&a=1#fragment") == "https://news.example/a?a=1&b=2"
    assert canon("http://x.example:80") == "http://x.example/"
    assert canon("https://x.example:8443/p?a=b%20c&fbclid=1") == "https://x.example:8443/p?a=b+c"
    assert canon("ftp://x.example/a") is None and canon("https://user@x.example/") is None
    assert one(spark, urls.hostname("u"), u="https://WWW.Example.org:8080/x") == "example.org"
    assert one(spark, urls.direct_url("u"), u="https://n.example/r?x=1&url=https%3A%2F%2Fp.example%2Fa") == "https://p.example/a"
    hosts = spark.createDataFrame([("localhost",), ("127.0.0.1",), ("10.1.2.3",), ("8.8.8.8",), ("a.example",), (None,)], "h string")
    assert [r[0] for r in hosts.select(urls.public_host("h")).collect()] == [False, False, False, True, True, False]


def test_rules(spark):
    assert [one(spark, rules.severity(F.lit(d), F.lit(i))) for d, i in ((5, 0), (1, 9), (0, 1), (0, 0))] == ["critical", "high", "medium", "unknown"]
    assert [one(spark, rules.assertion(F.lit(x))) for x in ("Directly seen", "alleged", "an opinion", "possibly", "", "inferred claim")] == ["observed", "attributed_claim", "opinion", "reported", "reported", "attributed_claim"]
    assert [one(spark, rules.clamped_confidence(F.lit(x))) for x in ("1.7", "high", "?", "0.2")] == [1.0, 0.9, 0.5, 0.2]
    assert one(spark, rules.canonical_field(F.lit(" Death_Count "))) == "fatalities"
    assert one(spark, rules.default_radius(F.lit("city"), F.lit(None).cast("double"))) == 12.0


def test_geometry(spark):
    assert one(spark, rules.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(90.0))) == pytest.approx(6371.0088 * math.pi / 2)
    ring = one(spark, rules.uncertainty_ring(F.lit(0.0), F.lit(10.0), F.lit(111.32)))
    assert len(ring) == 65 and ring[0] == pytest.approx([11.0, 0.0]) and ring[16] == pytest.approx([10.0, 1.0]) and ring[64] == pytest.approx(ring[0])


def test_scores(spark):
    assert one(spark, rules.total_score(*(F.lit(x) for x in (1.0, 1.0, 0.0, 0.0, 0.2)), F.lit(True))) == pytest.approx(0.74)
    assert one(spark, rules.total_score(*(F.lit(x) for x in (0.0, 0.0, 0.0, 0.0, 0.1)), F.lit(True))) == pytest.approx(0.62)
    assert one(spark, rules.time_score(F.lit(None).cast("timestamp_ntz"), F.lit(None).cast("timestamp_ntz"))) == 0.25
