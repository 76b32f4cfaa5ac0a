"""Article lists from search services and feeds, with access rules.

The service is a function (url, headers) -> (status, bytes), so that tests and clusters without a network can give their own.
"""

from __future__ import annotations

import json
import re
import time
import urllib.error
import urllib.request
import urllib.robotparser
from collections.abc import Callable, Iterator
from urllib.parse import urlencode, urlsplit

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quern.functions.dates import feed_date
from quern.functions.text import alias_pattern, compacted, folded, normalized, stable_id
from quern.functions.urls import canonical_url, direct_url, hostname, is_public

Fetch = Callable[[str, dict[str, str]], tuple[int, bytes]]
MOST_RECORDS, MOST_DAYS, MOST_BYTES, AGENT = 250, 90, 4_000_000, "quern/0.1"
ARTICLES = "country_iso2 string, url string, title string, seen_at string, language string, source_country string, ord int"


def bounded_fetch(url: str, headers: dict[str, str], most: int = MOST_BYTES, seconds: float = 20) -> tuple[int, bytes]:
    """GET with a cap on the body; a longer one is an error."""
    request = urllib.request.Request(url, headers={"User-Agent": AGENT} | headers)
    try:
        with urllib.request.urlopen(request, timeout=seconds) as r:
            body = r.read(most + 1)
            if len(body) > most:
                raise ValueError(f"more than {most} bytes")
            return r.status, body
    except urllib.error.HTTPError as e:
        return e.code, b""


def search_query(name: str, terms: list[str]) -> str:
    """Up to twenty terms and the country's name."""
    said = [f'"{t}"' if " " in t else t for t in (t.replace('"', "") for t in terms[:20])]
    return f"({' OR '.join(said)}) sourcecountry:{re.sub('[^A-Za-z]', '', name).lower()}"


class ArticleSource(DataSource):
    """spark.read.format("article_search"): one partition for each country.  Options: endpoint, countries (JSON list of [iso2, name,
    terms]), records, days."""

    fetch: Fetch = staticmethod(bounded_fetch)

    @classmethod
    def name(cls) -> str:
        return "article_search"

    def schema(self) -> str:
        return ARTICLES

    def reader(self, schema: object) -> DataSourceReader:
        return _ArticleReader(self.options, type(self).fetch)


class _ArticleReader(DataSourceReader):
    def __init__(self, options: dict, fetch: Fetch):
        self.endpoint, self.fetch = options["endpoint"], fetch
        self.countries, self.records, self.days = json.loads(options["countries"]), int(options.get("records", 100)), int(options.get("days", 30))
        if not 1 <= self.records <= MOST_RECORDS or not 1 <= self.days <= MOST_DAYS:
            raise ValueError(f"records must be 1 to {MOST_RECORDS} and days 1 to {MOST_DAYS}")

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(c) for c in self.countries]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        iso2, name, terms = partition.value
        status, body = self.fetch(self.endpoint + "?" + urlencode({"query": search_query(name, terms), "mode": "artlist", "maxrecords": self.records, "format": "json", "timespan": f"{self.days}d"}), {})
        if status != 200:
            raise ValueError(f"the service answered {status}")
        for k, row in enumerate(json.loads(body).get("articles", [])[: self.records]):
            if isinstance(row, dict):
                yield (iso2, row.get("url"), row.get("title"), row.get("seendate"), row.get("language"), row.get("sourcecountry"), k)


def discovered(articles: DataFrame) -> DataFrame:
    """Articles once for each canonical address and country, the first keeps its title."""
    rows = articles.withColumn("url", canonical_url("url")).where("url IS NOT NULL")
    first = F.row_number().over(Window.partitionBy("country_iso2", "url").orderBy("ord"))
    return rows.withColumn("_k", first).where("_k = 1").select(stable_id("disc", "country_iso2", "url").alias("discovery_id"), "country_iso2", "url", normalized("title").alias("title"), hostname("url").alias("domain"), "seen_at", "language", "source_country")


def feed_candidates(items: DataFrame) -> DataFrame:
    """Items (country_iso2, query, ord, title, link, pubDate) of all queries, once for each country and address: the first by query
    and place keeps its title; the address inside an aggregator's link counts, and a trailing publisher goes."""
    rows = items.withColumns({"url": canonical_url(direct_url("link")), "published_at": feed_date(F.col("pubDate"))}).where("url IS NOT NULL")
    first = F.row_number().over(Window.partitionBy("country_iso2", "url").orderBy("query", "ord"))
    return rows.withColumn("_k", first).where("_k = 1").select("country_iso2", "url", hostname("url").alias("domain"), F.regexp_replace(normalized("title"), r" - [^-]+$", "").alias("title"), "published_at")


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """Items of RSS files: title, link, pubDate, description."""
    return spark.read.format("xml").option("rowTag", "item").schema("title string, link string, pubDate string, description string").load(path)


#: Words that tell a report of a crash in a post: vehicle, event and consequence together, and none of the last.
POST_WORDS = (r"(?i)\b(bus|truck|lorry|car|motorcycle|van|train)\b", r"(?i)\b(crash|accident|collision)\w*", r"(?i)\b(killed|dead|died|injured|hurt)\b")
NO_POST = r"(?i)\b(video game|simulation|insurance|movie)\b"
POSTS_PER_COUNTRY, EXCERPT = 3, 280


def social_posts(posts: DataFrame, countries: DataFrame) -> DataFrame:
    """Posts (uri, author_did, handle, text, link, ord) that name a country and tell of a crash, once for each address, at most
    POSTS_PER_COUNTRY of a country; countries (iso2, alias).

    The aliases are a dimension; posts that don't tell of a crash are dropped before they meet it."""
    told = F.lit(True)
    for words in POST_WORDS:
        told = told & F.col("text").rlike(words)
    key = F.regexp_extract("uri", r"^(?:[^/]*/){4,}([^/]+)$", 1)
    fit = posts.where(told & ~F.col("text").rlike(NO_POST) & F.col("author_did").startswith("did:") & (key != ""))
    fit = fit.select("text", "handle", "ord", F.when(F.col("link").rlike("^https?://"), F.col("link")).alias("external_link"), F.concat(F.lit("post:"), "author_did", F.lit("/"), key).alias("post_url"), F.explode(F.array_distinct(F.regexp_extract_all(folded("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))).alias("_first"))
    names = countries.select("iso2", F.regexp_extract(folded("alias"), r"[\p{L}\p{N}]+", 0).alias("_first"), alias_pattern(F.col("alias")).alias("_pattern"))
    named = fit.join(names, "_first").where(F.expr("replace(lower(text), 'ß', 'ss') rlike _pattern")).groupBy("iso2", "post_url").agg(F.min_by(F.struct("handle", "external_link", compacted("text", EXCERPT).alias("excerpt")), "ord").alias("p"), F.min("ord").alias("ord"))
    place = F.row_number().over(Window.partitionBy("iso2").orderBy("ord"))
    return named.withColumn("_k", place).where(F.col("_k") <= POSTS_PER_COUNTRY).select(stable_id("social", "post_url").alias("candidate_id"), "iso2", "post_url", "p.handle", "p.external_link", "p.excerpt")


OUTCOMES = "url string, outcome string, status int, reason string, bytes long, content binary"


def allowed(robots_status: int, robots: bytes, url: str, agent: str = AGENT) -> tuple[bool, str]:
    """404 and 410 allow, any other answer but 200 denies, else the rules decide."""
    if robots_status in (404, 410):
        return True, "no robots file"
    if robots_status != 200:
        return False, f"robots file answered {robots_status}"
    rules = urllib.robotparser.RobotFileParser()
    rules.parse(robots.decode("utf-8", "replace").splitlines())
    return rules.can_fetch(agent, url), "robots rules"


def captured(urls: DataFrame, fetch: Fetch = bounded_fetch, most: int = MOST_BYTES, pause: float = 0.0) -> DataFrame:
    """Outcome of each address, captured, robots_denied, rejected or failed, and the page of those captured, for snapshots().

    Only public web addresses whose answer is a page are captured.  Addresses of a host share a task, which asks for its robots
    file once and waits `pause` seconds between calls to it; a host with many addresses is spread over SALT tasks."""

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        robots: dict[str, tuple[int, bytes]] = {}
        for batch in batches:
            out = []
            for url in batch.url:
                try:
                    parts = urlsplit(url)
                    if parts.scheme not in ("http", "https") or not is_public(parts.hostname):
                        out.append((url, "rejected", None, "not a public web address", None, None))
                        continue
                    origin = f"{parts.scheme}://{parts.netloc}"
                    if origin not in robots:
                        robots[origin] = fetch(origin + "/robots.txt", {})
                    ok, reason = allowed(*robots[origin], url)
                    if not ok:
                        out.append((url, "robots_denied", None, reason, None, None))
                        continue
                    time.sleep(pause)
                    status, body = fetch(url, {})
                    wrong = "status" if status != 200 else "size" if len(body) > most else "no page" if b"<" not in body[:1000] else None
                    out.append((url, "rejected", status, wrong, len(body), None) if wrong else (url, "captured", status, reason, len(body), body))
                except (OSError, ValueError) as e:
                    out.append((url, "failed", None, str(e)[:200], None, None))
            yield pd.DataFrame(out, columns=[x.split()[0] for x in OUTCOMES.split(", ")])

    salt = F.pmod(F.xxhash64("url"), F.lit(SALT))
    return urls.select("url", hostname("url").alias("host")).repartition(F.col("host"), salt).select("url").mapInPandas(probe, OUTCOMES)


#: Tasks that one host's addresses are spread over.
SALT = 4
