"""Every query against its SQL in DuckDB, on the smallest tables."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from quern.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(frame, columns):
    return sorted(tuple(str(v) for v in row) for row in frame[columns].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.execute(ORACLES[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    null = {"None": "null", "nan": "null", "<NA>": "null", "NaT": "null"}
    assert plain(got.astype(str).replace(null), columns) == plain(want.astype(str).replace(null), columns)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_gives_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_best_title_pair_matches_plain_python(spark):
    from difflib import SequenceMatcher

    from quern.operators.matching import GENERIC
    from quern.plans.tables import mentions

    rows = mentions(spark, SF).collect()
    best = {}
    for i, a in enumerate(sorted(rows, key=lambda r: r.mention_id)):
        for b in sorted(rows, key=lambda r: r.mention_id)[i + 1 :]:
            shared = set(a.terms) & set(b.terms)
            if a.country != b.country or a.source_id == b.source_id or len(shared) < 2 or not shared - set(GENERIC):
                continue
            fold = lambda x: x.lower().replace("ß", "ss")
            days = abs((a.event_time - b.event_time).total_seconds()) / 86400
            score = 0.55 * len(shared) / len(set(a.terms) | set(b.terms)) + 0.30 * SequenceMatcher(None, fold(a.title), fold(b.title)).ratio() + 0.15 * max(0, 1 - days / 7)
            key = (round(score, 8), -a.mention_id, -b.mention_id)
            if score >= 0.5 and key > best.get(a.country, (0,)):
                best[a.country] = key
    got = {r.grp: (r.score, -r.l_id, -r.r_id) for r in QUERIES["best_title_pair"](spark, SF).collect()}
    assert got == best != {}


def test_constrained_clusters_match_one_greedy_over_all_pairs(spark):
    from quern.plans.matching import _decisions
    from quern.plans.tables import mentions

    told = {r.mention_id: r for r in mentions(spark, SF).collect()}
    decisions = _decisions(spark, SF).collect()
    same = {(r.l_id, r.r_id) for r in decisions if r.decision == "same_incident"}
    barred = {(r.l_id, r.r_id) for r in decisions if r.decision in ("different_incident", "related_but_distinct")}
    for a in told.values():
        for b in told.values():
            if a.mention_id < b.mention_id and a.source_id != b.source_id and a.country == b.country and a.primary and b.primary and (a.mention_id, b.mention_id) not in same:
                far = abs((a.event_time - b.event_time).total_seconds()) > 3 * 86400
                if far or (a.locations and b.locations and not set(a.locations) & set(b.locations)):
                    barred.add((a.mention_id, b.mention_id))
    cluster = {n: {n} for pair in same for n in pair}
    for r in sorted((r for r in decisions if r.decision == "same_incident"), key=lambda r: (-r.confidence, r.l_id, r.r_id)):
        x, y = cluster[r.l_id], cluster[r.r_id]
        if x is not y and not any((min(i, j), max(i, j)) in barred for i in x for j in y):
            x |= y
            for n in y:
                cluster[n] = x
    got = {r.node: r.cluster for r in QUERIES["constrained_clusters"](spark, SF).collect()}
    assert got == {n: min(c) for n, c in cluster.items()} != {}


def test_links_for_clusters_leave_out_what_guards_tell_and_nothing_else(spark):
    from quern.plans.matching import _decisions, _links
    from quern.plans.tables import mentions

    want = _decisions(spark, SF).where("decision = 'same_incident' OR decision = 'different_incident' AND hard_guard IS NULL")
    got = _links(mentions(spark, SF)).select("l_id", "r_id", "decision", "confidence").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want.select("l_id", "r_id", "decision", "confidence").collect())) != []


def test_bootstraps_match_draws_over_rows(spark):
    import numpy as np

    labels = np.array([r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r.quality is not None], float)
    got = QUERIES["bootstrap_ci"](spark, SF).first()
    means = np.random.default_rng(3).choice(labels, (20_000, len(labels))).mean(axis=1)
    assert got.n == len(labels) and abs(got.low - np.quantile(means, 0.025)) < 0.02 and abs(got.high - np.quantile(means, 0.975)) < 0.02
    one = QUERIES["cluster_bootstrap"](spark, SF).first()
    assert one.groups <= 20 and 0 <= one.low <= one.high <= 1


def test_page_blocks_tell_each_paragraph_of_an_article(spark):
    import html
    import re

    got = {}
    for r in QUERIES["page_blocks"](spark, SF).collect():
        got.setdefault(r.page_id, set()).add(r.text)
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    found = 0
    for p in pages:
        for text in re.findall(r"(?s)<p>((?:(?!</?p>|<(?:div|ul|table|h\d|article)).)*)</p>", re.sub(r"(?s)<(script|style).*?</\1>", "", p.html)):
            plain = " ".join(html.unescape(re.sub("<[^>]*>", "", re.sub("<br>", " ", text))).split())
            words = plain.split()
            if len(plain) >= 2 and sum(len(w) == 1 for w in words) <= 0.55 * len(words) and not re.match(r"(?i)(share|like|comment|reply|follow|subscribe|log in|sign up|see more|advertisement)\b", plain):
                assert plain in got[p.page_id], (p.page_id, plain)
                found += 1
    assert found > 50 and set(got) == {p.page_id for p in pages}


def test_clusters_do_not_depend_on_row_order(spark):
    from quern.operators.matching import constrained_clusters
    from quern.plans.matching import _decisions

    d = _decisions(spark, SF)
    first = sorted(map(tuple, constrained_clusters(d).collect()))
    assert sorted(map(tuple, constrained_clusters(d.repartition(7).orderBy("confidence")).collect())) == first


def test_everything_works_without_the_llm_folders(tmp_path):
    root = Path(__file__).resolve().parent.parent
    for name in ("quern", "__spark_entry__.py"):
        (shutil.copytree if (root / name).is_dir() else shutil.copy)(root / name, tmp_path / name)
    shutil.rmtree(tmp_path / "quern" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'stable_id' in q and 'pipeline' not in q and not [n for n in q if n.startswith('op')]; assert set(e.oracle_sql()) <= set(q)"
    env = os.environ | {"PYTHONPATH": str(tmp_path)}
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, timeout=120).returncode == 0
    inside = [p for p in (root / "quern").rglob("*.py") if "llm" not in p.parts]
    assert not [p for p in inside if "quern.llm" in p.read_text()]
