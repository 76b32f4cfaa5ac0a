"""The registered queries on the smallest tables: against their SQL, or against plain Python over the same rows."""

import hashlib
import html
import importlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from quern.llm import common, decontaminate, packing, quality
from quern.llm.registry import ORACLES, QUERIES
from tests.llm.test_operators import plain_base, plain_components

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").toPandas()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, name):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got, want = QUERIES[name](spark, SF).toPandas(), duck.execute(ORACLES[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert sorted(map(tuple, got[columns].astype(str).to_numpy())) == sorted(map(tuple, want[columns].astype(str).to_numpy()))


def words(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]


def plain_leaks(rows, items):
    """Pairs (row id, item id) with a stretch of enough equal words on some alignment, all alignments tried."""
    found = set()
    ids = defaultdict(lambda: len(ids))
    own = {i: np.array([ids[w] for w in words(t)], int) for i, t in items}
    for d, text in rows:
        x = np.array([ids[w] for w in words(text)], int)
        for i, y in own.items():
            least = min(decontaminate.MIN_WORDS, len(y))
            equal = x[:, None] == y[None, :]
            at, to = np.nonzero(equal)
            shift, n = np.unique(at - to, return_counts=True)
            for s in shift[n * 100 >= decontaminate.SIMILARITY * least] if len(y) else ():
                lo, hi = max(0, -s), min(len(y), len(x) - s)
                if decontaminate.best_stretch(x[s + lo : s + hi] == y[lo:hi], least):
                    found.add((d, i))
                    break
    return found


def test_op2_finds_what_all_alignments_give(spark, docs):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    got = {(r.doc_id, r.item_id) for r in QUERIES["op2_decontamination"](spark, SF).collect()}
    assert got == plain_leaks(list(zip(docs.doc_id, docs.text, strict=True)), items) != set()


def test_op3_base_spans(spark, docs):
    text = dict(zip(docs.doc_id, docs.text, strict=True))
    for r in QUERIES["op3_pii"](spark, SF).collect():
        base = plain_base(text[r.doc_id] or "")
        listed = ",".join(f"{k}:{s}:{e}" for k, v in base.items() for s, e in v)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(len(v) for v in base.values())
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest() and set(listed.split(",")) - {""} <= set(r.spans.split(","))


def test_op4_counts_and_base(spark, docs):
    tokens = {i: [*words(t), ""] for i, t in zip(docs.doc_id, docs.text, strict=True)}
    c = Counter(w for i, x in tokens.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in x)
    n, v = sum(c.values()), len(c)
    got = QUERIES["op4_lm_score"](spark, SF).collect()
    for r in got:
        x = tokens[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(x), sum(c[w] > 0 for w in x), n)
        assert r.base_score == pytest.approx(sum(np.log10((c[w] + 1) / (n + 1 * (v + 1))) for w in x), rel=1e-9)
    held = [r for r in got if r.held_out]
    assert held and sum(r.score for r in held) > sum(r.base_score for r in held)


def packed_whole(rows, got):
    encode, want = packing._encoder(None), Counter()
    for i, t in rows:
        ids = np.append(encode(t or ""), np.uint32(2)).astype("<u4")
        for k, (s, n) in enumerate(packing.cuts(len(ids))):
            want[i, k, s, n, zlib.crc32(ids[s : s + n].tobytes())] += 1
    assert Counter(map(tuple, got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False))) == want
    got = got.sort_values(["sequence_id", "offset"])
    by = got.groupby("sequence_id")
    assert (by.length.sum() <= 1024).all() and (got.offset == by.length.cumsum() - got.length).all()
    assert got.sequence_id.nunique() <= 1.05 * -(-got.length.sum() // 1024) + 1


def test_op5_packs_every_token_once(spark, docs):
    packed_whole(list(zip(docs.doc_id, docs.text, strict=True)), QUERIES["op5_packing"](spark, SF).toPandas())


def test_op6_extracts_articles(spark):
    got = {r.page_id: r for r in QUERIES["op6_html_extraction"](spark, SF).collect()}
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    assert len(got) == len(pages)
    for p in pages:
        article = re.search(r"(?s)<article>(.*?)</article>", p.html)
        if article:
            parts = re.split(r"</?(?:p|h1|div|li|ul|table|tr|td)\b[^>]*>", article[1])
            want = "\n".join(x for x in (" ".join(html.unescape(re.sub("<[^>]*>", "", re.sub("<br>", " ", y))).split()) for y in parts) if x)
            assert got[p.page_id].text == want and got[p.page_id].n_chars == len(want)


def test_op8_even_and_groups_whole(spark, docs):
    got = QUERIES["op8_sharding"](spark, SF).toPandas()
    sizes = got.groupby("shard").size()
    assert len(got) == len(docs) and sizes.max() - sizes.min() <= 1 and (got.law == "rows").all()
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard"))
    text = got.merge(docs, on="doc_id")
    assert (text["size"] == text.text.str.encode("utf-8").str.len() + 1).all() and all(zlib.crc32(t.encode()) == c for t, c in zip(text.text, text.text_crc32, strict=True))
    assert text.groupby("text").shard.nunique().mean() < 1.05


def test_op10_held_out(spark):
    got = QUERIES["op10_quality"](spark, "/root/testdata/sf0.1").toPandas()
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").toPandas().merge(got, on="doc_id")
    held = labels[labels.held_out]
    assert (held.predicted == held.quality).mean() > 0.97
    assert ((held.quality == 1) & (held.predicted == 0)).sum() == 0


def test_pipeline_stage_by_stage(spark, tmp_path):
    """Each stage against plain Python over its own input."""
    table = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, table, SF).write.parquet(str(tmp_path / name))
        before, after = table.toPandas(), spark.read.parquet(str(tmp_path / name))
        rows = list(zip(before.doc_id, before.text, strict=True))
        kept = sorted(r.doc_id for r in after.select("doc_id").collect())
        if name != "pack":
            assert after.columns == table.columns and 0 < len(kept) <= len(rows)
        if name == "quality":
            bank = quality.fit(table, spark.read.parquet(f"{SF}/labels.parquet"))
            assert kept == sorted(r.doc_id for r in quality.scores(table, bank).collect() if r.score >= 0.7)
        elif name == "exact":
            best = {}
            for i, t in rows:
                key = re.sub("[\x20\x09-\x0d]", "", t or "")
                best[key] = min(best.get(key, (1, 0)), (-len(t or ""), i))
            assert kept == sorted(i for _, i in best.values())
        elif name == "near":
            assert kept == sorted(set(plain_components(rows, 5).values()))
        elif name == "decontaminate":
            items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
            assert kept == sorted({i for i, _ in rows} - {i for i, _ in plain_leaks(rows, items)})
        else:
            packed_whole(rows, after.toPandas())
        table = after
    assert corpus_pipeline.run(spark, SF).count() == table.count()


def test_no_import_errors_are_swallowed():
    for name in ("common", "decontaminate", "exact_dedup", "html_extract", "license_scan", "lm_score", "near_dedup", "packing", "pii", "quality", "registry", "sharding"):
        source = open(importlib.import_module(f"quern.llm.{name}").__file__).read()
        assert "ImportError" not in source and "localCheckpoint" not in source
    assert common.stored.__doc__


def test_stages_on_odd_rows_and_clashing_columns(spark, tmp_path):
    """Each stage on nulls, empty, long, equal and repeated rows, beside columns named like those inside the operators."""
    from tests.llm.test_operators import ODD

    schema = "doc_id long, text string, _gone string, _id string, _text int, _n long, score double, _kdigest string, _row int, keep boolean"
    leak = spark.read.parquet(f"{SF}/benchmark.parquet").first()["text"]
    rows = [*ODD, (None, "null id"), (None, "null id"), (20, leak), (21, leak + " more words after it that keep the copy near")]
    docs = spark.createDataFrame([(*r, "x", "y", 1, 2, 0.5, "z", 3, True) for r in rows], schema)
    expected = {
        "exact": [(None, "null id"), (4, ODD[4][1]), (5, ODD[5][1]), (6, ODD[6][1]), (7, ODD[7][1]), (8, "A B C"), (9, "x"), (11, "a b d"), (20, leak), (21, rows[-1][1])],
        "near": [(None, "null id"), (1, None), (2, ""), (3, "a b c"), (3, "a b c"), (5, ODD[5][1]), (6, ODD[6][1]), (7, ODD[7][1]), (9, "x"), (11, "a b d"), (None, "null id"), (20, leak)],
        "decontaminate": [r for r in rows if r[0] not in (20, 21)],
    }
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        if name == "pack":
            packed_whole([(-7 if i is None else i, t) for i, t in rows], out.na.fill({"doc_id": -7}).toPandas())
            continue
        assert out.columns == docs.columns
        got = out.collect()
        assert all(tuple(r)[2:] == ("x", "y", 1, 2, 0.5, "z", 3, True) for r in got)
        if name in expected:
            order = lambda x: sorted(x, key=str)
            if name == "near":  # a near copy and its original: the smaller id stays
                assert order({(r.doc_id, r.text) for r in got}) == order(set(expected[name]) - ({(20, leak)} if not any(r.doc_id == 20 for r in got) else set()) | ({(21, rows[-1][1])} if any(r.doc_id == 21 for r in got) else set()))
            else:
                assert order((r.doc_id, r.text) for r in got) == order(expected[name])
    empty = docs.limit(0)
    assert all(stage(spark, empty, SF).count() == 0 for _, stage in corpus_pipeline.STAGES)


def test_run_leaves_its_last_table_only(spark, tmp_path, monkeypatch):
    from quern.operators import store

    for module in (store, corpus_pipeline):
        monkeypatch.setattr(module, "shared_folder", lambda _: str(tmp_path))
    assert corpus_pipeline.run(spark, SF).count() > 0
    (folder,) = tmp_path.iterdir()
    assert [p.name for p in folder.iterdir()] == ["4-pack"]
