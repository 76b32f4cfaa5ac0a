"""Each operator against brute force and on odd rows: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import itertools
import random
import re
import textwrap
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from quern.llm import common, decontaminate, exact_dedup, html_extract, license_scan, lm_score, near_dedup, packing, pii, quality, sharding

LONG = "word other " * 40_000
ODD = [(1, None), (2, ""), (3, "a b c"), (3, "a b c"), (4, "a  b\nc"), (5, " \n\t"), (6, LONG), (7, "ä ö ü ß"), (8, "A B C"), (9, "x"), (10, LONG), (11, "a b d"), (12, "a b c")]
SCHEMA = "doc_id long, text string, _id string, _text int, _n long, score double, kept boolean, _part int, id int"


def table(spark, rows, schema=SCHEMA):
    """The rows with extra columns whose names clash with those inside the operators."""
    return spark.createDataFrame([(*r, "x", 1, 2, 0.5, False, 3, 4) for r in rows], schema)


@pytest.fixture
def odd(spark):
    return table(spark, ODD)


@pytest.fixture
def none(spark):
    return table(spark, [])


def prose(rng, n, words=400):
    return " ".join(f"w{int(rng.random() ** 2 * words)}" for _ in range(n))


# --- shared ---------------------------------------------------------------------------------------------------------


def test_words_and_shingles_match_plain_python():
    texts = [None, "", "One two  THREE\ttwo", "x", " a b ", "é É", LONG[:500], "a b c"]
    got = list(common.scan_words(pa.array(texts)))
    w = got[0][2]
    plain = [[x for x in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x] for t in texts]
    assert w.per_doc.tolist() == [len(p) for p in plain]
    assert w.hash.tolist() == [common.word_hash(x) for p in plain for x in p]
    for n in (1, 2, 3, 5):
        values, bounds = common.shingles(w, n)
        sets = [{tuple(p[i : i + n]) for i in range(len(p) - n + 1)} or ({tuple(p)} if p else set()) for p in plain]
        assert np.diff(bounds).tolist() == [len(s) for s in sets]
        assert all((np.diff(values[a:b].astype(object)) > 0).all() for a, b in itertools.pairwise(bounds))


def test_chunks_keep_rows_whole():
    off = np.array([0, 3, 3, 10, 30, 31])
    assert list(common.chunks(off, 10)) == [(0, 3), (3, 4), (4, 5)]
    assert list(common.chunks(off, 10, 2)) == [(0, 2), (2, 3), (3, 4), (4, 5)]


# --- 1 --------------------------------------------------------------------------------------------------------------


def test_every_known_sentence_holds_an_anchor_and_every_rule_known_sentences():
    assert all(any(a in s.lower() for a in license_scan.ANCHORS) for s in license_scan.known() if s not in _body())
    ids = {i for i, _ in license_scan.SENTENCES}
    assert len(ids) == len(license_scan.SENTENCES) == len(license_scan.known())
    assert all(set(r[2]) <= ids for r in license_scan.RULES)


def _body():
    """Sentences that count only within a rule that starts with an anchored one."""
    first = {r[2][0] for r in license_scan.RULES}
    return {s for s, i in license_scan.known().items() if i not in first}


def test_license_rules(spark):
    text = dict(license_scan.SENTENCES)
    rows = [
        (1, "Prose here. " + text[1]), (2, "\n".join(text[i] for i in (2, 3, 4, 5, 6))), (3, text[10].replace("software", "software\n") + "\n\n" + text[11] + "\n" + text[12]),
        (4, text[8] + "\n" + text[8] + " " + text[24]), (5, "not a license at all, licensed"), (6, None), (7, ""), (4, text[8]),
    ]
    got = sorted(tuple(r) for r in license_scan.scan(table(spark, rows)).collect())
    assert got == [
        (1, "apache-2.0-reference", "Apache-2.0", 1, "1"), (2, "apache-2.0-header", "Apache-2.0", 1, "2,3,4,5,6"), (3, "mit-text", "MIT", 1, "10,11,12"),
        (4, "cc-by-nc-4.0-short", "CC-BY-NC-4.0", 1, "8,8,24"), (4, "mit-released", "MIT", 1, "8"), (4, "mit-released", "MIT", 2, "8,8,24"),
    ]


@pytest.mark.parametrize("width", (20, 40, 60, 72, 100))
def test_license_sentences_wrapped_at_any_width(spark, width):
    text = dict(license_scan.SENTENCES)
    wrap = lambda ids, mark: "\n".join(textwrap.fill(text[i], width, initial_indent=mark, subsequent_indent=mark) for i in ids)
    rows = [(1, wrap((10, 11, 12), "")), (2, wrap((10,), "    ")), (3, wrap((17, 18, 19), "# ")), (4, wrap((2, 3), " * ")), (5, wrap((10,), "")[:-20])]
    got = {(r.doc_id, r.rule_id, r.n_matches, r.sentence_ids) for r in license_scan.scan(table(spark, rows)).collect()}
    assert got == {(1, "mit-text", 1, "10,11,12"), (2, "mit-grant", 1, "10"), (3, "gpl-2.0-header", 1, "17,18,19"), (4, "apache-2.0-header-short", 1, "2,3")}


def test_license_empty(none, odd):
    assert license_scan.scan(none).count() == 0
    assert license_scan.scan(odd).count() == 0


# --- 2 --------------------------------------------------------------------------------------------------------------


def test_decontamination_finds_passages_with_replaced_words(spark):
    rng = random.Random(2)
    items = [(i, prose(rng, n)) for i, n in enumerate((40, 25, 13, 6, 60, 0))]
    rows, expected = [], set()
    for d in range(60):
        body = prose(rng, rng.choice((0, 5, 80))).split()
        if d % 2:
            i = rng.randrange(5)
            words = items[i][1].split()
            for _ in range(len(words) // 12):
                words[rng.randrange(1, len(words) - 1)] = "replaced"
            at = rng.randrange(len(body) + 1)
            body = body[:at] + words + body[at:]
            expected.add((d, i))
        rows.append((d, " ".join(body).upper() if d % 3 else " ".join(body)))
    found = decontaminate.leaks(table(spark, rows), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in found.collect()} == expected
    blocks = decontaminate.leaks(table(spark, rows), spark.createDataFrame(items, "item_id long, text string"), block=20)
    assert {tuple(r) for r in blocks.collect()} == {tuple(r) for r in found.collect()}
    kept = decontaminate.drop_leaks(table(spark, rows), spark.createDataFrame(items, "item_id long, text string"))
    assert {r.doc_id for r in kept.collect()} == {d for d, _ in rows} - {d for d, _ in expected} and kept.columns == table(spark, []).columns


def test_two_replaced_words_never_escape_the_masks():
    for a, b in itertools.combinations(range(decontaminate.SPAN), 2):
        assert any(m[a] == m[b] == "0" for m in decontaminate.MASKS)


@pytest.mark.parametrize("size", range(12, 26))
def test_a_fifth_replaced_never_escapes_the_masks(size):
    """Every placement of size // 5 replaced words between equal ends."""
    kept = [sum(1 << at + i for i, bit in enumerate(m) if bit == "1") for m in decontaminate.MASKS for at in range(size - len(m) + 1)]
    for c in itertools.combinations(range(1, size - 1), size // 5):
        replaced = sum(1 << i for i in c)
        assert any(not k & replaced for k in kept), c


def test_fewest_replaced_words_that_escape_are_more_than_a_fifth():
    """The same for longer stretches, by the fewest words that leave no mask whole; above 55 words some window has two at most."""
    masks = [sum(1 << decontaminate.SPAN - 1 - i for i, bit in enumerate(m) if bit == "1") for m in decontaminate.MASKS]
    for size in range(12, 60):
        fewest = {0: 0}
        for i in range(size):
            after = {}
            for seen, n in fewest.items():
                for bit in (0, 1) if 0 < i < size - 1 else (0,):
                    window = (seen << 1 | bit) & (1 << decontaminate.SPAN) - 1
                    if (i + 1 < decontaminate.SPAN or all(window & m for m in masks)) and n + bit < after.get(window, size):
                        after[window] = n + bit
            fewest = after
        assert min(fewest.values()) > size // 5


def test_decontamination_finds_short_items_with_a_fifth_replaced(spark):
    rng = random.Random(21)
    items = [(15, prose(rng, 15, 3000)), (20, prose(rng, 20, 3000))]
    rows = []
    for d, (item, places) in enumerate(((0, (3, 4, 9)), (1, (2, 8, 9, 14)))):
        words = items[item][1].split()
        for k in places:
            words[k] = f"x{k}"
        rows.append((d, prose(rng, 30, 3000) + " " + " ".join(words) + " " + prose(rng, 30, 3000)))
    found = decontaminate.leaks(table(spark, rows), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in found.collect()} == {(0, 15), (1, 20)}


def test_decontamination_tolerates_a_fifth_of_replaced_words(spark):
    rng = random.Random(12)
    items = [(i, prose(rng, 40, 3000)) for i in range(20)]
    rows, marked = [], 0
    for d in range(400):
        words = items[d % 20][1].split()
        for k in rng.sample(range(40), 8):
            words[k] = f"x{rng.randrange(10**6)}"
        rows.append((d, prose(rng, 30, 3000) + " " + " ".join(words)))
    found = {(r.doc_id, r.item_id) for r in decontaminate.leaks(table(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    marked = sum((d, d % 20) in found for d in range(400))
    assert marked >= 396 and all(i == d % 20 for d, i in found)


def test_best_stretch_matches_all_stretches():
    rng = np.random.default_rng(1)
    for _ in range(1500):
        equal = rng.random(rng.integers(0, 30)) < rng.random()
        least, similarity = int(rng.integers(1, 15)), int(rng.choice([50, 80, 90, 100]))
        at = np.flatnonzero(equal).tolist()
        every = [(k - i + 1, -(e - s + 1), -s) for i, s in enumerate(at) for k, e in enumerate(at[i:], i) if e - s + 1 >= least and 100 * (k - i + 1) >= similarity * (e - s + 1)]
        want = max(every, default=None)
        assert decontaminate.best_stretch(equal, least, similarity) == (want and (want[0], -want[2], -want[2] - want[1]))


def test_alignments_match_all_equal_seeds():
    rng = random.Random(23)
    for _ in range(60):
        make = lambda n: " ".join(rng.choice(("a", "a", "a", "b", "c")) for _ in range(n))
        items = [make(rng.randint(1, 40)) for _ in range(4)]
        texts = [make(rng.randint(0, 70)) for _ in range(6)]
        own = [next(common.scan_words(pa.array([x])))[2].hash for x in items]
        _, _, w = next(common.scan_words(pa.array(texts)))
        want = set()
        for d, t in enumerate(texts):
            t = t.split()
            for i, x in enumerate(items):
                x = x.split()
                for s in range(-len(x), len(t)):
                    both = [(k, s + k) for k in range(len(x)) if 0 <= s + k < len(t)]
                    same = {k for k, p in both if x[k] == t[p]}
                    if len(x) < decontaminate.SPAN:
                        hit = bool(same & {0, len(x) - 1})
                    else:
                        hit = any(0 <= s + k and s + k + decontaminate.SPAN <= len(t) and all(k + j in same for j, bit in enumerate(m) if bit == "1") for m in decontaminate.MASKS for k in range(len(x) - decontaminate.SPAN + 1))
                    if hit:
                        want.add((d, i, s))
        assert {tuple(x) for x in decontaminate.Items(own).alignments(w, most=50).tolist()} == want


def test_decontamination_of_a_text_of_one_word(spark):
    items = spark.createDataFrame([(1, "same " * 300)], "item_id long, text string")
    got = decontaminate.leaks(table(spark, [(1, "same " * 20_000), (2, "same " * 11)]), items).collect()
    assert [tuple(r) for r in got] == [(1, 1, 300, 300, 0, 0)]


def test_decontamination_odd_rows(spark, odd, none):
    items = spark.createDataFrame([(1, "a b c"), (2, None), (3, ""), (4, "word other word other word other word other word other word other word")], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id) for r in decontaminate.leaks(odd, items).collect())
    assert got == [(3, 1), (3, 1), (4, 1), (6, 4), (8, 1), (10, 4), (12, 1)]
    assert decontaminate.leaks(none, items).count() == 0
    assert decontaminate.leaks(odd, items.limit(0)).count() == 0


# --- 3 --------------------------------------------------------------------------------------------------------------

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_base(text):
    valid = {"email": lambda x: True, "ip": lambda x: all(int(p) <= 255 for p in x.split(".")), "card": pii._card, "phone": lambda x: 9 <= len(re.sub(r"[^0-9]", "", x)) <= 15}
    return {k: [m.span() for m in re.finditer(p, text) if valid[k](m[0])] for k, p in PATTERNS.items()}


def test_base_spans_match_the_patterns():
    rng = random.Random(4)
    pieces = ["a@b.c", "@", ".", "1.2.3.4", "+1 (499) 555-6503", "4111 1111 1111 1111", "-", " ", "9", "x", "a.b@", "256.1.1.1", "b.c", "+", "(", "\n", "ü", "00"]
    for _ in range(3000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 14)))
        assert pii.base_spans(text) == plain_base(text), text


def test_field_finds_what_patterns_miss():
    rows = pii.training_rows(4, seed=99)
    base = [{k: [] for k in pii.KINDS} for _ in rows]
    tp = fp = fn = 0
    for (_, marks), found in zip(rows, pii.added_spans([r[0] for r in rows], base, pii.field()), strict=True):
        got, want = {(s, e, k) for k in found for s, e in found[k]}, set(marks)
        tp, fp, fn = tp + len(got & want), fp + len(got - want), fn + len(want - got)
    assert tp / (tp + fp) > 0.95 and tp / (tp + fn) > 0.95


HELD_OUT = [
    "please forward everything to {email:a at a dot T} before monday", "her old address was {email:a [at] a [dot] T} until spring", "ask {email:a (at) a (dot) T} about it",
    "questions? {email:a at a.T}", "bugs go to {email:a_a at a dot T}", "he uses {email:a at a dot T} now",
    "you can try {phone:999-999-9999} after lunch", "office : {phone:(999) 999-9999} , room \\9", "just {phone:999.999.9999} and wait",
    "support line {phone:999-999-9999}", "her phone , {phone:999 999 9999} , is off", "he charged it to {card:C4.} yesterday",
    "my visa is {card:C4/} so far", "they took {card:C4.} from me", "node {ip:B[.]B[.]B[.]B} rebooted",
    "log into {ip:B . B . B . B} please", "traffic from {ip:B[.]B[.]B[.]B} was blocked", "the router ( {ip:B . B . B . B} ) is up",
    "we met at noon dot on time", "lib version \\99 . \\9 . \\9 . \\9 is out", "our order \\9999-\\999-\\9999 shipped",
    "she looked at the dot and left", "score \\99-\\99 at half time", "on page \\99 , line \\999",
    "it took \\999 days and \\99 hours", "\\a \\a \\9999-\\9999 \\a", "stay at \\a. it rains",
    "invoice no \\999-\\999-\\9999 is due", "the isbn \\999-\\9-\\99-\\999999-\\9 is wrong", "from \\99.\\99.\\9999 to \\99.\\99.\\9999",
    "serial \\9999-\\9999-\\9999-\\9999 was lost", "at \\99:\\99 , gate \\99", "version 10 . 2 . 3 . 4 of lib",
    "order 2023-555-1234 shipped",
]


def test_field_on_sentences_it_was_not_trained_on(monkeypatch):
    model = pii.field()
    assert not set(HELD_OUT) & set(pii.TRAINING)
    monkeypatch.setattr(pii, "TRAINING", HELD_OUT)
    rows = pii.training_rows(20, seed=5)
    tp = fp = fn = 0
    for (_, marks), found in zip(rows, pii.added_spans([r[0] for r in rows], [{k: [] for k in pii.KINDS} for _ in rows], model), strict=True):
        got, want = {(s, e, k) for k in found for s, e in found[k]}, set(marks)
        tp, fp, fn = tp + len(got & want), fp + len(got - want), fn + len(want - got)
    assert tp / (tp + fp) > 0.97 and tp / (tp + fn) > 0.9


def test_decoding_round_triggers_finds_what_whole_lines_give(spark, monkeypatch):
    rng = random.Random(14)
    texts = [t for (t,) in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect() if t]
    marked = [t for t, _ in pii.training_rows(1, seed=8)]
    texts += [" ".join(rng.choice(texts).split()[:60]) + " " + rng.choice(marked) + " " + " ".join(rng.choice(texts).split()[:60]) for _ in range(150)]
    base = [pii.base_spans(t) for t in texts]
    some = pii.added_spans(texts, base, pii.field())
    monkeypatch.setattr(pii, "WINDOW", 10**6)
    assert some == pii.added_spans(texts, base, pii.field()) and sum(len(x) for m in some for x in m.values()) > 40


def test_viterbi_matches_all_label_sequences():
    model, rng = pii.Field(), np.random.default_rng(1)
    model.state[:] = rng.normal(size=model.state.shape)
    model.step[:] = rng.normal(size=model.step.shape)
    for n in (1, 2, 4):
        v = rng.integers(0, pii.N_VALUES, n)
        e = model.emission(pii._padded([pii.edged(v)])[0])[0]

        def total(y, e=e, n=n):
            return model.first[y[0]] + sum(e[i, y[i]] for i in range(n)) + sum(model.step[a, b] + model.barred[a, b] for a, b in itertools.pairwise(y))

        best = max(itertools.product(range(len(pii.LABELS)), repeat=n), key=total)
        assert tuple(model.decode([pii.edged(v), pii.edged(rng.integers(0, pii.N_VALUES, 5))])[0]) == best


def test_field_finds_numbers_that_stand_beside_each_other(spark):
    """The card pattern takes the end of the phone number along, the phone pattern the card: both fail their check."""
    text = "mail a@b.example +1 (269) 555-3296 4111111111111111 end"
    row = pii.personal_data(table(spark, [(1, text)])).first()
    assert (row.n_email, row.n_card, row.n_phone, row.spans) == (1, 0, 0, "email:5:16,card:35:51,phone:17:34")


def test_personal_data_rows(spark, none):
    rows = [(1, "ü mail a.b@c.example and +1 (499) 555-6503"), (2, None), (3, ""), (4, "write john dot doe at mail dot com now"), (1, "ü mail a.b@c.example and +1 (499) 555-6503"), (5, LONG), (6, "mail john at mail.com\nWrite to ann AT acme.org today")]
    got = sorted(tuple(r) for r in pii.personal_data(table(spark, rows)).collect())
    empty = hashlib.sha256(b"").hexdigest()
    first = (1, 1, 0, 0, 1, hashlib.sha256(b"email:7:20,phone:25:42").hexdigest(), "email:7:20,phone:25:42")
    assert got == [first, first, (2, 0, 0, 0, 0, empty, ""), (3, 0, 0, 0, 0, empty, ""), (4, 0, 0, 0, 0, empty, "email:6:34"), (5, 0, 0, 0, 0, empty, ""), (6, 0, 0, 0, 0, empty, "email:5:21,email:31:46")]
    assert pii.personal_data(none).count() == 0


# --- 4 --------------------------------------------------------------------------------------------------------------


def lm_rows():
    rng = random.Random(6)
    langs = [[f"{c}{i}{e}" for i, e in zip(range(300), itertools.cycle("xyz"))] for c in "pq"]
    return [(i, " ".join(langs[i % 2][int(rng.random() ** 3 * 300)] for _ in range(rng.randint(0, 60)))) for i in range(400)] + [(1000, None), (1001, "never seen"), (3, "twice once")]


def test_language_model_base_and_held_out(spark):
    rows = lm_rows()
    got = lm_score.lm_scores(table(spark, rows), words=100, known=200).collect()
    tokens = {i: [*(t or "").split(), 0] for i, t in rows}
    counts = Counter(x for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2 for x in [*(t or "").split(), 0])
    n, v = sum(counts.values()), len(counts)
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id == 3:
            continue
        x = tokens[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(x), sum(counts[y] > 0 for y in x), n)
        assert r.base_score == pytest.approx(sum(np.log10((counts[y] + 1) / (n + v + 1)) for y in x), rel=1e-9)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2)
    held = [r for r in got if r.held_out]
    # the language of a text follows from its words
    assert sum(r.score - r.base_score for r in held) > 0.03 * sum(r.n_tokens for r in held)


def test_language_model_scores_match_plain_python(spark):
    """Each token by itself: class and unit by whole exponentials, and its share of the group."""
    rows = lm_rows()
    docs = table(spark, rows).coalesce(1)
    texts = docs.where("crc32(cast(doc_id as string)) % 7 != 2").selectExpr("text AS _text")
    v = lm_score.vocabulary(lm_score.token_counts(texts), 100, 200)
    model = lm_score.train(texts, v)
    w = {n: x.astype(float) for n, x in model.w.items()}
    counts = Counter(x for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2 for x in (t or "").split())
    words = list(common.scan_words(pa.array([t for _, t in rows])))[0][2]
    unit = dict(zip(words.hash.tolist(), lm_score.units_of(words, v)[2].tolist(), strict=True))
    groups = defaultdict(Counter)
    for x, c in counts.items():
        u = unit[common.word_hash(x)]
        if u <= lm_score.ENDINGS:
            groups[u][x] = c
    logsum = lambda x: x.max() + np.log(np.exp(x - x.max()).sum())
    got = {(r.doc_id, r.n_tokens): r.score for r in lm_score.lm_scores(docs, words=100, known=200).collect()}
    for i, t in rows[:60] + rows[-3:]:
        said = (t or "").split()
        seq = [unit[common.word_hash(x)] for x in said] + [0]
        total = 0.0
        for k, u in enumerate(seq):
            q = sum(w["context"][seq[k - j - 1] if k > j else 0] @ w["place"][j] for j in range(lm_score.ORDER))
            c = u // lm_score.CLASS
            classes, inside = w["class"] @ q + w["class_bias"][:, 0], slice(c * lm_score.CLASS, (c + 1) * lm_score.CLASS)
            units = w["unit"][inside] @ q + w["bias"][inside, 0]
            total += (classes[c] - logsum(classes) + units[u % lm_score.CLASS] - logsum(units)) / np.log(10)
            if 0 < u <= lm_score.ENDINGS:
                g = groups[u]
                total += np.log10((g[said[k]] + 1) / (sum(g.values()) + len(g) + 1))
        assert got[i, len(seq)] == pytest.approx(total, rel=1e-4), i


def test_language_model_is_normalised():
    rng = np.random.default_rng(1)
    model = lm_score.Model(rng.integers(0, 50, lm_score.CLASS**2).astype(float), rank=8)
    model.w = {n: x + rng.normal(0, 0.3, x.shape).astype(np.float32) for n, x in model.w.items()}
    every = np.arange(lm_score.CLASS**2)
    for context in ([0, 0, 0], [300, 5, 0], [16000, 300, 300]):
        p = 10 ** model.log10(np.tile(context, (len(every), 1)), every)
        assert p.sum() == pytest.approx(1, abs=1e-4)


def test_language_model_shares_of_large_products():
    rng = np.random.default_rng(4)
    q, w, column = rng.normal(0, 60, (40, 5)).astype(np.float32), rng.normal(0, 9, (5, lm_score.CLASS)).astype(np.float32), rng.integers(0, lm_score.CLASS, 40)
    x = (q @ w).astype(float)
    want = x[np.arange(40), column] - x.max(axis=1) - np.log(np.exp(x - x.max(axis=1, keepdims=True)).sum(axis=1))
    got = lm_score._log_share(q, w, column, np.empty((lm_score.ROWS, lm_score.CLASS), np.float32))
    assert np.allclose(got, want, rtol=1e-4, atol=1e-3) and np.abs(x).max() > 700


def test_noise_contrastive_steps_learn_what_follows():
    """Units that follow one another for sure, and gradients of repeated rows that add up."""
    rng = np.random.default_rng(2)
    unit_counts = np.zeros(lm_score.CLASS**2)
    unit_counts[300:700] = 50
    after = rng.permutation(np.arange(300, 700))
    before = rng.integers(300, 700, 30_000)
    context = np.stack([before, rng.integers(300, 700, 30_000), np.zeros(30_000, int)], axis=1)
    target = after[before - 300]
    model = lm_score.Model(unit_counts)
    first = model.log10(context[:2000], target[:2000]).mean()
    trainer = lm_score.Trainer(model, 1)
    for _ in range(12):
        trainer.run(context, target, lm_score.RATE)
    model.w = trainer.w
    assert model.log10(context[:2000], target[:2000]).mean() > first + 1
    assert trainer.moved["context"][300:700].sum() == 12 * 2 * 30_000


def test_steps_of_learning_match_plain_sums():
    """One step on each of several texts against sums over tokens one by one."""
    rng = np.random.default_rng(7)
    n, rank, size = 300, 4, lm_score.CLASS
    model = lm_score.Model(rng.integers(0, 50, size**2).astype(float), rank)
    context, target = rng.integers(0, 600, (n, lm_score.ORDER)), rng.integers(0, 600, n)
    trainer, draws = lm_score.Trainer(model, 3), np.random.default_rng(3)
    trainer.step(context, target, 0.1)
    w = model.w
    edge = np.concatenate([[0.0], model.noise[size - 1 :: size]])
    classes = np.searchsorted(edge[1:], draws.random(lm_score.CLASS_NOISE) * edge[-1]).clip(0, size - 1)
    kinds = np.unique(target // size)
    at = edge[kinds][:, None] + draws.random((len(kinds), lm_score.NOISE)) * (edge[kinds + 1] - edge[kinds])[:, None]
    noise = np.clip(np.searchsorted(model.noise, at), kinds[:, None] * size, kinds[:, None] * size + size - 1)
    grad = {k: np.zeros(x.shape) for k, x in w.items()}
    for before, t in zip(context, target, strict=True):
        q = sum(w["context"][u] @ w["place"][k] for k, u in enumerate(before))
        dq, c = np.zeros(rank), t // size
        for table, bias, log, i, number, sign in (
            *(("class", "class_bias", model.log_class, i, lm_score.CLASS_NOISE, 0) for i in classes), ("class", "class_bias", model.log_class, c, lm_score.CLASS_NOISE, 1),
            *(("unit", "bias", model.log_unit, i, lm_score.NOISE, 0) for i in noise[np.searchsorted(kinds, c)]), ("unit", "bias", model.log_unit, t, lm_score.NOISE, 1),
        ):
            g = sign - 1 / (1 + np.exp(-(q @ w[table][i] + w[bias][i, 0] - log[i] - np.log(number))))
            grad[table][i] += g * q
            grad[bias][i, 0] += g
            dq += g * w[table][i]
        for k, u in enumerate(before):
            grad["context"][u] += w["place"][k] @ dq
            grad["place"][k] += np.outer(w["context"][u], dq)
    for k, g in grad.items():
        flat = g.reshape(len(g), -1)
        step = (0.01 if k == "place" else 0.1) / np.sqrt(1e-4 + (flat**2).mean(axis=1))
        assert np.allclose((trainer.w[k] - w[k]).reshape(len(g), -1), step[:, None] * flat, atol=2e-4), k


@pytest.mark.parametrize("columns", [1, 4])
def test_sums_of_groups(columns):
    """Groups of one, of few and of many places."""
    rng = np.random.default_rng(columns)
    for rows in (np.array([7]), np.zeros(50, int), rng.integers(0, 300, 200), np.minimum(rng.geometric(0.02, 5000) * 60, 16_383)):
        g = rng.normal(size=(len(rows), columns)).astype(np.float32)
        groups = lm_score.Groups(rows)
        want = np.zeros((1 << 14, columns))
        np.add.at(want, rows, g)
        assert np.allclose(groups.sums(g), want[groups.at], atol=1e-3) and sorted(groups.at) == sorted(set(rows.tolist()))
        assert (groups.at[groups.of] == rows).all() and (groups.often == np.bincount(rows)[groups.at]).all()


def test_class_exponentials_are_made_once_for_a_unit(monkeypatch):
    """A token takes exponentials of the units of its class only, unless products are too large for those of its positions."""
    rng = np.random.default_rng(8)
    model = lm_score.Model(rng.integers(0, 50, lm_score.CLASS**2).astype(float), rank=8)
    context, target = rng.integers(0, 16_384, (3000, lm_score.ORDER)), rng.integers(0, 16_384, 3000)
    plain, rows = lm_score._log_share, []
    monkeypatch.setattr(lm_score, "_log_share", lambda q, *more: rows.append(len(q)) or plain(q, *more))
    got = model.log10(context, target)
    assert sum(rows) == len(target)
    monkeypatch.setattr(lm_score, "LARGEST", 0.0)
    rows.clear()
    assert np.allclose(got, model.log10(context, target), atol=1e-5) and sum(rows) == 2 * len(target)
    monkeypatch.setattr(lm_score, "LARGEST", 25.0)
    model.w["class_bias"] = rng.normal(0, 60, model.w["class_bias"].shape).astype(np.float32)
    got = model.log10(context, target)
    monkeypatch.setattr(lm_score, "LARGEST", 0.0)
    assert np.allclose(got, model.log10(context, target), rtol=1e-5, atol=1e-5)
    monkeypatch.setattr(lm_score, "LARGEST", 25.0)
    model.w["context"] *= 500
    assert np.isfinite(model.log10(context, target)).all() and not lm_score.Scorer(model).powers


@pytest.mark.parametrize("same", [0, 30, 60])
def test_frequent_words_are_found_by_their_hashes(same):
    """Also hashes with equal leading bits, and ones below, between and above all others."""
    rng = np.random.default_rng(same)
    draw = lambda n: rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) >> np.uint64(same)
    hashes = np.unique(draw(5000))
    v = lm_score.Vocabulary(hashes, np.ones(len(hashes), np.int64), np.zeros(len(hashes), np.int64), np.ones(4), 1, 1, 1, np.ones(4))
    asked = np.concatenate([hashes, draw(5000), np.array([0, 2**64 - 1], np.uint64)])
    at, found = v.find(asked)
    assert (found == np.isin(asked, hashes)).all() and (hashes[at[found]] == asked[found]).all()


def test_language_model_learns_from_every_row(monkeypatch):
    """Beyond the tokens that every round learns from, each row is learnt from in its own round: none is left out."""
    monkeypatch.setattr(lm_score, "LEAST", 100)
    texts = [f"w{i} of row" for i in range(3000)]
    words = next(common.scan_words(pa.array(texts)))[2]
    hashes = np.unique(words.hash)
    units = np.arange(300, 300 + len(hashes))
    v = lm_score.Vocabulary(hashes, np.ones(len(hashes), np.int64), units, np.ones(lm_score.CLASS**2), 12_000, len(hashes), 3000, np.ones(lm_score.ENDINGS + 1))
    seen = Counter()
    monkeypatch.setattr(lm_score.Trainer, "run", lambda self, context, target, rate: seen.update(target.tolist()))
    rounds = pa.array(np.random.default_rng(1).integers(0, lm_score.ROUNDS, 3000), pa.int32())
    for number in range(lm_score.ROUNDS):
        rows = pa.RecordBatch.from_arrays([pa.array(texts), rounds], ["_text", "_round"])
        lm_score._learn(iter([rows.slice(0, 1000), rows.slice(1000)]), v, lm_score.Model(v.unit_counts, rank=2), number)
    own = dict(zip(hashes.tolist(), units.tolist(), strict=True))
    assert all(seen[own[h]] for h in words.hash[::3].tolist())
    assert sum(seen[own[h]] == 1 for h in words.hash[::3].tolist()) > 2500


def test_language_model_sequences():
    _, _, w = next(common.scan_words(pa.array(["a b c d", None, "e"])))
    context, target = lm_score.sequences(w, np.array([1, 2, 3, 4, 5]), 3)
    assert target.tolist() == [1, 2, 3, 4, 0, 0, 5, 0]
    assert context.tolist() == [[0, 0, 0], [1, 0, 0], [2, 1, 0], [3, 2, 1], [4, 3, 2], [0, 0, 0], [0, 0, 0], [5, 0, 0]]


def test_language_model_odd_rows(odd):
    got = lm_score.lm_scores(odd).collect()
    assert len(got) == len(ODD) and all(np.isfinite(r.score) and r.score < 0 for r in got)
    assert {r.n_tokens for r in got if r.doc_id in (1, 2, 5)} == {1} and len({r.base_score for r in got if r.doc_id in (6, 10)}) == 1


def test_language_model_empty(none, spark):
    assert lm_score.lm_scores(none).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    r = lm_score.lm_scores(table(spark, [(held, "a b")])).first()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (3, 0, 0, 0.0)


# --- 5 --------------------------------------------------------------------------------------------------------------


def test_plan_places_everything_once():
    rng = random.Random(7)
    for trial in range(12):
        length = rng.choice((8, 64, 1024))
        counts = {rng.randint(1, length): rng.randint(0, 40) for _ in range(rng.randint(0, 80))}
        made = packing.plan(counts, length)
        steps, used = made.steps, made.sequences
        ranks, filled = defaultdict(list), defaultdict(list)
        for x, first, n, seq, at in steps:
            for k in range(n):
                ranks[x].append(first + k)
                filled[seq + k].append((at, x))
        assert {x: sorted(r) for x, r in ranks.items()} == {x: list(range(n)) for x, n in counts.items() if n}
        assert sorted(filled) == list(range(used))
        for parts in filled.values():
            end = 0
            for at, x in sorted(parts):
                assert at == end
                end += x
            assert end <= length
        assert used <= 1.5 * -(-sum(x * n for x, n in counts.items()) // length) + 1, trial


def test_plan_takes_exact_complements():
    assert packing.plan({7: 5, 3: 5}, 10).sequences == 5
    assert packing.plan({6: 4, 3: 4, 1: 4}, 10).sequences == 4
    assert packing.plan({5: 2, 3: 2, 1: 4}, 10).sequences == 2


def test_plan_of_the_tables_fills_gaps_by_pairs_and_triples(spark):
    texts = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").toArrow().column(0).to_pylist()
    encode = packing._encoder(None)
    counts = Counter(n for t in texts for _, n in packing.cuts(len(encode(t or "")) + 1))
    made = packing.plan(counts)
    assert made.sequences <= 964 and made.filled[2] > 0 and made.filled[3] > 0


def test_plan_of_many_pieces_takes_few_steps():
    rng = random.Random(9)
    counts = {x: rng.randrange(1, 10**6) for x in range(1, 1025)}
    made = packing.plan(counts)
    assert len(made.steps) < 10_000 and made.sequences <= 1.03 * sum(x * n for x, n in counts.items()) / 1024


def test_workers_hold_no_more_than_they_need(monkeypatch):
    """The tokenizers file is loaded for texts with the special token only; what a task freed goes back when it ends."""
    import tokenizers

    class Never:
        @staticmethod
        def from_file(path):
            raise AssertionError("loaded")

    monkeypatch.setattr(tokenizers, "Tokenizer", Never)
    packing._encoder.cache_clear()
    assert len(packing._encoder(None)("two words"))
    with pytest.raises(AssertionError, match="loaded"):
        packing._encoder(None)("<|endoftext|>")
    packing._encoder.cache_clear()
    done = []
    monkeypatch.setattr(common, "returned", lambda: done.append(1))
    work = common.lean(lambda batches: (x + 1 for x in batches))
    assert list(work(iter([1, 2]))) == [2, 3] and done == [1]


def test_encoder_gives_the_ids_of_the_tokenizers_file(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [t[0] for t in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()] + ["", " ", "<|endoftext|> x", "a b​ c", "1234567 89", "\n\n\n  x", "日本語 🎉 ß"]
    rng = random.Random(11)
    planes = ((32, 127), (32, 127), (0, 48), (160, 0x250), (0x300, 0x370), (0x400, 0x500), (0x900, 0xA00), (0x2000, 0x2070), (0x3000, 0x3100), (0x4E00, 0x5000), (0xFF00, 0xFFF0), (0x1F300, 0x1F700))
    texts += ["".join(chr(rng.randrange(*rng.choice(planes))) for _ in range(rng.randint(1, 60))) for _ in range(4000)]
    encode = packing._encoder(None)
    assert all(encode(t or "").tolist() == slow.encode(t or "", add_special_tokens=False).ids for t in texts)


def test_packing_rows(spark, odd, none):
    got = packing.pack(odd).toPandas()
    assert (got.groupby("sequence_id").length.sum() <= 1024).all()
    got = got.sort_values(["sequence_id", "offset"])
    assert (got.offset == got.groupby("sequence_id").length.cumsum() - got.length).all()
    encode = packing._encoder(None)
    want = Counter()
    for i, t in ODD:
        ids = np.append(encode(t or ""), np.uint32(2)).astype("<u4")
        for k, (s, n) in enumerate(packing.cuts(len(ids))):
            want[i, k, s, n, zlib.crc32(ids[s : s + n].tobytes())] += 1
    assert Counter(map(tuple, got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False))) == want
    assert packing.pack(none).count() == 0


# --- 6 --------------------------------------------------------------------------------------------------------------


def test_labeller_on_unseen_layouts():
    rng, right, total = random.Random(123), 0, 0
    model = html_extract.labeller()
    for _ in range(150):
        page, labels = html_extract.training_page(rng)
        found = html_extract.blocks(page)
        if found and len(found) == len(labels):
            p, _ = model.forward(html_extract.batch_of([found]))
            right += int(((p >= 0.5) == np.array(labels)).sum())
            total += len(labels)
    assert right / total > 0.98


def test_gradients_match_differences():
    rng = random.Random(5)
    pages, labels = [], []
    while len(pages) < 3:
        page, marks = html_extract.training_page(rng)
        if len(found := html_extract.blocks(page)) == len(marks) and found:
            pages.append(found)
            labels.append(np.array(marks, float))
    model, y = html_extract.Labeller(3), np.concatenate(labels)
    model.w = {n: x.astype(np.float64) for n, x in model.w.items()}
    b = html_extract.batch_of(pages)

    def loss():
        p, _ = model.forward(b)
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    grads = model.gradients(b, y)
    pick = np.random.default_rng(0)
    for name, g in grads.items():
        at = np.unravel_index(np.argmax(np.abs(g)) if name in ("path", "inner", "word") else pick.integers(g.size), g.shape)
        old = model.w[name][at]
        model.w[name][at] = old + 1e-5
        up = loss()
        model.w[name][at] = old - 1e-5
        down = loss()
        model.w[name][at] = old
        assert (up - down) / 2e-5 == pytest.approx(g[at], abs=1e-6), name


def test_blocks_behind_closed_drawings_and_with_formulas():
    page = '<article><p>One <svg class="i"/> two.</p><p>Sum <math><mrow><mi>a</mi><mo>+</mo><mi>b</mi></mrow></math> is <math/> here.</p><p>Last <svg><title>t</title><text>no</text></svg> one.</p><script/>no</script></article>'
    assert [b.text for b in html_extract.blocks(page)] == ["One two.", "Sum a+b is here.", "Last no one."]
    assert [b.text for b in html_extract.blocks("<article><a href=x'y>Text don't miss</a> tail one.</article><p title='a > b' data-x=\"c > d\">Q</p>")] == ["Text don't miss tail one.", "Q"]
    assert [b.text for b in html_extract.blocks("<p>Let <math>x=4</math> hold<script>no</script>.</p><noscript><p>N</p></noscript><object>O</object><template><p>T</p></template>")] == ["Let x=4 hold.", "N", "O", "T"]
    assert [b.text for b in html_extract.blocks("<div>" * 3000 + "deep")] == ["deep"]
    path = html_extract.blocks('<div class="flex flex-col items-center justify-between bg-gray-100 rounded shadow-md sidebar">x</div>')[0].path
    assert ".sidebar" in path[-1]


def test_extraction_rows(spark):
    page = '<html><head><title>t</title><script>x("<p>")</script></head><body><nav><ul><li><a href="/">Home</a></li></ul></nav><!-- c --><div class="ad">Buy now.</div><article><h1>A &amp; B</h1><p><b>One\n two<br>three<p>Four &lt;x&gt;.</p></article><footer>&copy; x</footer>'
    rows = [(1, "u", page, "x"), (2, None, None, "x"), (3, "v", "", "x"), (1, "u", page, "x"), (4, "w", "<p>" + LONG, "x")]
    got = sorted((tuple(r) for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()), key=lambda r: r[0])
    text = "A & B\nOne two three\nFour <x>."
    assert got == [(1, "u", text, len(text)), (1, "u", text, len(text)), (2, None, "", 0), (3, "v", "", 0), (4, "w", LONG.strip(), len(LONG.strip()))]
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# --- 7 --------------------------------------------------------------------------------------------------------------


def test_exact_dedup_odd_rows(spark, odd, none):
    got = sorted(tuple(r)[:4] for r in exact_dedup.exact_duplicates(odd).collect())
    assert got == [
        (1, 5, 3, False), (2, 5, 3, False), (3, 4, 4, False), (3, 4, 4, False), (4, 4, 4, True), (5, 5, 3, True), (6, 6, 2, True),
        (7, 7, 1, True), (8, 8, 1, True), (9, 9, 1, True), (10, 6, 2, False), (11, 11, 1, True), (12, 4, 4, False),
    ]
    assert exact_dedup.exact_duplicates(none).count() == 0
    kept = exact_dedup.drop_exact_duplicates(odd)
    assert sorted(r.doc_id for r in kept.collect()) == [4, 5, 6, 7, 8, 9, 11] and kept.columns == odd.columns


def test_exact_dedup_keeps_one_of_repeated_rows(spark):
    rows = table(spark, [(1, "a"), (1, "a"), (1, "b"), (None, "c")])
    assert sum(r.kept for r in exact_dedup.exact_duplicates(rows).collect()) == 3
    assert sorted(r.text for r in exact_dedup.drop_exact_duplicates(rows).collect()) == ["a", "b", "c"]


def test_exact_dedup_keeps_the_longest_of_rows_that_repeat_an_id(spark):
    rows = table(spark, [(1, "a b"), (1, "a    b"), (2, "ab"), (2, "c"), (2, "c"), (None, None), (None, " ")])
    assert sorted((r.n_chars for r in exact_dedup.exact_duplicates(rows).collect() if r.kept)) == [1, 1, 6]
    for _ in range(2):
        assert sorted(r.text for r in exact_dedup.drop_exact_duplicates(rows.repartition(3)).collect()) == [" ", "a    b", "c"]


def test_exact_dedup_leaves_columns_with_clashing_names(spark):
    schema = "doc_id long, text string, _gone string, _GONE_ string, _kdigest string, _kid int, _row int"
    rows = [(1, "a", "x", "y", "z", 7, 8), (2, "a", "x", "y", "z", 7, 8), (3, "b", "x", "y", "z", 7, 8)]
    for more in ([], [(3, "b", "x", "y", "z", 7, 8)]):
        kept = exact_dedup.drop_exact_duplicates(spark.createDataFrame(rows + more, schema))
        assert sorted(map(tuple, kept.collect())) == [rows[0], rows[2]] and kept.columns == [c.split()[0] for c in schema.split(", ")]


def test_exact_dedup_merges_runs_in_rounds_of_pairs(spark):
    """Records of one digest in every run: each round halves the runs that hold it."""
    rows = [(i, "same") for i in range(500)] + [(1000 + i, f"t{i % 40}") for i in range(300)]
    records = exact_dedup.records_of(table(spark, rows), "doc_id", "text")
    merged = {bytes(r["_digest"]): r for r in exact_dedup.merge_runs(records).collect()}
    assert len(merged) == 41
    hot = merged[hashlib.sha256(b"same").digest()]
    assert (hot["_keep"], hot["_size"], hot["_runs"]) == (0, 500, (1 << exact_dedup.RUNS) - 1)
    assert all(merged[hashlib.sha256(f"t{k}".encode()).digest()]["_keep"] == 1000 + k for k in range(40))
    plan = exact_dedup.merge_runs(records)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_COL") == exact_dedup.RUNS.bit_length() - 1


def test_exact_dedup_of_text_ids(spark):
    rows = spark.createDataFrame([("b", "x y"), ("a", "xy"), (None, "z"), ("c", None)], "doc_id string, text string")
    assert sorted((str(r.doc_id), str(r.keep_id), r.kept) for r in exact_dedup.exact_duplicates(rows).collect()) == [("None", "None", True), ("a", "b", False), ("b", "b", True), ("c", "c", True)]
    assert exact_dedup.drop_exact_duplicates(rows).count() == 3


def test_exact_dedup_large_group(spark):
    rows = [(i, "same text" if i % 3 else f"text {i}") for i in range(3000)]
    got = exact_dedup.exact_duplicates(table(spark, rows)).collect()
    assert len(got) == 3000 and sum(r.kept for r in got) == 1001 and all(r.group_size == (2000 if r.doc_id % 3 else 1) for r in got)


# --- 8 --------------------------------------------------------------------------------------------------------------


def test_sharding_is_even_and_keeps_groups_together(spark):
    rng = random.Random(8)
    rows = [(i, f"copy {rng.randrange(60)}" if i % 3 == 0 else "hot" if i % 3 == 1 else f"text {i}") for i in range(3001)]
    got = sharding.balanced_shards(table(spark, rows)).toPandas()
    sizes = got.groupby("shard").size()
    assert len(got) == 3001 and len(sizes) == 16 and sizes.max() - sizes.min() <= 1
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard"))
    text = dict(rows)
    spread = got.assign(t=got.doc_id.map(text)).groupby("t").shard.nunique()
    assert spread["hot"] <= 10 and spread.drop("hot").mean() < 1.3


def plain_propagation(rows, shards):
    """One document after the other moves to the shard where most of its group are, by exchange with a document alone in its
    group; documents are dealt round the shards at first.  The number of cuts: shards that a group is in, beyond one."""
    text = dict(rows)
    size = Counter(text.values())
    at = {i: k % shards for k, (i, _) in enumerate(sorted(rows, key=lambda r: (size[r[1]] == 1, r[1], r[0])))}
    alone = [[i for i in at if at[i] == s and size[text[i]] == 1] for s in range(shards)]
    held = Counter((text[i], at[i]) for i in at)
    for _ in range(10):
        moved = 0
        for i in sorted(at):
            if size[text[i]] > 1:
                to = max(range(shards), key=lambda s, i=i: (held[text[i], s], -s))
                if to != at[i] and alone[to]:
                    other = alone[to].pop()
                    alone[at[i]].append(other)
                    held[text[i], at[i]] -= 1
                    held[text[i], to] += 1
                    at[other], at[i] = at[i], to
                    moved += 1
        if not moved:
            break
    return sum(len({at[i] for i in at if text[i] == t}) - 1 for t in size)


@pytest.mark.parametrize("alone", [2000, 600, 0])
def test_sharding_cuts_no_more_than_plain_propagation(spark, alone):
    rng = random.Random(alone)
    texts = [f"g{g}" for g in range(150) for _ in range(rng.randint(2, 25))] + ["hot"] * 700 + [f"x{k}" for k in range(alone)]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    got = sharding.balanced_shards(table(spark, rows)).toPandas()
    cuts = int((got.assign(t=got.doc_id.map(dict(rows))).groupby("t").shard.nunique() - 1).sum())
    sizes = got.groupby("shard").size()
    assert sizes.max() - sizes.min() <= 1
    # no placement has fewer cuts than the hot group needs; each shard's edge may cut one group more
    least = -(-700 // (len(rows) // 16)) - 1
    assert cuts <= plain_propagation(rows, 16) + 16 and (not alone or cuts <= least + 3 * 16)


def test_sharding_odd_rows(spark, odd, none):
    got = sharding.balanced_shards(odd, 4).toPandas()
    assert len(got) == len(ODD) and got.groupby("shard").size().max() - got.groupby("shard").size().min() <= 1
    assert sorted(zip(got.doc_id, got["size"], strict=True)) == sorted((i, len((t or "").encode()) + 1) for i, t in ODD)
    assert sharding.balanced_shards(none).count() == 0


# --- 9 --------------------------------------------------------------------------------------------------------------


def plain_components(rows, words, similarity=80):
    sets = {}
    for i, t in rows:
        w = (t or "").lower().split()
        sets.setdefault(i, []).append({tuple(w[k : k + words]) for k in range(len(w) - words + 1)} or ({tuple(w)} if w else set()))
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        if any(x and y and 100 * len(x & y) >= similarity * len(x | y) for x in sets[a] for y in sets[b]):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in sets}


@pytest.mark.parametrize("words", [2, 5])
def test_near_dedup_matches_brute_force(spark, words):
    rng = random.Random(words)
    bases = [prose(rng, 60).split() for _ in range(12)]
    rows = []
    for i in range(300):
        x = list(rng.choice(bases[:2] if i % 3 else bases))
        for _ in range(rng.randint(0, 7)):
            x[rng.randrange(len(x))] = f"n{rng.randrange(10**6)}"
        rows.append((i, " ".join(x)))
    got = near_dedup.near_duplicates(table(spark, rows), words=words).collect()
    assert {r.doc_id: r.component_id for r in got} == plain_components(rows, words)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_dedup_odd_rows(spark, odd, none):
    got = Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(odd, words=2).collect())
    # upper case counts as lower case; texts without words are linked with nothing
    assert got == Counter([(1, 0, 1, True), (2, 0, 2, True), (3, 2, 3, True), (3, 2, 3, True), (4, 2, 3, False), (5, 0, 5, True), (6, 2, 6, True), (7, 3, 7, True), (8, 2, 3, False), (9, 1, 9, True), (10, 2, 6, False), (11, 2, 11, True), (12, 2, 3, False)])
    assert near_dedup.near_duplicates(none).count() == 0
    assert near_dedup.drop_near_duplicates(odd, words=2).columns == odd.columns


def test_near_dedup_of_ids_that_repeat_with_other_texts(spark):
    rng = random.Random(17)
    bases = [prose(rng, 50).split() for _ in range(25)]
    rows = []
    for _ in range(150):
        x = list(rng.choice(bases))
        for _ in range(rng.randint(0, 3)):
            x[rng.randrange(50)] = f"n{rng.randrange(10**6)}"
        rows.append((rng.randrange(110), " ".join(x) if rng.random() > 0.05 else None))
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(table(spark, rows), words=2).collect()}
    assert got == plain_components(rows, 2)


def test_near_dedup_null_and_text_ids(spark):
    base = " ".join(f"w{i}" for i in range(40))
    ids, texts = [7, None, 3, 5, None], [base, base, base + " x", "a b c", None]
    star = [(None, base)] + [(i, f"{base} y{i}") for i in range(9)]
    assert {r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(star, "doc_id long, text string"), words=2).collect()} == {None}
    whole = Counter(map(tuple, near_dedup.near_duplicates(spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id int, text string"), words=2).collect()))
    # both rows with a null id are one node, the smallest of all
    assert whole == Counter([(7, 39, None, False), (None, 39, None, True), (3, 40, None, False), (5, 2, 5, True), (None, 0, None, True)])
    once = Counter(map(tuple, near_dedup.near_duplicates(spark.createDataFrame(list(zip(ids, texts, strict=True))[:4], "doc_id int, text string"), words=2).collect()))
    assert once == Counter([(7, 39, None, False), (None, 39, None, True), (3, 40, None, False), (5, 2, 5, True)])
    named = spark.createDataFrame([("b", base), ("a", base + " x"), ("c", base), ("z", "a b c"), (None, "other text here")], "doc_id string, text string").selectExpr("*", "1 AS _gone", "2 AS kept")
    assert {tuple(r) for r in near_dedup.near_duplicates(named, words=2).collect()} == {("b", 39, "a", False), ("a", 40, "a", True), ("c", 39, "a", False), ("z", 2, "z", True), (None, 2, None, True)}
    kept = near_dedup.drop_near_duplicates(named, words=2)
    assert {r.doc_id for r in kept.collect()} == {"a", "z", None} and kept.columns == named.columns


def test_tables_find_pairs_at_the_threshold():
    """Pairs of a similarity of 0.8 to 0.801: at least 0.999 of them share a table, and the sketch sets none aside."""
    rng = np.random.default_rng(5)
    odd, found, sketched, pairs = near_dedup._multipliers(), 0, 0, 6000
    for _ in range(pairs):
        both, left, right = 400, 50, 50
        values = rng.integers(0, 2**63, both + left + right).astype(np.uint64)
        low = [np.array([((v * odd[k] + odd[near_dedup.HASHES + k]) >> np.uint64(32)).min() for k in range(near_dedup.HASHES)]) for v in (values[: both + left], np.append(values[:both], values[both + left :]))]
        same = (low[0] == low[1]).reshape(2, near_dedup.TABLES, near_dedup.WIDTH).all(axis=2).any(axis=1)
        found += same.all()
        sketched += (low[0] & np.uint64(255) == low[1] & np.uint64(255)).sum() >= near_dedup.sketch_least(80)
    assert found / pairs >= 0.999 and sketched == pairs


def test_near_dedup_of_a_bucket_with_many_components(spark):
    """Texts that share a passage, in small groups of near copies: all meet, few are linked."""
    rng = random.Random(31)
    passage, rows = prose(rng, 120, 5000), []
    for g in range(260):
        body = [f"g{g}x{k}" for k in range(34)]
        for _ in range(rng.choice((1, 1, 2, 3))):
            x = list(body)
            x[rng.randrange(34)] = f"n{rng.randrange(10**6)}"
            rows.append((len(rows), passage + " " + " ".join(x)))
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(table(spark, rows), words=2, similarity=85).collect()}
    want = plain_components(rows, 2, 85)
    assert got == want and len(set(want.values())) > 200


def test_components_on_random_graphs(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    got = {r["_id"]: r["_label"] for r in near_dedup.components(spark.createDataFrame(edges, "_l long, _r long")).collect()}
    assert got == {x: root(x) for x in parent if root(x) != x}


# --- 10 -------------------------------------------------------------------------------------------------------------


def test_quality_separates_junk(spark):
    rng = random.Random(10)
    rows, labels = [], []
    for i in range(400):
        text = prose(rng, 40)
        rows.append((i, text if i % 4 else text.upper().replace(" ", "!! ")))
        labels.append((i, int(i % 4 > 0), 0))
    bank = quality.fit(table(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = quality.scores(table(spark, rows), bank).collect()
    held = [r for r in got if r.held_out]
    assert len(held) > 50 and all(r.predicted == int(r.doc_id % 4 > 0) for r in held)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    kept = quality.keep_quality(table(spark, rows), bank)
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if r.score >= 0.7} and kept.columns == table(spark, []).columns


def test_quality_votes_match_plain_cosine_voting(spark):
    """Scores against a loop over the bank in double precision, whatever rows stand beside a text; equal texts score alike."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    bank = quality.fit(docs, spark.read.parquet("/root/testdata/sf0.01/labels.parquet"))
    texts = [r[0] for r in docs.select("text").limit(300).collect()] + [None, "", "a b c"] * 2
    x = np.concatenate([f for _, _, f in quality.features(pa.array(texts))])
    got = bank.score(x.copy())
    z = x.astype(np.float64) * bank.idf
    for part in (slice(0, quality.HALF), slice(quality.HALF, 2 * quality.HALF), slice(2 * quality.HALF, None)):
        z[:, part] /= np.maximum(np.linalg.norm(z[:, part], axis=1, keepdims=True), 1e-300)
    z = z @ bank.axes.astype(np.float64)
    z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-300)
    for i, row in enumerate(z):
        votes = sorted(((float(round(row @ v, 5)), y) for v, y in zip(bank.vectors.astype(np.float64), bank.labels, strict=True)), reverse=True)
        last = votes[min(quality.NEIGHBOURS, len(votes)) - 1][0]
        votes = [(max(c, 0) ** quality.SHARPNESS, y) for c, y in votes if c >= last]
        want = sum(c * y for c, y in votes) / sum(c for c, _ in votes) if sum(c for c, _ in votes) > 0 else bank.labels.mean()
        assert got[i] == pytest.approx(want, abs=0.02), i
    assert got[-1] == got[-4] and got[-2] == got[-3] == got[-5] == got[-6]
    order = np.random.default_rng(3).permutation(len(texts))
    assert (bank.score(x[order])[np.argsort(order)] == got).mean() > 0.99 and np.allclose(bank.score(x[order])[np.argsort(order)], got, atol=0.02)
    assert np.allclose(np.concatenate([bank.score(x[i : i + 1]) for i in range(40)]), got[:40], atol=0.02)


def test_quality_of_long_texts(spark, odd):
    bank = quality.fit(odd, spark.createDataFrame([(3, 1), (7, 0), (6, 1), (9, 0)], "doc_id long, quality int"))
    assert {r.score for r in quality.scores(odd, bank).collect() if r.doc_id in (6, 10)} != set()


def test_quality_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(3, 1), (7, 0), (6, None), (None, 1), (9, 1), (9, 0)], "doc_id long, quality int")
    got = quality.scores(odd, quality.fit(odd, labels)).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in quality.scores(odd, quality.fit(odd, labels.limit(0))).collect()} == {0.5}
    assert quality.scores(none, quality.fit(none, labels)).count() == 0
