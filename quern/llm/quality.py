"""Quality classifier: nearest-neighbour voting in a latent-semantic space.

A text is counted in hashed features, pairs of bytes (upper and lower case differ) and words, and in shares that tell its shape
(repeated neighbours, distinct words, capitals, signs, digits, single signs, word length), each spread over KNOTS features.
Logarithms of the counts, weighted by inverse document frequency, and the shares are each scaled to length one and together
projected on the leading singular vectors.  The bank is
a sample of labelled rows, at most PER_CLASS of each label, those with the smallest hashes of their ids; its vectors and
labels are broadcast (PER_CLASS * 2 * RANK numbers at most).  Every text meets the whole bank in blocked matrix products; its
NEIGHBOURS nearest vote with the power SHARPNESS of their cosine.

Only the text goes into a score.  Rows whose crc32(id as text) mod 4 is 2 never enter the bank.

Cases: null text is empty text; empty texts and texts that share no feature with the bank get the bank's share of label 1;
rows with equal texts get equal scores; neighbours that tie for the last place all vote; an id labelled more than once counts with its smallest label, null labels not at
all; without any usable label every score is 0.5; an empty table gives an empty result; the operator reads only the id and
text columns, so other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import Words, chunks, crc_mod, lean, mix, stored, table, utf8

HALF, KNOTS, SHARES = 1024, 9, 8
WIDTH = 2 * HALF + KNOTS * SHARES
RANK, PER_CLASS, NEIGHBOURS, SHARPNESS, THRESHOLD = 64, 2048, 32, 8, 0.7


def _pair_codes() -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix(np.arange(1 << 16, dtype=np.uint64) + np.uint64(1)) % np.uint64(HALF)).astype(np.int64)


def features(col: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first row, end row, logarithms of 1 + counts of byte pairs and of words)."""
    codes = _pair_codes()
    data, off = utf8(col)
    for a, b in chunks(off, 1 << 19, 1024):
        own, at = data[off[a] : off[b]], off[a : b + 1] - off[a]
        n = b - a
        doc = np.repeat(np.arange(n), np.diff(at))
        within = doc[1:] == doc[:-1]
        pair = codes[(own[:-1].astype(np.int64) << 8) | own[1:]][within]
        words = Words(own, at)
        counts = np.concatenate([
            np.bincount(doc[:-1][within] * HALF + pair, minlength=n * HALF).reshape(n, HALF),
            np.bincount(words.doc * HALF + (words.hash >> np.uint64(54)).astype(np.int64), minlength=n * HALF).reshape(n, HALF),
        ], axis=1)
        yield a, b, np.concatenate([np.log1p(counts), _shape(own, at, words, (counts[:, HALF:] > 0).sum(axis=1))], axis=1).astype(np.float32)


_UPPER, _LETTER, _DIGIT, _SIGN = (np.zeros(256, bool) for _ in range(4))
_UPPER[65:91] = _LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = _DIGIT[48:58] = True
_SIGN[33:127] = ~(_LETTER | _DIGIT)[33:127]


def _shape(data: np.ndarray, at: np.ndarray, words: Words, buckets: np.ndarray) -> np.ndarray:
    """Each share as weights of the two knots next to it."""
    n = len(at) - 1

    def per_row(mask: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(mask)])[bounds])

    size, count = np.maximum(np.diff(at), 1), np.maximum(words.per_doc, 1)
    again = np.zeros(len(words.hash), bool)
    again[1:] = (words.hash[1:] == words.hash[:-1]) & (words.doc[1:] == words.doc[:-1])
    length = words.end - words.start
    shares = np.stack([
        per_row(again, words.bounds) / count,
        buckets / np.minimum(count, HALF),
        per_row(_UPPER[data], at) / np.maximum(per_row(_LETTER[data], at), 1),
        4 * per_row(_SIGN[data], at) / size,
        4 * per_row(_DIGIT[data], at) / size,
        per_row((length == 1) & _SIGN[data[words.start]], words.bounds) / count,
        per_row(length, words.bounds) / count / 16,
        per_row(_SIGN[data[words.end - 1]], words.bounds) / count,
    ], axis=1)
    place = np.clip(shares, 0, 1) * (KNOTS - 1)
    low = np.minimum(place.astype(np.int64), KNOTS - 2)
    out = np.zeros((n, SHARES, KNOTS))
    rows, cols = np.indices(low.shape)
    out[rows, cols, low] = 1 - (place - low)
    out[rows, cols, low + 1] = place - low
    out[words.per_doc == 0] = 0
    return out.reshape(n, SHARES * KNOTS)


@dataclass
class Bank:
    idf: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    def scaled(self, x: np.ndarray) -> np.ndarray:
        x = x * self.idf
        for part in (slice(0, HALF), slice(HALF, 2 * HALF), slice(2 * HALF, None)):
            size = np.linalg.norm(x[:, part], axis=1, keepdims=True)
            x[:, part] /= np.where(size > 0, size, 1)
        return x

    def project(self, x: np.ndarray) -> np.ndarray:
        z = self.scaled(x) @ self.axes
        size = np.linalg.norm(z, axis=1, keepdims=True)
        return z / np.where(size > 0, size, 1)

    def score(self, x: np.ndarray, block: int = 256) -> np.ndarray:
        """Each row against the whole bank.  Blocks have one shape and cosines are rounded, so that a row's score doesn't hang on
        the rows beside it; all of the bank that are as near as the last of the NEIGHBOURS vote."""
        out = np.full(len(x), self.labels.mean() if len(self.labels) else 0.5, np.float64)
        if not len(self.labels):
            return out
        k = min(NEIGHBOURS, len(self.labels))
        full = np.zeros((block, x.shape[1]), np.float32)
        for s in range(0, len(x), block):
            part = x[s : s + block]
            full[: len(part)], full[len(part) :] = part, 0
            cosine = np.round(self.project(full) @ self.vectors.T, 5)[: len(part)]
            least = np.partition(cosine, len(self.labels) - k, axis=1)[:, len(self.labels) - k]
            row, near = np.nonzero((cosine >= least[:, None]) & (cosine > 0))
            weight = cosine[row, near].astype(np.float64) ** SHARPNESS
            total, yes = np.bincount(row, weight, len(part)), np.bincount(row, weight * self.labels[near], len(part))
            out[s : s + block][total > 0] = yes[total > 0] / total[total > 0]
        return np.clip(out, 0, 1)


def _axes(x: np.ndarray, rank: int, seed: int = 11) -> np.ndarray:
    """Leading right singular vectors, by subspace iteration."""
    rank = min(rank, *x.shape)
    q = np.linalg.qr(x.T @ np.random.default_rng(seed).standard_normal((x.shape[0], min(rank + 16, *x.shape))).astype(np.float32))[0]
    for _ in range(4):
        q = np.linalg.qr(x.T @ (x @ q))[0]
    _, _, v = np.linalg.svd(x @ q, full_matrices=False)
    return (q @ v.T)[:, :rank].astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality", rank: int = RANK, per_class: int = PER_CLASS) -> Bank:
    """The bank from rows of docs that labels marks and that aren't held out."""
    known = labels.select(F.col(id_col).alias("_id"), F.col(label).cast("int").alias("_label")).where("_label IN (0, 1) AND _id IS NOT NULL").where(crc_mod("_id", 4) != 2)
    known = known.groupBy("_id").agg(F.min("_label").alias("_label"))
    sides = [known.where(F.col("_label") == v).orderBy(F.xxhash64("_id"), "_id").limit(per_class) for v in (0, 1)]
    sample = stored(sides[0].union(sides[1]), "sample")  # 2 * per_class ids at most
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(sample), "_id").select("_text", "_label", "_id")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, x in features(batch.column(0)):
                yield pa.RecordBatch.from_arrays([batch.column(2).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array([r.tobytes() for r in x.astype(np.float16)], pa.binary())], ["_id", "_label", "_x"])

    kind = rows.schema["_id"].dataType.simpleString()
    # an id that documents repeat counts once: its first text
    got = rows.mapInArrow(lean(count), f"_id {kind}, _label int, _x binary").groupBy("_id", "_label").agg(F.min("_x").alias("_x")).orderBy("_id").collect()
    y = np.array([r["_label"] for r in got], np.float64)
    if not len(got):
        return Bank(np.ones(WIDTH, np.float32), np.zeros((WIDTH, 1), np.float32), np.zeros((0, 1), np.float32), y)
    x = np.frombuffer(b"".join(bytes(r["_x"]) for r in got), np.float16).reshape(len(got), WIDTH).astype(np.float32)
    idf = np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))).astype(np.float32) + np.float32(1)
    idf[2 * HALF :] = 1
    bank = Bank(idf, np.zeros((WIDTH, 1), np.float32), np.zeros((0, 1), np.float32), y)
    bank.axes = _axes(bank.scaled(x), rank)
    bank.vectors = bank.project(x)
    return bank


def scores(docs: DataFrame, bank: Bank, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id, held_out, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(bank)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, x in features(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(shared.value.score(x))], ["_id", "score"])

    own = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    got = own.mapInArrow(lean(score), f"_id {own.schema['_id'].dataType.simpleString()}, score double")
    return got.select(F.col("_id").alias(id_col), F.coalesce(crc_mod("_id", 4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_quality(docs: DataFrame, bank: Bank, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of docs with a score of at least the threshold, with its columns; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(bank)
    at = docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, x in features(batch.column(at)):
                yield batch.slice(a, b - a).filter(pa.array(shared.value.score(x) >= threshold))

    return docs.mapInArrow(lean(keep), docs.schema)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scores(docs, fit(docs, table(spark, sf_dir, "labels")))
