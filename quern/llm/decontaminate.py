"""Benchmark decontamination by spaced-seed hashing.

MASKS are fixed patterns over SPAN word positions: a hash takes the words at the ones and ignores the others, so that words
may be replaced there: a window of SPAN words with two replaced words, wherever they stand, is hit by one mask at least, and so
is any stretch of SPAN words or more with a fifth of them replaced between equal ends (a test tries all).  The hashes of all
windows of the test items meet those of all windows of the documents; each hit fixes an alignment (item, document position of the item's first word).  Around a hit the words are compared along the
alignment, and the item leaks if some stretch of at least min(MIN_WORDS, words of the item) words, which starts and ends with
an equal word, has at least SIMILARITY equal words in a hundred.  Items with fewer words than a mask's span are compared at
every place where their first or last word occurs.

Test items go to the executors in blocks of at most BLOCK words, a broadcast of proven size each; documents are scanned once
for each block and are never shuffled.  What is returned is one row for each document and item that leaks into it.

Cases: null and empty texts have no words and never leak; items without words are ignored; repeated rows are reported each;
of several alignments of an item in a document the one with most equal words counts, then the first; an empty table gives an
empty result; only the id and text columns are read, so other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import Words, lean, mix, scan_words, table

#: Two of four interleaved groups of three positions each: any two ignored positions are in the groups that some mask ignores.
#: The next two find replacements that stand close together, by the six words beside them;
#: with the last two every stretch of 12 words or more with a fifth replaced, ends equal, is hit by a mask somewhere.
MASKS = ("110011001100", "101010101010", "100110011001", "011001100110", "010101010101", "001100110011", "111111000000", "000000111111", "110010110001", "111101100000")
SPAN = 12
MIN_WORDS, SIMILARITY = 12, 80
BLOCK = 1 << 20
SCHEMA = "_id {}, item_id {}, n_equal int, n_words int, doc_word int, item_word int"


def _seeds(h: np.ndarray, mask: str) -> np.ndarray:
    """Hash of each window of SPAN words under the mask."""
    n = len(h) - SPAN + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    factor = 0x9E3779B97F4A7C15
    with np.errstate(over="ignore"):
        for i, bit in enumerate(mask):
            if bit == "1":
                out += h[i : i + n] * np.uint64(factor)
                factor = factor * 0xD1342543DE82EF95 % 2**64
        return mix(out)


class Items:
    """A block of test items: their words, and seed hashes sorted for search behind a table of 2^20 flags."""

    def __init__(self, words: list[np.ndarray]):
        self.words = words
        self.tables = []
        for mask in MASKS:
            own = [_seeds(w, mask) for w in words]
            keys = np.concatenate([np.zeros(0, np.uint64), *own])
            item = np.repeat(np.arange(len(words)), [len(x) for x in own])
            at = np.concatenate([np.zeros(0, np.int64), *(np.arange(len(x)) for x in own)])
            again = np.zeros(len(keys), bool)
            again[1:] = (keys[1:] == keys[:-1]) & (item[1:] == item[:-1])
            self._add(keys, item, at, again)
        # short items: their first and last words stand for a seed
        short = [(w[k], i, k) for i, w in enumerate(words) if 0 < len(w) < SPAN for k in {0, len(w) - 1}]
        self._add(np.array([x[0] for x in short], np.uint64), np.array([x[1] for x in short], np.int64), np.array([x[2] for x in short], np.int64), np.zeros(len(short), bool))

    def _add(self, keys: np.ndarray, item: np.ndarray, at: np.ndarray, again: np.ndarray) -> None:
        flags = np.zeros(1 << 20, bool)
        flags[(keys >> np.uint64(44)).astype(np.int64)] = True
        order = np.argsort(keys, kind="stable")
        self.tables.append((flags, *((keys[o], item[o], at[o]) for o in (order, order[~again[order]]))))

    def alignments(self, w: Words, most: int = 1 << 20) -> np.ndarray:
        """Rows (row of w, item, word of the row where the item's first word would be), each once: of every equal seed in one row.

        A seed that follows an equal one on both sides tells the alignment of the hit before: a position that repeats its seed
        meets the items' first ones of such runs only.  Hits are made so many at a time and reduced to alignments, of which there
        are no more than words of the row and of the item together."""
        sizes = np.array([len(x) for x in self.words])
        wide = int(w.per_doc.max(initial=0)) + int(sizes.max(initial=0)) + 1
        found = np.zeros(0, np.int64)
        for k, (flags, every, firsts) in enumerate(self.tables):
            if not len(every[0]):
                continue
            own = _seeds(w.hash, MASKS[k]) if k < len(MASKS) else w.hash
            maybe = np.flatnonzero(flags[(own >> np.uint64(44)).astype(np.int64)])
            again = np.zeros(len(maybe), bool)
            if k < len(MASKS):
                again = (maybe > 0) & (own[maybe] == own[maybe - 1]) & (w.doc[maybe] == w.doc[maybe - 1])
            for (keys, item, at), where in ((every, maybe[~again]), (firsts, maybe[again])):
                lo, hi = np.searchsorted(keys, own[where], "left"), np.searchsorted(keys, own[where], "right")
                ends = np.cumsum(hi - lo)
                first = 0
                while first < len(where):
                    before = ends[first - 1] if first else 0
                    last = max(first + 1, int(np.searchsorted(ends, before + most, "right")))
                    n = (hi - lo)[first:last]
                    pick = np.repeat(lo[first:last] - (ends[first:last] - n - before), n) + np.arange(n.sum())
                    pos, i = np.repeat(where[first:last], n), item[pick]
                    doc = w.doc[pos]
                    start = pos - at[pick] - w.bounds[doc]
                    inside = pos - w.bounds[doc] + np.where(sizes[i] < SPAN, 1, SPAN) <= w.per_doc[doc]  # a hit must lie in one row
                    if inside.any():
                        found = np.unique(np.concatenate([found, (doc[inside] * len(sizes) + i[inside]) * wide + start[inside] + sizes.max()]))
                    first = last
        both, start = np.divmod(found, wide)
        return np.stack([*np.divmod(both, max(1, len(sizes))), start - sizes.max(initial=0)], 1)


def best_stretch(equal: np.ndarray, least: int, similarity: int = SIMILARITY) -> tuple[int, int, int] | None:
    """(equal words, first, end) of the stretch with most equal words that starts and ends equal, has least words or more and the
    similarity; the shortest of those, then the first.

    From the k-th to the l-th equal word a stretch has the similarity if balance[l] >= balance[k] + similarity - 100 for balance
    = 100 k - similarity * place; the longest that ends at l starts where the running minimum first allows it."""
    at = np.flatnonzero(equal)
    if not len(at):
        return None
    balance = 100 * np.arange(len(at)) - similarity * at
    start = np.searchsorted(-np.minimum.accumulate(balance), -(balance + 100 - similarity), "left")
    same, size = np.arange(len(at)) - start + 1, at - at[start] + 1
    good = np.flatnonzero(size >= least)
    if not len(good):
        return None
    k = good[np.lexsort((at[start[good]], size[good], -same[good]))[0]]
    return int(same[k]), int(at[start[k]]), int(at[k]) + 1


def found_in(texts: pa.Array, seeds: Items, min_words: int, similarity: int) -> Iterator[tuple[int, int, tuple[int, int, int, int]]]:
    """(row, index of the item, (equal words, words, first word in the text, first word in the item)) of each leak into a text."""
    for a, _, w in scan_words(texts):
        best: dict[tuple[int, int], tuple] = {}
        for d, i, s in seeds.alignments(w).tolist():
            x = seeds.words[i]
            lo, hi = max(0, -s), min(len(x), int(w.per_doc[d]) - s)
            base = int(w.bounds[d]) + s
            got = best_stretch(w.hash[base + lo : base + hi] == x[lo:hi], min(min_words, len(x)), similarity)
            if got and ((d, i) not in best or got[0] > best[d, i][0]):
                best[d, i] = (got[0], got[2] - got[1], s + lo + got[1], lo + got[1])
        for (d, i), values in best.items():
            yield a + d, i, values


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", min_words: int = MIN_WORDS, similarity: int = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """One row for each row of docs and item that leaks into it: id, item_id, n_equal, n_words, doc_word, item_word."""
    spark = docs.sparkSession
    own = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    item_type = items.schema[item_col].dataType.simpleString()
    schema = SCHEMA.format(own.schema["_id"].dataType.simpleString(), item_type)
    parts = []
    for ids, words in _blocks(items.select(F.col(item_col).alias("_item"), F.col(item_text).alias("_text")), block):
        shared = spark.sparkContext.broadcast((ids, words))

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            item_ids, item_words = shared.value
            seeds = Items(item_words)
            for batch in batches:
                rows, out = [], ([], [], [], [], [])
                for row, item, values in found_in(batch.column(1), seeds, min_words, similarity):
                    rows.append(row)
                    for to, v in zip(out, (item_ids[item], *values), strict=True):
                        to.append(v)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(out[0], _arrow(item_type)), *(pa.array(x, pa.int32()) for x in out[1:])], ["_id", "item_id", "n_equal", "n_words", "doc_word", "item_word"])

        parts.append(own.mapInArrow(lean(scan), schema))
    found = reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)
    return found.withColumnRenamed("_id", id_col)


def _arrow(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]


def _blocks(items: DataFrame, most: int) -> Iterator[tuple[list, list[np.ndarray]]]:
    """Item ids and word hashes, at most so many words at a time: the driver holds one block."""
    ids, words, n = [], [], 0
    for row in items.toLocalIterator():
        for _, _, w in scan_words(pa.array([row["_text"]], pa.string())):
            if len(w.hash):
                ids.append(row["_item"])
                words.append(w.hash.copy())
                n += len(w.hash)
        if n >= most:
            yield ids, words
            ids, words, n = [], [], 0
    if ids:
        yield ids, words


def drop_leaks(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", min_words: int = MIN_WORDS, similarity: int = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """The rows of docs into which no item leaks, with its columns; rows are told where they are read, nothing is shuffled."""
    at = docs.columns.index(text_col)
    for _, words in _blocks(items.select(F.col(item_col).alias("_item"), F.col(item_text).alias("_text")), block):
        shared = docs.sparkSession.sparkContext.broadcast(words)

        def clean(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            seeds = Items(shared.value)
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                keep[[row for row, _, _ in found_in(batch.column(at), seeds, min_words, similarity)]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(lean(clean), docs.schema)
    return docs


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
