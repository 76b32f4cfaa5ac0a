"""Best-fit packing by exact-complement hashing.

Documents become token ids and an end token; only those longer than a sequence are cut, into whole sequences from the end,
so that the first piece is the shorter one.  All that decides a packing is how many pieces there are of each length: a
table of LENGTH rows at most, whatever the input.  plan() works on these counts, on the driver:

1. Longest first, a length takes single pieces that fill its gap exactly, as often as the counts of both allow.
2. Pieces of a seed length and more are placed by best fit, decreasing.  Each gap they leave is looked up in a hash table of
   pair sums, then as a triple: a single and the pair sum of the rest.  Combinations that fill it exactly are consumed as often
   as the counts of their members allow.  All lengths take part.
3. What is left is packed by best fit, decreasing, many pieces at a time: all open sequences with the same smallest
   sufficient gap take a piece each.

The plan is a list of steps: pieces of one length with ranks [from, from + n) go to sequences [seq, seq + n) at an offset.
Its size depends on LENGTH, not on the rows; it is broadcast and each piece finds its step by binary search.  Ranks within a
length come from counts of hash parts, more for more rows, and prefix sums, so that no window holds all pieces of a length.

Cases: null or empty text is the end token alone; repeated rows are packed each; ties go by document and piece; an empty table
gives an empty result; only the id and text columns are read, so other columns may have any names.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.common import lean, prefix_offsets, stored, table

LENGTH, END = 1024, 2
#: Rows of one length that a window ranks at a time, about; rows of ranks that are broadcast at most, more are joined.
PART_ROWS, BROADCAST_RANKS = 1 << 22, 1 << 18
#: Lengths, of 1024, from which on best fit places pieces before combinations fill the gaps; 0: those over half, while shorter
#: ones may open sequences that combinations fill.
SEEDS = (0, 513, 320, 192, 128, 96)
#: (length, first rank, number, first sequence, offset)
Step = tuple[int, int, int, int, int]


@lru_cache(maxsize=1)
def _encoder(folder: str | None):
    """tiktoken with the ranks of byte_bpe_50k gives the ids of the tokenizers file of that name, some three times as fast;
    a test compares both.  Texts that hold the special token's string go to tokenizers itself."""
    import base64
    import os

    import public_tokenizers
    import tiktoken

    path = (lambda name: os.path.join(folder, name)) if folder else public_tokenizers.path
    with open(path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    @lru_cache(maxsize=1)
    def slow():  # a third of the encoder's memory, for texts that hardly any corpus has
        from tokenizers import Tokenizer

        return Tokenizer.from_file(path("byte_bpe_50k.json"))

    def encode(text: str) -> np.ndarray:
        if "<|endoftext|>" in text:
            return np.array(slow().encode(text, add_special_tokens=False).ids, np.uint32)
        return fast.encode_to_numpy(text, disallowed_special=()).astype(np.uint32, copy=False)

    return encode


def cuts(n: int, length: int = LENGTH) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: whole sequences, the first piece may be shorter."""
    first = n % length or length
    return [(0, first), *((s, length) for s in range(first, n, length))]


def pieces(docs: DataFrame, length: int = LENGTH, end: int = END, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """_id, _piece, _start, _length, _crc for each piece of each row."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(folder)
        for batch in batches:
            rows, out = [], ([], [], [], [])
            for i, text in enumerate(batch.column(1)):
                ids = np.append(encode(text.as_py() or ""), np.uint32(end)).astype("<u4")
                for k, (s, n) in enumerate(cuts(len(ids), length)):
                    rows.append(i)
                    for to, x in zip(out, (k, s, n, zlib.crc32(ids[s : s + n])), strict=True):
                        to.append(x)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(out[0], pa.int32()), *(pa.array(x, pa.int64()) for x in out[1:])], ["_id", "_piece", "_start", "_length", "_crc"])

    own = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return own.mapInArrow(lean(cut), f"_id {own.schema['_id'].dataType.simpleString()}, _piece int, _start long, _length long, _crc long")


def plan(counts: dict[int, int], length: int = LENGTH) -> _Plan:
    """The steps that place all counted pieces, and the number of sequences they use.

    Which pieces best fit should place before combinations fill the gaps depends on the lengths there are, so each of SEEDS is
    tried, with the largest and with the smallest gaps first; of plans with equally few sequences one with triples, then the one
    with most combinations, is taken."""
    tried = [_Plan(counts, length).made(seed * length // 1024, largest) for seed in SEEDS for largest in (True, False)]
    return min(tried, key=lambda x: (x.sequences, x.filled[3] == 0, -x.filled[2] - x.filled[3]))


class _Plan:
    """Open sequences by gap, and the pieces that are left, as counts of each length."""

    def __init__(self, counts: dict[int, int], length: int):
        self.length, self.sequences = length, 0
        self.left, self.used = np.zeros(length + 1, np.int64), np.zeros(length + 1, np.int64)
        for x, n in counts.items():
            self.left[x] += n
        self.steps: list[Step] = []
        self.gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap -> (first sequence, number)
        self.filled: Counter = Counter()  # members of the combination -> gaps filled exactly

    def made(self, seed: int, largest: bool) -> _Plan:
        self.open(self.length, int(self.left[self.length]))
        for x in range(self.length - 1, self.length // 2, -1):  # an exact partner is never a loss
            n = int(min(self.left[x], self.left[self.length - x]))
            if n:
                self.open(x, n)
                self.fill(self.length - x, (self.length - x,))
        self.best_fit(seed or self.length // 2 + 1)
        self.combine(largest, not seed)
        self.best_fit(1)
        return self

    def open(self, x: int, n: int, times: int = 1) -> None:
        """n new sequences that begin with so many pieces of length x."""
        if not n:
            return
        for k in range(times):
            self.place(x, n, self.sequences, k * x)
        if self.length - times * x:
            self.gaps[self.length - times * x].append((self.sequences, n))
        self.sequences += n

    def place(self, x: int, n: int, first: int, at: int) -> None:
        self.steps.append((x, int(self.used[x]), n, first, at))
        self.used[x] += n
        self.left[x] -= n

    def fill(self, gap: int, members: tuple[int, ...]) -> None:
        """Members into the open sequences with that gap, as often as both last; what is left of a gap stays open."""
        n = min(int(self.left[m]) // k for m, k in Counter(members).items())
        while n and self.gaps[gap]:
            first, there = self.gaps[gap].pop()
            take, at = min(n, there), self.length - gap
            for m in members:
                self.place(m, take, first, at)
                at += m
            if at < self.length:
                self.gaps[self.length - at].append((first, take))
            else:
                self.filled[len(members)] += take
            if there > take:
                self.gaps[gap].append((first + take, there - take))
            n -= take

    def combine(self, largest: bool, opening: bool) -> None:
        """Fill gaps exactly, then, if opening, those of shorter pieces that open sequences of their own: by pairs, looked up by their sum, then by triples, a single and the pair sum of what it leaves, then
        by singles, which best fit would find as well.  Of combinations with one sum the most even come first: they leave the
        smallest pieces, which fit anywhere."""
        lengths = np.flatnonzero(self.left).tolist()
        pairs: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for i, a in enumerate(lengths):
            for b in lengths[: i + 1]:
                if a + b > self.length:
                    break
                pairs[a + b].append((b, a))
        by_sum = {s: np.array(x) for s, x in pairs.items()}
        none = np.zeros((0, 2), np.int64)

        def available(total: int) -> list[tuple[int, int]]:
            p = by_sum.get(total, none)
            return p[(self.left[p] > 0).all(axis=1) & ((p[:, 0] != p[:, 1]) | (self.left[p[:, 0]] > 1))].tolist()

        def fill(gap: int, triple: bool, limit: Callable[[int], bool]) -> None:
            for a in reversed([x for x in lengths if 3 * x <= gap]) if triple else (0,):
                if not limit(gap):
                    break
                if not a or self.left[a]:
                    for b, c in available(gap - a):
                        if b >= a:
                            members = (c, b, a) if a else (c, b)
                            if opening and not self.gaps[gap]:  # open as many as the combination fills
                                x = self.length - gap
                                n = min(int(self.left[m]) // k for m, k in Counter((x, *members)).items())
                                self.open(x, n)
                            self.fill(gap, members)

        for triple in (False, True):
            for gap in sorted((g for g in self.gaps if self.gaps[g]), reverse=largest):
                fill(gap, triple, lambda g: bool(self.gaps[g]))
            for x in reversed(lengths) if opening else ():
                if x < self.length:
                    fill(self.length - x, triple, lambda g: bool(self.gaps[g] or self.left[self.length - g]))

    def best_fit(self, least: int) -> None:
        """Pieces of at least that length, the longest first, into the smallest gap that holds them."""
        for x in range(self.length, max(least, 1) - 1, -1):
            while self.left[x]:
                gap = min((g for g in self.gaps if g >= x and self.gaps[g]), default=None)
                if gap is not None:
                    self.fill(gap, (x,))
                    continue
                left, each = int(self.left[x]), self.length // x  # as many as fit into a new one
                self.open(x, *((left // each, each) if left >= each else (1, left)))


def pack(docs: DataFrame, length: int = LENGTH, end: int = END, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: id, piece, start, length, ids_crc32, sequence_id, offset."""
    cut = stored(pieces(docs, length, end, folder, id_col, text_col), "pieces")
    counts = {r["_length"]: r["n"] for r in cut.groupBy("_length").agg(F.count(F.lit(1)).alias("n")).collect()}  # length rows at most
    parts = max(64, sum(counts.values()) // PART_ROWS)
    cut = cut.withColumns({"_part": F.pmod(F.xxhash64("_id", "_piece", "_start"), F.lit(parts)).cast("int"), "_one": F.lit(1)})
    before = stored(prefix_offsets(cut, ["_length"], "_part", "_one"), "ranks")  # lengths x parts rows at most
    steps = sorted(plan(counts, length).steps)
    by = docs.sparkSession.sparkContext.broadcast(tuple(np.array(x, np.int64) for x in zip(*steps, strict=True)) if steps else ())
    rank = F.row_number().over(Window.partitionBy("_length", "_part").orderBy("_id", "_piece", "_start")) - 1
    ranked = cut.withColumn("_r", rank).join(F.broadcast(before) if len(counts) * parts <= BROADCAST_RANKS else before, ["_length", "_part"])
    ranked = ranked.select("_id", "_piece", "_start", "_length", "_crc", (F.col("_r") + F.col("_before")).cast("long").alias("_rank"))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, first, _, sequence, at = by.value
        width = np.int64(1) << 40  # ranks are below it
        keys = of * width + first
        for batch in batches:
            n, r = (batch.column(i).to_numpy() for i in (3, 5))
            k = np.searchsorted(keys, n * width + r, "right") - 1
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence[k] + r - first[k]), pa.array(at[k])], names)

    names = [id_col, "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    kind = ranked.schema["_id"].dataType.simpleString()
    return ranked.mapInArrow(lean(assign), f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
