"""What the operators share: durable intermediate tables and vectorised text scanning."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.store import stored as stored


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(id_col: str | Column, n: int) -> Column:
    """crc32 of the id as text, modulo n: the split into training and held-out rows."""
    return F.crc32(F.col(id_col).cast("string") if isinstance(id_col, str) else id_col.cast("string")) % n


def prefix_offsets(df: DataFrame, by: list[str], part: str, amount: str) -> DataFrame:
    """Sums of amount over the parts before, for each (by, part).  The caller bounds the number of such pairs."""
    sums = df.groupBy(*by, part).agg(F.sum(amount).alias("_sum"))
    keys = ", ".join(by)
    over = f"partition by {keys} order by {part}" if by else f"order by {part}"
    return sums.selectExpr(*by, part, f"sum(_sum) over ({over}) - _sum as _before")


def lean(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """work, after which the memory that it freed goes back to the system: Python workers live on through stages of other kinds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            returned()

    return run


def kept(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """work, during which freed arrays stay with the process, so that the next ones need no new pages; they go back after it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limits = getattr(ctypes.CDLL(None), "mallopt", None)  # glibc has it
        if limits:
            limits(_TRIM, 256 << 20)
            limits(_MMAP, 32 << 20)
        try:
            yield from work(batches)
        finally:
            if limits:
                limits(_TRIM, 128 << 10)
                limits(_MMAP, 128 << 10)
            returned()

    return run


#: Numbers that mallopt has for what is kept free at the end of the heap and for what is mapped by itself.
_TRIM, _MMAP = -1, -3


def returned() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


# --- text as arrays -------------------------------------------------------------------------------------------------

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_powers: list[np.ndarray] = [np.ones(0, np.uint64), np.ones(0, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 1 << 20)
        for i, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads their bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; null counts as empty."""
    if col.null_count:
        col = pc.fill_null(col, "")
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = np.int64 if pa.types.is_large_string(col.type) else np.int32
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, wide)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def chunks(off: np.ndarray, most: int = 1 << 19, rows: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Runs of whole rows, with at most that many bytes and rows, or one row if it alone has more bytes."""
    at, n = 0, len(off) - 1
    while at < n:
        to = min(at + rows, max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1))
        yield at, min(to, n)
        at = min(to, n)


class Words:
    """Words of some rows: runs of characters other than [\\x20\\x09-\\x0D], A-Z in lower case.

    doc: the row of each word; hash: 64 bits; start, end: byte positions in data; per_doc: words of each row.
    """

    def __init__(self, data: np.ndarray, off: np.ndarray):
        n, docs = len(data), len(off) - 1
        self.data = low = _LOWER[data]
        solid = ~_SPACE[data]
        edge = np.zeros(n + 1, bool)
        edge[off] = True
        first, last = solid.copy(), solid.copy()
        first[1:] &= ~solid[:-1] | edge[1:n]
        last[:-1] &= ~solid[1:] | edge[1:n]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        bounds = np.searchsorted(self.start, off)
        self.bounds = bounds
        self.per_doc = np.diff(bounds)
        self.doc = np.repeat(np.arange(docs), self.per_doc)
        power, inverse = _power_tables(n + 1)
        with np.errstate(over="ignore"):
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum((low.astype(np.uint64) + np.uint64(1)) * power[:n], out=sums[1:])
            self.hash = mix((sums[self.end] - sums[self.start]) * inverse[self.start] + (self.end - self.start).astype(np.uint64))


def word_hash(word: str) -> int:
    """The hash that Words gives to a single word."""
    return int(Words(np.frombuffer(word.encode(), np.uint8), np.array([0, len(word.encode())])).hash[0])


def scan_words(col: pa.Array) -> Iterator[tuple[int, int, Words]]:
    data, off = utf8(col)
    for a, b in chunks(off):
        yield a, b, Words(data[off[a] : off[b]], off[a : b + 1] - off[a])


def shingles(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed n-word shingles of each row, sorted, and their offsets; fewer words: the sequence as one; none: none."""
    h, count = words.hash, words.per_doc
    with np.errstate(over="ignore"):
        rolled = np.zeros(len(h), np.uint64)
        for k in range(min(n, len(h))):
            rolled[: len(h) - k] = mix(rolled[: len(h) - k] * np.uint64(0xD6E8FEB86659FD93) + h[k:])
        at = np.arange(len(h)) - np.repeat(words.bounds[:-1], count)
        whole = at <= np.repeat(count, count) - n
        short = np.flatnonzero((count > 0) & (count < n))
        values, doc = rolled[whole], words.doc[whole]
        own = np.zeros(len(short), np.uint64)
        for k in range(n - 1):
            has = count[short] > k
            own[has] = mix(own[has] * np.uint64(0xD6E8FEB86659FD93) + h[words.bounds[:-1][short[has]] + k])
        values, doc = np.concatenate([values, own]), np.concatenate([doc, short])
        if len(short):
            order = np.argsort(doc, kind="stable")
            values, doc = values[order], doc[order]
    bounds = np.searchsorted(doc, np.arange(len(count) + 1))
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        values[a:b].sort()
    keep = np.ones(len(values), bool)
    keep[1:] = (values[1:] != values[:-1]) | (doc[1:] != doc[:-1])
    return values[keep], np.concatenate([[0], np.cumsum(keep)])[bounds]
