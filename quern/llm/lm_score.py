"""Language-model scoring: a log-bilinear neural model trained by noise-contrastive estimation.

Tokens are words in lower case (A-Z) and one end for each text.  Counts of all tokens, over all training rows, make the base
score.  The model works on units: the end, the WORDS most frequent words, and for all other words ENDINGS groups by their last two
bytes, inside which a word has its share of counts plus one.  Each unit has a vector as context and one as target; the ORDER units
before a token, each through the matrix of its position, add up to a vector q, and the score of a unit is its product with q
plus a bias.  Units stand in classes of CLASS: the probability of a unit is that of its class, by products of q with class
vectors, times that within its class, so that log-probabilities over all units are exactly normalised.  Exponentials of the products
with class vectors are made once for each unit and position, and a token multiplies those of its positions (25 MB in a worker).

Training goes over the texts where they lie, and over all of them: a hash of the text deals the rows to ROUNDS, and each round learns
from its own; the first rows of a task, up to LEAST tokens, are learnt from in every round.  A task draws noise classes and noise
units of the same class by their frequencies, and moves its own copy of the vectors by noise-contrastive estimation.  Copies meet in
blocks: a unit's change is the mean over tasks, weighted by how often each has moved it.  The driver and each task hold the model,
which has a fixed size, and a task the tokens of its first rows.

Counts of frequent words, KNOWN at most, are broadcast.  All other words of a text meet their counts in a join on the word's
hash, once for each text, where a task holds its part of the counts and sorts nothing; one that only held-out rows hold may be
frequent there, and adaptive execution splits its rows.  Words
are told apart by hashes of 64 bits; n_known and base_score are exact but for collisions of those.

Cases: null and empty texts are an end alone; repeated rows are scored each and counted each; a null id is not held out; ties in
frequency go by hash; without training rows all counts are 0 and base scores are 0; an empty table gives an empty result;
only the id and text columns are read, so other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import Words, chunks, crc_mod, kept, mix, stored, table, utf8

#: Units are the end, ENDINGS groups and WORDS words: CLASS^2 = 16,384 together.
CLASS, ENDINGS, WORDS, KNOWN = 128, 255, 16_128, 65_536
RANK, ORDER, CLASS_NOISE, NOISE, ROUNDS, RATE = 32, 3, 64, 16, 2, 0.12
#: Tokens at the start of a task that every round learns from, tokens of a step, and how often the former are gone over at most.
LEAST, STEP, EPOCHS = 1 << 17, 4096, 6
END, END_HASH = 0, 1
CHUNK, BLOCK, ROWS = 1 << 20, 1 << 15, 1 << 10
#: Leading bits of a hash by which frequent words are found.
BITS = 17
#: Groups of rows with at least as many are added up one by one.
FEW = 10
#: Rows of a block of exponentials, and products whose exponentials, one for each position, can be multiplied.
SMALL, LARGEST = 256, 25.0


def _scan(col: pa.Array) -> Iterator[tuple[int, int, Words]]:
    data, off = utf8(col)
    for a, b in chunks(off, CHUNK):
        yield a, b, Words(data[off[a] : off[b]], off[a : b + 1] - off[a])


def endings(w: Words) -> np.ndarray:
    """The group, from 1, of each word by its last two bytes."""
    last = w.data[w.end - 1].astype(np.uint64)
    before = np.where(w.end - w.start > 1, w.data[np.maximum(w.end - 2, 0)], 0).astype(np.uint64)
    return 1 + (mix(last * np.uint64(256) + before + np.uint64(1)) % np.uint64(ENDINGS)).astype(np.int64)


def token_counts(texts: DataFrame) -> DataFrame:
    """texts (_text) -> _h, _b, _c: each token with its group and count."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, w in _scan(batch.column(0)):
                h, first, n = np.unique(w.hash, return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.append(h.view(np.int64), END_HASH)), pa.array(np.append(endings(w)[first], 0).astype(np.int32)), pa.array(np.append(n, b - a))], ["_h", "_b", "_c"])

    return texts.mapInArrow(kept(count), "_h long, _b int, _c long").groupBy("_h").agg(F.min("_b").alias("_b"), F.sum("_c").alias("_c"))


@dataclass
class Vocabulary:
    """Frequent tokens, sorted by hash, with counts and units; the count of each unit; what each group's shares are of."""

    hashes: np.ndarray
    counts: np.ndarray
    units: np.ndarray
    unit_counts: np.ndarray
    tokens: int
    distinct: int
    ends: int
    group_total: np.ndarray

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of each hash and whether it is there: from the first with equal leading bits upwards."""
        last = len(self.hashes) - 1
        if last < 0:
            return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        at = self._starts[h >> np.uint64(64 - BITS)]
        own = self.hashes[at]
        more = np.flatnonzero(own < h)
        while len(more):
            more = more[at[more] < last]
            at[more] += 1
            own[more] = self.hashes[at[more]]
            more = more[own[more] < h[more]]
        return at, own == h

    @cached_property
    def _starts(self) -> np.ndarray:
        """For each value of the leading bits the first hash that is not below."""
        return np.minimum(np.searchsorted(self.hashes, np.arange(1 << BITS, dtype=np.uint64) << np.uint64(64 - BITS)), len(self.hashes) - 1)

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 1) / (self.tokens + 1 * (self.distinct + 1)))


def vocabulary(counts: DataFrame, words: int = WORDS, known: int = KNOWN) -> Vocabulary:
    """From a table of counts: at most so many words come to the driver, all of a count or none."""
    # counts in steps of an eighth of a doubling: a few hundred rows for any corpus
    steps = counts.groupBy(F.floor(F.log2("_c") * 8).cast("int").alias("s")).count().orderBy(F.desc("s")).collect()
    room, least = known, None
    for r in steps:
        room -= r["count"]
        if room < 0:
            break
        least = r["s"]
    frequent = counts.where(F.floor(F.log2("_c") * 8) >= least).where(f"_h != {END_HASH}").toArrow() if least is not None else pa.table({"_h": pa.array([], pa.int64()), "_b": pa.array([], pa.int32()), "_c": pa.array([], pa.int64())})
    h, b, c = (frequent.column(n).to_numpy() for n in ("_h", "_b", "_c"))
    groups = {r["_b"]: (r["c"], r["n"]) for r in counts.groupBy("_b").agg(F.sum("_c").alias("c"), F.count(F.lit(1)).alias("n")).collect()}  # a row for each group
    total, distinct = np.zeros(ENDINGS + 1, np.int64), np.zeros(ENDINGS + 1, np.int64)
    for k, (tokens, n) in groups.items():
        total[k], distinct[k] = tokens, n
    rank = np.lexsort((h, -c))[:words]
    unit = b.astype(np.int64)
    unit[rank] = np.arange(1 + ENDINGS, 1 + ENDINGS + len(rank))
    inside, own = total.copy(), distinct.copy()
    np.subtract.at(inside, b[rank], c[rank])
    np.subtract.at(own, b[rank], 1)
    unit_counts = np.zeros(CLASS * CLASS)
    unit_counts[: 1 + ENDINGS] = inside
    unit_counts[1 + ENDINGS : 1 + ENDINGS + len(rank)] = c[rank]
    order = np.argsort(h.view(np.uint64))
    return Vocabulary(h.view(np.uint64)[order], c[order], unit[order], unit_counts, int(total.sum()), int(distinct.sum()), int(total[0]), (inside + own + 1).astype(np.float64))


def units_of(w: Words, v: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each word: index among frequent tokens, whether it is one, unit."""
    at, found = v.find(w.hash)
    group = endings(w)
    return at, found, np.where(found, v.units[at], group) if len(v.units) else group


def sequences(w: Words, unit: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Targets, each row's units and an end, and the ORDER units before each (columns, nearest first); ends stand before a text."""
    n = w.per_doc + 1
    start = np.concatenate([[0], np.cumsum(n)])
    target = np.full(start[-1], END, np.int64)
    target[np.arange(len(unit)) + w.doc] = unit  # each row before has one end more
    at = np.arange(len(target)) - np.repeat(start[:-1], n)
    context = np.full((len(target), ORDER), END, np.int64)
    for k in range(ORDER):
        has = np.flatnonzero(at > k)
        context[has, k] = target[has - k - 1]
    return context, target


class Model:
    """Context vectors, position matrices, and vectors and biases of units and of classes."""

    def __init__(self, unit_counts: np.ndarray, rank: int = RANK, seed: int = 5):
        rng = np.random.default_rng(seed)
        seen = unit_counts + np.where(np.arange(CLASS * CLASS) <= ENDINGS, 0.5, 1e-3)  # groups may come up unseen, places without a word can't
        share = (seen / seen.sum()).reshape(CLASS, CLASS)
        of_class = share.sum(axis=1)
        self.noise = np.cumsum(share.reshape(-1))  # cumulative frequencies, for draws
        self.log_class, self.log_unit = np.log(of_class).astype(np.float32), np.log(share / of_class[:, None]).reshape(-1).astype(np.float32)
        normal = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
        self.w = {"context": normal(CLASS * CLASS, rank), "unit": normal(CLASS * CLASS, rank), "bias": self.log_unit.copy()[:, None], "class": normal(CLASS, rank), "class_bias": self.log_class.copy()[:, None], "place": np.stack([np.eye(rank, dtype=np.float32) / (k + 1) for k in range(ORDER)])}

    def log10(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        return Scorer(self).log10(context, target)


class Scorer:
    """A model as it scores: each unit's vector moved to each position, and exponentials of their products with the class vectors,
    of which a token's product over its positions gives those of q."""

    def __init__(self, model: Model):
        w = model.w
        self.moved = [w["context"] @ w["place"][k] for k in range(ORDER)]
        self.of_class = np.concatenate([w["class"].T, w["class_bias"].T])
        self.of_unit = np.concatenate([w["unit"].reshape(CLASS, CLASS, -1).transpose(0, 2, 1), w["bias"].reshape(CLASS, 1, CLASS)], axis=1)
        with np.errstate(over="ignore"):
            self.powers, self.weight = [], np.exp(w["class_bias"][:, 0])
        for m in self.moved:
            x = m @ w["class"].T
            if not np.abs(x).max() < LARGEST:
                self.powers = []
                break
            self.powers.append(np.exp(x, out=x))

    def log10(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Normalised log10 probability of each target after its context, in blocks."""
        out, buffer = np.empty(len(target)), np.empty((ROWS, CLASS), np.float32)
        for s in range(0, len(target), BLOCK):
            t = target[s : s + BLOCK]
            order = np.argsort((t // CLASS).astype(np.uint8), kind="stable")
            before, t = [context[s : s + BLOCK, k].take(order) for k in range(ORDER)], t[order]
            c = t // CLASS
            q = np.ones((len(t), self.of_class.shape[0]), np.float32)  # the last column meets the biases
            x = self.moved[0].take(before[0], axis=0, mode="clip")
            for k in range(1, ORDER):
                x += self.moved[k].take(before[k], axis=0, mode="clip")
            q[:, :-1] = x
            got, place = self._class_share(before, q, c, buffer) if self.powers else _log_share(q, self.of_class, c, buffer), t % CLASS
            for k, lo, hi in zip(*(x.tolist() for x in _runs(c)), strict=True):
                got[lo:hi] += _log_share(q[lo:hi], self.of_unit[k], place[lo:hi], buffer)
            out[s + order] = got
        return out / np.log(10)

    def _class_share(self, before: list[np.ndarray], q: np.ndarray, c: np.ndarray, buffer: np.ndarray) -> np.ndarray:
        """Logarithm of the share of a class after the units before."""
        own, total = np.empty(len(c), np.float32), np.empty(len(c), np.float32)
        x, y = np.empty((SMALL, CLASS), np.float32), np.empty((SMALL, CLASS), np.float32)
        for s in range(0, len(c), SMALL):
            n = min(SMALL, len(c) - s)
            self.powers[0].take(before[0][s : s + n], axis=0, mode="clip", out=x[:n])
            for k in range(1, ORDER):
                x[:n] *= self.powers[k].take(before[k][s : s + n], axis=0, mode="clip", out=y[:n])
            own[s : s + n] = x[np.arange(n), c[s : s + n]]
            with np.errstate(over="ignore", invalid="ignore"):
                np.matmul(x[:n], self.weight, out=total[s : s + n])
        odd = np.flatnonzero(~((own > 1e-25) & (total > 1e-25) & (total < 1e25)))  # near the ends of what a number can hold
        own[odd] = total[odd] = 1
        out = np.log(own) + self.of_class[-1][c] - np.log(total)
        out[odd] = _log_share(q[odd], self.of_class, c[odd], buffer)
        return out


def _log_share(q: np.ndarray, w: np.ndarray, column: np.ndarray, buffer: np.ndarray) -> np.ndarray:
    """Logarithm of the share of a column in the exponentials of each row of q @ w, so many rows at a time as a cache holds."""
    own, total = np.empty(len(q), np.float32), np.empty(len(q), np.float32)
    ones = np.ones(w.shape[1], np.float32)
    with np.errstate(over="ignore", divide="ignore", invalid="ignore"):
        for s in range(0, len(q), ROWS):
            x = np.matmul(q[s : s + ROWS], w, out=buffer[: min(ROWS, len(q) - s)])
            own[s : s + ROWS] = x[np.arange(len(x)), column[s : s + ROWS]]
            np.exp(x, out=x)
            np.matmul(x, ones, out=total[s : s + ROWS])
        out = own - np.log(total)
    odd = np.flatnonzero(~np.isfinite(out))  # too large for exponentials as they are
    for i in odd:
        x = (q[i] @ w).astype(np.float64)
        out[i] = x[column[i]] - x.max() - np.log(np.exp(x - x.max()).sum())
    return out


def _runs(c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values, starts and ends of the runs of a sorted array."""
    first = np.flatnonzero(np.diff(c, prepend=-1))
    return c[first], first, np.append(first[1:], len(c))


def _logistic(x: np.ndarray) -> np.ndarray:
    """Of -x, in place; an exponential that overflows gives 0."""
    with np.errstate(over="ignore"):
        np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


class Groups:
    """Places of equal numbers, groups by falling size.  Numbers, and how many there are, stay below 2^16.

    order brings equal ones together; first, often: where a group starts there and how many it has; more: groups with more than k;
    at: the number of each group; of: the group of each place.
    """

    def __init__(self, rows: np.ndarray):
        key = rows.astype(np.uint32) << np.uint32(16)
        key |= np.arange(len(rows), dtype=np.uint32)
        key.sort()
        self.order = (key & np.uint32(0xFFFF)).astype(np.int64)
        key >>= np.uint32(16)
        bounds = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])
        often = bounds[1:] - bounds[:-1]
        by = np.argsort(len(rows) - often.astype(np.uint16), kind="stable")
        self.first, self.often, self._by = bounds[by], often[by], by
        self.at = rows[self.order[self.first]]
        self.more = (len(by) - np.cumsum(np.bincount(np.minimum(often, FEW), minlength=FEW + 1))).tolist()

    @property
    def of(self) -> np.ndarray:
        rank, of = np.empty_like(self._by), np.empty_like(self.order)
        rank[self._by] = np.arange(len(rank))
        of[self.order] = np.repeat(rank, self.often[rank])
        return of

    def sums(self, g: np.ndarray) -> np.ndarray:
        """Sums of the rows of g in each group: the k-th rows of all groups at once, and large groups by themselves."""
        large, out = self.more[FEW - 1], g.take(self.order[self.first], axis=0, mode="clip")
        for k, to in enumerate(self.more[1 : FEW - 1], 1):
            if to > large:
                out[large:to] += g.take(self.order[self.first[large:to] + k], axis=0, mode="clip")
        if large:
            first, often = self.first[:large], self.often[:large]
            start = np.cumsum(often) - often
            x = g.take(self.order[np.arange(start[-1] + often[-1]) + np.repeat(first - start, often)], axis=0, mode="clip")
            # two columns are added as one complex number: half as many additions, the same sums
            out[:large] = np.add.reduceat(x.view(np.complex64) if x.shape[1] % 2 == 0 else x, start, axis=0).view(np.float32)
        return out


class Trainer:
    """A copy of the model that one task moves, with how often each row of each table was moved."""

    def __init__(self, model: Model, seed: int):
        self.model, self.rng = model, np.random.default_rng(seed)
        self.w = {n: x.copy() for n, x in model.w.items()}
        self.square = {n: np.full(x.shape[:1], 1e-4, np.float32) for n, x in model.w.items()}
        self.moved = {n: np.zeros(x.shape[:1], np.float32) for n, x in model.w.items()}

    def _move(self, names: tuple[str, ...], rows: np.ndarray, times: np.ndarray, grads: tuple[np.ndarray, ...], rate: float) -> None:
        """Adds the gradients of rows that may repeat, each row's step by its own sum of squares."""
        groups = Groups(rows)
        at, often = groups.at, groups.sums(times[:, None])[:, 0]
        for name, g in zip(names, grads, strict=True):
            total = groups.sums(g.reshape(len(g), -1))
            width = total.shape[1]
            self.square[name][at] += (total * total) @ np.full(width, 1 / width, np.float32)
            self.moved[name][at] += often
            total *= (rate / np.sqrt(self.square[name][at]))[:, None]
            w = self.w[name].reshape(-1, width)
            total += w.take(at, axis=0, mode="clip")
            whole = np.dtype((np.void, 4 * width))  # rows are written as one value each
            w.view(whole)[:, 0][at] = total.view(whole)[:, 0]

    def step(self, context: np.ndarray, target: np.ndarray, rate: float) -> None:
        """One step of noise-contrastive estimation: classes against CLASS_NOISE drawn classes, units against NOISE drawn units of
        their class, each by their frequencies; what is drawn serves all tokens of the step, or of the class."""
        w, model = self.w, self.model
        order = np.argsort((target // CLASS).astype(np.uint8), kind="stable")
        context, target = context[order], target[order]
        c, size, rank = target // CLASS, len(target), w["unit"].shape[1]
        edge = np.concatenate([[0.0], model.noise[CLASS - 1 :: CLASS]])
        kinds, starts, ends = _runs(c)
        often = (ends - starts).astype(np.float32)

        # what a unit adds to q from a position is made once for all tokens that have it there; a column of ones in q meets the biases,
        # and sums up what they get
        places, wide = [], np.ones((size, rank + 1), np.float32)
        for k in range(ORDER):
            groups = Groups(context[:, k])
            vectors = w["context"].take(groups.at, axis=0, mode="clip")
            part = (vectors @ w["place"][k]).take(groups.of, axis=0, mode="clip")
            q = q + part if k else part
            places.append((groups, vectors))
        wide[:, :rank] = q

        # classes against drawn ones, so many tokens at a time as a cache holds
        drawn = np.searchsorted(edge[1:], self.rng.random(CLASS_NOISE) * edge[-1]).clip(0, CLASS - 1)
        pulled = np.concatenate([w["class"][drawn], (w["class_bias"][drawn, 0] - model.log_class[drawn] - np.float32(np.log(CLASS_NOISE)))[:, None]], axis=1)
        back, class_push, away = np.empty_like(wide), np.zeros_like(pulled), -pulled.T
        for lo in range(0, size, ROWS):
            part = wide[lo : lo + ROWS]
            off = _logistic(part @ away)
            np.matmul(off, pulled, out=back[lo : lo + ROWS])
            class_push += off.T @ part
        dq = -back[:, :rank]
        class_rows, class_often = np.concatenate([kinds, drawn]), np.concatenate([often, np.full(len(drawn), size, np.float32)])

        # units, and after them the class of the token
        drawn = edge[kinds][:, None] + self.rng.random((len(kinds), NOISE)) * (edge[kinds + 1] - edge[kinds])[:, None]
        noise = np.clip(np.searchsorted(model.noise, drawn), kinds[:, None] * CLASS, kinds[:, None] * CLASS + CLASS - 1)
        pulled = np.empty((len(kinds), NOISE + 1, rank + 1), np.float32)
        pulled[:, :NOISE, :rank], pulled[:, :NOISE, rank] = w["unit"].take(noise, axis=0), w["bias"][noise, 0] - model.log_unit[noise] - np.float32(np.log(NOISE))
        pulled[:, NOISE, :rank], pulled[:, NOISE, rank] = w["class"][kinds], w["class_bias"][kinds, 0] - model.log_class[kinds] - np.float32(np.log(CLASS_NOISE))
        off, push, away = np.empty((size, NOISE + 1), np.float32), np.empty_like(pulled), np.ascontiguousarray(-pulled.transpose(0, 2, 1))
        spans = [(k, wide[lo:hi], off[lo:hi], back[lo:hi]) for k, lo, hi in zip(range(len(kinds)), starts.tolist(), ends.tolist(), strict=True)]
        for k, q_k, off_k, _ in spans:
            np.dot(q_k, away[k], out=off_k)
        _logistic(off)
        off[:, NOISE] -= 1
        for k, q_k, off_k, back_k in spans:
            np.dot(off_k, pulled[k], out=back_k)
            np.dot(off_k.T, q_k, out=push[k])
        dq -= back[:, :rank]
        np.negative(push, out=push)
        grads = np.concatenate([push[:, NOISE], -class_push])
        self._move(("class", "class_bias"), class_rows, class_often, (np.ascontiguousarray(grads[:, :rank]), grads[:, rank:]), rate)

        t_true = w["unit"].take(target, axis=0, mode="clip")
        on = 1 - _logistic(model.log_unit[target] + np.float32(np.log(NOISE)) - np.einsum("ij,ij->i", q, t_true) - w["bias"][target, 0])
        t_true *= on[:, None]
        dq += t_true
        rows, often = np.concatenate([target, noise.reshape(-1)]), np.concatenate([np.ones(size, np.float32), np.repeat(often, NOISE)])
        grads = np.empty((len(rows), rank), np.float32)
        np.multiply(on[:, None], q, out=grads[:size])
        grads[size:] = push[:, :NOISE, :rank].reshape(-1, rank)
        self._move(("unit", "bias"), rows, often, (grads, np.concatenate([on, push[:, :NOISE, rank].reshape(-1)])[:, None]), rate)

        # contexts and their positions, from sums over the tokens that have a unit there
        sums = [groups.sums(dq) for groups, _ in places]
        place = np.stack([vectors.T @ s for (_, vectors), s in zip(places, sums, strict=True)])
        rows, often = np.concatenate([groups.at for groups, _ in places]), np.concatenate([groups.often for groups, _ in places]).astype(np.float32)
        self._move(("context",), rows, often, (np.concatenate([s @ w["place"][k].T for k, s in enumerate(sums)]),), rate)
        self._move(("place",), np.arange(ORDER), np.full(ORDER, size, np.float32), (place,), rate / 10)

    def run(self, context: np.ndarray, target: np.ndarray, rate: float) -> None:
        order = self.rng.permutation(len(target))
        rows = np.concatenate([context, target[:, None]], axis=1).astype(np.uint16)  # numbers of units are below 2^14
        for k in range(0, len(order), STEP):
            part = rows.take(order[k : k + STEP], axis=0).astype(np.int64)
            self.step(part[:, :ORDER], part[:, ORDER], rate)

    def changes(self) -> Iterator[tuple[str, int, np.ndarray]]:
        """(table, first row, [times moved, times moved x change] of a block of rows) of what was moved."""
        for n, x in self.w.items():
            flat = (x - self.model.w[n]).reshape(len(x), -1)
            rows = max(1, BLOCK // flat.shape[1])
            for s in range(0, len(flat), rows):
                times = self.moved[n][s : s + rows, None]
                if times.any():
                    yield n, s, np.concatenate([times, times * flat[s : s + rows]], axis=1)


def _learn(batches: Iterator[pa.RecordBatch], v: Vocabulary, model: Model, number: int) -> Trainer | None:
    """Rows (text, round) while they are read: the first up to LEAST tokens, which are gone over again, and all others of this round."""
    part = TaskContext.get().partitionId() if TaskContext.get() else 0
    trainer = Trainer(model, 1000 * number + part)
    held, had = [], 0
    rate = RATE / (number + 1)
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            rows = batch.slice(start, 256)
            if had >= LEAST:
                rows = rows.filter(pc.equal(rows.column(1), number))
            for a, b, w in _scan(rows.column(0)):
                context, target = sequences(w, units_of(w, v)[2], b - a)
                if had < LEAST:
                    held.append((context, target))
                    had += len(target)
                else:
                    trainer.run(context, target, rate)
    if not held:
        return None
    context, target = (np.concatenate(x) for x in zip(*held, strict=True))
    for _ in range(min(EPOCHS, 1 + LEAST // len(target))):
        trainer.run(context, target, rate)
    return trainer


def train(texts: DataFrame, v: Vocabulary, rank: int = RANK, rounds: int = ROUNDS) -> Model:
    """The model after rounds over texts (_text)."""
    model, spark = Model(v.unit_counts, rank), texts.sparkSession
    dealt = texts.select("_text", F.pmod(F.xxhash64("_text"), F.lit(rounds)).cast("int").alias("_round"))
    for number in range(rounds):
        shared = spark.sparkContext.broadcast((v, model))

        def learn(batches: Iterator[pa.RecordBatch], shared=shared, number=number) -> Iterator[pa.RecordBatch]:
            trainer = _learn(batches, *shared.value, number)
            for name, first, block in trainer.changes() if trainer else ():
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([first]), pa.array([block.astype(np.float32).tobytes()], pa.binary())], ["_table", "_first", "_block"])

        def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[tuple[str, int], np.ndarray] = {}
            for batch in batches:
                for name, first, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    block = np.frombuffer(block, np.float32).astype(np.float64)
                    sums[name, first] = sums[name, first] + block if (name, first) in sums else block
            for (name, first), total in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([first]), pa.array([total.tobytes()], pa.binary())], ["_table", "_first", "_block"])

        kind = "_table string, _first long, _block binary"
        blocks = dealt.mapInArrow(kept(learn), kind).repartition("_table", "_first").mapInArrow(added, kind).collect()  # the size of one model
        for r in blocks:
            x = model.w[r["_table"]]
            flat = x.reshape(len(x), -1)
            total = np.frombuffer(r["_block"], np.float64).reshape(-1, flat.shape[1] + 1)
            flat[r["_first"] : r["_first"] + len(total)] += (total[:, 1:] / np.maximum(total[:, :1], 1)).astype(np.float32)
        shared.unpersist()
    return model


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, known: int = KNOWN) -> DataFrame:
    """One row for each row of docs: id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    held = F.coalesce(crc_mod("_id", 7) == 2, F.lit(False))
    texts = rows.where(~held).select("_text")
    counts = stored(token_counts(texts), "counts")
    v = vocabulary(counts, words, known)
    shared = spark.sparkContext.broadcast((v, train(texts, v)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, model = shared.value
        row = TaskContext.get().partitionId() << 36
        scorer, base, log_total = Scorer(model), v.base(v.counts), np.log10(v.group_total)
        inside = np.log10(v.counts + 1.0)
        for batch in batches:
            for a, b, w in _scan(batch.column(1)):
                n = b - a
                at, found, unit = units_of(w, v)
                context, target = sequences(w, unit, n)
                doc = np.repeat(np.arange(n), w.per_doc + 1)
                grouped = unit <= ENDINGS
                own = found.nonzero()[0]
                model_part = np.bincount(doc, scorer.log10(context, target), n) - np.bincount(w.doc[grouped], log_total[unit[grouped]], n)
                share = (found & grouped).nonzero()[0]
                model_part += np.bincount(w.doc[share], inside[at[share]], n)
                base_part = np.bincount(w.doc[own], base[at[own]], n) + v.base(np.array(v.ends))
                known_part = np.bincount(w.doc[own], minlength=n) + (v.ends > 0)
                lost = np.flatnonzero(~found)
                order = lost[np.lexsort((w.hash[lost], w.doc[lost]))]
                h, doc = w.hash[order], w.doc[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
                first = np.flatnonzero(new)
                times = np.diff(np.append(first, len(h)))
                offsets = pa.array(np.searchsorted(doc[first], np.arange(n + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([
                    pa.array(row + np.arange(n)), batch.column(0).slice(a, n), pa.array((w.per_doc + 1).astype(np.int64)), pa.array(known_part.astype(np.int64)), pa.array(base_part), pa.array(model_part),
                    pa.ListArray.from_arrays(offsets, pa.array(h[first].view(np.int64))), pa.ListArray.from_arrays(offsets, pa.array(times.astype(np.int32))),
                ], names)
                row += n

    names = ["_row", "_id", "_tokens", "_known", "_base", "_model", "_h", "_k"]
    kind = rows.schema["_id"].dataType.simpleString()
    scanned = stored(rows.mapInArrow(kept(score), f"_row long, _id {kind}, _tokens long, _known long, _base double, _model double, _h array<long>, _k array<int>"), "scanned")
    rare = scanned.select("_row", F.explode(F.arrays_zip("_h", "_k")).alias("x")).select("_row", F.col("x._h").alias("_h"), F.col("x._k").cast("long").alias("_k"))
    met = rare.join(counts.select("_h", "_c").hint("shuffle_hash"), "_h", "left").withColumn("_c", F.coalesce("_c", F.lit(0)))
    more = met.groupBy("_row").agg(
        F.sum(F.when(F.col("_c") > 0, F.col("_k")).otherwise(0)).alias("_more_known"),
        F.sum(F.col("_k") * F.log10((F.col("_c") + 1) / F.lit(float(v.tokens + v.distinct + 1)))).alias("_more_base"),
        F.sum(F.col("_k") * F.log10(F.col("_c") + 1)).alias("_more_model"),
    )
    result = scanned.select("_row", "_id", "_tokens", "_known", "_base", "_model").join(more, "_row", "left")

    def plus(x: str, y: str):
        return F.col(x) + F.coalesce(y, F.lit(0))

    return result.select(
        F.col("_id").alias(id_col), held.alias("held_out"), F.col("_tokens").alias("n_tokens"), plus("_known", "_more_known").cast("long").alias("n_known"),
        F.lit(int(v.tokens)).cast("long").alias("train_tokens"), plus("_base", "_more_base").alias("base_score"), plus("_model", "_more_model").alias("score"),
    )


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))
