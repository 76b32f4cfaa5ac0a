"""MinHash near-dedup with tensored banding.

A text's set is its distinct hashed word shingles.  Rows with the same set (size and 128-bit digest of the sorted set) form a
class; the rest works on one representative of each class, so that thousands of copies count once.

Keys: two collections of TABLES small hashes, each of WIDTH minhashes.  Every pair (i, j) of one hash of the first and one of
the second is a table, so TABLES^2 tables of 2 * WIDTH minhashes each come from 2 * TABLES * WIDTH minhashes computed: at a
similarity of s two sets share no table with probability 1 - (1 - (1 - s^WIDTH)^TABLES)^2, 8e-4 at 0.8.  Under a similarity
parameter far below 0.8 more tables are needed for that.

Buckets of several members give a star from the member that meets most others.  After those
links are verified and joined into components, only buckets whose members are still in different components go on: their
members are compared in blocks within the bucket, a pair in the first of the tables it shares only, see _crossing.  So a
large group of near copies costs about as many pairs as it has members, and no link between components is lost: nothing is
capped.

Verification: a sketch of one byte of each minhash sets aside pairs with fewer equal ones than sketch_least tells (one true
pair in a million) and sizes that rule out the similarity, then the full sets of 64-bit shingle hashes are compared.

Components: smallest-label propagation with shortcuts over written edge tables.

Cases: null and empty texts and texts without words have an empty set and are linked with nothing; texts with fewer words than
a shingle are one shingle; equal sets are linked; rows with the same id are one node; a null id is an id like any other and sorts
first; ids that aren't whole numbers, or repeat, are told apart by a hash of id and set of 64 bits, and a group's smallest id is
that in their own order; an empty table gives an empty result; only the id and text columns are read, so other columns may have any names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from quern.llm.common import fresh, lean, mix, scan_words, shingles, stored, table

WIDTH, TABLES, SIMILARITY = 3, 11, 80
HASHES = 2 * WIDTH * TABLES
#: Members of a bucket that are compared with one another in one piece.
BLOCK = 256
#: Ids that are broadcast to fetch their texts, or to drop rows; more are joined.
BROADCAST_IDS = 500_000
#: Representatives whose keys one task makes, about.
KEYED = 8192
SET = ["_n", "_set"]
#: The node of a null id: the smallest of all.
NULL_ID = -(2**63)


@lru_cache
def sketch_least(similarity: int) -> int:
    """Equal sketch bytes that all but one in a million pairs of that similarity have."""
    p, below = similarity / 100, 0.0
    for k in range(HASHES + 1):
        below += comb(HASHES, k) * p**k * (1 - p) ** (HASHES - k)
        if below > 1e-6:
            return k
    return HASHES


def _multipliers() -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(np.arange(1, 2 * HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """docs (_own, _text) -> _own, size and digest of the set, small hashes of both collections, sketch."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        odd = _multipliers()
        for batch in batches:
            for a, b, w in scan_words(batch.column(1)):
                values, bounds = shingles(w, words)
                n = np.diff(bounds)
                full = np.flatnonzero(n)
                low = np.full((b - a, HASHES), 0, np.uint32)
                with np.errstate(over="ignore"):
                    if len(full):
                        at = bounds[:-1][full]
                        for k in range(HASHES):
                            low[full, k] = np.minimum.reduceat(((values * odd[k] + odd[HASHES + k]) >> np.uint64(32)).astype(np.uint32), at)
                    keys = np.zeros((b - a, 2 * TABLES), np.uint64)
                    for k in range(2 * TABLES):
                        for x in range(WIDTH):
                            keys[:, k] = mix(keys[:, k] ^ (low[:, k * WIDTH + x] + np.uint64(k << 40)))
                keys = (keys >> np.uint64(32)).astype(np.uint32).view(np.int32)
                halves = [pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(keys[:, s]).reshape(-1)), TABLES).cast(pa.list_(pa.int32())) for s in (slice(0, TABLES), slice(TABLES, None))]
                sketch = pa.FixedSizeBinaryArray.from_buffers(pa.binary(HASHES), b - a, [None, pa.py_buffer(np.ascontiguousarray((low & 255).astype(np.uint8)))]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(n.astype(np.int64)), _digests(values, bounds), *halves, sketch], names)

    names = ["_own", *SET, "_a", "_b", "_sketch"]
    return docs.mapInArrow(lean(sign), f"_own {docs.schema['_own'].dataType.simpleString()}, _n long, _set binary, _a array<int>, _b array<int>, _sketch binary")


def _digests(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    raw = memoryview(values).cast("B") if len(values) else b""
    return pa.array([hashlib.blake2b(raw[8 * s : 8 * e], digest_size=16).digest() for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)], pa.binary())


@dataclass
class Texts:
    """rows (_own, _text), and what was signed of them; a node (_id) is an id if ids are different whole numbers, else the hash of
    an id and its set."""

    rows: DataFrame
    signed: DataFrame
    words: int
    whole: bool

    def sets(self, ids: DataFrame) -> DataFrame:
        """_id, _values: the sorted set of each of those nodes as bytes."""
        ids = stored(ids, "ids", few=True)
        ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
        if self.whole:
            wanted = self.rows.withColumn("_id", _node(F.col("_own"))).join(ids, "_id", "left_semi").select("_own", "_text")
        else:
            owners = stored(self.signed.join(ids, "_id", "left_semi").select(F.col("_own").alias("_owner")).distinct(), "owners", few=True)
            wanted = self.rows.join(owners, F.col("_own").eqNullSafe(F.col("_owner")), "left_semi").select("_own", "_text")
        words = self.words

        def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for a, b, w in scan_words(batch.column(1)):
                    values, bounds = shingles(w, words)
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), _digests(values, bounds), pa.array([values[s:e].tobytes() for s, e in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())], ["_own", "_set", "_values"])

        found = wanted.mapInArrow(lean(collect), f"_own {self.rows.schema['_own'].dataType.simpleString()}, _set binary, _values binary")
        found = found.select((_node(F.col("_own")) if self.whole else F.xxhash64("_own", "_set")).alias("_id"), "_values")
        return stored(found if self.whole else found.join(ids, "_id", "left_semi").dropDuplicates(["_id"]), "sets")


def _node(own: Column) -> Column:
    return F.coalesce(own.cast("long"), F.lit(NULL_ID))


def promising(pairs: DataFrame, reps: DataFrame, similarity: int) -> DataFrame:
    """Pairs (_l, _r) whose sizes and sketches allow the similarity."""
    own = reps.select("_id", "_n", "_sketch")
    left = own.select(F.col("_id").alias("_l"), F.col("_n").alias("_ln"), F.col("_sketch").alias("_ls"))
    right = own.select(F.col("_id").alias("_r"), F.col("_n").alias("_rn"), F.col("_sketch").alias("_rs"))
    both = pairs.join(left, "_l").join(right, "_r").where(f"100 * least(_ln, _rn) >= {similarity} * greatest(_ln, _rn)")

    least = sketch_least(similarity)

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                left, right = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, HASHES) for i in (2, 3))
                yield batch.select(["_l", "_r"]).filter(pa.array((left == right).sum(axis=1) >= least))

    return both.select("_l", "_r", "_ls", "_rs").mapInArrow(lean(alike), "_l long, _r long")


def verify(pairs: DataFrame, texts: Texts, similarity: int) -> DataFrame:
    """Those pairs whose full sets have the similarity."""
    sets = texts.sets(pairs.select(F.col("_l").alias("_id")).union(pairs.select("_r")).distinct())

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                same = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                keep.append(100 * same >= similarity * (len(x) + len(y) - same))
            yield batch.select(["_l", "_r"]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(sets.select(F.col("_id").alias("_l"), F.col("_values").alias("_lv")), "_l").join(sets.select(F.col("_id").alias("_r"), F.col("_values").alias("_rv")), "_r")
    return both.select("_l", "_r", "_lv", "_rv").mapInArrow(lean(compare), "_l long, _r long")


def components(edges: DataFrame) -> DataFrame:
    """edges (_l, _r) -> _id, _label: the smallest id that it reaches, for each id that has an edge and is not the smallest."""
    up = stored(edges.where("_l != _r").select(F.greatest("_l", "_r").alias("_id"), F.least("_l", "_r").alias("_up")).distinct(), "edges", few=True)
    while True:
        # each node keeps its smallest neighbour above; its others are linked with that one
        least = up.groupBy("_id").agg(F.min("_up").alias("_min"), F.count(F.lit(1)).alias("_k"))
        others = up.join(least.where("_k > 1").select("_id", "_min"), "_id").where("_up != _min").select(F.col("_up").alias("_id"), F.col("_min").alias("_up"))
        joined = stored(least.select("_id", F.col("_min").alias("_up")).unionByName(others).distinct(), "edges", few=True)
        # shortcut: to the smallest above the one above
        top = stored(joined.groupBy("_id").agg(F.min("_up").alias("_top")).withColumnRenamed("_id", "_up"), "top", few=True)  # written, so that a hot centre's join can be split
        step = joined.join(top, "_up", "left").select("_id", F.coalesce("_top", "_up").alias("_next"), F.col("_top").isNotNull().alias("_moved"))
        step = stored(step, "step", few=True)
        state = step.agg(F.count(F.lit(1)), F.count_distinct("_id"), F.coalesce(F.sum(F.col("_moved").cast("int")), F.lit(0))).first()
        if state[0] == state[1] and state[2] == 0:
            return joined.select("_id", F.col("_up").alias("_label"))
        # a node with several above keeps them all, moved up; what they are linked through stays linked
        up = step.select("_id", F.col("_next").alias("_up")).distinct()


def _labelled(ids: DataFrame, labels: DataFrame) -> DataFrame:
    return ids.join(labels, "_id", "left").withColumn("_label", F.coalesce("_label", "_id"))


def _pieces(rows: pa.Table) -> Iterator[pa.Table]:
    """The runs of equal first columns."""
    edges = np.flatnonzero(np.diff(rows.column(0).to_numpy())) + 1
    for s, e in zip([0, *edges], [*edges, rows.num_rows], strict=True):
        if e > s:
            yield rows.slice(s, e - s)


def _by_piece(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Whole pieces from batches sorted by piece."""
    held: list[pa.Table] = []
    for batch in batches:
        for run in _pieces(pa.Table.from_batches([batch])):
            if held and held[-1].column(0)[0] != run.column(0)[0]:
                yield pa.concat_tables(held).combine_chunks()
                held = []
            held.append(run)
    if held:
        yield pa.concat_tables(held).combine_chunks()


def _crossing(members: DataFrame, labels: DataFrame, reps: DataFrame, texts: Texts, similarity: int) -> DataFrame | None:
    """Links (_l, _r) between members of a bucket that are in different components; None if each bucket is in one.

    A bucket is cut into blocks of its main component and of the others; each block of others meets each block in one piece.  A
    pair that shares several tables is compared in the first of them only, told from its small hashes.  A piece compares whole
    sets and gives at most one link for each component that it joins: pairs are never rows.
    """
    known = _labelled(members, labels)
    counts = known.groupBy("_key", "_label").agg(F.count(F.lit(1)).alias("_c"))
    state = counts.groupBy("_key").agg(F.max(F.struct("_c", "_label")).alias("_m"), F.sum("_c").alias("_all")).where("_m._c < _all")
    state = stored(state.selectExpr("_key", "_m._label AS _main", f"cast(ceil((_all - _m._c) / {BLOCK}) AS int) AS _no", f"cast(ceil(_m._c / {BLOCK}) AS int) AS _nm"), "open", few=True)
    if not state.limit(1).count():
        return None
    own = known.join(state, "_key").withColumn("_other", F.col("_label") != F.col("_main")).withColumn("_at", F.expr("cast(pmod(xxhash64(_id), if(_other, _no, _nm)) as int)"))
    spread = F.expr("""if(_other, concat(transform(sequence(0, _no - 1), x -> named_struct('p', least(x, _at), 'q', greatest(x, _at), 'm', false)),
                                         transform(sequence(0, _nm - 1), x -> named_struct('p', _at, 'q', x, 'm', true))),
                              transform(sequence(0, _no - 1), x -> named_struct('p', x, 'q', _at, 'm', true)))""")
    pieces = own.withColumn("_p", F.explode(spread)).withColumn("_piece", F.xxhash64("_key", "_p.p", "_p.q", "_p.m"))
    pieces = pieces.select("_piece", "_id", "_label", "_other", "_at", "_t").join(reps.select("_id", "_n", "_sketch", "_a", "_b"), "_id")
    pieces = pieces.select("_piece", "_id", "_label", "_other", "_at", "_t", "_n", "_sketch", "_a", "_b").repartition("_piece").sortWithinPartitions("_piece", "_id")
    least = sketch_least(similarity)

    def meets(label: np.ndarray, other: np.ndarray, at: np.ndarray, i: int) -> np.ndarray:
        """Which members of the piece member i is compared with: the main component's, or the other block's, or all of its own."""
        if not other.all():
            return (label != label[i]) & ~other
        return (label != label[i]) & ((at != at[i]) | (at == at[0]).all())

    def promising_members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_piece(batches):
            label, other, at, n = (rows.column(i).to_numpy() for i in (2, 3, 4, 6))
            first = rows.column(5)[0].as_py()
            sketch = np.frombuffer(b"".join(rows.column(7).to_pylist()), np.uint8).reshape(-1, HASHES)
            half = [rows.column(k).combine_chunks().flatten().to_numpy().reshape(-1, TABLES) for k in (8, 9)]
            keep = np.zeros(len(label), bool)
            for i in np.flatnonzero(other):
                js = np.flatnonzero(meets(label, other, at, i) & (100 * np.minimum(n, n[i]) >= similarity * np.maximum(n, n[i])))
                js = js[(sketch[js] == sketch[i]).sum(axis=1) >= least]
                if len(js):
                    a, b = ((h[js] == h[i]).argmax(axis=1) for h in half)
                    js = js[a * TABLES + b == first]
                    keep[js] = True
                    keep[i] |= len(js) > 0
            if keep.any():
                yield from rows.select(["_piece", "_id", "_label", "_other", "_at"]).filter(pa.array(keep)).to_batches()

    hopeful = stored(pieces.mapInArrow(lean(promising_members), "_piece long, _id long, _label long, _other boolean, _at int"), "hopeful")
    sets = texts.sets(hopeful.select("_id").distinct())
    whole = hopeful.join(sets, "_id").select("_piece", "_id", "_label", "_other", "_at", "_values").repartition("_piece").sortWithinPartitions("_piece", "_id")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_piece(batches):
            ids, label, other, at = (rows.column(i).to_numpy() for i in (1, 2, 3, 4))
            values = [np.frombuffer(x, np.uint64) for x in rows.column(5).to_pylist()]
            n = np.array([len(x) for x in values])
            _, index = np.unique(np.concatenate(values), return_inverse=True)
            starts = np.concatenate([[0], np.cumsum(n)])
            mark = np.zeros(index.max() + 1, bool)
            joined = {int(x): int(x) for x in label}

            def root(x: int, joined=joined) -> int:
                while joined[x] != x:
                    joined[x] = joined[joined[x]]
                    x = joined[x]
                return x

            left, right = [], []
            for i in np.flatnonzero(other):
                mine = index[starts[i] : starts[i + 1]]
                mark[mine] = True
                same = np.add.reduceat(mark[index].astype(np.int32), starts[:-1])
                mark[mine] = False
                for j in np.flatnonzero(meets(label, other, at, i) & (100 * same >= similarity * (n + n[i] - same))):
                    a, b = root(int(label[i])), root(int(label[j]))
                    if a != b:
                        joined[max(a, b)] = min(a, b)
                        left.append(int(ids[i]))
                        right.append(int(ids[j]))
            if left:
                yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["_l", "_r"])

    return whole.mapInArrow(lean(compare), "_l long, _r long")


def near_duplicates(docs: DataFrame, words: int = 5, similarity: int = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id, n_shingles, component_id, kept."""
    kind = docs.schema[id_col].dataType
    rows = docs.select(F.col(id_col).alias("_own"), F.col(text_col).alias("_text"))
    signed = stored(signatures(rows, words), "signatures")
    repeats = bool(signed.groupBy("_own").count().where("count > 1").limit(1).count())
    whole = isinstance(kind, IntegralType) and not repeats
    signed = signed.withColumn("_id", _node(F.col("_own")) if whole else F.xxhash64("_own", "_set"))
    texts = Texts(rows, signed, words, whole)
    classes = stored(signed.where("_n > 0").groupBy(*SET).agg(F.min("_id").alias("_rep"), F.count(F.lit(1)).alias("_size")), "classes", few=True)
    reps = stored(signed.join(classes.select(F.col("_rep").alias("_id"), *SET), ["_id", *SET], "left_semi").dropDuplicates(["_id"]).drop("_own"), "reps", few=True)

    table_keys = f"flatten(transform(sequence(0, {TABLES - 1}), i -> transform(sequence(0, {TABLES - 1}), j -> xxhash64(_a[i], _b[j], i * {TABLES} + j))))"
    # small rows that become many: so few to a task that their counts fit into its memory
    dealt = reps.repartition(max(8, reps.count() // KEYED), "_id")
    keys = dealt.select("_id", F.posexplode(F.expr(table_keys)).alias("_t", "_key"))
    buckets = stored(keys.groupBy("_key").agg(F.count(F.lit(1)).alias("_k")).where("_k > 1"), "buckets")
    members = stored(keys.join(buckets, "_key"), "members")
    # the centre of a star: the member that meets most others, in all tables together
    degree = members.groupBy("_id").agg(F.sum("_k").alias("_d"))
    centres = stored(members.join(degree, "_id").groupBy("_key").agg(F.max(F.struct("_d", F.bitwise_not("_id").alias("_i"))).alias("_c")).select("_key", F.bitwise_not("_c._i").alias("_c")), "centres")  # written, so that a hot bucket's join can be split
    stars = members.join(centres, "_key").select(F.least("_c", "_id").alias("_l"), F.greatest("_c", "_id").alias("_r"))
    pairs = stars.where("_l != _r").distinct()
    members = members.where("_k > 2").select("_key", "_t", "_id")

    pairs = stored(promising(pairs, reps, similarity), "pairs")
    edges = verify(pairs, texts, similarity)
    if not whole:  # nodes of one id, and of one set, are linked
        for key in (["_own"], SET):
            same = signed.where("_n > 0" if key == SET else "true").groupBy(*key).agg(F.min("_id").alias("_r"))
            on = [F.col(f"x.{k}").eqNullSafe(F.col(f"y.{k}")) for k in key]
            edges = edges.union(signed.select("_id", *key).distinct().alias("x").join(stored(same, "same", few=True).alias("y"), on).select(F.col("_id").alias("_l"), "_r"))
    edges = stored(edges, "links", few=True)
    labels = components(edges)
    more = _crossing(members, labels, reps, texts, similarity)
    if more is not None:
        labels = components(more.union(labels.select(F.col("_label").alias("_l"), F.col("_id").alias("_r"))))

    labels = stored(labels, "labels", few=True)
    if whole:
        named = stored(_labelled(classes.withColumnRenamed("_rep", "_id"), labels).select(*SET, "_label"), "named", few=True)
        result = signed.select("_id", "_own", *SET).join(named, SET, "left").withColumn("_label", F.coalesce("_label", "_id"))
    else:
        result = _labelled(signed.select("_id", "_own", "_n"), labels)
    if whole:
        group = F.when(F.col("_label") != NULL_ID, F.col("_label")).cast(kind)
    else:
        result = stored(result, "labelled")
        least = stored(result.groupBy("_label").agg(F.min(F.struct("_own")).alias("_least")), "least", few=True)
        result, group = result.join(least, "_label"), F.col("_least._own")
    return result.select(F.col("_own").alias(id_col), F.col("_n").alias("n_shingles"), group.alias("component_id"), F.col("_own").eqNullSafe(group).alias("kept"))


def drop_near_duplicates(docs: DataFrame, words: int = 5, similarity: int = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group, with the columns of docs; few ids are broadcast, more are joined."""
    name = fresh(docs, "_gone")
    gone = stored(near_duplicates(docs, words, similarity, id_col, text_col).where("NOT kept").select(F.col(id_col).alias(name)).distinct(), "gone", few=True)
    return docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, F.col(id_col).eqNullSafe(F.col(name)), "left_anti")


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=2)


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM w),
n AS (SELECT doc_id, len(s) AS n FROM g),
e AS (SELECT doc_id, hash(unnest(s)) AS x FROM g),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
m AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS c FROM n UNION SELECT m.b, r.c FROM r JOIN m ON m.a = r.doc_id)
SELECT doc_id, n AS n_shingles, c AS component_id, doc_id = c AS kept FROM (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id) JOIN n USING (doc_id)
"""
