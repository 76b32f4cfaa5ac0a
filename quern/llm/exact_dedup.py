"""Exact dedup by a tree merge of sorted digest runs, in DataFrame operations only.

Each document gives one small record: SHA-256, byte length and a second 64-bit hash of its normalised text, its length in
code points and its id.  Records go to RUNS runs by a hash of the id, so that a group that holds a third of all rows is
spread over all runs; within a run each digest is merged into one record before anything is exchanged.  Then run r and run
r XOR 2^k exchange halves, for k = 0, 1, 2, ...: a record goes to the one of the two whose bit k is that of its digest.  What a
run holds is sorted by digest and merged, so that after log2(RUNS) rounds each run holds the one record of each digest of its
range.  A run is dealt over SLICES slices of the digest, so that its size is no bound on the work of a task; the engine's
exchange does not keep the order of what it delivers, so each level sorts again, and merges in one pass over the sorted rows.

At every level a digest keeps one record: the longest original text, then the smallest id, its count, and the set of runs it
came from (a bit map).  Records merge only if the length and the second hash agree as well.  The way down explodes that bit map:
documents meet their group on (digest, run), so that no join sees a whole group in one task.

Cases: null text is empty text; all empty texts form one group; of rows that repeat an id within a group the longest is kept, of
those equal in that too any one, as they look alike; a null id sorts first and is kept like any other; an empty table gives an
empty result; only the id and text columns are read, so other columns may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.common import fresh, stored, table

#: Runs (a power of two; their set is a bit map of 64 bits at most) and slices of a run.
RUNS, SLICES = 16, 4096
#: Ids of dropped rows that are broadcast to drop them; more are joined.
BROADCAST_IDS = 1_000_000
KEY = ["_digest", "_bytes", "_check"]


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")


def records_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """_id, the merge key (digest, length and second hash of the normalised text), _chars and the run of each row."""
    norm = normalised(F.col(text_col))
    return docs.select(
        F.col(id_col).alias("_id"), F.unhex(F.sha2(norm, 256)).alias("_digest"), F.octet_length(norm).cast("long").alias("_bytes"), F.xxhash64(norm).alias("_check"),
        F.length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("_chars"), F.pmod(F.xxhash64(F.col(id_col)), F.lit(RUNS)).cast("int").alias("_run"),
    )


def merge_runs(records: DataFrame) -> DataFrame:
    """One row for each key: _keep (id), _size and _runs, after log2(RUNS) rounds of exchange and merge."""
    place = F.conv(F.substring(F.hex("_digest"), 1, 5), 16, 10).cast("int")  # 20 bits of the digest: the slice, and the run at the end
    runs = records.withColumns({"_slice": F.pmod(place, F.lit(SLICES)), "_best": F.struct((-F.col("_chars")).alias("less"), F.col("_id").alias("id"))})
    level = runs.groupBy("_run", "_slice", *KEY).agg(F.min("_best").alias("_best"), F.count(F.lit(1)).alias("_size"), F.bit_or(F.expr("shiftleft(1L, _run)")).alias("_runs"))
    bit = 1
    while bit < RUNS:
        partner = F.col("_run").bitwiseAND(F.lit(~bit)).bitwiseOR(F.floor(place / SLICES).cast("int").bitwiseAND(F.lit(bit)))  # itself, or _run XOR bit
        exchanged = level.withColumn("_run", partner).repartition("_run", "_slice").sortWithinPartitions("_run", "_slice", *KEY)
        level = exchanged.groupBy("_run", "_slice", *KEY).agg(F.min("_best").alias("_best"), F.sum("_size").alias("_size"), F.bit_or("_runs").alias("_runs"))
        bit *= 2
    return level.select(*KEY, F.col("_best.id").alias("_keep"), "_size", "_runs")


def _told(records: DataFrame) -> DataFrame:
    """Records with _keep, _size and _kept."""
    runs = F.explode(F.expr(f"filter(sequence(0, {RUNS - 1}), r -> (shiftrightunsigned(_runs, r) & 1L) = 1L)")).alias("_run")
    joined = records.join(merge_runs(records).select(*KEY, "_keep", "_size", runs), [*KEY, "_run"])
    first = F.row_number().over(Window.partitionBy(*KEY, "_run", "_id").orderBy(F.desc("_chars"))) if _repeats(records) else F.lit(1)
    return joined.withColumn("_kept", F.col("_id").eqNullSafe(F.col("_keep")) & (first == 1))


def _repeats(records: DataFrame) -> bool:
    """Whether any id occurs twice; ids and runs are small numbers, and partial sums go first."""
    return bool(records.groupBy("_run", "_id").count().filter("count > 1").limit(1).count())


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id, keep_id, group_size, kept, text_sha256, n_chars."""
    told = _told(stored(records_of(docs, id_col, text_col), "digests"))
    return told.select(
        F.col("_id").alias(id_col), F.col("_keep").alias("keep_id"), F.col("_size").alias("group_size"),
        F.col("_kept").alias("kept"), F.lower(F.hex("_digest")).alias("text_sha256"), F.col("_chars").alias("n_chars"),
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with its columns.

    The ids of the rows that go are broadcast if there are few, else joined; texts are shuffled in that case only.  Where ids
    repeat, rows are told by id and digest, and of those that are alike in both the longest text stays, then the first by all
    columns."""
    records = stored(records_of(docs, id_col, text_col), "digests")
    told = _told(records)
    if not _repeats(records):
        name = fresh(docs, "_gone")
        gone = stored(told.where("NOT _kept").select(F.col("_id").alias(name)), "gone")
        return docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, F.col(_quoted(id_col)).eqNullSafe(F.col(name)), "left_anti")
    kept = told.where("_kept").select(F.col("_id").alias("_kid"), F.col("_digest").alias("_kdigest"))
    rows = docs.select(F.struct(*(F.col(_quoted(c)) for c in docs.columns)).alias("_row"), F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    rows = rows.withColumn("_digest", F.unhex(F.sha2(normalised(F.col("_text")), 256)))
    rows = rows.join(kept, F.col("_id").eqNullSafe(F.col("_kid")) & (F.col("_digest") == F.col("_kdigest")), "left_semi")
    first = Window.partitionBy("_id", "_digest").orderBy(F.desc(F.length("_text")), F.to_json("_row"))
    return rows.withColumn("_first", F.row_number().over(first)).where("_first = 1").select("_row.*")


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_chars, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
  row_number() OVER w = 1 AS kept, text_sha256, n_chars
FROM n WINDOW w AS (PARTITION BY text_sha256 ORDER BY n_chars DESC, doc_id)
"""
