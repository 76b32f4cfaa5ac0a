"""Checks that return issues (code, subject, detail) instead of raising."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators.store import stored

#: Protected items, or words of theirs, that are broadcast; more are joined.
MOST_ITEMS = 200_000


def issue(rows: DataFrame, code: str, subject: str, detail: str | None = None) -> DataFrame:
    return rows.select(F.lit(code).alias("code"), F.col(subject).cast("string").alias("subject"), (F.col(detail).cast("string") if detail else F.lit(None).cast("string")).alias("detail"))


def duplicate_keys(rows: DataFrame, key: str, code: str) -> DataFrame:
    return issue(rows.groupBy(key).count().where("count > 1"), code, key, "count")


def missing_references(rows: DataFrame, key: str, to: DataFrame, to_key: str, code: str) -> DataFrame:
    gone = rows.select(key).distinct().join(to.select(F.col(to_key).alias("_k")), F.col(key) == F.col("_k"), "left_anti")
    return issue(gone, code, key)


def difference(left: DataFrame, right: DataFrame, key: str, codes: tuple[str, str]) -> DataFrame:
    """Keys of one side only, both ways."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return issue(a.join(b, key, "left_anti"), codes[0], key).union(issue(b.join(a, key, "left_anti"), codes[1], key))


def below_quota(groups: DataFrame, key: str, rows: DataFrame, quota: int, code: str) -> DataFrame:
    """Groups, those without rows included, with fewer rows than the quota."""
    have = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    return issue(groups.select(key).distinct().join(have, key, "left").withColumn("_n", F.coalesce("_n", F.lit(0))).where(F.col("_n") < quota), code, key, "_n")


def uncited_support(facts: DataFrame, evidence: DataFrame) -> DataFrame:
    """Facts (record_id, field, value, support) that cite unknown evidence, or have a value without any."""
    cites = facts.select("record_id", F.explode("support").alias("evidence_id"))
    unknown = cites.join(evidence.select("evidence_id").distinct(), "evidence_id", "left_anti")
    bare = facts.where(F.col("value").isNotNull() & (F.size("support") <= 0))
    return issue(unknown, "unknown_evidence", "record_id", "evidence_id").union(issue(bare, "value_without_support", "record_id", "field"))


def every(*issues: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, issues)


def leaks_of(texts: DataFrame, id_col: str, text_col: str, protected: DataFrame, item_col: str, protected_text: str) -> DataFrame:
    """Texts that hold a protected text whole, by words: found by the item's rarest word, then a containment test.

    Every item has a word, and a text that holds the item holds that word; the rarest one of the item's keeps common words out.
    Words are counted without their texts; a text meets the items of the rare words it holds where it is read, so that no text is
    shuffled, as long as the items can be broadcast."""
    spaced = lambda c: F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(c), r"[ \t\n\r\f\x0B]+", " ")), F.lit(" "))
    words = lambda c: F.array_distinct(F.filter(F.split(c, " "), lambda w: w != ""))
    small = lambda d: F.broadcast(d) if d.count() <= MOST_ITEMS else d
    items = protected.select(F.col(item_col), spaced(protected_text).alias("_p"))
    item_words = items.select(item_col, F.explode(words("_p")).alias("_w"))
    wanted = stored(item_words.select("_w").distinct(), "wanted")
    often = texts.select(F.explode(words(spaced(text_col))).alias("_w")).join(small(wanted), "_w", "left_semi").groupBy("_w").agg(F.count(F.lit(1)).alias("_n"))
    rare = item_words.join(often, "_w", "left").groupBy(item_col).agg(F.min_by("_w", F.struct(F.coalesce("_n", F.lit(0)), "_w")).alias("_w"))
    rare = stored(rare.join(items, item_col), "rare")
    held = texts.select(F.col(id_col), spaced(text_col).alias("_t")).withColumn("_w", F.explode(words("_t")))
    return held.join(small(rare), "_w").where(F.contains("_t", F.col("_p"))).select(id_col, item_col).distinct()
