"""Selections by rank within groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_per_group(rows: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= n)


def capped(rows: DataFrame, keys: list[str], cap_key: str, order: list[Column], cap: int, most: int, exempt: Column) -> DataFrame:
    """At most cap rows of each cap_key within a group, exempt rows aside, then at most so many in all."""
    place = F.row_number().over(Window.partitionBy(*keys, cap_key).orderBy(*order))
    kept = rows.withColumn("_place", place).where((F.col("_place") <= cap) | exempt).drop("_place")
    return top_per_group(kept, keys, order, most)


def priority_order(rows: DataFrame, keys: list[str], domain: str, pair: Column, order: list[Column]) -> DataFrame:
    """position within the group: pairs first, then the first row of each domain, then the rest."""
    first = F.row_number().over(Window.partitionBy(*keys, domain).orderBy(*order)) == 1
    tier = F.when(pair, 0).when(F.col("_first"), 1).otherwise(2)
    return rows.withColumn("_first", first).withColumn("position", F.row_number().over(Window.partitionBy(*keys).orderBy(tier, *order))).drop("_first")


def quota_selection(rows: DataFrame, group: str, key: str, domain: str, confidence: str, url: str, n: int) -> DataFrame:
    """n rows of each group: two rows of different domains of its best key first, then by confidence; one row for each url."""
    order = [F.col(key).isNull(), F.desc(confidence), F.col(domain), F.col(url)]
    once = top_per_group(rows, [group, url], order, 1).drop("rank")
    keyed = once.where(F.col(key).isNotNull())
    best = keyed.groupBy(group, key).agg(F.count_distinct(domain).alias("_d"), F.max(confidence).alias("_c")).where("_d >= 2")
    best = top_per_group(best, [group], [F.desc("_c"), F.col(key)], 1).select(group, F.col(key).alias("_key"))
    per = top_per_group(keyed.join(best, group).where(F.col(key) == F.col("_key")), [group, domain], order, 1).drop("rank")
    pair = top_per_group(per, [group], order, 2).select(group, url, F.lit(True).alias("pair"))
    joined = once.join(pair, [group, url], "left").withColumn("pair", F.coalesce("pair", F.lit(False)))
    return top_per_group(joined, [group], [F.desc("pair"), *order], n)


def accepted(rows: DataFrame, group: str, domain: str, title: Column, ok: Column, order: list[Column], cap: int = 3, most: int = 20) -> DataFrame:
    """Rows taken in order: those that are ok, the first of a title, while fewer than cap of their domain and most of the group
    are taken before.

    Only rows that are ok count against a domain, so they are filtered first; the place among them is then that among taken ones."""
    fit = rows.where(ok).withColumn("_title", title)
    fit = fit.withColumn("_t", F.row_number().over(Window.partitionBy(group, "_title").orderBy(*order))).where("_t = 1")
    fit = fit.withColumn("_d", F.row_number().over(Window.partitionBy(group, domain).orderBy(*order))).where(F.col("_d") <= cap)
    return fit.withColumn("position", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("position") <= most).drop("_title", "_t", "_d")
