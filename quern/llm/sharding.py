"""Sharding by balanced label propagation, in DataFrame operations only.

Law `rows`: shards 0 to n-1 hold numbers of rows that differ by one at most.  Documents with equal texts are linked; the
fewer groups are cut over shards, the better.  Rows of a group are alike, so the state of the propagation is one row for
each (group, shard) with a count: a group that holds a third of all rows has 16 such rows, not a third of all.

1. Rows of groups of two or more are dealt round the shards, so that the start is even but cuts every group.
2. Rounds: each (group, shard) wants to join the shard where most neighbours of its group are (one of the first few, for a
   group larger than a shard).  Quotas between each two
   shards are the smaller of both demands (an exchange) and then the free room of the target.  Movers are taken in the order
   of a hash of their group, by prefix sums over hash buckets, and the one at the quota's end moves in part.  Rounds end when
   four in a row have left no fewer groups cut, every other one of them for groups whose best shard is full.
3. Rows without neighbours fill what room is left, so that counts end exactly even.
4. Rows of a group take its places by their rank within the group.  Ranks, and slots within a shard, come from counts of
   hash parts and prefix sums over those, so no window ever holds a whole group or shard.

Demand and room are tables of n x n and n numbers and are all that the driver sees.

Cases: null text has size 1 and shares a group with empty text; repeated rows are linked rows, each gets a slot; ties go by
hash, then id; a null id is an id of its own; an empty table gives an empty result; only the id and text columns are read, so other
columns may have any names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.common import prefix_offsets, stored, table

SHARDS = 16
#: Rows that a window ranks at a time, about; rows of a table of sums that are broadcast at most, more are joined.
PART_ROWS, BROADCAST_ROWS = 1 << 20, 1 << 20
GROUP = ["_digest", "_bytes"]


def _parts(rows: int) -> int:
    """Hash parts for so many rows."""
    return max(64, rows // PART_ROWS)


def _small(df: DataFrame, rows: int) -> DataFrame:
    """df with a hint to broadcast it, if it has so few rows at most."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _quotas(demand: dict[tuple[int, int], int], room: list[int]) -> dict[tuple[int, int], int]:
    """Rows that may move between each two shards: exchanges first, then free room of the target, largest demand first."""
    allowed = {k: min(v, demand.get(k[::-1], 0)) for k, v in demand.items()}
    room = list(room)
    for (s, t), v in sorted(demand.items(), key=lambda x: (-x[1], x[0])):
        more = min(v - allowed[s, t], room[t])
        if more > 0:
            allowed[s, t] += more
            room[t] -= more
    return {k: v for k, v in allowed.items() if v > 0}


def _round(cells: DataFrame, capacity: list[int], number: int, parts: int, kind: str = "all") -> tuple[DataFrame, int]:
    """Cells (group, _shard, _n) after one round, and the rows that moved.

    kind "spare": only groups that fit into a shard move, to where others of them have room; "giant": larger groups gather, and
    the others leave the shards where they do."""
    spark = cells.sparkSession
    group = Window.partitionBy(*GROUP)
    most = max(1, max(capacity))
    wanted = None
    if kind == "spare":
        held = {r["_shard"]: r["n"] for r in cells.groupBy("_shard").agg(F.sum("_n").alias("n")).collect()}  # a row for each shard
        wanted = [s for s, c in enumerate(capacity) if held.get(s, 0) < c]
    elif kind == "giant":
        giants = cells.withColumns({"_sum": F.sum("_n").over(group), "_k": F.row_number().over(group.orderBy(F.desc("_n"), F.xxhash64(*GROUP, "_shard")))})
        heads_ = {r["_shard"] for r in giants.where(F.col("_sum") > most).where(F.col("_k") <= F.ceil(F.col("_sum") / most)).select("_shard").distinct().collect()}
        wanted = [s for s in range(len(capacity)) if s not in heads_]
        if len(wanted) in (0, len(capacity)):
            return cells, 0
    roomy = F.lit(True) if wanted is None else F.col("_shard").isin(wanted)
    order = F.row_number().over(group.orderBy(F.desc(roomy), F.desc("_n"), F.xxhash64(*GROUP, "_shard"))) - 1
    wish = cells.withColumns({"_order": order, "_most": F.ceil(F.sum("_n").over(group) * (1 + number / 4) / most).cast("int")})
    # a group larger than a shard gathers in as many shards as it fills, in later rounds in more, as others hold room there
    heads = F.collect_list("_shard").over(group.orderBy("_order").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    wish = wish.withColumn("_to", F.element_at(heads, (F.col("_order") % F.col("_most") + 1).cast("int")))
    if wanted is not None:  # groups that fit into a shard go to the best of those, from full ones or from heads of larger groups
        fits, any_ = F.sum("_n").over(group) <= most, F.max(F.when(roomy, 1).otherwise(0)).over(group).cast("boolean")
        stays = roomy if kind == "giant" else F.lit(False)
        larger = F.col("_to") if kind == "giant" else F.col("_shard")
        wish = wish.withColumn("_to", F.when(~fits, larger).when(any_ & ~stays, F.element_at(heads, 1)).otherwise(F.col("_shard")))
    wish = wish.drop("_order", "_most")
    wish = wish.withColumn("_part", F.pmod(F.xxhash64(*GROUP, F.lit(7)), F.lit(parts)).cast("int"))
    wish = stored(wish, "wishes")
    load, demand = [0] * len(capacity), {}
    for r in wish.groupBy("_shard", "_to").agg(F.sum("_n").alias("n")).collect():  # shards x shards rows at most
        load[r["_shard"]] += r["n"]
        if r["_shard"] != r["_to"]:
            demand[r["_shard"], r["_to"]] = r["n"]
    allowed = _quotas(demand, [c - x for c, x in zip(capacity, load, strict=True)])
    if not allowed:
        return cells, 0
    quota = spark.createDataFrame([(s, t, n) for (s, t), n in allowed.items()], "_shard int, _to int, _quota long")
    movers = wish.join(F.broadcast(quota), ["_shard", "_to"], "left")
    before = prefix_offsets(wish.where("_shard != _to"), ["_shard", "_to"], "_part", "_n")  # shards x shards x parts rows
    movers = movers.join(_small(before, len(capacity) ** 2 * parts), ["_shard", "_to", "_part"], "left")
    running = F.sum("_n").over(Window.partitionBy("_shard", "_to", "_part").orderBy(*GROUP).rowsBetween(Window.unboundedPreceding, -1))
    movers = movers.withColumn("_ahead", F.coalesce("_before", F.lit(0)) + F.coalesce(running, F.lit(0)))
    movers = movers.withColumn("_go", F.when(F.col("_shard") == F.col("_to"), 0).otherwise(F.greatest(F.lit(0), F.least("_n", F.coalesce("_quota", F.lit(0)) - F.col("_ahead")))).cast("long"))
    moves = F.expr("array(named_struct('s', _shard, 'n', _n - _go), named_struct('s', _to, 'n', _go))")
    after = movers.select(*GROUP, F.explode(moves).alias("m")).where("m.n > 0").groupBy(*GROUP, F.col("m.s").alias("_shard")).agg(F.sum("m.n").alias("_n"))
    return stored(after, "cells"), sum(allowed.values())


def propagated(cells: DataFrame, capacity: list[int]) -> DataFrame:
    """Cells after rounds until groups are cut no less in four rounds in a row: those cut least.

    At first groups larger than a shard gather.  When a round cuts no fewer, the next one is for groups whose best shard is full:
    they go where others of their group have room, which frees places for the round after it."""
    cut = cells.count()  # a group that is whole has one cell
    parts = _parts(cut)
    for _ in range(2):
        cells, _ = _round(cells, capacity, 0, parts, "giant")
    best, idle, number, spare = cells, 0, 0, False
    cut = cells.count()
    while idle < 4:
        cells, moved = _round(cells, capacity, number, parts, "spare" if spare else "all")
        now = cells.count() if moved else cut
        number, idle, spare = number + 1, 0 if now < cut else idle + 1, not spare and now >= cut
        best, cut = (cells, now) if now < cut else (best, cut)
    return best


def balanced_shards(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id, size, text_crc32, law, shard, slot, grown_shard."""
    spark, text = docs.sparkSession, F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("_id"), F.xxhash64(F.lit(1), text).alias("_digest"), (F.octet_length(text) + 1).cast("long").alias("_bytes"), F.crc32(text).cast("long").alias("_crc"))
    # the group is told by two hashes of 96 bits together, and by the length
    rows = stored(rows.withColumns({"_digest": F.concat_ws(".", "_digest", "_crc"), "_spread": F.xxhash64("_id", F.lit(3))}), "rows")
    many = _parts(rows.count())
    rows = rows.withColumn("_part", F.pmod("_spread", F.lit(many)).cast("int")).drop("_spread")
    parts = stored(rows.groupBy(*GROUP, "_part").agg(F.count(F.lit(1)).alias("_n")), "parts")
    groups = stored(parts.groupBy(*GROUP).agg(F.sum("_n").alias("_n")), "groups")
    total = groups.agg(F.coalesce(F.sum("_n"), F.lit(0)), F.coalesce(F.sum(F.when(F.col("_n") > 1, F.col("_n"))), F.lit(0))).first()
    capacity = [total[0] // shards + (s < total[0] % shards) for s in range(shards)]

    # groups of two and more: an even start, then rounds of propagation
    several = groups.where("_n > 1").withColumn("_part", F.pmod(F.xxhash64(*GROUP), F.lit(many)).cast("int"))
    ahead = F.coalesce(F.sum("_n").over(Window.partitionBy("_part").orderBy(*GROUP).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    several = several.withColumn("_ahead", ahead).join(_small(prefix_offsets(several, [], "_part", "_n"), many), "_part").withColumn("_o", F.col("_ahead") + F.col("_before"))
    at = F.expr(f"transform(sequence(0, {shards - 1}), s -> named_struct('s', s, 'n', (_o + _n + {shards - 1} - s) div {shards} - (_o + {shards - 1} - s) div {shards}))")
    cells = several.select(*GROUP, F.explode(at).alias("c")).where("c.n > 0").select(*GROUP, F.col("c.s").cast("int").alias("_shard"), F.col("c.n").alias("_n"))
    if total[1]:
        cells = propagated(stored(cells, "cells"), capacity)

    # places of a group: shards take intervals of its ranks; parts of its rows take intervals of the same ranks
    places = cells.withColumn("_hi", F.sum("_n").over(Window.partitionBy(*GROUP).orderBy("_shard"))).withColumn("_lo", F.col("_hi") - F.col("_n")).drop("_n")
    dealt = parts.join(groups.where("_n > 1").select(*GROUP), GROUP).withColumn("_to", F.sum("_n").over(Window.partitionBy(*GROUP).orderBy("_part"))).withColumn("_from", F.col("_to") - F.col("_n")).drop("_n")
    dealt = dealt.join(places, GROUP).where("_from < _hi AND _lo < _to").groupBy(*GROUP, "_part").agg(F.min("_from").alias("_from"), F.collect_list(F.struct("_lo", "_hi", "_shard")).alias("_places"))
    rank = F.row_number().over(Window.partitionBy(*GROUP, "_part").orderBy("_id")) - 1
    ranked = rows.withColumn("_r", rank).join(dealt, [*GROUP, "_part"], "left").withColumn("_r", F.col("_r") + F.col("_from"))
    ranked = ranked.withColumn("_shard", F.expr("filter(_places, p -> p._lo <= _r AND _r < p._hi)[0]._shard")).drop("_places", "_from", "_r")

    # rows alone in their group fill the room that is left
    ranked = stored(ranked, "ranked")
    load = [0] * shards
    for r in ranked.where("_shard IS NOT NULL").groupBy("_shard").count().collect():  # a row for each shard
        load[r["_shard"]] = r["count"]
    room = [c - x for c, x in zip(capacity, load, strict=True)]
    edges = [sum(room[:s]) for s in range(shards)]
    alone = ranked.where("_shard IS NULL").withColumn("_one", F.lit(1))
    number = F.row_number().over(Window.partitionBy("_part").orderBy("_id", *GROUP)) - 1
    alone = alone.withColumn("_k", number).join(_small(prefix_offsets(alone, [], "_part", "_one"), many), "_part")
    bounds = "array(" + ", ".join(f"{e}L" for e in edges) + ")"
    # the last shard whose first place is at or before the row's; shards without room start where the next one does
    fill = F.expr(f"cast(size(filter({bounds}, e -> e <= _k + _before)) - 1 AS int)")
    placed = ranked.where("_shard IS NOT NULL").unionByName(alone.withColumn("_shard", fill).select(*ranked.columns))
    placed = stored(placed, "placed").withColumn("_one", F.lit(1))
    slot = F.row_number().over(Window.partitionBy("_shard", "_part").orderBy("_id", *GROUP)) - 1
    placed = placed.withColumn("_slot", slot).join(_small(prefix_offsets(placed, ["_shard"], "_part", "_one"), shards * many), ["_shard", "_part"])
    return placed.select(
        F.col("_id").alias(id_col), F.col("_bytes").alias("size"), F.col("_crc").alias("text_crc32"), F.lit("rows").alias("law"),
        F.col("_shard").alias("shard"), (F.col("_slot") + F.col("_before")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balanced_shards(table(spark, sf_dir, "documents"))
