"""Aggregates that fuse many reports into one record.  Ties go to what was seen first, by an explicit order column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.rules import default_radius, severity
from quern.operators.store import stored

#: Most confidence of a place and of a country that stands for one, and the facts of a record.
MOST_PLACE, MOST_COUNTRY = 0.9, 0.2
FIELDS = ("fatalities", "injuries")
UNTITLED = "Reported traffic incident with unresolved location"


def agreement(value: str | Column) -> Column:
    """Aggregate: the value if all non-null ones agree, else null."""
    v = F.col(value) if isinstance(value, str) else value
    return F.when(F.min(v) == F.max(v), F.max(v))


def plurality(rows: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """Most frequent value of each key, the earliest on a tie: value, votes, alternatives (sorted), contradiction, confidence, state.

    Counts are taken by (key, value) first, so a hot key costs as many rows as it has different values.
    """
    votes = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"), F.min(order).alias("_first"))
    best = F.min(F.struct((-F.col("_n")).alias("_less"), F.col("_first").alias("_o"), F.col(value).alias("_v"), F.col("_n")))
    fused = votes.groupBy(*keys).agg(best.alias("_b"), F.collect_set(value).alias("_all"), F.sum("_n").alias("_total"))
    other = F.sort_array(F.filter("_all", lambda x: x != F.col("_b._v")))
    confidence = F.greatest(F.lit(0.0), F.least(F.lit(0.9), 0.55 + 0.08 * F.col("_b._n") - 0.12 * F.size(other)))
    return fused.select(*keys, F.col("_b._v").alias("value"), F.col("_b._n").alias("votes"), other.alias("alternatives"), (F.size(other) > 0).alias("contradiction"), confidence.alias("confidence"), F.col("_total").alias("reports"))


def fact_state(value: Column) -> Column:
    return F.when(value.isNull(), "not_reported").when(value == 0, "reported_zero").otherwise("known")


def modal_time(rows: DataFrame, keys: list[str], time: str, order: str, carried: list[str]) -> DataFrame:
    """The most frequent exact time of each key with what the first timed row says besides, as an interval of a day."""
    timed = rows.where(F.col(time).isNotNull())
    best = plurality(timed, keys, time, order).select(*keys, F.col("value").alias("start"))
    first = timed.groupBy(*keys).agg(F.min_by(F.struct(*carried), order).alias("_f")).select(*keys, *(F.col(f"_f.{c}").alias(c) for c in carried))
    return best.join(first, keys).withColumn("end", F.expr("start + INTERVAL 1 DAY"))


def fused_place(rows: DataFrame, keys: list[str], name: str, granularity: str, confidence: str, order: str, carried: list[str] = []) -> DataFrame:  # noqa: B006
    """Most named place of each key, countries only if there are no others: place, confidence (raised by repeats), granularity,
    carried columns, all of the first row that names it, alternatives.

    Counts are taken by (key, name) first; what is finer than a country is told from those counts."""
    fine = F.col(granularity) != "country"
    first = F.min_by(F.struct(fine.alias("fine"), F.col(confidence).alias("confidence"), F.col(granularity).alias("granularity"), *carried), order)
    votes = rows.groupBy(*keys, name).agg(F.count(F.lit(1)).alias("_n"), F.count_if(fine).alias("_fine"), F.min(F.when(fine, F.col(order))).alias("_of"), F.min(order).alias("_o"), F.min_by(F.struct(F.col(confidence).alias("confidence"), F.col(granularity).alias("granularity"), *carried), F.when(fine, F.col(order))).alias("_ff"), first.alias("_f"))
    as_fine = F.min(F.when(F.col("_fine") > 0, F.struct((-F.col("_fine")).alias("less"), F.col("_of").alias("o"), F.col(name).alias("name"), F.col("_fine").alias("n"), F.lit(True).alias("fine"), F.col("_ff").alias("f"))))
    rest = F.struct(F.col("_f.confidence").alias("confidence"), F.col("_f.granularity").alias("granularity"), *(F.col(f"_f.{c}").alias(c) for c in carried))
    as_country = F.min(F.struct((-F.col("_n")).alias("less"), F.col("_o").alias("o"), F.col(name).alias("name"), F.col("_n").alias("n"), F.lit(False).alias("fine"), rest.alias("f")))
    out = votes.groupBy(*keys).agg(F.coalesce(as_fine, as_country).alias("b"), F.sort_array(F.collect_set(name)).alias("names"))
    more = F.col("b.n") - 1
    raised = F.when(F.col("b.fine"), F.least(F.lit(MOST_PLACE), F.col("b.f.confidence") + 0.05 * more)).otherwise(F.least(F.lit(MOST_COUNTRY), F.col("b.f.confidence") + 0.02 * more))
    return out.select(*keys, F.col("b.name").alias("place"), raised.alias("confidence"), F.col("b.f.granularity").alias("granularity"), *(F.col(f"b.f.{c}").alias(c) for c in carried), F.array_remove("names", F.col("b.name")).alias("alternatives"))


def independent_sources(rows: DataFrame, keys: list[str], group: str, source: str) -> DataFrame:
    """Number of sources, of independent groups, and the groups of more than one source, of each key."""
    own = F.coalesce(F.col(group), F.col(source).cast("string"))
    per = rows.select(*keys, own.alias("_g"), source).distinct().groupBy(*keys, "_g").agg(F.count(F.lit(1)).alias("_n"))
    return per.groupBy(*keys).agg(F.sum("_n").alias("sources"), F.count(F.lit(1)).alias("independent"), F.count_if(F.col("_n") > 1).alias("duplicate_groups"))


def last_wins(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key, at the place of its first: adds first_order."""
    rest = [c for c in rows.columns if c not in keys]
    merged = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r"), F.min(order).alias("first_order"))
    return merged.select(*keys, *(F.col(f"_r.{c}").alias(c) for c in rest), "first_order")


def nested_counts(rows: DataFrame, keys: list[str], outer: str, inner: str) -> DataFrame:
    """keys -> map of outer to map of inner to count."""
    level = rows.groupBy(*keys, outer, inner).agg(F.count(F.lit(1)).alias("_n"))
    level = level.groupBy(*keys, outer).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(inner, "_n")))).alias("_m"))
    return level.groupBy(*keys).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(outer, F.map_entries("_m").alias("_e"))))).alias("_x")).select(
        *keys, F.transform_values("_x", lambda _, e: F.map_from_entries(e)).alias("counts")
    )


def casualty_facts(clusters: DataFrame, mentions: DataFrame) -> DataFrame:
    """cluster -> facts: an array of one struct for each of FIELDS, told or not, with its evidence."""
    told = clusters.join(mentions.select("mention_id", "evidence_ids", *FIELDS), "mention_id").select("cluster", "mention_id", "evidence_ids", F.explode(F.create_map(*(x for f in FIELDS for x in (F.lit(f), F.col(f))))).alias("field", "value")).where("value IS NOT NULL")
    voted = plurality(told, ["cluster", "field"], "value", "mention_id")
    cited = told.groupBy("cluster", "field").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("evidence_ids")))).alias("support"))
    every = clusters.select("cluster").distinct().withColumn("field", F.explode(F.array(*map(F.lit, FIELDS))))
    facts = every.join(voted.join(cited, ["cluster", "field"]), ["cluster", "field"], "left").withColumns({
        "state": fact_state(F.col("value")), "confidence": F.coalesce("confidence", F.lit(0.0)), "contradiction": F.coalesce("contradiction", F.lit(False)),
        "alternatives": F.coalesce("alternatives", F.array().cast("array<int>")), "support": F.coalesce("support", F.array().cast("array<string>")),
    })
    return facts.groupBy("cluster").agg(F.sort_array(F.collect_list(F.struct("field", "value", "state", "alternatives", "contradiction", "confidence", "support"))).alias("facts"))


def most_told(field: str) -> Column:
    """The largest value told of a fact, alternatives included; 0 if none."""
    own = F.filter(F.col("facts"), lambda x: x["field"] == field)
    return F.coalesce(F.array_max(F.flatten(F.transform(own, lambda x: F.concat(F.array(x["value"]), x["alternatives"])))), F.lit(0))


def moods(sentiments: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """key -> polarities, by_aspect (aspect -> polarity -> number), n_sentiments: each piece of evidence counts once, the last row told.

    sentiments (evidence_id, source_id, aspect, polarity, sentiment_id), members (key, source_id)."""
    own = members.select(key, "source_id").distinct().join(sentiments, "source_id")
    once = own.groupBy(key, "evidence_id").agg(F.max_by(F.struct("aspect", "polarity"), "sentiment_id").alias("_s")).select(key, "_s.aspect", "_s.polarity")
    counts = nested_counts(once, [key], "aspect", "polarity").withColumnRenamed("counts", "by_aspect")
    return counts.join(once.groupBy(key).agg(F.sort_array(F.collect_set("polarity")).alias("polarities"), F.count(F.lit(1)).alias("n_sentiments")), key)


def fuse_clusters(clusters: DataFrame, mentions: DataFrame, sentiments: DataFrame | None = None) -> DataFrame:
    """One record for each cluster, in the shape that querying.Filter, feature and page take.

    clusters (cluster, mention_id); mentions (mention_id, source_id, dependency_group, title, event_time, evidence_ids, vehicles,
    effects, fatalities, injuries, and of their place: place_name, granularity, lat, lon, place_confidence, radius_km, reason).
    Ties go to the mention with the smallest id."""
    joined = stored(clusters.join(mentions, "mention_id"), "members")
    union = lambda c: F.sort_array(F.array_distinct(F.flatten(F.collect_list(c))))
    base = joined.groupBy("cluster").agg(
        F.sort_array(F.collect_set("mention_id")).alias("mention_ids"), F.sort_array(F.collect_set("source_id")).alias("source_ids"), union("evidence_ids").alias("evidence_ids"),
        union("vehicles").alias("vehicles"), union("effects").alias("effects"), F.min_by("title", F.when(F.col("title").isNotNull(), F.struct("source_id", "mention_id"))).alias("title"),
    ).withColumn("incident_id", F.concat(F.lit("inc_"), F.substring(F.sha2(F.array_join(F.transform("mention_ids", lambda m: m.cast("string")), "|"), 256), 1, 16)))
    own = F.coalesce("dependency_group", F.col("source_id").cast("string"))
    groups = joined.select("cluster", own.alias("_g"), F.col("dependency_group").isNotNull().alias("_named"), "source_id").distinct().groupBy("cluster", "_g", "_named").agg(F.sort_array(F.collect_set("source_id")).alias("_s"))
    groups = groups.groupBy("cluster").agg(F.count_distinct("_g").alias("source_count"), F.sort_array(F.collect_list(F.when(F.col("_named") & (F.size("_s") > 1), F.col("_s")))).alias("duplicate_groups"))
    time = plurality(joined, ["cluster"], "event_time", "mention_id").select("cluster", F.col("value").alias("event_start"), F.col("alternatives").alias("other_times"))
    place = fused_place(joined.where("place_name IS NOT NULL"), ["cluster"], "place_name", "granularity", "place_confidence", "mention_id", ["lat", "lon", "radius_km", "reason"])
    cites = joined.where("place_name IS NOT NULL").groupBy("cluster").agg(union("evidence_ids").alias("place_evidence"))
    out = base.join(groups, "cluster").join(casualty_facts(clusters, mentions), "cluster").join(time, "cluster", "left").join(place.withColumnRenamed("confidence", "_c").withColumnRenamed("alternatives", "other_places").join(cites, "cluster"), "cluster", "left")
    if sentiments is not None:
        out = out.join(moods(sentiments, joined, "cluster"), "cluster", "left")
    else:
        out = out.withColumns({"polarities": F.lit(None).cast("array<string>"), "by_aspect": F.lit(None).cast("map<string, map<string, bigint>>"), "n_sentiments": F.lit(None).cast("long")})
    country = F.col("granularity") == "country"
    out = out.withColumns({
        "title": F.coalesce("title", F.lit(UNTITLED)), "kind": F.lit("road_crash"), "event_end": F.expr("event_start + INTERVAL 1 DAY"), "date": F.date_format("event_start", "yyyy-MM-dd"), "granularity": F.coalesce("granularity", F.lit("unknown")),
        "method": F.when(country, "collection_country_fallback").when(F.col("place").isNotNull(), "source_named_offline_gazetteer_centroid").otherwise("unresolved"), "is_incident_location": F.col("place").isNotNull() & ~country,
        "confidence": F.coalesce("_c", F.lit(0.0)), "radius_km": F.when(F.col("lat").isNotNull(), default_radius(F.col("granularity"), F.col("radius_km"))), "severity": severity(most_told("fatalities"), most_told("injuries")),
        "polarities": F.coalesce("polarities", F.array().cast("array<string>")), "n_sentiments": F.coalesce("n_sentiments", F.lit(0)), "other_places": F.coalesce("other_places", F.array().cast("array<string>")),
    }).drop("_c", "cluster")
    return out.withColumn("summary", summary_text()).withColumn("text", F.concat_ws(" ", "title", "summary"))


def summary_text() -> Column:
    """What a record tells, in English sentences."""
    told = lambda f: F.element_at(F.filter("facts", lambda x: x["field"] == f), 1)
    count = lambda f, one, many: F.when(told(f)["state"] == "not_reported", F.lit(f"{many} not reported")).when(told(f)["state"] == "reported_zero", F.lit(f"zero {many} reported")).otherwise(F.concat(told(f)["value"].cast("string"), F.when(told(f)["value"] == 1, f" {one}").otherwise(f" {many}")))
    return F.concat_ws(
        " ", F.when(F.col("event_start").isNotNull(), F.concat(F.lit("Reported for "), F.date_format("event_start", "d MMMM yyyy"), F.lit("."))).otherwise("The time is not established."),
        F.when(F.col("place").isNotNull(), F.concat(F.lit("Place: "), "place", F.lit(", at "), F.replace("granularity", F.lit("_"), F.lit(" ")), F.lit(" precision."))).otherwise("The place is not resolved."),
        F.concat(F.lit("Casualties: "), count("fatalities", "fatality", "fatalities"), F.lit(" and "), count("injuries", "injury", "injuries"), F.lit(".")),
        F.when(F.size("vehicles") > 0, F.concat(F.lit("Vehicles or road users: "), F.array_join("vehicles", ", "), F.lit("."))), F.when(F.size("effects") > 0, F.concat(F.lit("Effects: "), F.array_join("effects", "; "), F.lit("."))),
        F.concat(F.size("source_ids").cast("string"), F.lit(" source records, "), F.col("source_count").cast("string"), F.lit(" independent groups, "), F.size("evidence_ids").cast("string"), F.lit(" pieces of evidence.")),
    )


def reconciled(records: DataFrame, candidates: DataFrame, key: str) -> DataFrame:
    """Records of a model held to what their mentions tell: records (key, place, lat, lon, confidence), candidates (key, name,
    granularity, lat, lon, confidence).

    The place becomes the located candidate whose words of more than three letters occur most in the model's name, then the most
    confident, then the first by name, countries only if there are no others; its confidence is the smaller one.  Coordinates
    without a located candidate go."""
    own = candidates.where("lat IS NOT NULL AND lon IS NOT NULL").join(records.select(key, F.lower(F.coalesce("place", F.lit(""))).alias("_said")), key)
    words = F.array_distinct(F.filter(F.split(F.lower(F.replace("name", F.lit(","), F.lit(" "))), r"\s+"), lambda w: F.length(w) > 3))
    fit = F.struct((F.col("granularity") != "country").alias("fine"), F.size(F.filter(words, lambda w: F.contains(F.col("_said"), w))).alias("overlap"), F.col("confidence").alias("c"))
    best = own.withColumn("_fit", fit).groupBy(key).agg(F.max("_fit").alias("_top"), F.collect_list(F.struct("_fit", F.struct("name", "granularity", "lat", "lon", "confidence").alias("v"))).alias("_all"))
    best = best.select(key, F.array_min(F.transform(F.filter("_all", lambda x: x["_fit"] == F.col("_top")), lambda x: x["v"])).alias("_b"))
    out = records.join(best, key, "left")
    found = F.col("_b").isNotNull()
    return out.select(
        key, F.when(found, F.col("_b.name")).otherwise(F.col("place")).alias("place"), F.col("_b.lat").alias("lat"), F.col("_b.lon").alias("lon"), F.when(found, F.col("_b.granularity")).otherwise("unknown").alias("granularity"),
        F.when(found, F.least("confidence", "_b.confidence")).when(F.col("lat").isNotNull(), 0.0).otherwise(F.col("confidence")).alias("confidence"),
        F.when(F.col("_b.granularity") == "country", "collection_country_fallback").when(found, "source_named_offline_gazetteer_centroid").when(F.col("lat").isNotNull(), "unresolved; ungrounded coordinates discarded").otherwise("unresolved").alias("method"),
    )


def unanimous_facts(told: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Facts (key, field, value) that all mentions of a record agree on and that the record lacks, with confidence 0.8."""
    one = told.where("value IS NOT NULL").groupBy(key, "field").agg(F.min("value").alias("value"), F.max("value").alias("_most")).where("value = _most").drop("_most")
    return one.join(known.select(key, "field"), [key, "field"], "left_anti").select(key, "field", "value", fact_state(F.col("value")).alias("state"), F.lit(0.8).alias("confidence"))
