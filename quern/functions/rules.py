"""Scores, labels and geometry as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
EARTH_KM, DEGREE_KM = 6371.0088, 111.32
SAME_TIME, SAME_TERMS = 0.65, 0.3
RADIUS_KM = {"intersection": 0.75, "road_segment": 1.0, "area": 3.0, "city": 12.0, "district": 35.0}
FIELD_ALIASES = {"fatality_count": "fatalities", "fatalities_count": "fatalities", "death_count": "fatalities", "injury_count": "injuries", "injuries_count": "injuries", "injured_count": "injuries"}
LABEL_CONFIDENCE = {"low": 0.35, "medium": 0.65, "high": 0.9}
#: Words that tell an assertion, in order of precedence.
ASSERTIONS = (("direct", "observed"), ("observ", "observed"), ("alleg", "attributed_claim"), ("claim", "attributed_claim"), ("opinion", "opinion"), ("sentiment", "opinion"), ("infer", "inferred"), ("predict", "predicted"), ("possible", "predicted"))


def severity(deaths: Column, injuries: Column) -> Column:
    """critical from five deaths, high from one, medium with injuries, else unknown."""
    return F.when(deaths >= 5, "critical").when(deaths >= 1, "high").when(injuries >= 1, "medium").otherwise("unknown")


def assertion(value: Column, default: str = "reported") -> Column:
    """Free text to a closed set, the first that is contained wins."""
    v = F.lower(F.coalesce(value, F.lit("")))
    out = F
    for word, label in ASSERTIONS:
        out = out.when(F.contains(v, F.lit(word)), F.lit(label))
    return out.otherwise(F.lit(default))


def clamped_confidence(value: Column) -> Column:
    """A number between 0 and 1, or the number of a label, else a half."""
    table = F.create_map(*(F.lit(x) for pair in LABEL_CONFIDENCE.items() for x in pair))
    number = value.try_cast("double")
    return F.coalesce(F.when(number.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), number))), F.try_element_at(table, F.lower(value)), F.lit(0.5))


def canonical_field(name: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in FIELD_ALIASES.items() for x in pair))
    return F.coalesce(F.try_element_at(table, F.lower(F.trim(name))), name)


def default_radius(granularity: Column, radius: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in RADIUS_KM.items() for x in pair))
    return F.coalesce(radius, F.try_element_at(table, granularity))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def uncertainty_ring(lat: Column, lon: Column, radius_km: Column, steps: int = 64) -> Column:
    """Closed ring of (lon, lat) points around a place."""
    dy = radius_km / DEGREE_KM
    dx = radius_km / (DEGREE_KM * F.greatest(F.lit(0.2), F.cos(F.radians(lat))))
    turn = lambda i: i * 2 * 3.141592653589793 / steps
    return F.transform(F.sequence(F.lit(0), F.lit(steps)), lambda i: F.array(lon + F.cos(turn(i)) * dx, lat + F.sin(turn(i)) * dy))


def estimated_cost(tokens_in: Column, tokens_out: Column, rate_in: float, rate_out: float) -> Column:
    """Currency units for tokens at rates per million."""
    return F.round((tokens_in * rate_in + tokens_out * rate_out) / 1e6, 8)


def time_score(left: Column, right: Column, most_days: int = 3) -> Column:
    """1 at the same time, falling to 0 at most_days; a quarter if either is unknown."""
    days = days_apart(left, right)
    return F.when(days.isNull(), 0.25).otherwise(F.greatest(F.lit(0.0), 1 - days / most_days))


def days_apart(left: Column, right: Column) -> Column:
    """Days and fractions between two timestamps without zone."""
    return F.abs(F.timestamp_diff("MICROSECOND", left, right)) / 86_400_000_000


def total_score(time: Column, location: Column, entity: Column, vehicle: Column, lexical: Column, shared_terms: Column) -> Column:
    """Weighted sum with its two floors, 1 at most."""
    total = 0.30 * time + 0.35 * location + 0.15 * entity + 0.05 * vehicle + 0.15 * lexical
    # each part stands in few places, since expressions are copied to where they stand
    total = F.greatest(total, F.when((location == 1) & (lexical > 0), 0.74), F.when((lexical >= 0.5) | shared_terms, 0.62))
    return F.least(total, F.lit(1.0))


def adjudicated(total: Column, time: Column, location: Column, lexical: Column, guard: Column) -> Column:
    same = ((location == 1) & (time >= SAME_TIME)) | ((lexical >= SAME_TERMS) & (total >= 0.6) & guard.isNull())
    return F.when(same, "same_incident").otherwise("uncertain")


def half_coordinates(lat: Column, lon: Column) -> Column:
    """Whether a place has one coordinate without the other, which it may not."""
    return lat.isNull() != lon.isNull()
