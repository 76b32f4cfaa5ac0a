"""URL scalars."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

#: Answers that deny access, and query parameters that only track.
BLOCKED = (401, 403, 407, 418, 429, 451)
TRACKING = ("fbclid", "gclid", "mc_cid", "mc_eid", "ref", "ref_src")


def _column(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def hostname(url: str | Column) -> Column:
    """Host in lower case without one leading www."""
    return F.regexp_replace(F.lower(F.regexp_extract(_column(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), r"^www\.", "")


def canonical_url(url: str | Column) -> Column:
    """Lower-case scheme and host, no default port, fragment or tracking parameter, parameters in order; null if not web or with a
    user part."""
    u = F.trim(_column(url))
    part = lambda k: F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?", k)
    scheme, host = F.lower(part(1)), F.lower(part(2))
    host = F.when(scheme == "http", F.regexp_replace(host, ":80$", "")).when(scheme == "https", F.regexp_replace(host, ":443$", "")).otherwise(host)
    path = F.when(part(3) == "", F.lit("/")).otherwise(part(3))
    decoded = lambda x: F.coalesce(F.try_url_decode(x), x)
    encoded = lambda x: F.replace(F.replace(F.url_encode(x), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))
    pairs = F.transform(
        F.filter(F.split(part(4), "&"), lambda p: p != ""),
        lambda p: F.struct(decoded(F.substring_index(p, "=", 1)).alias("k"), decoded(F.when(F.contains(p, F.lit("=")), F.regexp_replace(p, "^[^=]*=", "")).otherwise(F.lit(""))).alias("v")),
    )
    kept = F.sort_array(F.filter(pairs, lambda p: ~F.lower(p["k"]).startswith("utm_") & ~F.lower(p["k"]).isin(*TRACKING)))
    query = F.array_join(F.transform(kept, lambda p: F.concat(encoded(p["k"]), F.lit("="), encoded(p["v"]))), "&")
    whole = F.concat(scheme, F.lit("://"), host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))
    return F.when(scheme.isin("http", "https") & (host != "") & ~F.contains(host, F.lit("@")), whole)


def direct_url(url: str | Column) -> Column:
    """The publisher's address inside an aggregator link's url parameter, else the link."""
    u = _column(url)
    inner = F.nullif(F.regexp_extract(u, r"[?&]url=([^&#]+)", 1), F.lit(""))
    return F.coalesce(F.try_url_decode(inner), u)


def is_public(host: str | None) -> bool:
    """Whether the host is neither local nor an address outside the public range."""
    if not host or host == "localhost" or host.endswith((".localhost", ".local")):
        return False
    try:
        return ipaddress.ip_address(host.strip("[]")).is_global
    except ValueError:
        return True


@F.pandas_udf(BooleanType())
def public_host(host: pd.Series) -> pd.Series:
    return host.map(is_public)


def safe_relative_path(path: str | Column) -> Column:
    """Whether a path stays below its folder: not empty, not absolute, no backslash, no dot parts."""
    p = _column(path)
    return (p != "") & ~p.contains("\\") & ~p.startswith("/") & ~p.rlike(r"(^|/)\.{0,2}(/|$)")


def web_url(url: str | Column) -> Column:
    """Whether an address is absolute, of the web and without credentials."""
    u = _column(url)
    return u.rlike(r"^(?i:https?)://[^/?#@:]+(:[0-9]*)?([/?#].*)?$")


def country_code(code: str | Column, assigned: list[str] | None = None) -> Column:
    """Whether a code has three capital letters, and is one of the assigned ones if those are given."""
    c = _column(code)
    return c.rlike("^[A-Z]{3}$") & (c.isin(assigned) if assigned else F.lit(True))


def access_class(status: str | Column) -> Column:
    """What an HTTP status says about access to a publisher; null is a request that failed."""
    s = _column(status)
    return F.when(s.isNull(), "request_error").when(s.between(200, 399), "accessible").when(s.isin(*BLOCKED), "blocked").when(s.isin(404, 410), "unavailable").otherwise("http_error")
