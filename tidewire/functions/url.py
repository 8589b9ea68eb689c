"""Canonical URLs in built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewire.functions.text import control_trim

# Query parameters that only track, by name or prefix, and the ports that go without saying.
TRACKING = r"(?i)^(utm_.*|fbclid|gclid)$"
DEFAULT_PORTS = {"http": "80", "https": "443"}


def _part(url: Column, part: str) -> Column:
    return F.try_parse_url(url, F.lit(part))


def url_error(raw: Column) -> Column:
    """EMPTY_URL, INVALID_URL, UNSUPPORTED_SCHEME, MISSING_HOST, or null for a good URL; the first that applies."""
    url = control_trim(raw)
    scheme = F.lower(_part(url, "PROTOCOL"))
    return (
        F.when(raw.isNull() | (url == ""), "EMPTY_URL")
        .when(scheme.isNull() & _part(url, "PATH").isNull(), "INVALID_URL")
        .when(scheme.isNull() | ~scheme.isin("http", "https"), "UNSUPPORTED_SCHEME")
        .when(_part(url, "HOST").isNull(), "MISSING_HOST")
    )


def domain(raw: Column) -> Column:
    return F.lower(_part(control_trim(raw), "HOST"))


def _ascii(c: Column) -> Column:
    """Characters beyond ASCII are percent-encoded as UTF-8."""
    encoded = F.array_join(F.transform(F.split(c, ""), lambda x: F.when(x.rlike(r"[^\x00-\x7F]"), F.url_encode(x)).otherwise(x)), "")
    return F.when(c.rlike(r"[^\x00-\x7F]"), encoded).otherwise(c)


def canonical_url(raw: Column) -> Column:
    """Null for a URL with an error. Lower-case scheme and host, no user, fragment or default port, no slashes at the end of
    the path (but the root's), query parameters sorted without those that only track."""
    url = control_trim(raw)
    scheme, host = F.lower(_part(url, "PROTOCOL")), domain(raw)
    port = F.regexp_extract(F.coalesce(_part(url, "AUTHORITY"), F.lit("")), r":([0-9]+)$", 1)
    hide = (port == "") | F.coalesce(F.create_map(*[F.lit(x) for kv in DEFAULT_PORTS.items() for x in kv])[scheme] == port, F.lit(False))
    path = F.coalesce(_part(url, "PATH"), F.lit(""))
    path = F.when(path.rlike("^/+$"), F.lit("/")).otherwise(F.regexp_replace(path, "/+$", ""))
    asked = F.filter(F.split(F.coalesce(_part(url, "QUERY"), F.lit("")), "&", -1), lambda p: ~p.rlike(r"^\s*$") & ~F.split_part(p, F.lit("="), F.lit(1)).rlike(TRACKING))
    query = F.array_join(F.array_sort(asked), "&")
    made = F.concat(scheme, F.lit("://"), host, F.when(hide, F.lit("")).otherwise(F.concat(F.lit(":"), port)), path, F.when(query == "", F.lit("")).otherwise(F.concat(F.lit("?"), query)))
    return F.when(url_error(raw).isNull(), _ascii(made))


def url_hash(canonical: Column) -> Column:
    return F.sha2(canonical, 256)
