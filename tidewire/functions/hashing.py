"""Canonical texts and their hashes, stable references, retry times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Minutes to wait after the first, second, ... failed attempt; after the last there is no retry.
BACKOFF_MINUTES = (1, 5, 15, 60, 360)
MAX_ATTEMPTS = 5


def sha256(c: Column) -> Column:
    return F.sha2(c, 256)


def instant_text(ts: Column) -> Column:
    """ISO-8601 in UTC; a fraction has 3 or 6 digits and is written only if it isn't zero."""
    micros = F.pmod(F.unix_micros(ts), F.lit(1_000_000))
    fraction = F.when(micros == 0, "").when(micros % 1000 == 0, F.concat(F.lit("."), F.lpad((micros / 1000).cast("int").cast("string"), 3, "0"))).otherwise(F.concat(F.lit("."), F.lpad(micros.cast("string"), 6, "0")))
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), fraction, F.lit("Z"))


def framed(name: str, c: Column) -> Column:
    """name=<UTF-8 length>:<value> and a line end; null counts as empty."""
    v = F.coalesce(c.cast("string"), F.lit(""))
    return F.concat(F.lit(f"{name}="), F.octet_length(v).cast("string"), F.lit(":"), v, F.lit("\n"))


def framed_hash(**fields: Column) -> Column:
    return sha256(F.concat(*[framed(k, v) for k, v in fields.items()]))


def lines_hash(*values: Column) -> Column:
    """Hash of values on a line each, null as an empty line."""
    return sha256(F.concat_ws("\n", *[F.coalesce(v.cast("string"), F.lit("")) for v in values]))


def article_ref(url_hash: Column) -> Column:
    return F.concat(F.lit("article-"), F.substring(url_hash, 1, 16))


def pair_ref(left: Column, right: Column, prefix: str = "pair-") -> Column:
    """The same for either order."""
    return F.concat(F.lit(prefix), F.substring(sha256(F.concat(F.least(left, right), F.lit("|"), F.greatest(left, right))), 1, 16))


def next_retry_at(attempt: Column, completed_at: Column, retry_after_seconds: Column | None = None) -> Column:
    """completed_at plus the provider's own wait, or else the wait of this attempt; null from MAX_ATTEMPTS on."""
    own = F.get(F.array(*[F.lit(60 * m) for m in BACKOFF_MINUTES]), (attempt - 1).cast("int"))
    wait = own if retry_after_seconds is None else F.coalesce(retry_after_seconds, own)
    at = F.timestamp_micros(F.unix_micros(completed_at) + wait.cast("long") * 1_000_000)
    return F.when(attempt < MAX_ATTEMPTS, at)
