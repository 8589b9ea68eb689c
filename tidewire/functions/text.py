"""Column functions for text fields: trims as the source data needs them, lists, locations, tone, titles, dates of pages."""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.schemas import LOCATION, TONE_FIELDS

TITLE_UNITS, IMAGE_CHARS = 1000, 2048
# Titles that say nothing of their article.
GENERIC_TITLES = ("home", "news", "npr news", "untitled", "homepage")


def control_trim(c: Column) -> Column:
    """Strip characters up to U+0020 at both ends."""
    return F.regexp_replace(c, r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def is_blank(c: Column) -> Column:
    """Only white space (no-break spaces are none), or nothing."""
    return c.rlike(r"^[\t-\r\x1C-\x1F\p{Z}&&[^\u00A0\u2007\u202F]]*$")


def or_null(c: Column) -> Column:
    return F.when(~is_blank(c), c)


def name_list(raw: Column) -> Column:
    """`;`-separated names: trimmed, empty ones dropped, the first of equal ones kept, in order. Null: no names."""
    parts = F.transform(F.split(F.coalesce(raw, F.lit("")), ";", -1), control_trim)
    return F.array_distinct(F.filter(parts, lambda x: x != ""))


def finite_double(c: Column) -> Column:
    v = control_trim(c).try_cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)


def strict_int(c: Column) -> Column:
    return F.when(c.rlike(r"^[+-]?[0-9]+$"), c.try_cast("int"))


def locations(raw: Column) -> Column:
    """`;`-separated blocks of 7 `#`-separated fields -> struct(items, discarded).

    The type must be an integer; a latitude or longitude may be blank, but if it isn't a finite number the block is
    discarded, as one with another number of fields is. Blank blocks don't count.
    """
    blocks = F.filter(F.split(F.coalesce(raw, F.lit("")), ";", -1), lambda b: ~is_blank(b))

    def item(b: Column) -> Column:
        f = F.split(b, "#", -1)
        at = lambda i: F.get(f, F.lit(i))
        text = lambda i: F.nullif(control_trim(at(i)), F.lit(""))
        kind, lat, lon = strict_int(control_trim(at(0))), finite_double(at(4)), finite_double(at(5))
        ok = (F.size(f) == 7) & kind.isNotNull() & (is_blank(at(4)) | lat.isNotNull()) & (is_blank(at(5)) | lon.isNotNull())
        value = F.struct(kind.alias("type"), text(1).alias("name"), text(2).alias("countryCode"), text(3).alias("adm1Code"), lat.alias("latitude"), lon.alias("longitude"), text(6).alias("featureId"))
        return F.when(ok, value)

    kept = F.filter(F.transform(blocks, item), lambda x: x.isNotNull())
    return F.struct(kept.cast(f"array<{LOCATION}>").alias("items"), (F.size(blocks) - F.size(kept)).alias("discarded"))


def tone(raw: Column) -> Column:
    """`,`-separated numbers -> struct of seven; missing, blank, invalid and non-finite ones are null, the word count an int."""
    parts = F.split(F.coalesce(raw, F.lit("")), ",", -1)
    values = [finite_double(F.get(parts, F.lit(i))) for i in range(6)] + [strict_int(control_trim(F.get(parts, F.lit(6))))]
    return F.struct(*[v.alias(n) for v, n in zip(values, TONE_FIELDS)])


@F.pandas_udf(T.StringType())
def html_unescape(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else html.unescape(x))


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


@F.pandas_udf(T.StringType())
def casefold(s: pd.Series) -> pd.Series:
    """Full case folding ('ß' is 'ss', a final sigma a sigma), for which Spark has no function."""
    return s.map(lambda x: None if x is None else x if x.isascii() and x.islower() else x.casefold())


def cut_units(c: Column) -> Column:
    """At most TITLE_UNITS UTF-16 units; a character of two units that would be cut in half goes whole."""
    pairs = r"[\x{10000}-\x{10FFFF}]"
    units = lambda x: F.length(F.regexp_replace(x, pairs, "xx"))
    short = F.substring(c, 1, TITLE_UNITS)
    fits = F.filter(F.sequence(F.lit(1), F.length(short)), lambda i: units(F.substring(short, F.lit(1), i)) <= TITLE_UNITS)
    return F.when(units(short) <= TITLE_UNITS, short).otherwise(F.substring(short, F.lit(1), F.array_max(fits)))


def collapse(c: Column) -> Column:
    """Runs of white space and separators become one space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"[\s\p{Z}]+", " "))


def tag_titles(extras: Column, tag: str = "PAGE_TITLE") -> Column:
    """Contents of every <tag>..</tag>, in order."""
    return F.regexp_extract_all(F.coalesce(extras, F.lit("")), F.lit(rf"(?is)<{tag}>(.*?)</{tag}>"), 1)


def first_title(candidates: Column) -> Column:
    """First of (unescaped) candidates that isn't empty when stripped, cut to TITLE_UNITS UTF-16 units."""
    stripped = F.transform(candidates, lambda t: F.regexp_replace(t, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    return cut_units(F.get(F.filter(stripped, lambda t: t != ""), F.lit(0)))


def publication_time(extras: Column, document_date: Column, tag: str = "PAGE_PRECISEPUBTIMESTAMP") -> Column:
    """First valid yyyyMMddHHmmss in the tags that is no more than 15 minutes after the document date (if there is one)."""
    raw = F.regexp_extract_all(F.coalesce(extras, F.lit("")), F.lit(rf"(?is)<{tag}>\s*([0-9]{{14}})\s*</{tag}>"), 1)
    times = F.transform(raw, lambda t: F.try_to_timestamp(t, F.lit("yyyyMMddHHmmss")))
    latest = document_date + F.expr("INTERVAL 15 MINUTES")
    return F.get(F.filter(times, lambda t: t.isNotNull() & (document_date.isNull() | (t <= latest))), F.lit(0))


def image_url(raw: Column) -> Column:
    """An absolute http(s) URL with an authority, at most IMAGE_CHARS long, as it stands; else null."""
    url = F.regexp_replace(raw, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")
    scheme, host = F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))), F.try_parse_url(url, F.lit("AUTHORITY"))
    return F.when((url != "") & (F.length(url) <= IMAGE_CHARS) & scheme.isin("http", "https") & ~is_blank(F.coalesce(host, F.lit(""))), url)


def title_input(title: Column, unescape: bool = True, plain: bool = False) -> Column:
    """The title as it goes into an embedding: entities, NFKC, white space. plain: the caller knows that the first two change nothing."""
    c = title if plain else nfkc(html_unescape(title) if unescape else title)
    return F.nullif(collapse(c), F.lit(""))


def ampersand_title(title: Column) -> Column:
    """The title with &amp; resolved, ASCII white space collapsed and spaces of any width off its ends; all else stays as it stands."""
    spaced = F.regexp_replace(F.replace(title, F.lit("&amp;"), F.lit("&")), r"[\t\n\f\r ]+", " ")
    return F.nullif(F.regexp_replace(spaced, r"^\p{Zs}+|\p{Zs}+\z", ""), F.lit(""))


def title_usability(normalized: Column) -> Column:
    return F.when(normalized.isNull(), "TITLE_MISSING").when(F.lower(F.upper(normalized)).isin(*GENERIC_TITLES), "TITLE_GENERIC").otherwise("USABLE")


def word_key(c: Column) -> Column:
    """Case-folded words (after NFKC) joined by single spaces: a key under which titles count as the same."""
    return F.trim(F.regexp_replace(casefold(nfkc(c)), r"[^\p{L}\p{N}_]+", " "))


def token_set(c: Column) -> Column:
    """Distinct words of letters and digits, case-folded."""
    return F.array_distinct(F.regexp_extract_all(casefold(F.coalesce(c, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), 0))


def locations_json(c: Column) -> Column:
    """Places as a JSON array; null stays null."""
    return F.to_json(c, {"ignoreNullFields": "false"})


def locations_from_json(c: Column) -> Column:
    """Places of a JSON array, also where it was written as a JSON string of the array; anything else gives an empty array."""
    kind = f"array<{LOCATION}>"
    inner = F.when(F.startswith(F.ltrim(c), F.lit('"')), F.get_json_object(F.concat(F.lit('{"v":'), c, F.lit("}")), "$.v")).otherwise(c)
    return F.coalesce(F.from_json(inner, kind), F.array().cast(kind))


def jaccard(a: Column, b: Column) -> Column:
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(either == 0, F.lit(0.0)).otherwise(both / either)
