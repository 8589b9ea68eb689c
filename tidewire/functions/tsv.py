"""Typed fields of tab-separated rows, with an error struct instead of an exception."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewire.functions.text import control_trim, is_blank


@dataclass(frozen=True)
class Field:
    """kind: text, long, int, double, date or timestamp; a required field must not be blank; optional: the row may be shorter."""

    name: str
    column: int
    kind: str = "text"
    required: bool = False


# Positions of the fields in the three datasets, in the order in which they are read.
EVENT_FIELDS = (
    Field("global_event_id", 0, "long", True), Field("event_date", 1, "date"), Field("actor1_code", 5), Field("actor1_name", 6), Field("actor1_country_code", 7),
    Field("actor2_code", 15), Field("actor2_name", 16), Field("actor2_country_code", 17), Field("event_code", 26), Field("quad_class", 29, "int"),
    Field("goldstein_scale", 30, "double"), Field("avg_tone", 34, "double"), Field("source_url", 60),
)
MENTION_FIELDS = (
    Field("global_event_id", 0, "long", True), Field("event_time_date", 1, "timestamp"), Field("mention_time_date", 2, "timestamp"), Field("mention_type", 3, "int"),
    Field("mention_source_name", 4), Field("mention_identifier", 5), Field("confidence", 11, "int"), Field("mention_doc_tone", 13, "double"),
)
GKG_FIELDS = (
    Field("document_date", 1, "timestamp"), Field("gkg_record_id", 0, "text", True), Field("source_collection_identifier", 2, "int"), Field("source_common_name", 3),
    Field("document_identifier", 4), Field("themes_raw", 7), Field("locations_raw", 9), Field("persons_raw", 11), Field("organizations_raw", 13), Field("tone_raw", 15),
    Field("sharing_image_raw", 18), Field("extras_raw", 26),
)
FIELDS = {"EVENTS": EVENT_FIELDS, "MENTIONS": MENTION_FIELDS, "GKG": GKG_FIELDS}
CODES = {"long": "INVALID_NUMBER", "int": "INVALID_NUMBER", "double": "INVALID_NUMBER", "date": "INVALID_DATE", "timestamp": "INVALID_TIMESTAMP"}


def lenient_timestamp(raw: Column) -> Column:
    """yyyyMMddHHmmss; a day that the month hasn't, up to 31, becomes the month's last."""
    first = F.try_to_timestamp(F.concat(F.substring(raw, 1, 6), F.lit("01"), F.substring(raw, 9, 6)), F.lit("yyyyMMddHHmmss"))
    day = F.substring(raw, 7, 2).try_cast("int")
    last = F.dayofmonth(F.last_day(first))
    good = raw.rlike("^[0-9]{14}$") & day.between(1, 31)
    return F.when(good, F.timestamp_micros(F.unix_micros(first) + (F.least(day, last) - 1).cast("long") * 86_400_000_000))


def _double(c: Column) -> Column:
    """Decimal and hexadecimal floating-point literals, with or without a type letter, NaN and Infinity."""
    plain = F.regexp_replace(c, r"(?<=[0-9.])[dDfF]$", "")
    hexed = r"^([+-]?)0[xX]([0-9a-fA-F]*)(?:\.([0-9a-fA-F]*))?[pP]([+-]?[0-9]+)[dDfF]?$"
    sign, whole, part, power = (F.regexp_extract(c, hexed, i) for i in (1, 2, 3, 4))
    digits = F.concat(whole, part)
    # up to 13 hexadecimal digits are exact in a double; what comes after them is below its precision
    size = F.conv(F.substring(F.concat(digits, F.repeat(F.lit("0"), 13)), 1, 13), 16, 10).cast("double") * F.pow(F.lit(16.0), F.length(whole) - 13)
    found = F.when(sign == "-", -size).otherwise(size) * F.pow(F.lit(2.0), power.try_cast("int"))
    return F.when(c.rlike(hexed), F.when(F.length(digits) > 0, found)).otherwise(plain.try_cast("double"))


def value(raw: Column, kind: str) -> Column:
    """The typed value, or null if it isn't one."""
    if kind in ("long", "int"):
        return F.when(raw.rlike(r"^[+-]?[0-9]+$"), raw.try_cast("bigint" if kind == "long" else "int"))
    if kind == "double":
        return _double(control_trim(raw))
    if kind == "date":  # an offset after the day changes nothing
        good = raw.rlike("^[0-9]{8}(Z|[+-](0[0-9]|1[0-7])([0-5][0-9]){1,2}|[+-]1800(00)?)?$")
        return F.when(good, F.to_date(F.try_to_timestamp(F.substring(raw, 1, 8), F.lit("yyyyMMdd"))))
    return lenient_timestamp(raw) if kind == "timestamp" else raw


def cells(raw_tsv: Column) -> Column:
    return F.split(raw_tsv, "\t", -1)


def typed(row: Column, dataset: str) -> dict[str, Column]:
    """Of a column of cells: name -> struct(raw, value) of each field; a blank cell is null."""
    out = {}
    for f in FIELDS[dataset]:
        cell = F.get(row, F.lit(f.column))
        cell = F.when(~is_blank(cell), cell)
        out[f.name] = F.struct(cell.alias("raw"), value(cell, f.kind).alias("value"))
    return out


def row_error(row: Column, dataset: str, least_columns: int, prefix: str) -> Column:
    """error struct<code, message>, or null, from columns prefix + name of typed(): the first field in reading order that fails decides."""
    error = F.when(F.size(row) < least_columns, _error("COLUMN_COUNT", F.concat(F.lit(f"{dataset} row has "), F.size(row).cast("string"), F.lit(f" columns, {least_columns} are needed"))))
    for f in FIELDS[dataset]:
        raw, v = F.col(f"{prefix}{f.name}.raw"), F.col(f"{prefix}{f.name}.value")
        if f.required:
            error = error.when(raw.isNull(), _error("REQUIRED_FIELD", F.lit(f"{f.name} is required")))
        if f.kind != "text":
            error = error.when(raw.isNotNull() & v.isNull(), _error(CODES[f.kind], F.concat(F.lit(f"{f.name} is invalid: "), raw)))
    return error


def _error(code: str, message: Column) -> Column:
    return F.struct(F.lit(code).alias("code"), F.substring(message, 1, 4000).alias("message"))
