"""Retention of payloads: what may go, what stays."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def validate_period(period: timedelta) -> None:
    if period <= timedelta(0):
        raise ValueError("the retention period must be positive")


def eligible(payloads: DataFrame, domain: DataFrame, cutoff: Column, limit: int | None = None) -> DataFrame:
    """Ids of payloads whose typed row was parsed at or before the cutoff, the oldest first; limit bounds a batch."""
    rows = payloads.select("id").join(domain.select("id", "parsed_at"), "id").where(F.col("parsed_at") <= cutoff)
    return rows.orderBy("parsed_at", "id").limit(limit) if limit else rows


def remaining(payloads: DataFrame, gone: DataFrame) -> DataFrame:
    return payloads.join(gone.select("id"), "id", "left_anti")


def health(payloads: DataFrame, domain: DataFrame, cutoff: Column) -> DataFrame:
    """One row: payloads that may go, and those that stay (without a typed row, or parsed later)."""
    j = payloads.select("id").join(domain.select("id", "parsed_at"), "id", "left")
    return j.agg(F.count_if(F.col("parsed_at") <= cutoff).alias("eligible"), F.count_if(F.col("parsed_at").isNull() | (F.col("parsed_at") > cutoff)).alias("retained"))
