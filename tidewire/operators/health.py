"""Health of the pipeline, of extraction and of embeddings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions.hashing import MAX_ATTEMPTS
from tidewire.schemas import DATASETS


def _one(df: DataFrame, name: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias(name))


def zero_filled(counts: DataFrame, key: str, value: str, names: tuple[str, ...]) -> DataFrame:
    """A row for each name, in that order, 0 where counts has none."""
    spine = counts.sparkSession.createDataFrame([(n, i) for i, n in enumerate(names)], f"{key} STRING, _order INT")
    return F.broadcast(spine).join(counts, key, "left").select(key, "_order", F.coalesce(value, F.lit(0)).alias(value)).orderBy("_order").drop("_order")


def pipeline_health(payloads: dict[str, DataFrame], domain: dict[str, DataFrame], errors: DataFrame) -> DataFrame:
    """Per dataset: payload rows, rows without a typed row, open errors, typed rows."""
    parts = []
    for name, rows in payloads.items():
        waiting = _one(rows.join(domain[name].select("id"), "id", "left_anti"), "pending_rows")
        open_errors = _one(errors.where((F.col("dataset_type") == name) & F.col("resolved_at").isNull()), "open_errors")
        parts.append(_one(rows, "payload_rows").crossJoin(waiting).crossJoin(open_errors).crossJoin(_one(domain[name], "domain_rows")).select(F.lit(name).alias("dataset"), "*"))  # one row each
    return reduce(DataFrame.unionByName, parts)


def signals_per_type(signals: DataFrame) -> DataFrame:
    return signals.groupBy("signal_type").agg(F.count(F.lit(1)).alias("signals"))


def latest_processed(signals: DataFrame, extraction_errors: DataFrame, processing_errors: DataFrame) -> DataFrame:
    """Latest source time by type over linked signals, extraction errors and all processing errors, closed ones too."""
    rows = signals.where("article_id IS NOT NULL").select("signal_type", "source_timestamp")
    rows = rows.unionByName(extraction_errors.select("signal_type", "source_timestamp")).unionByName(processing_errors.select(F.col("dataset_type").alias("signal_type"), "source_timestamp"))
    return rows.groupBy("signal_type").agg(F.max("source_timestamp").alias("latest_processed_at"))


def open_errors(extraction_errors: DataFrame, processing_errors: DataFrame) -> DataFrame:
    rows = extraction_errors.select("signal_type", "error_code").unionByName(processing_errors.where("resolved_at IS NULL").select(F.col("dataset_type").alias("signal_type"), "error_code"))
    return rows.groupBy("signal_type", "error_code").agg(F.count(F.lit(1)).alias("errors")).orderBy("signal_type", "error_code")


def pending_signals(signals: DataFrame, extraction_errors: DataFrame) -> DataFrame:
    """Signals neither linked nor in error, per type; every type has a row."""
    todo = signals.where("article_id IS NULL").join(extraction_errors.select("signal_type", "source_id"), ["signal_type", "source_id"], "left_anti")
    return zero_filled(todo.groupBy("signal_type").agg(F.count(F.lit(1)).alias("pending")), "signal_type", "pending", tuple(DATASETS))


def embedding_health(inputs: DataFrame, calls_enabled: bool = True) -> DataFrame:
    """One row: counts by status, those out of attempts, and the state UP, DEGRADED or MODEL_CALLS_DISABLED."""
    of = lambda s: F.count_if(F.col("embedding_status") == s)
    out = inputs.agg(of("READY").alias("ready"), of("PENDING").alias("pending"), of("RETRYABLE_FAILURE").alias("retryable"), of("TERMINAL_FAILURE").alias("terminal"), F.count_if((F.col("embedding_status") == "RETRYABLE_FAILURE") & (F.col("attempt_count") >= MAX_ATTEMPTS)).alias("exhausted"))
    state = F.lit("MODEL_CALLS_DISABLED") if not calls_enabled else F.when((F.col("terminal") > 0) | (F.col("exhausted") > 0), "DEGRADED").otherwise("UP")
    return out.withColumn("state", state)


def grouped_counts(rows: DataFrame, *keys: str, measure: Column | None = None, having: Column | None = None) -> DataFrame:
    """Counts (and a sum) by keys; `having` filters groups by their columns."""
    out = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), *([F.sum(measure).alias("total")] if measure is not None else []))
    return out if having is None else out.where(having)


def observed(df: DataFrame, name: str, **metrics: Column):
    """df with an Observation that counts as it runs: (df, observation)."""
    from pyspark.sql import Observation

    o = Observation(name)
    return df.observe(o, *[m.alias(k) for k, m in metrics.items()]), o
