"""Versioned title inputs of articles, embedding artifacts and their attempts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions import hashing, text

PARTS = ["article_ref", "effective_at", "effective_at_source", "normalized_title", "title_input_hash", "title_usability"]
#: An artifact is the vector of one title hash by one model.
ARTIFACT_KEY = ["title_normalization_version", "title_input_hash", "embedding_model_id", "embedding_model_version", "embedding_dimension"]


@dataclass(frozen=True)
class ClusteringVersion:
    id: int
    version_key: str
    window_hours: int
    threshold: float = 0.70
    model_id: str = "hashing"
    model_version: str = "1"
    dimension: int = 64
    title_version: str = "title-v1"
    generic_version: str = "generic-v1"
    search_mode: str = "EXACT"
    status: str = "SHADOW"

    def validate(self) -> None:
        if self.search_mode != "EXACT" or self.window_hours not in (24, 48, 72) or abs(self.threshold - 0.70) > 1e-9:
            raise ValueError(f"{self.version_key}: exact search, a window of 24, 48 or 72 hours and a threshold of 0.70 are needed")


# The three versions that are compared.
VERSIONS = tuple(ClusteringVersion(i, f"shadow-{h}h", h) for i, h in enumerate((24, 48, 72), 1))


def versions_table(spark: SparkSession, versions: tuple[ClusteringVersion, ...] = VERSIONS) -> DataFrame:
    rows = [(v.id, v.version_key, v.window_hours, v.threshold, v.model_id, v.model_version, v.dimension, v.title_version, v.generic_version, v.status) for v in versions]
    return spark.createDataFrame(rows, "clustering_version_id BIGINT, version_key STRING, window_hours INT, threshold DOUBLE, embedding_model_id STRING, embedding_model_version STRING, embedding_dimension INT, title_normalization_version STRING, generic_title_rule_version STRING, status STRING")


def article_titles(articles: DataFrame, projected: DataFrame) -> DataFrame:
    """Per article: reference, effective time (published, else first seen) with its source, normalised title, usability, hash."""
    j = articles.join(projected.select(F.col("article_id").alias("id"), "title", "published_at"), "id", "left")
    j = j.withColumn("normalized_title", text.title_input(F.col("title")))
    usable = text.title_usability(F.col("normalized_title"))
    return j.select(
        F.col("id").alias("article_id"), hashing.article_ref(F.col("url_hash")).alias("article_ref"), F.coalesce("published_at", "first_seen_at").alias("effective_at"),
        F.when(F.col("published_at").isNotNull(), "PUBLISHED_AT").otherwise("FIRST_SEEN_AT").alias("effective_at_source"), "normalized_title", usable.alias("title_usability"),
        F.when(usable == "USABLE", hashing.sha256(F.col("normalized_title"))).alias("title_input_hash"),
    )


def fingerprint() -> Column:
    """Hash of everything that an input depends on, a value a line."""
    own = ["version_key", "title_normalization_version", "generic_title_rule_version", "embedding_model_id", "embedding_model_version", "embedding_dimension"]
    return hashing.lines_hash(*[F.col(c) for c in own], F.col("article_ref"), hashing.instant_text(F.col("effective_at")), *[F.col(c) for c in PARTS[2:]])


def candidate_inputs(titles: DataFrame, versions: DataFrame, current: DataFrame) -> DataFrame:
    """Every article under every shadow version (a handful of rows, broadcast), with its fingerprint; changed: not the current one."""
    wanted = titles.crossJoin(F.broadcast(versions.where("status = 'SHADOW'"))).withColumn("article_input_fingerprint", fingerprint())
    now = current.where("current_marker = 1").select("clustering_version_id", "article_ref", F.col("article_input_fingerprint").alias("_current"))
    return wanted.join(now, ["clustering_version_id", "article_ref"], "left").withColumn("changed", ~F.col("_current").eqNullSafe(F.col("article_input_fingerprint"))).drop("_current")


def stale_inputs(articles: DataFrame, gkg: DataFrame, versions: DataFrame, current: DataFrame, now: Column, repair: bool = False, limit: int | None = None) -> DataFrame:
    """article_id, article_ref, clustering_version_id, why: the inputs that a run has to look at again, in that order.

    Every article under every shadow version: without a current input (NEW), changed since (CHANGED: the article, or the
    latest of its records, else its creation, is younger than the input), or with an embedding that may be tried (RETRY).
    """
    latest = gkg.where("article_id IS NOT NULL").groupBy("article_id").agg(F.max("created_at").alias("_latest"))
    a = articles.select(F.col("id").alias("article_id"), hashing.article_ref(F.col("url_hash")).alias("article_ref"), F.col("created_at").alias("_made"), F.col("updated_at").alias("_updated")).join(latest, "article_id", "left")
    a = a.crossJoin(F.broadcast(versions.where("status = 'SHADOW'").select("clustering_version_id")))
    own = current.where("current_marker = 1").select("clustering_version_id", "article_ref", F.col("created_at").alias("_input"), F.col("embedding_status").alias("status"), "attempt_count", "next_retry_at")
    j = a.join(own, ["clustering_version_id", "article_ref"], "left")
    why = F.when(F.col("_input").isNull(), "NEW").when((F.col("_updated") > F.col("_input")) | (F.coalesce("_latest", "_made") > F.col("_input")), "CHANGED").when(retry_due(now, repair), "RETRY")
    out = j.select("article_id", "article_ref", "clustering_version_id", why.alias("why")).where("why IS NOT NULL")
    return out.orderBy("article_id", "clustering_version_id").limit(limit) if limit else out


def missing_artifacts(candidates: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Artifact keys that usable inputs need and nobody has: each once, so equal titles cost one model call."""
    return candidates.where("title_usability = 'USABLE'").groupBy(*ARTIFACT_KEY).agg(F.min("normalized_title").alias("normalized_title")).join(artifacts.select(*ARTIFACT_KEY), ARTIFACT_KEY, "left_anti")


def retry_due(now: Column, repair: bool) -> Column:
    """Which artifacts a run may call the model for: pending ones, and failed ones whose time has come (a repair: also those without a time)."""
    due = F.col("next_retry_at") <= now
    due = due | F.col("next_retry_at").isNull() if repair else F.coalesce(due, F.lit(False))
    return (F.col("status") == "PENDING") | ((F.col("status") == "RETRYABLE_FAILURE") & due & (F.col("attempt_count") < hashing.MAX_ATTEMPTS))


def after_attempt(artifacts: DataFrame, outcomes: DataFrame, completed_at: Column) -> DataFrame:
    """artifacts with outcomes (key, bytes, hash, norm, error, retryable, retry_after) taken in. A READY artifact never changes."""
    j = artifacts.join(outcomes, ARTIFACT_KEY, "left")
    tried = (F.col("status") != "READY") & (F.col("bytes").isNotNull() | F.col("error").isNotNull())
    good, attempt = tried & F.col("error").isNull(), F.col("attempt_count") + F.when(tried, 1).otherwise(0)
    again = tried & F.col("error").isNotNull() & F.col("retryable") & (attempt < hashing.MAX_ATTEMPTS)
    status = F.when(good, "READY").when(again, "RETRYABLE_FAILURE").when(tried, "TERMINAL_FAILURE").otherwise(F.col("status"))
    retry = hashing.next_retry_at(attempt, completed_at, F.col("retry_after"))
    return j.select(
        *ARTIFACT_KEY, status.alias("status"), F.when(good, F.col("bytes")).otherwise(F.col("vector_bytes")).alias("vector_bytes"), F.when(good, F.col("hash")).otherwise(F.col("vector_hash")).alias("vector_hash"),
        F.when(good, F.col("norm").cast("decimal(20,10)")).otherwise(F.col("vector_norm")).alias("vector_norm"), attempt.cast("int").alias("attempt_count"),
        F.when(again, retry).when(~tried, F.col("next_retry_at")).alias("next_retry_at"), F.when(good, completed_at).otherwise(F.col("ready_at")).alias("ready_at"),
    )


def synchronised(history: DataFrame, wanted: DataFrame, now: Column) -> DataFrame:
    """Slowly changing history: the wanted fingerprint of each (version, article) becomes the current row.

    The same fingerprint stays (a former one is current again), another current row is superseded, a new one is added.
    """
    key = ["clustering_version_id", "article_ref", "article_input_fingerprint"]
    now_wanted = wanted.select(*key).withColumn("_wanted", F.lit(True))
    touched = wanted.select(*key[:2]).distinct().withColumn("_touched", F.lit(True))
    old = history.join(now_wanted, key, "left").join(touched, key[:2], "left")
    want = F.coalesce("_wanted", F.lit(False))
    close = F.col("_touched").isNotNull() & ~want & (F.col("current_marker") == 1)
    old = old.withColumn("superseded_at", F.when(close, now).when(~want, F.col("superseded_at"))).withColumn("current_marker", F.when(want, F.lit(1).cast("smallint")).when(~close, F.col("current_marker")))
    added = wanted.join(history.select(*key), key, "left_anti").withColumn("current_marker", F.lit(1).cast("smallint")).withColumn("created_at", now).withColumn("superseded_at", F.lit(None).cast("timestamp"))
    return old.select(*history.columns).unionByName(added.select(*[c for c in history.columns if c in added.columns]), allowMissingColumns=True)


def latest_rows(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first whole row of each key by order."""
    from pyspark.sql.window import Window

    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")
