"""Signal summary and detail views of articles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.schemas import DATASETS


def linked_signals(events: DataFrame, mentions: DataFrame, gkg: DataFrame) -> DataFrame:
    parts = [t.where("article_id IS NOT NULL").select("article_id", F.lit(n).alias("signal_type"), F.col("id").alias("source_id"), "source_timestamp", F.col(DATASETS[n][0]).alias("raw_url")) for n, t in zip(DATASETS, (events, mentions, gkg))]
    return reduce(DataFrame.unionByName, parts)


def signal_summary(articles: DataFrame, signals: DataFrame, types: tuple[str, ...] = tuple(DATASETS)) -> DataFrame:
    """A row per article: counts (0 without signals), first and last time (null without). Signals are summed before they are joined."""
    counts = [F.count_if(F.col("signal_type") == t).alias(f"{t.lower()}_count") for t in types]
    sums = signals.groupBy("article_id").agg(F.count("source_id").alias("signal_count"), *counts, F.min("source_timestamp").alias("first_signal_at"), F.max("source_timestamp").alias("last_signal_at"))
    names = ["signal_count", *[f"{t.lower()}_count" for t in types]]
    return articles.join(sums.withColumnRenamed("article_id", "id"), "id", "left").withColumns({n: F.coalesce(n, F.lit(0)).cast("long") for n in names})


def summary_aggregates(articles: DataFrame, signals: DataFrame, gkg: DataFrame, themes: int = 5) -> DataFrame:
    """What a list of articles shows without a query per article: types, times, most frequent themes, mean tone."""
    base = signals.groupBy("article_id").agg(F.count(F.lit(1)).alias("signal_count"), F.array_sort(F.collect_set("signal_type")).alias("signal_types"), F.min("source_timestamp").alias("first_signal_at"), F.max("source_timestamp").alias("latest_signal_at"))
    own = gkg.where("article_id IS NOT NULL")
    counted = own.select("article_id", F.explode("themes").alias("theme")).groupBy("article_id", "theme").agg(F.count(F.lit(1)).alias("n"))
    top = counted.groupBy("article_id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "theme"))), 1, themes)["theme"].alias("top_themes"))
    tones = own.groupBy("article_id").agg(F.avg("tone_value").alias("average_tone"))
    out = articles.withColumnRenamed("id", "article_id").join(base, "article_id", "left").join(top, "article_id", "left").join(tones, "article_id", "left")
    return out.withColumn("signal_count", F.coalesce("signal_count", F.lit(0)))


def article_detail(articles: DataFrame, signals: DataFrame) -> DataFrame:
    """A row per signal, and one without a signal for articles that have none."""
    return articles.join(signals.withColumnRenamed("article_id", "id"), "id", "left")
