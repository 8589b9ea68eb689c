"""Signals -> articles: one article per canonical URL, links from signals, errors for bad URLs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions import url
from tidewire.lineage import numbered
from tidewire.schemas import DATASETS

SIGNAL_ORDER = {name: i for i, name in enumerate(DATASETS)}


def signals(events: DataFrame, mentions: DataFrame, gkg: DataFrame) -> DataFrame:
    """signal_type, source_id, source_timestamp, raw_url, article_id of all three tables."""
    tables = dict(zip(DATASETS, (events, mentions, gkg)))
    parts = [t.select(F.lit(n).alias("signal_type"), F.col("id").alias("source_id"), "source_timestamp", F.col(DATASETS[n][0]).alias("raw_url"), "article_id") for n, t in tables.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def unlinked(found: DataFrame, errors: DataFrame) -> DataFrame:
    """Signals that are neither linked nor in error: what an extraction has to do."""
    return found.where("article_id IS NULL").join(errors.select("signal_type", "source_id"), ["signal_type", "source_id"], "left_anti")


def extract(todo: DataFrame, articles: DataFrame, now: Column) -> dict[str, DataFrame]:
    """articles: the whole new table; links: signal_type, source_id, article_id; errors: new rows for bad URLs.

    first_seen_at is the earliest signal of the URL, old or new. New ids follow the order in which signals would be taken
    one by one (dataset, source id), so reruns agree.
    """
    raw = F.col("raw_url")
    rows = todo.withColumn("canonical_url", url.canonical_url(raw)).withColumn("error_code", url.url_error(raw)).withColumn("domain", url.domain(raw))
    bad = rows.where("error_code IS NOT NULL")
    errors = bad.select("signal_type", "source_id", "source_timestamp", "raw_url", "error_code", F.concat(F.lit("bad URL: "), F.coalesce(F.substring(raw, 1, 200), F.lit("null"))).alias("error_message"), now.alias("created_at"))
    good = rows.where("error_code IS NULL").withColumn("url_hash", url.url_hash(F.col("canonical_url")))
    rank = F.struct(F.create_map(*[F.lit(x) for kv in SIGNAL_ORDER.items() for x in kv])[F.col("signal_type")].alias("t"), F.col("source_id").alias("i"))
    seen = good.groupBy("url_hash").agg(F.first("canonical_url").alias("canonical_url"), F.first("domain").alias("domain"), F.min("source_timestamp").alias("seen"), F.min(rank).alias("rank"))
    start = articles.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_start"))
    known = articles.select("url_hash", *[F.col(c).alias(f"_{c}") for c in ("id", "canonical_url", "domain", "first_seen_at", "created_at", "updated_at")])
    merged = seen.join(known, "url_hash", "full_outer")
    fresh = numbered(merged.where("_id IS NULL").withColumns({"_t": F.col("rank.t"), "_i": F.col("rank.i")}), [F.col("_t"), F.col("_i")], "_new").drop("_t", "_i")
    fresh = fresh.crossJoin(F.broadcast(start)).withColumn("id", F.col("_start") + F.col("_new")).drop("_start", "_new")
    out = merged.where("_id IS NOT NULL").withColumn("id", F.col("_id")).unionByName(fresh)
    table = out.select(
        F.col("id").cast("long").alias("id"), F.coalesce("_canonical_url", "canonical_url").alias("canonical_url"), "url_hash", F.coalesce("_domain", "domain").alias("domain"),
        F.least("_first_seen_at", "seen").alias("first_seen_at"), F.coalesce("_created_at", now).alias("created_at"), F.when(F.col("seen").isNotNull(), now).otherwise(F.col("_updated_at")).alias("updated_at"),
    )
    links = good.select("signal_type", "source_id", "url_hash").join(table.select("url_hash", F.col("id").alias("article_id")), "url_hash").drop("url_hash")
    return {"articles": table, "links": links, "errors": errors}


def linked(domain: DataFrame, links: DataFrame, dataset: str) -> DataFrame:
    """A typed table with the new article ids filled in; ids that are there stay."""
    own = links.where(F.col("signal_type") == dataset).select(F.col("source_id").alias("id"), F.col("article_id").alias("_article"))
    return domain.join(own, "id", "left").withColumn("article_id", F.coalesce("article_id", "_article")).drop("_article").select(*domain.columns)
