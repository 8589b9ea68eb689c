"""Labelled pairs as CSV, corpora and predictions as JSON, with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAIRS = "pair_id STRING, label STRING, left_article_id BIGINT, right_article_id BIGINT, category STRING, languages STRING, rationale STRING"
ARTICLE = "ref: STRING, urlHash: STRING, canonicalUrl: STRING, domain: STRING, title: STRING, titleInputHash: STRING, firstSeenAt: STRING, publishedAt: STRING"
PAIR = "id: STRING, left: STRING, right: STRING, label: STRING, split: STRING, category: STRING, hardNegative: BOOLEAN, rationale: STRING, verification: STRUCT<method: STRING, checkedAt: STRING, evidence: ARRAY<STRING>>"
CORPUS = f"schemaVersion STRING, corpusVersion STRING, provenance MAP<STRING, STRING>, articles ARRAY<STRUCT<{ARTICLE}>>, pairs ARRAY<STRUCT<{PAIR}>>, referenceStories ARRAY<STRUCT<id: STRING, split: STRING, articleRefs: ARRAY<STRING>, rationale: STRING>>"
PREDICTIONS = "pairs ARRAY<STRUCT<pairId: STRING, sameStory: BOOLEAN, candidate: BOOLEAN, score: DOUBLE>>"


def read_labelled_pairs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=PAIRS)


def labelled_with_articles(pairs: DataFrame, articles: DataFrame) -> DataFrame:
    """Pairs with both articles; `missing` names the side that no article has."""
    left, right = articles.select(F.col("id").alias("left_article_id"), F.struct("*").alias("left")), articles.select(F.col("id").alias("right_article_id"), F.struct("*").alias("right"))
    out = pairs.join(left, "left_article_id", "left").join(right, "right_article_id", "left")
    return out.withColumn("missing", F.when(F.col("left").isNull(), "left").when(F.col("right").isNull(), "right"))


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, schema=CORPUS, multiLine=True)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, schema=PREDICTIONS, multiLine=True).select(F.explode("pairs").alias("p")).select("p.*")


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
