"""Payload rows -> typed rows, errors and their resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions import text, tsv
from tidewire.schemas import DATASETS, TONE_FIELDS


def pending(payloads: DataFrame, import_files: DataFrame, domain: DataFrame, errors: DataFrame, dataset: str, now: Column, retry_seconds: int = 60) -> DataFrame:
    """Payloads of completed files without a typed row, save those whose open error is younger than the back-off."""
    done = import_files.where((F.col("status") == "COMPLETED") & (F.col("dataset_type") == dataset)).select(F.col("id").alias("import_file_id"))
    recent = errors.where((F.col("dataset_type") == dataset) & F.col("resolved_at").isNull() & (F.unix_micros("occurred_at") > F.unix_micros(now) - retry_seconds * 1_000_000))
    rows = payloads.join(done, "import_file_id", "left_semi").join(domain.select("id"), "id", "left_anti")
    return rows.join(recent.select(F.col("source_row_id").alias("id")), "id", "left_anti")


def _finish(rows: DataFrame, dataset: str) -> DataFrame:
    """What a dataset derives from its raw fields."""
    if dataset != "GKG":
        return rows
    extras = text.tag_titles(F.col("extras_raw"))
    plain = ~F.exists(extras, lambda t: t.contains("&"))
    joined = F.array_join(F.transform(extras, lambda t: F.regexp_replace(t, "\x1e", " ")), "\x1e")
    rows = rows.withColumn("_titles", F.when(plain, joined).otherwise(text.html_unescape(joined)))
    tones, places = text.tone(F.col("tone_raw")), text.locations(F.col("locations_raw"))
    image = text.image_url(F.col("sharing_image_raw"))
    return (
        rows.withColumn("page_title", text.first_title(F.split("_titles", "\x1e", -1)))
        .withColumn("page_precise_pub_timestamp", text.publication_time(F.col("extras_raw"), F.col("document_date")))
        .withColumn("sharing_image_url", image)
        .withColumn("main_image_url", image)
        .withColumn("main_image_source", F.when(image.isNotNull(), "GKG_SHARING_IMAGE"))
        .withColumns({c: text.name_list(F.col(f"{c}_raw")) for c in ("themes", "persons", "organizations")})
        .withColumn("_places", places)
        .withColumn("locations", F.col("_places.items"))
        .withColumn("discarded_locations", F.col("_places.discarded"))
        .withColumn("_tone", tones)
        .withColumns({c: F.col(f"_tone.{c}") for c in TONE_FIELDS})
        .drop("_titles", "_places", "_tone", *[c for c in rows.columns if c.endswith("_raw")])
    )


def stage(payloads: DataFrame, dataset: str, now: Column) -> tuple[DataFrame, DataFrame]:
    """(typed rows, error rows): each payload becomes one or the other; an error row has the code of its first bad field."""
    _, least, _ = DATASETS[dataset]
    provenance = ["id", "import_file_id", "source_file", "source_timestamp", "row_number", "ingested_at"]
    rows = payloads.select(*provenance, tsv.cells(F.col("raw_tsv")).alias("_cells"))
    rows = rows.withColumns({f"_t_{n}": c for n, c in tsv.typed(F.col("_cells"), dataset).items()})
    rows = rows.withColumn("_error", tsv.row_error(F.col("_cells"), dataset, least, "_t_"))
    fields = [F.col(f"_t_{f.name}.value").alias(f.name) for f in tsv.FIELDS[dataset]]
    good = rows.where("_error IS NULL").select(*provenance, now.alias("parsed_at"), *fields, F.lit(None).cast("long").alias("article_id"))
    bad = rows.where("_error IS NOT NULL").select(
        F.lit(dataset).alias("dataset_type"), F.col("id").alias("source_row_id"), "import_file_id", "source_file", "source_timestamp", "row_number",
        F.lit("PARSE").alias("failed_step"), F.col("_error.code").alias("error_code"), F.col("_error.message").alias("error_message"), now.alias("occurred_at"), F.lit(None).cast("timestamp").alias("resolved_at"),
    )
    return _finish(good, dataset), bad


def resolved(errors: DataFrame, good: DataFrame, dataset: str, now: Column) -> DataFrame:
    """Error history with all open errors of rows that are good now closed."""
    done = good.select(F.col("id").alias("_done"))
    own = (errors["dataset_type"] == dataset) & (errors["source_row_id"] == F.col("_done")) & errors["resolved_at"].isNull()
    return errors.join(done, own, "left").withColumn("resolved_at", F.coalesce("resolved_at", F.when(F.col("_done").isNotNull(), now))).drop("_done")


def column_histogram(payloads: DataFrame) -> DataFrame:
    """Rows by number of columns, and how many hold a title tag."""
    return payloads.groupBy(F.size(F.split("raw_tsv", "\t", -1)).alias("columns")).agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.size(text.tag_titles(F.col("raw_tsv"))) > 0).alias("with_title")).orderBy("columns")
