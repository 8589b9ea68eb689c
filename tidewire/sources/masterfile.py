"""File lists: one line a file, complete 15-minute windows, and which of them to import next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions.text import control_trim
from tidewire.functions.tsv import lenient_timestamp
from tidewire.schemas import DATASETS

_SUFFIX = "|".join(suffix.replace(".", r"\.") for _, _, suffix in DATASETS.values())


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """A landed copy of the list as text lines, numbered in the order of the file."""
    return spark.read.text(path).withColumn("line", F.monotonically_increasing_id())


def files(lines: DataFrame) -> DataFrame:
    """lines (value, line) -> source_timestamp, dataset_type, url, line. The last word of a line is the URL; other lines are dropped."""
    url = F.element_at(F.split(control_trim(F.col("value")), r"\s+"), -1)
    stamp, suffix = (F.regexp_extract(url, rf"^(?:.*/)?([0-9]{{14}})\.({_SUFFIX})$", i) for i in (1, 2))
    kind = F.create_map(*[F.lit(x) for name, (_, _, s) in DATASETS.items() for x in (s, name)])
    found = lines.select(url.alias("url"), stamp.alias("_stamp"), suffix.alias("_suffix"), "line").where("_stamp != ''")
    return found.select(lenient_timestamp(F.col("_stamp")).alias("source_timestamp"), kind[F.col("_suffix")].alias("dataset_type"), "url", "line").where("source_timestamp IS NOT NULL")


def complete_windows(found: DataFrame, datasets: tuple[str, ...] = tuple(DATASETS)) -> DataFrame:
    """Windows for which every dataset has a file: source_timestamp and a map of dataset to URL (that of the last line, if there are several)."""
    each = found.where(F.col("dataset_type").isin(*datasets)).groupBy("source_timestamp", "dataset_type").agg(F.max_by("url", "line").alias("url"))
    windows = each.groupBy("source_timestamp").agg(F.count(F.lit(1)).alias("_n"), F.map_from_entries(F.collect_list(F.struct("dataset_type", "url"))).alias("files"))
    return windows.where(F.col("_n") == len(datasets)).drop("_n")


def latest(windows: DataFrame, limit: int) -> DataFrame:
    """The last `limit` windows (all, if the limit isn't positive), in ascending order."""
    if limit > 0:
        windows = windows.orderBy(F.col("source_timestamp").desc()).limit(limit)
    return windows.orderBy("source_timestamp")


def failed_windows(import_files: DataFrame, limit: int = 20) -> DataFrame:
    return import_files.where("status = 'FAILED'").select("source_timestamp").distinct().orderBy("source_timestamp").limit(limit)


def windows_to_import(windows: DataFrame, import_files: DataFrame, newest: int = 4, retries: int = 20) -> DataFrame:
    """Failed windows first, then the newest ones, each once."""
    first = failed_windows(import_files, retries).withColumn("priority", F.lit(0))
    rest = latest(windows, newest).select("source_timestamp").withColumn("priority", F.lit(1))
    return first.unionByName(rest).groupBy("source_timestamp").agg(F.min("priority").alias("priority")).orderBy("priority", "source_timestamp")
