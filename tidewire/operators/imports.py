"""Import of payload files: a manifest row for every (dataset, file), files that are done are skipped, failures are kept."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire import schemas
from tidewire.lineage import cut
from tidewire.sources.archives import payload_lines, read_archives
from tidewire.sources.store import TableStore

KEY = ["dataset_type", "source_file"]


@dataclass(frozen=True)
class ImportResult:
    dataset: str
    source_file: str
    row_count: int
    skipped: bool


class ImportFailed(RuntimeError):
    """The file could not be read; the manifest says why."""


def _mark(spark: SparkSession, tables: TableStore, **values) -> None:
    columns = [c.split()[0] for c in schemas.IMPORT_FILES.split(", ")]
    row = spark.createDataFrame([tuple(values.get(c) for c in columns)], schemas.IMPORT_FILES)
    tables.merge("import_files", row, KEY)


def import_dataset(spark: SparkSession, tables: TableStore, dataset: str, path: str, source_timestamp: datetime, now: datetime) -> ImportResult:
    """Import one archive. A file that is COMPLETED is skipped; one that failed, or was left PROCESSING, is done again.

    Rows are a write-once part named by the file's checksum, complete before the manifest says so. Row ids follow from
    the file's number and the row number, so a repeated import gives the same rows.
    """
    name = path.rsplit("/", 1)[-1]
    manifest = tables.read("import_files")
    known = None if manifest is None else manifest.where((F.col("dataset_type") == dataset) & (F.col("source_file") == name)).first()
    if known and known["status"] == "COMPLETED":
        return ImportResult(dataset, name, known["row_count"], True)
    number = known["id"] if known else 1 + (0 if manifest is None else manifest.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0])
    base = {"id": number, "dataset_type": dataset, "source_file": name, "source_url": path, "source_timestamp": source_timestamp, "started_at": now}
    _mark(spark, tables, **base, status="PROCESSING")
    archive = read_archives(spark, path)
    lines = cut(payload_lines(archive), "payload")  # unzipped once: errors, rows and their number are read from here
    error = lines.where("error IS NOT NULL").select("error", "checksum_sha256").first()
    if error:
        _mark(spark, tables, **base, status="FAILED", checksum_sha256=error["checksum_sha256"], error_message=error["error"][:4000])
        raise ImportFailed(f"{name}: {error['error']}")
    rows = lines.select(
        (F.lit(number) * F.lit(1 << 32) + F.col("row_number")).alias("id"), F.lit(number).cast("long").alias("import_file_id"), "source_file",
        F.lit(source_timestamp).alias("source_timestamp"), "row_number", "raw_tsv", F.lit(now).alias("ingested_at"),
    )
    facts = lines.agg(F.max("checksum_sha256").alias("checksum"), F.count(F.lit(1)).alias("rows")).first()
    checksum, count = facts["checksum"] or archive.select("checksum_sha256").first()[0], facts["rows"]  # an empty file has no line to name it
    tables.write_once(f"payloads_{dataset.lower()}", f"{number}-{checksum[:16]}", rows)
    _mark(spark, tables, **base, status="COMPLETED", checksum_sha256=checksum, row_count=count, completed_at=now)
    return ImportResult(dataset, name, count, False)


def import_window(spark: SparkSession, tables: TableStore, files: dict[str, str], source_timestamp: datetime, now: datetime) -> list[ImportResult]:
    """The files of one window in the order of the datasets; the first failure ends it. The order is the contract, and the
    manifest has one writer, so files come one after another; each is read by its own job."""
    return [import_dataset(spark, tables, d, files[d], source_timestamp, now) for d in schemas.DATASETS if d in files]


def import_windows(spark: SparkSession, tables: TableStore, windows: list[tuple[datetime, dict[str, str]]], now: datetime) -> dict[datetime, str]:
    """Each window on its own: a failing one doesn't stop the next."""
    out = {}
    for at, files in windows:
        try:
            import_window(spark, tables, files, at, now)
            out[at] = "COMPLETED"
        except ImportFailed as e:
            out[at] = f"FAILED: {e}"
    return out


def payloads(spark: SparkSession, tables: TableStore, dataset: str) -> DataFrame:
    """The payload rows of a dataset that retention has not let go."""
    rows = spark.read.schema(schemas.PAYLOADS).parquet(f"{tables.root}/payloads_{dataset.lower()}/*")
    gone = tables.read(f"payloads_gone_{dataset.lower()}")
    return rows if gone is None else rows.join(gone, "id", "left_anti")
