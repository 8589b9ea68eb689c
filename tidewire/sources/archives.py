"""Zipped payload files: rows of the first entry of each archive, with the checksum of the archive."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Archives under path -> source_file, checksum_sha256, content."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("source_file"), F.sha2("content", 256).alias("checksum_sha256"), "content")


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """An archive's rows come in batches; an archive that can't be read gives one row with its error and no line."""
    for b in batches:
        for name, checksum, content in zip(*(b.column(c).to_pylist() for c in ("source_file", "checksum_sha256", "content"))):
            numbers, texts, error = [], [], None
            try:
                archive = zipfile.ZipFile(io.BytesIO(content))
                if not archive.namelist():
                    raise ValueError("the archive is empty")
                with archive.open(archive.namelist()[0]) as entry:
                    for i, line in enumerate(io.TextIOWrapper(entry, "utf-8", errors="replace", newline="\n"), 1):
                        numbers.append(i)
                        texts.append(line.rstrip("\n").rstrip("\r"))
                        if len(texts) == 5000:
                            yield _batch(name, checksum, numbers, texts, [None] * len(texts))
                            numbers, texts = [], []
            except (ValueError, zipfile.BadZipFile) as e:
                error = str(e)[:4000]
            if error or texts:
                yield _batch(name, checksum, numbers + [None] * bool(error), texts + [None] * bool(error), [None] * len(texts) + [error] * bool(error))


def _batch(name, checksum, numbers, texts, errors) -> pa.RecordBatch:
    n = len(texts)
    return pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array([checksum] * n), pa.array(numbers, pa.int64()), pa.array(texts, pa.string()), pa.array(errors, pa.string())], ["source_file", "checksum_sha256", "row_number", "raw_tsv", "error"])


def payload_lines(archives: DataFrame) -> DataFrame:
    """source_file, checksum_sha256, row_number (from 1; blank lines count), raw_tsv, error."""
    return archives.mapInArrow(_lines, "source_file string, checksum_sha256 string, row_number long, raw_tsv string, error string")
