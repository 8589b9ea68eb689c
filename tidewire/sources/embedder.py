"""Embedding providers as functions over Arrow batches; the one here needs no network and hashes words into dimensions."""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator
from datetime import datetime, timezone
from email.utils import parsedate_to_datetime
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Statuses after which a request may be sent again.
RETRYABLE_STATUSES = frozenset({408, 409, 429, *range(500, 600)})


class Embedder(Protocol):
    def embed(self, texts: list[str], dimension: int) -> list[list[float]]: ...


class EmbeddingFailed(RuntimeError):
    """What a provider answered: a code, whether the request may be sent again, and after how many seconds."""

    def __init__(self, code: str, message: str, retryable: bool, retry_after: int | None = None):
        super().__init__(message)
        self.code, self.retryable, self.retry_after = code, retryable, retry_after


def request_body(model: str, texts: list[str], dimension: int) -> str:
    return json.dumps({"model": model, "input": texts, "encoding_format": "float", "dimensions": dimension})


def retry_after_seconds(value: str | None, now: datetime) -> int | None:
    """Seconds of a retry-after header, a number or a date; never negative; None if it is neither."""
    try:
        return max(0, int(value))
    except (TypeError, ValueError):
        pass
    try:
        return max(0, int((parsedate_to_datetime(value) - now).total_seconds()))
    except (TypeError, ValueError):
        return None


def parse_response(status: int, headers: dict[str, str], body: str, wanted: int, now: datetime) -> list[list[float]]:
    """The vectors of an answer in the order of the request; everything else raises EmbeddingFailed."""
    if status // 100 != 2:
        code, message = f"HTTP_{status}", f"the provider answered {status}"
        try:
            error = json.loads(body).get("error", {})
            code, message = str(error.get("code") or code), str(error.get("message") or message)
        except (ValueError, AttributeError):
            pass
        wait = {k.lower(): v for k, v in headers.items()}.get("retry-after") if status == 429 else None
        raise EmbeddingFailed(code, message, status in RETRYABLE_STATUSES, retry_after_seconds(wait, now))
    data = sorted(json.loads(body).get("data", []), key=lambda item: item.get("index", -1))
    if len(data) != wanted:
        raise EmbeddingFailed("INCOMPLETE_BATCH", f"{len(data)} of {wanted} vectors came back", True)
    return [item["embedding"] for item in data]


class TransportEmbedder:
    """A provider behind any transport: send(body) -> (status, headers, body), which may raise TimeoutError or OSError."""

    def __init__(self, send: Callable[[str], tuple[int, dict[str, str], str]], model: str, clock: Callable[[], datetime] = lambda: datetime.now(timezone.utc)):
        self.send, self.model, self.clock = send, model, clock

    def embed(self, texts: list[str], dimension: int) -> list[list[float]]:
        try:
            status, headers, body = self.send(request_body(self.model, texts, dimension))
        except TimeoutError as e:
            raise EmbeddingFailed("TIMEOUT", "the request timed out", True) from e
        except OSError as e:
            raise EmbeddingFailed("IO_ERROR", "the request failed", True) from e
        return parse_response(status, headers, body, len(texts), self.clock())


class HashingEmbedder:
    """Deterministic: words and their neighbours are hashed into signed dimensions."""

    def embed(self, texts: list[str], dimension: int) -> list[list[float]]:
        out = np.zeros((len(texts), dimension), np.float32)
        for i, text in enumerate(texts):
            words = text.lower().split()
            for w in [*words, *(" ".join(p) for p in zip(words, words[1:]))]:
                h = zlib.crc32(w.encode())
                out[i, (h >> 1) % dimension] += 1.0 if h & 1 else -1.0
        return out.tolist()


def embed_texts(df: DataFrame, key: str, text: str, dimension: int, embedder: Embedder | None = None, batch: int = 256) -> DataFrame:
    """key, vector, error, retryable, retry_after: a batch that fails has no vectors and says why; its failure is its own."""
    model = embedder or HashingEmbedder()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, batch):
                part = b.slice(a, batch)
                n = part.num_rows
                try:
                    found = model.embed(part.column(1).to_pylist(), dimension)
                    if len(found) != n:
                        raise EmbeddingFailed("INCOMPLETE_BATCH", f"{len(found)} of {n} vectors came back", True)
                    outcome = [None, None, None]
                except EmbeddingFailed as e:
                    found, outcome = [None] * n, [e.code, e.retryable, e.retry_after]
                except Exception as e:  # a provider may fail in any way; the row says how
                    found, outcome = [None] * n, [type(e).__name__, False, None]
                said = [pa.array([x] * n, t) for x, t in zip(outcome, (pa.string(), pa.bool_(), pa.int32()))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.list_(pa.float32())), *said], ["key", "vector", "error", "retryable", "retry_after"])

    return df.select(df[key].cast("string").alias("key"), df[text].alias("text")).mapInArrow(run, "key string, vector array<float>, error string, retryable boolean, retry_after int")


class CacheMismatch(RuntimeError):
    """A vector cache was made from other inputs, or by another model."""


def cached_vectors(spark: SparkSession, path: str, texts: DataFrame, model: str, dimension: int, embedder: Embedder | None = None) -> DataFrame:
    """key, input_hash, vector of texts (key, text), from the cache at path, or embedded and written there.

    A cache holds its model, dimension and the hash of every input. One that was made by another model, or whose keys and
    hashes are not those of the texts, raises.
    """
    wanted = texts.select(F.col("key").cast("string").alias("key"), "text", F.sha2("text", 256).alias("input_hash"))
    try:
        cache = spark.read.parquet(path)
    except AnalysisException:
        cache = None
    if cache is None:
        made = embed_texts(wanted, "key", "text", dimension, embedder).join(wanted.select("key", "input_hash"), "key")
        made.select(F.lit(model).alias("model"), F.lit(dimension).alias("dimension"), "key", "input_hash", "vector", "error").write.parquet(path)
        cache = spark.read.parquet(path)
    other = cache.where((F.col("model") != model) | (F.col("dimension") != dimension))
    differ = cache.join(wanted, ["key", "input_hash"], "left_anti")
    missing = wanted.join(cache, ["key", "input_hash"], "left_anti")
    if not other.isEmpty() or not differ.isEmpty() or not missing.isEmpty():
        raise CacheMismatch(path)
    return cache.select("key", "input_hash", "vector", "error")
