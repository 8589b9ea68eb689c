"""Exact deduplication with counting quotient filters.

Every partition of the fingerprints builds counting quotient filters: a fingerprint is split into a quotient, which is its
place, and a remainder, which is stored. A filter holds a bit for each quotient that has a run, a bit for each remainder
that ends a run, a bit for each remainder that has a counter, the remainders packed to their bits, and the counters in as
many bytes as they need. Filters merge without loss: their sorted remainders are merged run by run and counters added,
into a filter with more quotients and shorter remainders. Fingerprints with a count above one go to byte verification,
where the normalised texts themselves are the grouping key; all others are unique without a look at their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import SPACE, cut, join_checked, unused

#: Bits of a fingerprint; texts that share one by chance are told apart by their bytes.
FINGERPRINT_BITS = 46


def normalised(text: Column) -> Column:
    """Each run of ASCII white space becomes one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"[{SPACE}]+", " ")


def _pack(values: np.ndarray, width: int) -> bytes:
    """The lowest `width` bits of each value, one after another."""
    shifts = np.arange(width - 1, -1, -1, dtype=np.uint64)
    return np.packbits(((values[:, None] >> shifts) & np.uint64(1)).astype(np.uint8)).tobytes()


def _unpack(data: bytes, width: int, n: int) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(data, np.uint8), count=n * width).reshape(n, width)
    return bits.astype(np.uint64) @ (np.uint64(1) << np.arange(width - 1, -1, -1, dtype=np.uint64)) if width else np.zeros(n, np.uint64)


class CountingQuotientFilter:
    """A multiset of fingerprints of `bits` bits: distinct ones ascending, with counts.

    Packed, a fingerprint's leading bits are its quotient, of which there are about as many as fingerprints, and the rest
    is its remainder. Runs follow each other in the order of their quotients, and remainders ascend within a run.
    """

    def __init__(self, fingerprints: np.ndarray, counts: np.ndarray, bits: int):
        self.fingerprints, self.counts, self.bits = fingerprints, counts, bits

    @classmethod
    def build(cls, fingerprints: np.ndarray, bits: int) -> CountingQuotientFilter:
        distinct, counts = np.unique(fingerprints, return_counts=True)
        return cls(distinct, counts.astype(np.int64), bits)

    def merged(self, other: CountingQuotientFilter) -> CountingQuotientFilter:
        """Each side's sorted remainders are placed between the other's; equal ones become one, with their counters added."""
        n, m = len(self.fingerprints), len(other.fingerprints)
        f, c = np.empty(n + m, np.uint64), np.empty(n + m, np.int64)
        for x, y, side in ((self, other, "left"), (other, self, "right")):
            at = np.arange(len(x.fingerprints)) + np.searchsorted(y.fingerprints, x.fingerprints, side)
            f[at], c[at] = x.fingerprints, x.counts
        if not n + m:
            return self
        first = np.flatnonzero(np.concatenate(([True], f[1:] != f[:-1])))
        return CountingQuotientFilter(f[first], np.add.reduceat(c, first), self.bits)

    @classmethod
    def merge(cls, filters: list[CountingQuotientFilter]) -> CountingQuotientFilter:
        """All filters, two and two, so that each remainder is placed a logarithmic number of times."""
        while len(filters) > 1:
            filters = [a.merged(b) for a, b in zip(filters[::2], filters[1::2])] + ([filters[-1]] if len(filters) % 2 else [])
        return filters[0]

    def pack(self) -> bytes:
        n = len(self.fingerprints)
        q = max(0, int(n).bit_length() - 1)
        quotients = (self.fingerprints >> np.uint64(self.bits - q)).astype(np.int64)
        occupied, last = np.zeros(1 << q, bool), np.ones(n, bool)
        occupied[quotients] = True
        last[:-1] = quotients[1:] != quotients[:-1]
        many = self.counts > 1
        counters, rest = bytearray(), self.counts[many]
        for c in rest.tolist():
            while c > 127:
                counters.append(c & 127 | 128)
                c >>= 7
            counters.append(c)
        parts = [np.packbits(x).tobytes() for x in (occupied, last, many)]
        remainders = _pack(self.fingerprints & np.uint64((1 << (self.bits - q)) - 1), self.bits - q)
        return np.array([n, self.bits], np.uint32).tobytes() + b"".join(parts) + remainders + bytes(counters)

    @classmethod
    def unpack(cls, data: bytes) -> CountingQuotientFilter:
        n, bits = (int(x) for x in np.frombuffer(data, np.uint32, 2))
        q, at, parts = max(0, n.bit_length() - 1), 8, []
        for size in (1 << q, n, n):
            parts.append(np.unpackbits(np.frombuffer(data, np.uint8, -(-size // 8), at), count=size).astype(bool))
            at += -(-size // 8)
        occupied, last, many = parts
        run = np.concatenate(([0], np.cumsum(last)[:-1])) if n else np.zeros(0, int)
        size = -(-n * (bits - q) // 8)
        remainders = _unpack(data[at : at + size], bits - q, n)
        tail = np.frombuffer(data, np.uint8, -1, at + size) if at + size < len(data) else np.zeros(0, np.uint8)
        counts = np.ones(n, np.int64)
        if len(tail):
            ends = np.flatnonzero(tail < 128)
            starts = np.concatenate(([0], ends[:-1] + 1))
            place = np.arange(len(tail)) - np.repeat(starts, ends - starts + 1)
            counts[many] = np.add.reduceat((tail & 127).astype(np.int64) << (7 * place), starts)
        quotients = np.flatnonzero(occupied)[run].astype(np.uint64)
        return cls((quotients << np.uint64(bits - q)) | remainders, counts, bits)


def _build_filters(prefix_bits: int, buffer_rows: int):
    bits = FINGERPRINT_BITS - prefix_bits

    def filters(fp: np.ndarray) -> pa.RecordBatch:
        prefix = fp >> np.uint64(bits)
        order = np.argsort(prefix, kind="stable")
        ids, starts = np.unique(prefix[order], return_index=True)
        own = fp[order] & np.uint64((1 << bits) - 1)
        packed = [CountingQuotientFilter.build(part, bits).pack() for part in np.split(own, starts[1:])]
        return pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int32)), pa.array(packed, pa.binary())], ["prefix", "filter"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            held.append(np.asarray(b.column(0).to_numpy(zero_copy_only=False)).astype(np.uint64))
            n += len(held[-1])
            if n >= buffer_rows:
                yield filters(np.concatenate(held))
                held, n = [], 0
        if n:
            yield filters(np.concatenate(held))

    return run


def _merge_filters(prefix_bits: int):
    bits = FINGERPRINT_BITS - prefix_bits

    def run(t: pa.Table) -> pa.Table:
        merged = CountingQuotientFilter.merge([CountingQuotientFilter.unpack(x) for x in t.column("filter").to_pylist()])
        many = merged.counts > 1
        found = (np.uint64(t.column("prefix")[0].as_py()) << np.uint64(bits)) | merged.fingerprints[many]
        return pa.table({"_cand": pa.array(found.astype(np.int64)), "_seen": pa.array(merged.counts[many])})

    return run


def repeated_fingerprints(df: DataFrame, fingerprint: str, prefix_bits: int = 12, buffer_rows: int = 1 << 20) -> DataFrame:
    """The fingerprints (long, FINGERPRINT_BITS bits) that occur more than once: _cand, _seen.

    A partition sends, for each prefix, one filter in which its own copies are already counted, so a fingerprint that a
    third of the rows share costs one entry a partition. prefix_bits sets how many merge groups there are.
    """
    built = df.select(fingerprint).mapInArrow(_build_filters(prefix_bits, buffer_rows), "prefix int, filter binary")
    return built.groupBy("prefix").applyInArrow(_merge_filters(prefix_bits), "_cand long, _seen long")


def print_of(text: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(text), 64 - FINGERPRINT_BITS)


def exact_duplicates(docs: DataFrame, prefix_bits: int = 12) -> DataFrame:
    """documents (doc_id, text) -> doc_id, keep_id, group_size, kept, text_sha256; a row per row of documents.

    Texts are equal when identical after white space is normalised; null counts as empty. Of equal texts the smallest
    doc_id stays (a null doc_id is never the smallest unless all are null). Rows that repeat a doc_id with an equal text
    are all counted, and all marked kept if their doc_id stays. Empty tables give empty results; other columns are ignored.
    """
    norm = normalised(F.col("text"))
    texts = docs.select("doc_id", norm.alias("_norm"))
    prints = cut(texts.select("doc_id", print_of(F.col("_norm")).alias("_fp"), F.unhex(F.sha2("_norm", 256)).alias("_sha")), "dedup-prints")
    cand = cut(repeated_fingerprints(prints, "_fp", prefix_bits), "dedup-repeated")
    again = texts.select("doc_id", "_norm", print_of(F.col("_norm")).alias("_fp"))
    same = join_checked(again, cand.select("_cand"), F.col("_fp") == F.col("_cand"), "left_semi")
    groups = same.groupBy("_fp", "_norm").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    groups = cut(groups.where("group_size > 1").select(F.col("_fp").alias("_gfp"), F.unhex(F.sha2("_norm", 256)).alias("_gsha"), "keep_id", "group_size"), "dedup-groups")
    out = join_checked(prints, groups, (F.col("_fp") == F.col("_gfp")) & (F.col("_sha") == F.col("_gsha")), "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return out.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        F.lower(F.hex("_sha")).alias("text_sha256"),
    )


def without_copies(docs: DataFrame) -> DataFrame:
    """The documents that stay, with their own columns. Of rows that repeat a doc_id with an equal text one stays.

    Null texts count as empty, a null doc_id stays only where all rows of its text have none, and an empty table gives an
    empty result.
    """
    rows = cut(exact_duplicates(docs), "dedup-rows")
    key = ["doc_id", "text_sha256"]
    of, own, norm = unused(docs, "of", "of_sha", "norm")
    named = [F.col("doc_id").alias(of), F.col("text_sha256").alias(own)]
    dropped = cut(rows.where("not kept").select(*named).distinct(), "dedup-dropped")
    sha = F.sha2(normalised(docs["text"]), 256)
    same = docs["doc_id"].eqNullSafe(F.col(of)) & (sha == F.col(own))
    left = join_checked(docs, dropped, same, "left_anti")
    again = cut(rows.where("kept").groupBy(*key).count().where("count > 1").select(*named), "dedup-again")
    if again.isEmpty():
        return left
    once = join_checked(left, again, same, "left_semi").withColumn(norm, normalised(docs["text"])).dropDuplicates(["doc_id", norm]).drop(norm)
    return join_checked(left, again, same, "left_anti").unionByName(once)
