"""Shared helpers of the training-data operators: reading tables, checked broadcasts, batches by bytes, skew-proof running sums."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewire.lineage import cut, fresh_path

__all__ = ["BROADCAST_BYTES", "SPACE", "cut", "fresh_path", "give_back", "join_checked", "narrow_enough", "relieve", "row_bucket", "running_offset", "table", "text_slices", "unused"]

#: ASCII white space of every contract of this package, as a Java/Python character class body.
SPACE = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Most bytes of a narrow table that are sent to every executor; above, tables are joined by shuffle.
BROADCAST_BYTES = 32 << 20


def narrow_enough(df: DataFrame) -> bool:
    """Whether a narrow table that has been cut is within the bound: counted rows times a row's width (variable ones count as 32)."""
    width = sum({"long": 8, "double": 8, "integer": 4, "boolean": 1}.get(f.dataType.typeName(), 32) for f in df.schema)
    return df.count() * width <= BROADCAST_BYTES


def join_checked(df: DataFrame, narrow: DataFrame, on, how: str) -> DataFrame:
    """Join with a narrow table that has been cut: by broadcast if its size is within the bound, else by sorting both."""
    return df.join(F.broadcast(narrow) if narrow_enough(narrow) else narrow.hint("merge"), on, how)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until no column of df (of any case) has them."""
    taken, found = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        found.append(name)
        taken.add(name.lower())
    return found


def give_back() -> None:
    """Return freed memory to the system: workers are reused, and what one stage has freed should not count in the next."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def relieve(spark: SparkSession) -> None:
    """Have each executor's JVM collect its garbage and so shrink its heap, which else stays as large as any stage before made it."""
    executors = max(1, spark.sparkContext._jsc.sc().getExecutorMemoryStatus().size() - 1)  # the driver is one of these
    n = 2 * executors  # tasks go round the executors; a second call finds little to do
    spark.range(0, n, 1, n).select(F.reflect(F.lit("java.lang.System"), F.lit("gc")).alias("gc")).write.format("noop").mode("overwrite").save()


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut so that their texts are about `most` bytes at most (a longer text stands alone)."""
    for b in batches:
        size = np.asarray(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False), np.int64)
        part = np.cumsum(size) // most
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), b.num_rows] if b.num_rows else []
        for x, y in zip(cuts, cuts[1:]):
            yield b.slice(x, y - x)
    give_back()


def row_bucket(buckets: int, *cols: Column) -> Column:
    """A sub-bucket of a group, from the md5 of the columns (SQL engines agree on it); spreads a group over many tasks."""
    text = F.concat_ws(":", *[F.coalesce(c.cast("string"), F.lit("")) for c in cols])
    return (F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % buckets).cast("int")


def running_offset(df: DataFrame, group: str, bucket: str, order: list[str], measure: str, out: str) -> DataFrame:
    """Add `out`: the sum of `measure` over the rows of the same group that come before, in the order (bucket, *order).

    A group is never held by one task: each (group, bucket) is summed where it lies, bucket sums are added up over at
    most (groups x buckets) rows, and only the rows of one (group, bucket) are sorted together.
    """
    sums = df.groupBy(group, bucket).agg(F.sum(measure).alias("_bucket_sum"))
    before = Window.partitionBy(group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(F.col(group).alias("_g"), F.col(bucket).alias("_b"), F.coalesce(F.sum("_bucket_sum").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = df.join(base, (F.col(group) == F.col("_g")) & (F.col(bucket) == F.col("_b")), "left")
    return joined.withColumn(out, F.col("_base") + F.sum(measure).over(inside) - F.col(measure)).drop("_g", "_b", "_base")
