"""Durable cuts of lineage, and order over whole tables without a task that holds them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir of the session.

    Where it is unset, a local master gets a folder of our own; on a cluster that would lose files, so it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tidewire-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: lineage ends here, and lost executors cost nothing."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def running(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """Add, for each name, the sum of its measure over all rows up to this one in the order, which must be total.

    Rows are dealt to ranges of the order and written down, each range is summed, and the sums of the ranges before are
    added to the running sums within: what meets in one task is a row for each range.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = df.withColumns({f"_o{i}": c for i, c in enumerate(order)}).withColumns({f"_m_{n}": c for n, c in sums.items()})
    keys = [F.col(f"_o{i}") for i in range(len(order))]
    dealt = cut(keyed.repartitionByRange(parts, *keys).withColumn("_part", F.spark_partition_id()), "running")
    totals = dealt.groupBy("_part").agg(*[F.sum(f"_m_{n}").alias(f"_t_{n}") for n in sums])
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    base = totals.select(F.col("_part").alias("_p"), *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_t_{n}") for n in sums])
    inside = Window.partitionBy("_part").orderBy(*keys).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = dealt.join(F.broadcast(base), F.col("_part") == F.col("_p"))
    out = joined.withColumns({n: F.col(f"_t_{n}") + F.sum(f"_m_{n}").over(inside) for n in sums})
    return out.select(*df.columns, *sums)


def numbered(df: DataFrame, order: list[Column], out: str) -> DataFrame:
    """Add the row's number in the order over the whole table, from 1."""
    return running(df, order, {out: F.lit(1).cast("long")})


def tree_hash(df: DataFrame, order: list[Column], text: Column, width: int = 1024) -> DataFrame:
    """One row (hash, rows): SHA-256 over the texts in order, by blocks: `width` texts make a hash, `width` hashes the next, up to one.

    No text at all gives the hash of nothing.
    """
    level = numbered(df.select(text.alias("_text"), *[c.alias(f"_k{i}") for i, c in enumerate(order)]), [F.col(f"_k{i}") for i in range(len(order))], "_n").select("_n", "_text")
    rows = None
    while True:
        blocks = level.groupBy(F.floor((F.col("_n") - 1) / width).alias("_b")).agg(F.array_sort(F.collect_list(F.struct("_n", "_text"))).alias("_all"))  # width rows a group
        blocks = blocks.select((F.col("_b") + 1).alias("_n"), F.sha2(F.array_join(F.transform("_all", lambda x: x["_text"]), ""), 256).alias("_text"), F.size("_all").cast("long").alias("_rows"))
        level = cut(blocks, "hashes")
        found = level.agg(F.count(F.lit(1)), F.sum("_rows")).first()
        rows = found[1] if rows is None else rows
        if found[0] <= 1:
            break
    one = level.agg(F.coalesce(F.max("_text"), F.sha2(F.lit(""), 256)).alias("hash"))
    return one.withColumn("rows", F.lit(rows or 0).cast("long"))
