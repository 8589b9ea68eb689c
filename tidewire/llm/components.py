"""Connected components of an edge table, by alternating large-star and small-star steps (Kiveris et al., 2014).

Only (node, neighbour) rows move; a node's neighbours are never gathered. Minima are pre-aggregated before they are
shuffled, and written down before they are joined, so that both sides of a join are plain exchanges, which adaptive
execution can split where a component's centre is hot.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import cut


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of each batch -> stars: every node with the smallest node that it reaches within the batch."""
    for b in batches:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = x = parent[parent[x]]
            return x

        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            x, y = root(x), root(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
        stars = [(x, root(x)) for x in list(parent)]
        stars = [s for s in stars if s[0] != s[1]]
        yield pa.RecordBatch.from_arrays([pa.array([s[i] for s in stars], pa.int64()) for i in (0, 1)], ["u", "v"])


def _are_stars(e: DataFrame) -> bool:
    """Whether every u has one edge and no v is a u: then v is the smallest node of each component."""
    ends = e.select(F.col("u").alias("x"), F.lit(1).alias("c"), F.lit(0).alias("r")).unionByName(e.select(F.col("v").alias("x"), F.lit(0).alias("c"), F.lit(1).alias("r")))
    return ends.groupBy("x").agg(F.sum("c").alias("c"), F.max("r").alias("r")).where("c > 1 or c = 1 and r = 1").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """edges (a long, b long), any direction, repeats and loops allowed -> node, component (smallest node reached).

    Nodes without an edge are not returned. Null ends are ignored. No edges: an empty result.
    """
    a, b = edges.columns
    clean = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    e = cut(clean.select(F.col(a).alias("a"), F.col(b).alias("b")).mapInArrow(_forest, "u long, v long").distinct(), "cc-start")
    while not _are_stars(e):
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(both.groupBy("u").agg(F.min("v").alias("_m")).select(F.col("u").alias("_u"), F.least("u", "_m").alias("_m")), "cc-least")
        large = both.where("v > u").join(least, F.col("u") == F.col("_u")).select(F.col("v").alias("u"), F.col("_m").alias("v"))
        large = cut(large.where("u != v").distinct(), "cc-large")
        least = cut(large.groupBy("u").agg(F.min("v").alias("_m")).select(F.col("u").alias("_u"), "_m"), "cc-least")
        small = large.join(least, F.col("u") == F.col("_u")).where("v != _m").select(F.col("v").alias("u"), F.col("_m").alias("v"))
        e = cut(small.unionByName(least.select(F.col("_u").alias("u"), F.col("_m").alias("v"))).distinct(), "cc-small")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
