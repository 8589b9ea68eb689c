"""Hierarchical weighted hash tree: rows descend region, rack and shard levels by weighted hash draws.

At each level every child of the node chosen before draws an exponential variable -ln(u)/weight for a row, u being a hash
of (key, the child's name) and weight the sum of the weights below the child; the smallest draw wins. Levels draw
independently. A changed weight changes draws only on the path from the root to it, so rows move only into or out of the
subtrees on that path: into or out of that region, within the region only to or from that rack, within the rack only to or
from that shard. Nodes are named by their numbers on the path, so a tree that grows keeps the names that it has; a shard
that is added as a region of its own takes rows only into itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import row_bucket, running_offset, unused

#: A tree is a list of regions, a region a list of racks, a rack a list of (shard number, weight).
Tree = list[list[list[tuple[int, float]]]]
#: Hex digits of a hash that make one draw (52 bits), and draws that one SHA-256 holds.
DIGITS, PER_DIGEST = 13, 4


def regular_tree(shards: int, per_rack: int = 4, racks_per_region: int = 4, weight: float = 1.0) -> Tree:
    """Shards 0.. dealt in order into racks and regions."""
    racks = [[(s, weight) for s in range(i, min(i + per_rack, shards))] for i in range(0, shards, per_rack)]
    return [racks[i : i + racks_per_region] for i in range(0, len(racks), racks_per_region)]


def grown(tree: Tree, weight: float = 1.0) -> Tree:
    """The tree with one more shard, numbered on, in a region of its own."""
    return [*tree, [[(1 + max((s for region in tree for rack in region for s, _ in rack), default=-1), weight)]]]


def _draw(key: Column, parent: Column, child: int, weight: Column) -> Column:
    """The draw of a parent's child with this number; PER_DIGEST neighbours share one digest. No weight: never the smallest."""
    digest = F.sha2(F.concat(key, F.lit(":"), parent, F.lit(f":{child // PER_DIGEST}")), 256)
    u = F.conv(F.substring(digest, 1 + DIGITS * (child % PER_DIGEST), DIGITS), 16, 10).cast("long")
    return F.when(weight > 0, -F.log((u + F.lit(0.5)) / F.lit(float(16**DIGITS))) / weight)


def _choice(df: DataFrame, key: Column, parent: Column, at: Column, weights: list[list[float]], out: str) -> DataFrame:
    """Add `out`: the child that is chosen, `at` being the parent's place in weights (a list of child weights a parent)."""
    most = max(len(w) for w in weights)
    table = F.array(*[F.array(*[F.lit(float(x)) for x in [*w, *[0.0] * (most - len(w))]]) for w in weights])
    own = F.element_at(table, at + 1)
    draws = [F.struct(_draw(key, parent, c, F.element_at(own, c + 1)).alias("d"), F.lit(c).alias("c")) for c in range(most)]
    least = F.array_min(F.filter(F.array(*draws), lambda s: s["d"].isNotNull()))
    return df.withColumn(out, least["c"])


def place(df: DataFrame, key: str, trees: dict[str, Tree]) -> DataFrame:
    """Add one int column per named tree: the shard of the row. Rows with equal keys go together; a null key counts as ''."""
    text = F.coalesce(F.col(key).cast("string"), F.lit(""))
    for name, tree in trees.items():
        region, rack, shard = unused(df, "_region", "_rack", "_shard")
        sizes = [[sum(w for _, w in r) for r in reg] for reg in tree]
        first_rack = [sum(len(r) for r in tree[:i]) for i in range(len(tree))]
        racks = [r for reg in tree for r in reg]
        first_shard = [sum(len(r) for r in racks[:i]) for i in range(len(racks))]
        numbers = F.array(*[F.lit(s) for r in racks for s, _ in r])
        look = lambda values, at: F.element_at(F.array(*[F.lit(v) for v in values]), at + 1)
        df = _choice(df, text, F.lit("root"), F.lit(0), [[sum(s) for s in sizes]], region)
        df = _choice(df, text, F.col(region).cast("string"), F.col(region), sizes, rack)
        path = F.concat_ws(".", F.col(region).cast("string"), F.col(rack).cast("string"))
        at = look(first_rack, F.col(region)) + F.col(rack)
        df = _choice(df, text, path, at, [[w for _, w in r] for r in racks], shard)
        df = df.withColumn(name, F.element_at(numbers, look(first_shard, at) + F.col(shard) + 1)).drop(region, rack, shard)
    return df


def shard_documents(docs: DataFrame, shards: int = 40, buckets: int = 256) -> DataFrame:
    """Place documents (doc_id, text) by the law `key` into `shards` shards of a regular tree, and number the rows of each.

    Returns doc_id, size (UTF-8 bytes + 16; a null text has none), text_crc32 (null counts as empty), law, shard, slot
    (gapless from 0 within a shard, in the order (bucket, doc_id)), grown_shard (the shard if there were one more, in a
    region of its own). Null doc_ids count as one key. Repeated rows get slots of their own. An empty table gives an empty
    result; other columns are ignored.
    """
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit(1).cast("long").alias("_one"),
    )
    tree = regular_tree(shards)
    placed = place(rows, "doc_id", {"shard": tree, "grown_shard": grown(tree)})
    placed = placed.withColumn("_bucket", row_bucket(buckets, F.col("doc_id"), F.col("size"), F.col("text_crc32")))
    numbered = running_offset(placed, "shard", "_bucket", ["doc_id", "size", "text_crc32"], "_one", "slot")
    return numbered.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")
