"""Exact cosine pairs within a time window, and the decisions drawn from them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewire.functions import hashing, vectors
from tidewire.lineage import cut, numbered

TOP_ONE = "top-one-below-threshold-v1"
#: Members of a time bucket that are compared by one task, as against as many others.
BLOCK_ROWS = 2048


def window_join(rows: DataFrame, ts: str, seconds: int, ident: str, columns: list[str], place: str | None = None) -> DataFrame:
    """All pairs of rows at most `seconds` apart, once each, with left id < right id: columns as left_* and right_*.

    Time is cut into buckets of the window's length. A row meets its own bucket and the two beside it, so the join is an
    equi-join whatever the number of rows.
    """
    width = seconds * 1_000_000
    own = rows.withColumn("_bucket", F.floor(F.unix_micros(ts) / width).cast("long"))
    keys = [place] if place else []
    left = own.select("_bucket", *keys, *[F.col(c).alias(f"left_{c}") for c in dict.fromkeys([ident, ts, *columns])])
    right = own.select(F.explode(F.array(*[F.col("_bucket") + d for d in (-1, 0, 1)])).alias("_bucket"), *keys, *[F.col(c).alias(f"right_{c}") for c in dict.fromkeys([ident, ts, *columns])])
    near = F.abs(F.unix_micros(f"left_{ts}") - F.unix_micros(f"right_{ts}")) <= width
    return left.join(right, ["_bucket", *keys]).where((F.col(f"left_{ident}") < F.col(f"right_{ident}")) & near).drop("_bucket")


def _scored(pairs: DataFrame) -> DataFrame:
    c = vectors.cosine(F.col("left_vector"), F.col("right_vector"), F.col("left_norm"), F.col("right_norm"))
    apart = vectors.seconds_apart(F.col("left_effective_at"), F.col("right_effective_at"))
    return pairs.select(F.col("left_article_ref").alias("left_ref"), F.col("right_article_ref").alias("right_ref"), c.alias("cosine"), apart.alias("seconds_apart")).withColumn("similarity", vectors.quantised(F.col("cosine")))


def _with_norm(members: DataFrame) -> DataFrame:
    return members.select("article_ref", "effective_at", "vector").withColumn("norm", vectors.norm(F.col("vector")))


def scored_pairs(members: DataFrame, hours: int) -> DataFrame:
    """members (article_ref, effective_at, vector) -> left_ref, right_ref, cosine (double), similarity (six decimals), seconds apart.

    All pairs of the window, for evaluation; decisions need only those of preselected_pairs.
    """
    return _scored(window_join(_with_norm(members), "effective_at", hours * 3600, "article_ref", ["vector", "norm"]))


def _block_scores(width: int, threshold: float):
    """Members of one pair of blocks (side 0 and side 1, or one block with itself) -> pairs that can decide anything."""

    def run(t: pa.Table) -> pa.Table:
        ref, micros, side = (t.column(c).to_numpy(zero_copy_only=False) for c in ("article_ref", "micros", "side"))
        order = np.argsort(ref, kind="stable")
        ref, micros, side = ref[order], micros[order], side[order]
        rows = t.column("vector").combine_chunks().take(pa.array(order))
        x = rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ref), -1) if len(ref) else np.zeros((0, 1))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        alone = not side.any()
        i, j = (np.arange(len(ref)),) * 2 if alone else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
        left, right = [], []
        best_at, best = np.full(len(j), -1), np.full(len(j), -2.0)
        for a in range(0, len(i), 512):
            p = i[a : a + 512]
            c = np.clip(x[p] @ x[j].T, -1, 1)
            c[(np.abs(micros[p][:, None] - micros[j][None]) > width) | (p[:, None] == j[None])] = -2.0
            if not c.size:
                continue
            near, one = np.nonzero(c >= threshold - 1e-6), c.argmax(1)
            has = np.flatnonzero(c[np.arange(len(p)), one] > -2)
            left += [p[near[0]], p[has]]
            right += [j[near[1]], j[one[has]]]
            down = c.argmax(0)
            top = c[down, np.arange(len(j))]
            better = top > best
            best_at[better], best[better] = p[down[better]], top[better]
        has = np.flatnonzero(best > -2)
        left, right = np.concatenate([*left, best_at[has]]).astype(int), np.concatenate([*right, j[has]]).astype(int)
        low, high = np.minimum(left, right), np.maximum(left, right)
        found = np.unique(np.stack([low, high]), axis=1) if len(low) else np.zeros((2, 0), int)
        return pa.table({"left_ref": pa.array(ref[found[0]], pa.string()), "right_ref": pa.array(ref[found[1]], pa.string())})

    return run


def preselected_pairs(members: DataFrame, hours: int, threshold: float, block_rows: int | None = None) -> DataFrame:
    """left_ref, right_ref of the pairs that can decide anything: at or near the threshold, or a member's best in a block.

    Time is cut into buckets of the window's length and buckets into blocks of about block_rows by a hash. Every two blocks
    of a bucket, or of neighbouring ones, are multiplied as matrices by a task of their own, which holds two blocks at most.
    """
    width = hours * 3600 * 1_000_000
    rows = members.select("article_ref", "vector", F.unix_micros("effective_at").alias("micros")).withColumn("_own", F.floor(F.col("micros") / width).cast("long"))
    counts = rows.groupBy("_own").agg(F.count(F.lit(1)).alias("_n")).select("_own", F.ceil(F.col("_n") / (block_rows or BLOCK_ROWS)).cast("int").alias("_blocks"))
    counts = cut(counts, "blocks")  # a row a bucket
    beside = counts.select((F.col("_own") - 1).alias("_own"), F.col("_blocks").alias("_next"))
    before = counts.select((F.col("_own") + 1).alias("_own"), F.col("_blocks").alias("_before"))
    rows = rows.join(F.broadcast(counts.join(beside, "_own", "left").join(before, "_own", "left")), "_own").withColumn("_block", F.pmod(F.xxhash64("article_ref"), F.col("_blocks")).cast("int"))
    places = lambda n, make: F.when(n.isNotNull(), F.transform(F.sequence(F.lit(0), n - 1), make)).otherwise(F.array())
    at = lambda first, second, x, y, side: F.struct(first.alias("bucket"), second.alias("other"), x.cast("int").alias("x"), y.cast("int").alias("y"), side.cast("int").alias("side"))
    own, block = F.col("_own"), F.col("_block")
    within = places(F.col("_blocks"), lambda k: at(own, own, F.least(block, k), F.greatest(block, k), F.when(block > k, 1).otherwise(0)))
    ahead = places(F.col("_next"), lambda k: at(own, own + 1, block, k, F.lit(0)))
    behind = places(F.col("_before"), lambda k: at(own - 1, own, k, block, F.lit(1)))
    spread = rows.select(F.explode(F.concat(within, ahead, behind)).alias("p"), "article_ref", "micros", "vector").select("p.*", "article_ref", "micros", "vector")
    found = spread.groupBy("bucket", "other", "x", "y").applyInArrow(_block_scores(width, threshold), "left_ref string, right_ref string")
    return found.distinct()


def scored_selection(members: DataFrame, selected: DataFrame) -> DataFrame:
    """The exact scores of selected pairs (left_ref, right_ref) alone."""
    own = _with_norm(members)
    side = lambda s: own.select(*[F.col(c).alias(f"{s}_{c}") for c in own.columns])
    j = selected.join(side("left"), F.col("left_ref") == F.col("left_article_ref")).join(side("right"), F.col("right_ref") == F.col("right_article_ref"))
    return _scored(j)


def pair_decisions(members: DataFrame, hours: int, threshold: float) -> DataFrame:
    """decisions() of all pairs of the window, of which only the preselected ones are scored exactly."""
    return decisions(scored_selection(members, preselected_pairs(members, hours, threshold)), threshold)


def decisions(pairs: DataFrame, threshold: float) -> DataFrame:
    """SAME_STORY pairs (similarity at or above the threshold), and for every article without one its best pair as UNCERTAIN.

    The best pair has the largest exact cosine, ties by the smaller reference on the other side. decision_rank: similarity
    down, then both references.
    """
    scored = pairs.withColumn("_same", F.col("similarity") >= F.lit(str(threshold)).cast("decimal(7,6)"))
    same = scored.where("_same")
    ends = scored.select(F.explode(F.array(F.struct(F.col("left_ref").alias("ref"), F.col("right_ref").alias("other")), F.struct(F.col("right_ref").alias("ref"), F.col("left_ref").alias("other")))).alias("e"), "left_ref", "right_ref", "cosine", "similarity", "seconds_apart", "_same")
    best = ends.groupBy("e.ref").agg(F.bool_or("_same").alias("_has"), F.min_by(F.struct("left_ref", "right_ref", "cosine", "similarity", "seconds_apart"), F.struct(-F.col("cosine"), F.col("e.other"))).alias("p"))
    unsure = best.where("NOT _has").select("p.*").dropDuplicates(["left_ref", "right_ref"])
    columns = ["left_ref", "right_ref", "cosine", "similarity", "seconds_apart"]
    out = same.select(*columns, F.lit("SAME_STORY").alias("result"), F.lit(None).cast("string").alias("reason"))
    out = out.unionByName(unsure.select(*columns, F.lit("UNCERTAIN").alias("result"), F.lit(TOP_ONE).alias("reason")))
    return out


def ranked(decided: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Add decision_rank: similarity down, then both references; over all decisions, or for each value of `by`."""
    order = [F.col("similarity").desc(), F.col("left_ref"), F.col("right_ref")]
    if by:
        return decided.withColumn("decision_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return numbered(decided, [-F.col("similarity"), *order[1:]], "decision_rank")


def window_pairs(members: DataFrame, hours: int) -> DataFrame:
    """One row: how many pairs of members lie within the window, counted without forming them."""
    from tidewire.plans.quality import temporal_neighbours

    near = temporal_neighbours(members.select("article_ref", "effective_at"), "article_ref", "effective_at", hours)
    return near.agg((F.coalesce(F.sum("neighbours"), F.lit(0)) / 2).cast("long").alias("compared"))


def search_report(members: DataFrame, hours: int, decided: DataFrame) -> DataFrame:
    """One row: members, pairs compared, articles in a SAME_STORY pair, and those without."""
    same = decided.where("result = 'SAME_STORY'").select(F.explode(F.array("left_ref", "right_ref")).alias("r")).distinct()
    counts = [x.agg(F.count(F.lit(1)).alias(n)) for x, n in ((members, "members"), (same, "changed"))]
    return counts[0].crossJoin(window_pairs(members, hours)).crossJoin(counts[1]).withColumn("skipped", F.col("members") - F.col("changed"))  # one row each


def decision_hash(snapshot_key: Column, rule: str = "pair-rule-v1") -> Column:
    return hashing.framed_hash(snapshot=snapshot_key, left=F.col("left_ref"), right=F.col("right_ref"), similarity=F.col("similarity"), seconds=F.col("seconds_apart"), rank=F.col("decision_rank"), result=F.col("result"), rule=F.lit(rule))


def both_ends(pairs: DataFrame, *columns: str) -> DataFrame:
    """Each pair twice, as (ref, other) from either end, from one scan of the pairs."""
    ends = F.array(F.struct(F.col("left_ref").alias("ref"), F.col("right_ref").alias("other")), F.struct(F.col("right_ref").alias("ref"), F.col("left_ref").alias("other")))
    return pairs.select(F.explode(ends).alias("e"), *columns).select("e.ref", "e.other", *columns)


def neighbour_ranks(pairs: DataFrame, k: int) -> DataFrame:
    """ref, other, cosine, rank of the k nearest others of each ref (ties by reference)."""
    rank = F.row_number().over(Window.partitionBy("ref").orderBy(F.col("cosine").desc(), "other"))
    return both_ends(pairs, "cosine").withColumn("rank", rank).where(F.col("rank") <= k)


def top_neighbours(members: DataFrame, hours: int, k: int) -> DataFrame:
    """Per unordered pair, the better rank that one has among the other's k nearest in the window (ties by reference)."""
    ends = neighbour_ranks(scored_pairs(members, hours), k)
    return ends.groupBy(F.least("ref", "other").alias("left_ref"), F.greatest("ref", "other").alias("right_ref")).agg(F.min("rank").alias("rank"), F.max("cosine").alias("cosine"))
