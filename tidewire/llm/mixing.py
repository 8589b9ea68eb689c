"""Mixing sources to target weights.

The words of a source, its documents laid end to end, are cut into blocks of a fixed number of words. The mix is a row of
slots, cut into output shards. Every slot of a shard draws a source by the targets, so the source counts of a shard are a
multinomial draw, seeded by the shard. Counts of a source are numbered on from shard to shard. Free draws leave a source off
its target by about the square root of its slots, so draws beyond a source's target, which lie in its last shards, go in
order to the sources that are short. Slot k of a source maps through that source's own pseudorandom index permutation to a
block: pass k div n of the source's n blocks, index k mod n within the pass. Slots and blocks are joined by (source, block).

Permutations are swap-or-not shuffles (Hoang, Morris and Rogaway, 2012): bijections of [0, n) for any n, each round one
hash, all in built-in functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewire.llm.common import SPACE, cut, join_checked, row_bucket, running_offset, unused

#: Weights of the sources in code point order (null last), repeating.
WEIGHTS = (3.0, 1.0, 2.0)


def word_count(text: Column) -> Column:
    """Number of [^\\x20\\x09-\\x0D]+ in the text; null has none."""
    marks = F.regexp_replace(F.coalesce(text, F.lit("")), f"[^{SPACE}]+", "w")
    return F.length(F.translate(marks, " \t\n\x0b\x0c\r", "")).cast("long")


def shuffle_index(index: Column, n: Column, key: list[Column], rounds: int = 8) -> Column:
    """The image of index, in [0, n), under the swap-or-not permutation that key selects.

    A round pairs x with (turn - x) mod n and, by a coin that both share, swaps the two or not. One expression, folded
    over the rounds, keeps the plan small whatever the number of rounds.
    """

    def swap(x: Column, r: Column) -> Column:
        partner = F.pmod(F.pmod(F.xxhash64(r, F.lit("turn"), *key), n) - x, n)
        choose = lambda p: F.when(F.xxhash64(r, F.lit("coin"), F.greatest(x, p), *key).bitwiseAND(F.lit(1)) == 1, p).otherwise(x)
        return F.transform(F.array(partner), choose)[0]

    return F.aggregate(F.array(*[F.lit(r) for r in range(rounds)]), index.cast("long"), swap)


def targets(sizes: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """sizes (source, source_size), a row a source -> source, source_no, source_size, target.

    Targets share `share` of all sizes by weight; a target above `most` times its source's size stops there, and what is
    over goes to the others by weight, until none is above. In one pass: in the order of (most * size / weight), sources
    are full up to the first for which the level that remains for it and all after it is no higher than its own.
    The table has a row a source; its windows run in one task.
    """
    all_rows = Window.partitionBy()
    ranked = sizes.withColumn("source_no", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.col("source_no") - 1) % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("_w", w).withColumn("_cap", F.col("source_size") * F.lit(float(most)))
    ranked = ranked.withColumn("_total", F.sum("source_size").over(all_rows) * F.lit(float(share)))
    order = Window.orderBy(F.col("_cap") / F.col("_w"), "source_no")
    before = F.coalesce(F.sum("_cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    after = F.sum("_w").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    ranked = ranked.withColumn("_level", (F.col("_total") - before) / after)
    fits = F.col("_level") <= F.col("_cap") / F.col("_w")
    level = F.min_by(F.when(fits, F.col("_level")), F.when(fits, F.struct(F.col("_cap") / F.col("_w"), F.col("source_no")))).over(all_rows)
    ranked = ranked.withColumn("_final", level)
    target = F.least(F.col("_cap"), F.coalesce(F.col("_final") * F.col("_w"), F.col("_cap")))
    return ranked.select("source", "source_no", "source_size", target.alias("target"))


def slot_plan(sizes: DataFrame, block_words: int, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """targets() with _n, the blocks of a source, _k, the slots that it is to have (2 _n at most), and _first, its first ticket."""
    n = F.ceil(F.col("source_size") / F.lit(block_words)).cast("long")
    wanted = F.least(2 * n, F.round(F.col("target") * n / F.col("source_size")).cast("long"))
    p = targets(sizes, share, most).withColumn("_n", n).withColumn("_k", F.when(F.col("source_size") > 0, wanted).otherwise(F.lit(0).cast("long")))
    before = Window.orderBy("source_no").rowsBetween(Window.unboundedPreceding, -1)
    return p.withColumn("_first", F.coalesce(F.sum("_k").over(before), F.lit(0).cast("long")))


def _owner(df: DataFrame, value: str, spans: DataFrame, total: int) -> DataFrame:
    """Join rows with the span (first, length, ...) that holds their value; spans cover [0, total) without overlap.

    Values and spans meet in equal stretches of [0, total), so the join is an equi-join whatever the number of spans.
    """
    n = spans.count()
    stretches = min(total, 4 * n + 256)
    stretch = lambda c: F.floor(c * F.lit(stretches) / F.lit(float(total))).cast("long")
    spread = spans.withColumn("_stretch", F.explode(F.sequence(stretch(F.col("first")), stretch(F.col("first") + F.col("length") - 1))))
    rows = df.withColumn("_at", stretch(F.col(value)))
    inside = (F.col("_at") == F.col("_stretch")) & (F.col(value) >= F.col("first")) & (F.col(value) < F.col("first") + F.col("length"))
    return join_checked(rows, cut(spread, "mix-spans"), inside, "inner").drop("_stretch", "_at", "first", "length")


def shard_counts(plan: DataFrame, shard_slots: int, seed: int) -> DataFrame:
    """The draw: shard, source_no, slots, how many slots of each output shard fall to each source; plan has been cut."""
    total = plan.agg(F.sum("_k")).first()[0] or 0
    spark = plan.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // (1 << 20) + 1)
    s = spark.range(0, total, 1, tasks).select(F.floor(F.col("id") / shard_slots).cast("long").alias("shard"), (F.col("id") % shard_slots).alias("_slot"))
    s = s.withColumn("_ticket", F.pmod(F.xxhash64(F.lit(seed), F.lit("draw"), "shard", "_slot"), F.lit(max(1, total)).cast("long")))
    spans = plan.where("_k > 0").select("source_no", F.col("_first").alias("first"), F.col("_k").alias("length"))
    if not total:
        return s.select("shard", F.lit(0).alias("source_no"), F.lit(0).cast("long").alias("slots"))
    return cut(_owner(s, "_ticket", spans, total).groupBy("shard", "source_no").agg(F.count(F.lit(1)).alias("slots")), "mix-counts")


def slots(plan: DataFrame, counts: DataFrame, seed: int, run: int = 1 << 12) -> DataFrame:
    """A row per slot of the mix: shard, source_no, slot (0 to _k - 1 of its source), block.

    Draws beyond a source's _k are dealt in order to the sources that have fewer.
    """
    spark = plan.sparkSession
    named = counts.withColumn("_run", F.floor(F.col("shard") / run).cast("long"))
    numbered = running_offset(named, "source_no", "_run", ["shard"], "slots", "_from").select("shard", "source_no", "slots", "_from")
    numbered = cut(numbered.join(plan.select(F.col("source_no").alias("_no"), "_k"), F.col("source_no") == F.col("_no")).drop("_no"), "mix-numbered")
    over = F.greatest(F.lit(0).cast("long"), F.col("_from") + F.col("slots") - F.greatest("_k", "_from"))
    good = numbered.withColumn("_count", F.col("slots") - over).where("_count > 0").select("shard", "source_no", F.col("_from").alias("_slot"), "_count")

    drawn = numbered.groupBy(F.col("source_no").alias("_no")).agg(F.sum("slots").alias("_drawn"))
    ends = plan.join(drawn, F.col("source_no") == F.col("_no"), "left").select("source_no", "_k", F.coalesce("_drawn", F.lit(0).cast("long")).alias("_drawn"))
    before = Window.orderBy("source_no").rowsBetween(Window.unboundedPreceding, -1)
    earlier = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0).cast("long"))
    more, less = F.greatest(F.lit(0).cast("long"), F.col("_drawn") - F.col("_k")), F.greatest(F.lit(0).cast("long"), F.col("_k") - F.col("_drawn"))
    ends = cut(ends.withColumn("_more", more).withColumn("_less", less).withColumn("_more_before", earlier(more)).withColumn("_less_before", earlier(less)), "mix-ends")
    moved = ends.agg(F.sum("_more")).first()[0] or 0
    total = plan.agg(F.sum("_k")).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // (1 << 18) + 1)
    if moved:
        extra = numbered.where(over > 0).join(ends.select(F.col("source_no").alias("_no"), "_more_before"), F.col("source_no") == F.col("_no"))
        first = F.greatest("_k", "_from")
        rank = F.explode(F.sequence(first, F.col("_from") + F.col("slots") - 1))
        extra = extra.select("shard", "_more_before", "_k", rank.alias("_slot")).select("shard", (F.col("_more_before") + F.col("_slot") - F.col("_k")).alias("_rank"))
        spans = ends.where("_less > 0").select("source_no", F.col("_less_before").alias("first"), F.col("_less").alias("length"), F.col("_drawn"), F.col("_less_before").alias("_start"))
        dealt = _owner(extra, "_rank", spans, moved).select("shard", "source_no", (F.col("_drawn") + F.col("_rank") - F.col("_start")).alias("_slot"), F.lit(1).cast("long").alias("_count"))
        good = good.unionByName(dealt)
    s = good.repartition(tasks, "shard", "source_no").select("shard", "source_no", F.explode(F.sequence(F.col("_slot"), F.col("_slot") + F.col("_count") - 1)).alias("slot"))
    s = join_checked(s, plan.select(F.col("source_no").alias("_no"), "_n"), F.col("source_no") == F.col("_no"), "inner")
    of_pass = F.floor(F.col("slot") / F.col("_n")).cast("long")
    block = shuffle_index(F.col("slot") % F.col("_n"), F.col("_n"), [F.lit(seed), F.col("source_no"), of_pass])
    return s.select("shard", "source_no", "slot", block.alias("block"))


def mix_documents(docs: DataFrame, block_words: int = 64, shard_slots: int = 4096, seed: int = 7, buckets: int = 512) -> DataFrame:
    """documents (doc_id, text, source) -> doc_id, source, size, source_size, target, taken, first_shard, text_crc; a row per row of documents.

    size: words of the text (null: 0). taken: words that the mix takes of this document, repeats counted; at most twice
    its size. first_shard: the first output shard that holds one of its blocks (null: none). A source has
    ceil(size / block_words) blocks and the mix takes round(target / mean block) of them, none more than twice, so taken
    words differ from the target by about a block. Null sources are one source, the last. Documents without words have
    taken 0. Repeated rows count one by one. An empty table gives an empty result; other columns are ignored. The draw
    depends on (seed, doc_id, texts, sources) alone, so reruns agree.
    """
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).alias("text_crc"))
    rows = cut(rows, "mix-sizes")  # texts are read once
    plan = cut(slot_plan(rows.groupBy("source").agg(F.sum("size").alias("source_size")), block_words), "mix-plan")
    named = join_checked(rows, plan.select(F.col("source").alias("_source"), "source_no", "source_size", "target"), F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
    named = named.withColumn("_bucket", row_bucket(buckets, F.col("doc_id"), F.col("text_crc")))
    laid = running_offset(named, "source_no", "_bucket", ["doc_id", "text_crc"], "size", "_from")
    last = F.floor((F.col("_from") + F.col("size") - 1) / block_words).cast("long")
    first = F.floor(F.col("_from") / block_words).cast("long")
    blocks = laid.withColumn("block", F.explode(F.when(F.col("size") > 0, F.sequence(first, last)).otherwise(F.array(F.lit(-1).cast("long")))))
    words = F.least(F.col("_from") + F.col("size"), (F.col("block") + 1) * block_words) - F.greatest(F.col("_from"), F.col("block") * block_words)
    blocks = blocks.withColumn("_words", words)
    drawn = slots(plan, shard_counts(plan, shard_slots, seed), seed)
    times = drawn.groupBy("source_no", "block").agg(F.count(F.lit(1)).alias("_times"), F.min("shard").alias("_shard"))
    taken = blocks.join(times.hint("merge"), ["source_no", "block"], "left")  # the planner takes exploded rows for few
    row = ["doc_id", "source", "size", "source_size", "target", "_from", "text_crc"]
    return (
        taken.groupBy(*row)
        .agg(F.coalesce(F.sum(F.col("_words") * F.col("_times")), F.lit(0)).cast("long").alias("taken"), F.min("_shard").alias("first_shard"), F.count(F.when(F.col("block") == -1, 1)).alias("_empty"))
        .withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.greatest(F.col("_empty"), F.lit(1)))))
        .select("doc_id", "source", "size", "source_size", "target", "taken", "first_shard", "text_crc")
    )


def mixed(docs: DataFrame, seed: int = 7) -> DataFrame:
    """The documents that the mix takes, with their own columns: each as often as taken / size says, rounded up or down by
    a hash of doc_id and text, so that whole documents meet the targets as well as their blocks do. Documents without
    words are not taken. Null doc_ids and sources are documents like others; an empty table gives an empty result."""
    of, crc, times, copy = unused(docs, "of", "of_crc", "times", "copy")
    takes = mix_documents(docs, seed=seed).where("taken > 0").select(F.col("doc_id").alias(of), F.col("text_crc").alias(crc), (F.col("taken") / F.col("size")).alias(times))
    takes = takes.groupBy(of, crc).agg(F.max(times).alias(times))  # rows that repeat an id with its text
    own = F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0))
    joined = join_checked(docs, cut(takes, "mix-takes"), docs["doc_id"].eqNullSafe(F.col(of)) & (own == F.col(crc)), "inner")
    u = F.pmod(F.xxhash64(F.lit(seed), of, crc), F.lit(1 << 20)) / F.lit(float(1 << 20))
    copies = F.floor(F.col(times) + u).cast("int")
    return joined.withColumn(copy, F.explode(F.sequence(F.lit(0), copies))).where(F.col(copy) > 0).select(*[docs[c] for c in docs.columns])
