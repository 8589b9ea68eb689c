"""Evaluation of pair decisions: metrics, threshold calibration, recall, lexical baseline, corpus rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewire.functions import hashing, text
from tidewire.lineage import cut, running
from tidewire.plans.pairs import window_join


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def confusion(judged: DataFrame, label: Column, predicted: Column) -> DataFrame:
    """One row: tp, fp, fn, tn, uncertain (left out), precision, recall, f1. label: SAME, DIFFERENT or UNCERTAIN."""
    same, other = label == "SAME", label == "DIFFERENT"
    n = judged.agg(F.count_if(same & predicted).alias("tp"), F.count_if(other & predicted).alias("fp"), F.count_if(same & ~predicted).alias("fn"), F.count_if(other & ~predicted).alias("tn"), F.count_if(label == "UNCERTAIN").alias("uncertain"))
    p, r = _ratio(F.col("tp"), F.col("tp") + F.col("fp")), _ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    n = n.withColumn("precision", p).withColumn("recall", r)
    return n.withColumn("f1", _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def evaluate(pairs: DataFrame, predictions: DataFrame, split: str) -> tuple[DataFrame, DataFrame]:
    """(metrics, false merges) of a split. A pair without a prediction raises; merges go through connected predictions."""
    own = pairs.where(F.col("split") == split)
    j = own.join(predictions.select(F.col("pairId").alias("id"), "sameStory", "candidate", "score"), "id", "left")
    missing = j.where("sameStory IS NULL").select("id").limit(5).collect()
    if missing:
        raise ValueError(f"no prediction for {', '.join(r['id'] for r in missing)}")
    metrics = confusion(j, F.col("label"), F.col("sameStory"))
    found = j.where("label = 'SAME'").agg(_ratio(F.count_if(F.col("candidate")), F.count(F.lit(1))).alias("candidate_recall"))
    from tidewire.plans.clusters import connected

    nodes = own.select(F.explode(F.array("left", "right")).alias("ref")).distinct()
    merged = connected(nodes, j.where("sameStory AND label != 'UNCERTAIN'").select(F.col("left").alias("left_ref"), F.col("right").alias("right_ref")))
    ends = j.join(merged.select(F.col("node").alias("left"), F.col("component").alias("_l")), "left").join(merged.select(F.col("node").alias("right"), F.col("component").alias("_r")), "right")
    false_merges = ends.where("label = 'DIFFERENT' AND _l = _r").select("id")
    alone = merged.groupBy("component").count().agg(_ratio(F.sum(F.when(F.col("count") == 1, 1).otherwise(0)), F.sum("count")).alias("singleton_share"))
    return metrics.crossJoin(found).crossJoin(alone), false_merges  # one row each


def calibrate(judged: DataFrame, score: Column, label: Column) -> DataFrame:
    """One row: the threshold, among 0, 1 and all scores, with the best (f1, precision, threshold). One sort of the scores.

    Distinct scores are gone through in order, range by range.
    """
    rows = judged.where(label.isin("SAME", "DIFFERENT")).select(score.alias("t"), (label == "SAME").cast("long").alias("p"), (label != "SAME").cast("long").alias("n"))
    ends = judged.sparkSession.createDataFrame([(0.0, 0, 0), (1.0, 0, 0)], "t DOUBLE, p BIGINT, n BIGINT")
    each = rows.unionByName(ends).groupBy("t").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    c = running(each, [-F.col("t")], {"tp": F.col("p"), "fp": F.col("n")})
    c = c.crossJoin(F.broadcast(each.agg(F.sum("p").alias("positives"))))  # one row
    c = c.withColumn("precision", _ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", _ratio(F.col("tp"), F.col("positives")))
    c = c.withColumn("f1", _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    best = c.agg(F.max_by(F.struct("t", "tp", "fp", "precision", "recall", "f1"), F.struct("f1", "precision", "t")).alias("b"))
    return best.select(F.col("b.t").alias("threshold"), "b.tp", "b.fp", "b.precision", "b.recall", "b.f1")


def predicted(scores: DataFrame, candidates: DataFrame, threshold: float) -> DataFrame:
    """pairId, sameStory (a candidate at or above the threshold), candidate, score to six decimals."""
    c = candidates.select("pairId").distinct().withColumn("_c", F.lit(True))
    j = scores.join(c, "pairId", "left").withColumn("candidate", F.coalesce("_c", F.lit(False)))
    return j.select("pairId", (F.col("candidate") & (F.col("score") >= threshold)).alias("sameStory"), "candidate", F.round("score", 6).alias("score"))


def auc(scores: DataFrame, score: str, positive: Column) -> DataFrame:
    """One row: chance that a positive scores above a negative, ties half; from ranks, without pairing them."""
    each = scores.groupBy(F.col(score).alias("_s")).agg(F.count_if(positive).alias("p"), F.count_if(~positive).alias("n"))
    c = running(each, [F.col("_s")], {"_upto": F.col("n")}).withColumn("_b", F.col("_upto") - F.col("n"))
    s = F.sum(F.col("p") * (F.col("_b") + F.col("n") / 2.0))
    return c.agg((s / (F.sum("p") * F.sum("n"))).alias("auc"))


def recall_at(ranked: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """One row: share of truth (ref, other) that is among the first k of ranked (ref, other, rank)."""
    hit = ranked.where(F.col("rank") <= k).select("ref", "other").withColumn("_hit", F.lit(1))
    return truth.join(hit, ["ref", "other"], "left").agg(F.count(F.lit(1)).alias("queries"), F.coalesce(F.sum("_hit"), F.lit(0)).alias("hits")).withColumn("recall", _ratio(F.col("hits"), F.col("queries")))


def lexical_top(rows: DataFrame, hours: int, k: int, corpus: DataFrame | None = None) -> DataFrame:
    """rows (ref, at, title, tie) -> left, right, similarity, rank of lexical candidates.

    Every corpus row ranks all others within the window by the Jaccard similarity of their words (those without a common
    word have 0), ties by `tie`, and its k first are taken; those whose other end is no corpus row drop out after that. A
    pair that both ends rank has the better rank. Without a corpus all rows are one.

    Corpus rows meet the rows of their time bucket and of the two beside it; ranks are cut to k before rows are shuffled.
    """
    width = hours * 3_600_000_000
    t = rows.select("ref", F.unix_micros("at").alias("_at"), text.token_set(F.col("title")).alias("_words"), "tie").withColumn("_bucket", F.floor(F.col("_at") / width).cast("long"))
    t = cut(t, "lexical")
    own = t if corpus is None else t.join(corpus.select("ref"), "ref", "left_semi")
    own = own.select("ref", F.col("_at").alias("_own_at"), F.col("_words").alias("_own"), F.explode(F.array(*[F.col("_bucket") + d for d in (-1, 0, 1)])).alias("_bucket"))
    others = t.select(F.col("ref").alias("other"), "_at", "_words", "tie", "_bucket")
    near = own.join(others, "_bucket").where((F.col("ref") != F.col("other")) & (F.abs(F.col("_at") - F.col("_own_at")) <= width))
    scored = near.select("ref", "other", "tie", text.jaccard(F.col("_own"), F.col("_words")).alias("similarity"))
    first = scored.withColumn("rank", F.row_number().over(Window.partitionBy("ref").orderBy(F.col("similarity").desc(), "tie"))).where(F.col("rank") <= k)
    if corpus is not None:
        first = first.join(corpus.select(F.col("ref").alias("other")), "other", "left_semi")
    pair = first.groupBy(F.least("ref", "other").alias("left"), F.greatest("ref", "other").alias("right"))
    return pair.agg(F.max("similarity").alias("similarity"), F.min("rank").alias("rank"))


def candidate_signals(pairs: DataFrame, articles: DataFrame) -> DataFrame:
    """pairs (left, right, cosine) with what both articles (ref, title, domain, at, event_ids, persons, organizations) share."""
    side = lambda s: articles.select(F.col("ref").alias(s), *[F.col(c).alias(f"_{s}_{c}") for c in articles.columns if c != "ref"])
    j = pairs.join(side("left"), "left").join(side("right"), "right")
    two = lambda c: (F.col(f"_left_{c}"), F.col(f"_right_{c}"))
    shared = lambda c: F.array_sort(F.array_intersect(*(F.coalesce(x, F.array().cast(articles.schema[c].dataType)) for x in two(c))))
    words = [text.token_set(x) for x in two("title")]
    folded = [text.casefold(x) for x in two("title")]
    hours = F.round(F.abs(F.unix_micros("_left_at") - F.unix_micros("_right_at")) / 3.6e9, 4)
    return j.select(
        "left", "right", hashing.pair_ref(F.col("left"), F.col("right"), "candidate-").alias("id"), "cosine", F.round(text.jaccard(*words), 6).alias("lexical"), hours.alias("hours_apart"),
        (F.col("_left_domain") == F.col("_right_domain")).alias("same_domain"), (folded[0] == folded[1]).alias("same_title"),
        shared("event_ids").alias("shared_events"), shared("persons").alias("shared_persons"), shared("organizations").alias("shared_organizations"),
    )


def candidate_strata(candidates: DataFrame, most: int) -> DataFrame:
    """candidate_signals() rows -> the same with a stratum and a rank; a row for each stratum that takes it, `most` of each.

    hard: alike by vector, not by words, no common event, but common names; conflict: event and vector disagree; overlap:
    the band in which both labels occur; low_positive: alike by words, the least alike by vector first.
    """
    events, named = F.size("shared_events") > 0, (F.size("shared_persons") > 0) | (F.size("shared_organizations") > 0)
    c = F.col("cosine")
    rules = {
        "hard": (c >= 0.65) & (F.col("lexical") <= 0.50) & ~F.col("same_title") & ~events & named,
        "conflict": (events & (c < 0.72)) | (~events & (c >= 0.84)),
        "overlap": c.between(0.50, 0.85),
        "low_positive": F.col("same_title") | (F.col("lexical") >= 0.8),
    }
    taken = F.filter(F.array(*[F.when(F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()]), lambda x: x.isNotNull())
    rows = candidates.withColumn("stratum", F.explode(taken))
    first = F.when(F.col("stratum") == "low_positive", c).otherwise(-c)
    rank = F.row_number().over(Window.partitionBy("stratum").orderBy(first, "id"))
    return rows.withColumn("stratum_rank", rank).where(F.col("stratum_rank") <= most)


def story_articles(articles: DataFrame, stories: DataFrame, each: int = 3) -> DataFrame:
    """stories (story_id, title_key, split) x articles (ref, title, domain, url_hash) -> story_id, split, ref, place (1 to each).

    Of the articles under a story's title, the first of each domain by URL hash, and the first `each` of these.
    """
    found = articles.withColumn("title_key", text.word_key(F.col("title"))).join(F.broadcast(stories), "title_key")  # stories are edited by hand
    one = found.withColumn("_d", F.row_number().over(Window.partitionBy("story_id", "domain").orderBy("url_hash", "ref"))).where("_d = 1")
    return one.withColumn("place", F.row_number().over(Window.partitionBy("story_id").orderBy("url_hash", "ref"))).where(F.col("place") <= each).select("story_id", "split", "ref", "place")


def _corpus_pair(rows: DataFrame, label: str, category: Column, hard: bool = False) -> DataFrame:
    return rows.select(hashing.pair_ref(F.col("left"), F.col("right")).alias("id"), "left", "right", F.lit(label).alias("label"), "split", category.alias("category"), F.lit(hard).alias("hardNegative"))


def story_pairs(chosen: DataFrame) -> DataFrame:
    """SAME_STORY pairs of story_articles()."""
    a, b = chosen.select("story_id", "split", F.col("ref").alias("left"), F.col("place").alias("_p")), chosen.select("story_id", F.col("ref").alias("right"), F.col("place").alias("_q"))
    return _corpus_pair(a.join(b, "story_id").where("_p < _q"), "SAME_STORY", F.lit("syndicated"))


def across_stories(chosen: DataFrame, relations: DataFrame) -> DataFrame:
    """relations (first, second): pairs of every article of the one with every article of the other, in the split of the first."""
    a = chosen.select(F.col("story_id").alias("first"), "split", F.col("ref").alias("left"), F.col("place").alias("_p"))
    b = chosen.select(F.col("story_id").alias("second"), F.col("ref").alias("right"), F.col("place").alias("_q"))
    return relations.join(a, "first").join(b, "second")


def corpus_pairs(chosen: DataFrame, hard: DataFrame, reviewed: DataFrame, controls: dict[str, int]) -> DataFrame:
    """All pairs of a corpus, by id: SAME_STORY pairs within stories; hard negatives across related stories (first, second,
    category); as many clear negatives of a split as `controls` says, across its other stories in the order of the stories and
    of their articles; and reviewed pairs (left, right, label, split, category)."""
    related = hard.select(F.least("first", "second").alias("first"), F.greatest("first", "second").alias("second"), "category")
    negative = _corpus_pair(across_stories(chosen, related), "DIFFERENT_STORY", F.col("category"), hard=True)
    stories = chosen.select("story_id", "split").distinct()
    others = stories.select(F.col("story_id").alias("first"), F.col("split")).join(stories.select(F.col("story_id").alias("second"), "split"), "split").where("first < second").select("first", "second")
    clear = across_stories(chosen, others.join(related, ["first", "second"], "left_anti"))
    place = F.row_number().over(Window.partitionBy("split").orderBy("first", "second", "_p", "_q"))
    most = F.create_map(*[F.lit(x) for kv in controls.items() for x in kv])[F.col("split")]
    clear = _corpus_pair(clear.withColumn("_n", place).where(F.col("_n") <= most), "DIFFERENT_STORY", F.lit("clear-negative-control"))
    known = reviewed.select(hashing.pair_ref(F.col("left"), F.col("right")).alias("id"), "left", "right", "label", "split", "category", F.lit(False).alias("hardNegative"))
    return story_pairs(chosen).unionByName(negative).unionByName(clear).unionByName(known).orderBy("id")


def _missing(rows: DataFrame, what: Column, *fields: str) -> DataFrame:
    """missing_<field> for every field that is null or an empty text."""
    empty = [F.when(F.col(f).isNull() | (F.col(f).cast("string") == ""), F.lit(f"missing_{f}")) for f in fields]
    return rows.select(F.explode(F.filter(F.array(*empty), lambda x: x.isNotNull())).alias("rule"), what.alias("subject"))


def _several(rows: DataFrame, rule: str, *keys: str) -> DataFrame:
    subject = F.concat_ws("|", *[F.col(k) for k in keys])
    return rows.groupBy(*keys).count().where("count > 1").select(F.lit(rule).alias("rule"), subject.alias("subject"))


def _where(rows: DataFrame, rule: str, bad: Column, subject: str) -> DataFrame:
    return rows.where(F.coalesce(bad, F.lit(False))).select(F.lit(rule).alias("rule"), F.col(subject).alias("subject"))


# Labels, splits, and what a whole corpus holds at least.
LABELS, SPLITS = ("SAME_STORY", "DIFFERENT_STORY", "UNCERTAIN"), ("calibration", "evaluation")
MINIMUM = {"definite": 100, "same": 25, "hard_negative": 25, "stories": 10}
STORY_ARTICLES = 3


def corpus_violations(articles: DataFrame, pairs: DataFrame, stories: DataFrame, minimum: bool = True) -> DataFrame:
    """rule, subject for every rule that a corpus breaks, as assertion queries over its three tables.

    articles (ref, urlHash, canonicalUrl, domain, title, titleInputHash, firstSeenAt), pairs (id, left, right, label, split,
    category, rationale, hardNegative, verification: struct(method, checkedAt, evidence)), stories (id, split, articleRefs,
    rationale).
    """
    title_hash = hashing.sha256(text.title_input(F.col("title"), unescape=False))
    p = pairs.withColumns({"_low": F.least("left", "right"), "_high": F.greatest("left", "right"), **{f"verification_{f}": F.col(f"verification.{f}") for f in ("method", "checkedAt")}, "_evidence": F.size(F.coalesce("verification.evidence", F.array().cast("array<string>")))})
    ends = p.select(F.col("id").alias("pair"), "split", F.explode(F.array("left", "right")).alias("ref"))
    known = articles.select("ref").distinct()
    in_splits = ends.where(F.col("split").isin(*SPLITS) & F.col("ref").isNotNull()).groupBy("ref").agg(F.collect_set("split").alias("splits"))
    members = stories.select(F.col("id").alias("story"), "split", F.explode("articleRefs").alias("ref"))
    out = [
        _missing(articles, F.col("ref"), "ref", "urlHash", "canonicalUrl", "domain", "title", "titleInputHash", "firstSeenAt"),
        _several(articles, "duplicate_article", "ref"),
        _several(articles, "duplicate_url_hash", "urlHash"),
        _where(articles, "bad_url_hash", ~F.col("urlHash").rlike("^[0-9a-f]{64}$"), "ref"),
        _where(articles, "title_hash_mismatch", (F.col("title") != "") & ~F.col("titleInputHash").eqNullSafe(title_hash), "ref"),
        _missing(p, F.col("id"), "id", "left", "right", "label", "split", "category", "rationale", "verification", "verification_method", "verification_checkedAt"),
        _where(p, "missing_verification_evidence", F.col("_evidence") == 0, "id"),
        _several(p, "duplicate_pair", "id"),
        _several(p, "repeated_ends", "_low", "_high"),
        _where(p, "self_pair", F.col("left") == F.col("right"), "id"),
        ends.join(known, "ref", "left_anti").select(F.lit("unknown_article").alias("rule"), F.col("pair").alias("subject")),
        _where(p, "bad_label", ~F.col("label").isin(*LABELS), "id"),
        _where(p, "bad_split", ~F.col("split").isin(*SPLITS), "id"),
        _where(in_splits, "split_leakage", F.size("splits") > 1, "ref"),
        _missing(stories, F.col("id"), "id", "split", "rationale"),
        _several(stories, "duplicate_story", "id"),
        _where(stories, "bad_story_split", ~F.col("split").isin(*SPLITS), "id"),
        _where(stories, "small_story", F.coalesce(F.size("articleRefs"), F.lit(0)) < STORY_ARTICLES, "id"),
        members.join(known, "ref", "left_anti").select(F.lit("unknown_story_article").alias("rule"), F.col("story").alias("subject")),
        _several(members.select("story", "ref").distinct(), "article_in_several_stories", "ref"),
        members.join(in_splits, "ref").where(F.col("split").isin(*SPLITS) & (F.col("splits") != F.array("split"))).select(F.lit("story_split_mismatch").alias("rule"), F.col("story").alias("subject")),
    ]
    if minimum:
        n = p.agg(F.count_if(F.col("label").isin("SAME_STORY", "DIFFERENT_STORY")).alias("definite"), F.count_if(F.col("label") == "SAME_STORY").alias("same"), F.count_if((F.col("label") == "DIFFERENT_STORY") & F.coalesce("hardNegative", F.lit(False))).alias("hard_negative"))
        n = n.crossJoin(stories.agg(F.count_if(F.size("articleRefs") >= STORY_ARTICLES).alias("stories")))  # one row each
        short = [F.when(F.col(k) < least, F.struct(F.lit(f"few_{k}").alias("rule"), F.col(k).cast("string").alias("subject"))) for k, least in MINIMUM.items()]
        out.append(n.select(F.explode(F.filter(F.array(*short), lambda x: x.isNotNull())).alias("x")).select("x.rule", "x.subject"))
    return reduce(DataFrame.unionByName, out)


def gate(metrics: DataFrame, precision: float = 0.98, recall: float = 0.90) -> DataFrame:
    return metrics.withColumn("passed", (F.col("precision") >= precision) & (F.col("recall") >= recall))


def labelled_in_window(articles: DataFrame, pairs: DataFrame, hours: int) -> DataFrame:
    """Labelled pairs (left, right) whose articles (ref, first_seen_at) lie within the window."""
    near = window_join(articles.select("ref", "first_seen_at"), "first_seen_at", hours * 3600, "ref", [])
    return pairs.join(near.select(F.col("left_ref").alias("_l"), F.col("right_ref").alias("_r")), (F.least("left", "right") == F.col("_l")) & (F.greatest("left", "right") == F.col("_r")), "left_semi")
