"""Data quality: coverage, distributions, duplicates, lateness, volumes, URL variants, publication times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewire.functions import text

QUANTILES = {"p10": 0.1, "p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}


def coverage(**conditions: Column) -> list[Column]:
    """For each condition a count and its percentage of the rows, to four decimals."""
    out = []
    for name, c in conditions.items():
        n = F.count_if(F.coalesce(c, F.lit(False)))
        out += [n.alias(f"{name}_count"), F.round(100.0 * n / F.count(F.lit(1)), 4).alias(f"{name}_pct")]
    return out


def distribution(c: Column, prefix: str = "") -> list[Column]:
    """n, min, quantiles (exact, interpolated), max."""
    q = [F.percentile(c, F.lit(p)).alias(prefix + n) for n, p in QUANTILES.items()]
    return [F.count(c).alias(f"{prefix}n"), F.min(c).alias(f"{prefix}min"), *q, F.max(c).alias(f"{prefix}max")]


def feature_frequency(rows: DataFrame, ident: str, values: Column, feature: str) -> DataFrame:
    """How many distinct owners each value has, then the largest, median and 90 % of these numbers."""
    each = rows.select(F.col(ident).alias("_i"), F.explode(values).alias("_v")).groupBy("_v").agg(F.count_distinct("_i").alias("n"))
    return each.agg(F.lit(feature).alias("feature"), F.count(F.lit(1)).alias("distinct_values"), F.max("n").alias("max_owners"), F.percentile("n", F.lit(0.5)).alias("p50_owners"), F.percentile("n", F.lit(0.9)).alias("p90_owners"))


def title_duplicates(rows: DataFrame, title: Column) -> DataFrame:
    """One row: groups of equal titles (whatever the case), rows in them, rows too many, unique, generic and short titles."""
    key = text.casefold(title)
    each = rows.where(title.isNotNull()).groupBy(key.alias("_k")).agg(F.count(F.lit(1)).alias("n"))
    short = F.size(F.split(F.trim("_k"), r"\s+")) < 4
    many = F.col("n") > 1
    s = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return each.agg(
        s("n").alias("titles"), F.count_if(many).alias("duplicate_groups"), s(F.when(many, F.col("n"))).alias("duplicate_rows"), s(F.when(many, F.col("n") - 1)).alias("excess_rows"), F.count_if(~many).alias("unique_titles"),
        s(F.when(F.col("_k").isin(*text.GENERIC_TITLES), F.col("n"))).alias("generic_rows"), s(F.when(short, F.col("n"))).alias("short_rows"),
    )


def top_titles(rows: DataFrame, title: Column, k: int = 20) -> DataFrame:
    """The most frequent titles, whatever the case: by count, then title."""
    return rows.where(title.isNotNull()).groupBy(text.casefold(title).alias("title")).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.col("rows").desc(), "title").limit(k)


def article_features(articles: DataFrame, events: DataFrame, mentions: DataFrame, gkg: DataFrame) -> DataFrame:
    """A row per article (id): what its signals hold and when they came. Each table is summed by article before it is joined."""
    span = lambda p: [f(c).alias(f"{p}_{n}") for c, n in (("source_timestamp", ""), ("ingested_at", "ingested_")) for f, n in ((F.min, n + "first"), (F.max, n + "last"))]
    of = lambda t, *aggs: t.where("article_id IS NOT NULL").groupBy("article_id").agg(*aggs)
    n = F.count(F.lit(1))
    e = of(events, n.alias("event_count"), F.count_distinct("global_event_id").alias("event_global_ids"), F.count_distinct("event_code").alias("event_codes"), *span("event"))
    m = of(mentions, n.alias("mention_count"), F.count_distinct("global_event_id").alias("mention_global_ids"), *span("mention"))
    any_of = lambda c: F.bool_or(F.size(F.coalesce(c, F.array())) > 0).alias(f"has_{c}")
    titled, dated = F.trim(F.coalesce("page_title", F.lit(""))) != "", F.col("page_precise_pub_timestamp").isNotNull()
    firsts = [F.min(F.when(ok, F.col(c))).alias(name) for ok, c, name in ((titled, "source_timestamp", "title_first"), (dated, "source_timestamp", "published_signal_first"), (titled, "ingested_at", "title_ingested_first"), (dated, "ingested_at", "published_ingested_first"))]
    g = of(gkg, n.alias("gkg_count"), *[any_of(c) for c in ("themes", "persons", "organizations", "locations")], *span("gkg"), *firsts)
    ids = events.select("article_id", "global_event_id").unionByName(mentions.select("article_id", "global_event_id"))
    out = articles.select(F.col("id").alias("article_id"))
    for part in (e, m, g, of(ids, F.count_distinct("global_event_id").alias("global_ids"))):
        out = out.join(part, "article_id", "left")
    counts = ["event_count", "mention_count", "gkg_count", "event_global_ids", "mention_global_ids", "event_codes", "global_ids"]
    flags = [f"has_{c}" for c in ("themes", "persons", "organizations", "locations")]
    ends = {"last_signal_at": F.greatest("event_last", "mention_last", "gkg_last"), "first_ingested_at": F.least("event_ingested_first", "mention_ingested_first", "gkg_ingested_first"), "last_ingested_at": F.greatest("event_ingested_last", "mention_ingested_last", "gkg_ingested_last")}
    return out.select("article_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts], *[F.coalesce(c, F.lit(False)).alias(c) for c in flags], *[c.alias(k) for k, c in ends.items()], "title_first", "published_signal_first", "title_ingested_first", "published_ingested_first")


def lateness_hours(first: Column, last: Column) -> Column:
    return (F.unix_micros(last) - F.unix_micros(first)) / F.lit(3.6e9)


def bucket_volumes(rows: DataFrame, ts: str, minutes: int) -> DataFrame:
    """Rows per bucket from the first to the last, empty ones too."""
    width = minutes * 60
    at = F.floor(F.unix_micros(ts) / (width * 1_000_000)).cast("long")
    counts = rows.groupBy(at.alias("_b")).agg(F.count(F.lit(1)).alias("rows"))
    spine = counts.agg(F.min("_b").alias("a"), F.max("_b").alias("z")).where("a IS NOT NULL").select(F.explode(F.sequence("a", "z")).alias("_b"))
    return spine.join(counts, "_b", "left").select(F.timestamp_seconds(F.col("_b") * width).alias("bucket"), F.coalesce("rows", F.lit(0)).alias("rows"))


def daily_breakdown(rows: DataFrame, ts: str, **measures: Column) -> DataFrame:
    """A row a day from the first to the last, days without rows too: rows and counted conditions."""
    counts = rows.groupBy(F.to_date(ts).alias("day")).agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(c).alias(n) for n, c in measures.items()])
    spine = counts.agg(F.min("day").alias("a"), F.max("day").alias("z")).where("a IS NOT NULL").select(F.explode(F.sequence("a", "z")).alias("day"))
    return spine.join(counts, "day", "left").select("day", *[F.coalesce(n, F.lit(0)).alias(n) for n in ("rows", *measures)])


def temporal_neighbours(rows: DataFrame, ident: str, ts: str, hours: int) -> DataFrame:
    """For each row, how many others lie within the hours on either side, both ends included.

    Rows are counted per second, and seconds are dealt to buckets of the window's length, each with the two beside it. In
    a bucket the counts are cumulated once; a second then reads the sum at its upper end and the one before its lower end.
    """
    sec = F.floor(F.unix_micros(ts) / 1_000_000).cast("long")
    width = hours * 3600
    each = rows.groupBy(sec.alias("_s")).agg(F.count(F.lit(1)).alias("_n")).withColumn("_own", F.floor(F.col("_s") / width).cast("long"))
    beside = F.explode(F.array(*[F.col("_own") + d for d in (-1, 0, 1)]))
    none = F.lit(None).cast("long")
    points = each.select(beside.alias("_b"), F.col("_s").alias("_at"), F.lit(0).alias("_kind"), "_n", none.alias("_of"), F.lit(0).alias("_sign"))
    for at, sign in ((F.col("_s") + width, 1), (F.col("_s") - width - 1, -1)):
        points = points.unionByName(each.select(F.col("_own").alias("_b"), at.alias("_at"), F.lit(1).alias("_kind"), F.lit(0).cast("long").alias("_n"), F.col("_s").alias("_of"), F.lit(sign).alias("_sign")))
    so_far = F.sum("_n").over(Window.partitionBy("_b").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    counted = points.withColumn("_sum", so_far).where("_of IS NOT NULL").groupBy("_of").agg(F.sum(F.col("_sign") * F.col("_sum")).alias("_near"))
    return rows.select(F.col(ident), sec.alias("_s")).join(counted, F.col("_s") == F.col("_of")).select(ident, (F.col("_near") - 1).alias("neighbours"))


def url_variants(urls: DataFrame, url: str, kind: str) -> DataFrame:
    """Groups of URLs that differ only by scheme, `www.` or query: key, urls, variants, sample."""
    c = F.col(url)
    bare = F.regexp_replace(c, "^https?://", "")
    keys = {"scheme": bare, "www": F.regexp_replace(c, r"^(https?://)www\.", "$1"), "query": F.split_part(c, F.lit("?"), F.lit(1))}
    groups = urls.where(c.isNotNull()).select(keys[kind].alias("key"), c.alias("u")).distinct().groupBy("key")
    return groups.agg(F.count(F.lit(1)).alias("urls"), F.bool_or(F.col("u").contains("?")).alias("has_query"), F.slice(F.array_sort(F.collect_list("u")), 1, 5).alias("sample")).where("urls > 1")


def query_parameters(urls: DataFrame, url: str) -> DataFrame:
    """How often each query parameter name occurs."""
    q = F.split_part(F.split_part(F.col(url), F.lit("#"), F.lit(1)), F.lit("?"), F.lit(2))
    names = urls.select(F.explode(F.split(q, "&")).alias("p")).where("p != ''").select(F.lower(F.split_part("p", F.lit("="), F.lit(1))).alias("name"))
    return names.groupBy("name").agg(F.count(F.lit(1)).alias("urls"))


def trailing_slashes(urls: DataFrame, url: str) -> DataFrame:
    path = F.regexp_replace(F.split_part(F.split_part(F.col(url), F.lit("#"), F.lit(1)), F.lit("?"), F.lit(1)), "^https?://[^/]*", "")
    return urls.agg(F.count_if(path.rlike(".+/$")).alias("with_slash"), F.count_if(~path.rlike("/$") & (path != "")).alias("without_slash"), F.count_if((path == "/") | (path == "")).alias("root"))


def publication_quality(rows: DataFrame, ident: str, extras: str, document_date: str, tag: str = "PAGE_PRECISEPUBTIMESTAMP") -> DataFrame:
    """One row: rows, tagged, not compact, rejected as future, accepted, owners with several and with conflicting times."""
    raw = F.regexp_extract_all(F.coalesce(extras, F.lit("")), F.lit(rf"(?is)<{tag}>(.*?)</{tag}>"), 1)
    t = rows.select(F.col(ident).alias("_i"), raw.alias("_raw"), text.publication_time(F.col(extras), F.col(document_date), tag).alias("_at"))
    each = t.select("_i", F.size("_raw").alias("n"), F.size(F.array_distinct("_raw")).alias("d"), F.size(F.filter("_raw", lambda x: ~x.rlike("^[0-9]{14}$"))).alias("odd"), F.col("_at").isNotNull().alias("ok"))
    return each.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.expr("n > 0")).alias("tagged"), F.count_if(F.expr("odd > 0")).alias("not_compact"), F.count_if(F.expr("n > 0 AND odd = 0 AND NOT ok")).alias("rejected"), F.count_if(F.expr("ok")).alias("accepted"), F.count_if(F.expr("n > 1")).alias("several"), F.count_if(F.expr("d > 1")).alias("conflicting"))


def fingerprint(**tables: tuple[DataFrame, Column]) -> DataFrame:
    """One row: a JSON object of each table's row count and largest value."""
    parts = [df.agg(F.lit(n).alias("n"), F.struct(F.count(F.lit(1)).alias("rows"), F.max(c).cast("string").alias("latest")).alias("v")) for n, (df, c) in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy().agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("n", "v"))))).alias("fingerprint"))


def hash_sample(rows: DataFrame, order: list[str], n: int, also: DataFrame | None = None, key: str = "id") -> DataFrame:
    """The n rows smallest by a stored hash, with rows that must be in."""
    out = rows.orderBy(*order).limit(n)
    return out if also is None else out.unionByName(also).dropDuplicates([key])


def capped(rows: DataFrame, by: list[str], order: list[Column], most: int) -> DataFrame:
    """At most `most` rows of each group, the first by order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_n") <= most).drop("_n")
