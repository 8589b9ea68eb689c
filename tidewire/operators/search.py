"""Article search, paging, detail and rankings."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions.text import is_blank
from tidewire.operators import extraction, health
from tidewire.schemas import DATASETS

MAX_LIMIT = 100


class InvalidRequest(ValueError):
    """A criterion that no search can have."""


@dataclass(frozen=True)
class Criteria:
    q: str | None = None
    domain: str | None = None
    first_seen_from: datetime | None = None
    first_seen_to: datetime | None = None
    theme: str | None = None
    signal_type: str | None = None
    direction: str = "desc"


def parse_instant(value: str | None) -> datetime | None:
    """ISO-8601 with a zone."""
    if value is None:
        return None
    try:
        found = datetime.fromisoformat(value)
    except ValueError as e:
        raise InvalidRequest("invalid_request") from e
    if found.tzinfo is None:
        raise InvalidRequest("invalid_request")
    return found


def validate(c: Criteria, offset: int = 0, limit: int = 20) -> None:
    bad = c.direction not in ("asc", "desc") or c.signal_type is not None and c.signal_type not in DATASETS
    bad = bad or c.first_seen_from is not None and c.first_seen_to is not None and not c.first_seen_from < c.first_seen_to
    if bad or offset < 0 or not 1 <= limit <= MAX_LIMIT:
        raise InvalidRequest("invalid_request")


def title_matches(gkg: DataFrame, q: str, key: str = "article_id", title: str = "page_title") -> DataFrame:
    """Keys with any non-blank title that holds q, whatever the case."""
    return gkg.where(~is_blank(F.col(title)) & F.contains(F.lower(title), F.lit(q.lower()))).select(key)


def matching(articles: DataFrame, c: Criteria, events: DataFrame, mentions: DataFrame, gkg: DataFrame) -> DataFrame:
    """Articles for which all given criteria hold; conditions on signals are semi-joins."""
    where: list[Column] = []
    if c.domain and c.domain.strip():
        where.append(F.col("domain") == c.domain)
    if c.first_seen_from is not None:
        where.append(F.col("first_seen_at") >= F.lit(c.first_seen_from))
    if c.first_seen_to is not None:
        where.append(F.col("first_seen_at") < F.lit(c.first_seen_to))
    found = articles.where(reduce(lambda x, y: x & y, where)) if where else articles
    semi = []
    if c.q and c.q.strip():
        semi.append(title_matches(gkg, c.q))
    if c.theme and c.theme.strip():
        semi.append(gkg.where(F.array_contains("themes", c.theme)).select("article_id"))
    if c.signal_type:
        semi.append(dict(zip(DATASETS, (events, mentions, gkg)))[c.signal_type].select("article_id"))
    for s in semi:
        found = found.join(s.withColumnRenamed("article_id", "id"), "id", "left_semi")
    return found


def page(found: DataFrame, direction: str = "desc", offset: int = 0, limit: int = 20, keys: tuple[str, ...] = ("first_seen_at", "id")) -> DataFrame:
    """A page in the order of the keys, all in one direction: a top-k, not a sort of everything."""
    order = [F.col(k).desc() if direction == "desc" else F.col(k).asc() for k in keys]
    return found.orderBy(*order).limit(offset + limit).orderBy(*order).offset(offset)


def first_values(signals: DataFrame, key: str, order: list[str], picks: dict[str, tuple[Column, Column]]) -> DataFrame:
    """For each key and pick (value, condition): the value of the first row, by order, for which the condition holds. One pass."""
    at = F.struct(*order)
    return signals.groupBy(key).agg(*[F.min_by(F.when(ok, v), F.when(ok, at)).alias(n) for n, (v, ok) in picks.items()])


def projected(gkg: DataFrame) -> DataFrame:
    """Title, publication time and image of each article: three first values, each of its own row, with their provenance."""
    has = lambda c: F.col(c).isNotNull()
    picks = {
        "title": (F.col("page_title"), has("page_title") & ~is_blank(F.col("page_title"))),
        "published_at": (F.col("page_precise_pub_timestamp"), has("page_precise_pub_timestamp")),
        "main_image_url": (F.col("main_image_url"), has("main_image_url")),
    }
    out = first_values(gkg.where("article_id IS NOT NULL"), "article_id", ["source_timestamp", "id"], picks)
    label = lambda c, s: F.when(F.col(c).isNotNull(), F.lit(s))
    return out.withColumns({"title_source": label("title", "GKG"), "published_at_source": label("published_at", "GKG_PAGE_PRECISE_PUB_TIMESTAMP"), "main_image_source": label("main_image_url", "GKG_SHARING_IMAGE")})


def search(articles: DataFrame, events: DataFrame, mentions: DataFrame, gkg: DataFrame, criteria: Criteria = Criteria(), offset: int = 0, limit: int = 20) -> tuple[DataFrame, DataFrame]:
    """(a page of articles with projected fields, their total as one row)."""
    validate(criteria, offset, limit)
    found = matching(articles, criteria, events, mentions, gkg)
    shown = page(found, criteria.direction, offset, limit)
    own = gkg.join(F.broadcast(shown.select(F.col("id").alias("article_id"))), "article_id", "left_semi")  # limit rows at most
    order = [F.col(k).desc() if criteria.direction == "desc" else F.col(k).asc() for k in ("first_seen_at", "id")]
    return shown.join(projected(own).withColumnRenamed("article_id", "id"), "id", "left").orderBy(*order), found.agg(F.count(F.lit(1)).alias("total"))


def detail(articles: DataFrame, events: DataFrame, mentions: DataFrame, gkg: DataFrame, article_id: int) -> tuple[DataFrame, DataFrame]:
    """(header with projected fields, all signals in order of time, id and type; each type's own columns, nulls elsewhere)."""
    header = articles.where(F.col("id") == article_id)
    own = [t.where(F.col("article_id") == article_id) for t in (events, mentions, gkg)]
    parts = [t.drop("article_id", "raw_tsv").withColumn("signal_type", F.lit(n)).withColumn("type_order", F.lit(i)) for i, (n, t) in enumerate(zip(DATASETS, own))]
    rows = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts)
    return header.join(projected(own[2]).withColumnRenamed("article_id", "id"), "id", "left"), rows.orderBy("source_timestamp", "id", "type_order")


class NotFound(LookupError):
    """There is no article with this id."""


# The parameters that a request for a list of articles may have.
LIST_PARAMETERS = ("q", "domain", "firstSeenFrom", "firstSeenTo", "theme", "signalType", "direction", "offset", "limit")


def _whole(value: str, name: str) -> int:
    try:
        return int(value)
    except ValueError as e:
        raise InvalidRequest(f"{name} must be a number") from e


class Facade:
    """The requests of a caller, as texts, over the tables: what is unknown or malformed raises InvalidRequest."""

    def __init__(self, articles: DataFrame, events: DataFrame, mentions: DataFrame, gkg: DataFrame):
        self.tables = (articles, events, mentions, gkg)

    def latest_articles(self, **parameters: str) -> tuple[DataFrame, DataFrame]:
        """search() by the parameters of LIST_PARAMETERS."""
        for name in parameters:
            if name not in LIST_PARAMETERS:
                raise InvalidRequest(f"unknown parameter: {name}")
        get = parameters.get
        criteria = Criteria(get("q"), get("domain"), parse_instant(get("firstSeenFrom")), parse_instant(get("firstSeenTo")), get("theme"), get("signalType"), get("direction", "desc"))
        return search(*self.tables, criteria, _whole(get("offset", "0"), "offset"), _whole(get("limit", "20"), "limit"))

    def article_detail(self, article_id: str) -> tuple[DataFrame, DataFrame]:
        """detail(); NotFound if there is no such article."""
        header, signals = detail(*self.tables, _whole(article_id, "id"))
        if header.isEmpty():
            raise NotFound(article_id)
        return header, signals

    def top_domains(self, limit: str = "10") -> DataFrame:
        return top_domains(self.tables[0], _whole(limit, "limit"))

    def top_themes(self, limit: str = "10") -> DataFrame:
        return top_themes(self.tables[3], _whole(limit, "limit"))

    def extraction_health(self, extraction_errors: DataFrame, processing_errors: DataFrame) -> dict[str, DataFrame]:
        """Signals per type, latest processed, open errors and pending signals."""
        found = extraction.signals(*self.tables[1:])
        return {
            "signals": health.signals_per_type(found),
            "latest_processed": health.latest_processed(found, extraction_errors, processing_errors),
            "open_errors": health.open_errors(extraction_errors, processing_errors),
            "pending": health.pending_signals(found, extraction_errors),
        }


def top_counts(rows: DataFrame, name: Column, limit: int) -> DataFrame:
    """The most frequent values: by count, then name."""
    if not 1 <= limit <= MAX_LIMIT:
        raise InvalidRequest("invalid_request")
    return rows.select(name.alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("count")).orderBy(F.col("count").desc(), "name").limit(limit)


def top_domains(articles: DataFrame, limit: int = 10) -> DataFrame:
    return top_counts(articles, F.col("domain"), limit)


def top_themes(gkg: DataFrame, limit: int = 10) -> DataFrame:
    """Over all rows, linked to an article or not."""
    return top_counts(gkg, F.explode("themes"), limit)
