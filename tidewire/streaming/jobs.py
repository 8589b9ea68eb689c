"""The scheduled jobs, each a function over a store: what it finds there to do, it does, and says how much that was.

A scheduler (or `tumbling.run_polling`) calls them; none keeps state of its own, so any of them may be run again.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire import schemas
from tidewire.functions import vectors
from tidewire.lineage import cut
from tidewire.operators import extraction, imports, retention, search, staging
from tidewire.plans import inputs, snapshots
from tidewire.sources import embedder, masterfile
from tidewire.sources.store import TableStore
from tidewire.streaming.tumbling import drained

# Rows of a batch and batches of a run.
BATCH_ROWS, BATCHES, EMBEDDING_ROWS = 1000, 10, 100
TABLES = {
    "events": schemas.EVENTS, "mentions": schemas.MENTIONS, "gkg": schemas.GKG, "articles": schemas.ARTICLES, "processing_errors": schemas.PROCESSING_ERRORS,
    "extraction_errors": schemas.EXTRACTION_ERRORS, "article_inputs": schemas.ARTICLE_INPUTS, "artifacts": schemas.ARTIFACTS, "import_files": schemas.IMPORT_FILES,
}


def table(tables: TableStore, name: str) -> DataFrame:
    """A table of the store; empty where nothing has been written yet."""
    found = tables.read(name)
    return tables.spark.createDataFrame([], TABLES[name]) if found is None else found


def _shaped(df: DataFrame, name: str, tables: TableStore) -> DataFrame:
    """df with the columns of a table, null where it has none."""
    schema = tables.spark.createDataFrame([], TABLES[name]).schema
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def _at(now: datetime):
    return F.lit(now).cast("timestamp")


def ingestion(tables: TableStore, list_path: str, landed: Callable[[str], str], now: datetime, newest: int = 4, retries: int = 20) -> dict[datetime, str]:
    """Import the failed windows and the newest ones; landed maps a file's URL to where its copy lies."""
    windows = cut(masterfile.complete_windows(masterfile.files(masterfile.read_list(tables.spark, list_path))), "windows")
    todo = masterfile.windows_to_import(windows, table(tables, "import_files"), newest, retries)
    rows = todo.join(windows, "source_timestamp").orderBy("priority", "source_timestamp").collect()  # newest + retries rows at most
    return imports.import_windows(tables.spark, tables, [(r["source_timestamp"], {k: landed(u) for k, u in r["files"].items()}) for r in rows], now)


def staging_batch(tables: TableStore, dataset: str, now: datetime, rows: int | None = BATCH_ROWS) -> int:
    """Stage the first pending payloads by id (all, without a bound)."""
    name = dataset.lower()
    errors = table(tables, "processing_errors")
    todo = staging.pending(imports.payloads(tables.spark, tables, dataset), table(tables, "import_files"), table(tables, name), errors, dataset, _at(now))
    todo = cut(todo.orderBy("id").limit(rows) if rows else todo, "staging")
    count = todo.count()
    if count:
        good, bad = staging.stage(todo, dataset, _at(now))
        good = cut(_shaped(good.withColumn("created_at", _at(now)), name, tables), "staged")
        known = table(tables, "processing_errors")
        closed = staging.resolved(known, good, dataset, _at(now))
        fresh = bad.withColumn("id", F.xxhash64("dataset_type", "source_row_id", "occurred_at"))
        tables.merge(name, good, ["id"])
        tables.write("processing_errors", cut(_shaped(closed, "processing_errors", tables).unionByName(_shaped(fresh, "processing_errors", tables)), "errors"))
    return count


def stage_all(tables: TableStore, now: datetime, rows: int = BATCH_ROWS, batches: int = BATCHES) -> dict[str, int]:
    """Bounded batches for each dataset until one does nothing."""
    return {d: drained(lambda d=d: staging_batch(tables, d, now, rows), batches) for d in schemas.DATASETS if tables.names(f"payloads_{d.lower()}")}


def reprocess(tables: TableStore, dataset: str, now: datetime) -> DataFrame:
    """Stage all payloads of a dataset anew and put the result in the place of the typed rows, keeping article links.

    One row comes back: rows before and after, and how many are lost, added, or changed. A row that fails now stays as it was.
    """
    name = dataset.lower()
    before = cut(table(tables, name), "before")
    good, _ = staging.stage(imports.payloads(tables.spark, tables, dataset), dataset, _at(now))
    good = good.drop("article_id").join(before.select("id", "article_id", "created_at"), "id", "left")
    after = cut(_shaped(good, name, tables), "after")
    kept = before.join(after.select("id"), "id", "left_anti")
    own = [c for c in before.columns if c not in ("id", "parsed_at")]
    digest = lambda df: df.select("id", F.xxhash64(F.to_json(F.struct(*own), {"ignoreNullFields": "false"})).alias("h"))
    both = digest(before).withColumnRenamed("h", "b").join(digest(after).withColumnRenamed("h", "a"), "id", "full_outer")
    report = cut(both.agg(F.count("b").alias("before"), F.count("a").alias("after"), F.count_if(F.col("a").isNull()).alias("kept"), F.count_if(F.col("b").isNull()).alias("added"), F.count_if(F.col("a") != F.col("b")).alias("changed")), "report")
    tables.write(name, after.unionByName(kept))
    return report


def extract_all(tables: TableStore, now: datetime) -> int:
    """Link all signals that are neither linked nor in error; how many there were."""
    own = [table(tables, n) for n in ("events", "mentions", "gkg")]
    errors = table(tables, "extraction_errors")
    todo = cut(extraction.unlinked(extraction.signals(*own), errors), "unlinked")
    count = todo.count()
    if count:
        out = extraction.extract(todo, table(tables, "articles"), _at(now))
        articles, links = cut(_shaped(out["articles"], "articles", tables), "articles"), cut(out["links"], "links")
        fresh = out["errors"].withColumn("id", F.xxhash64("signal_type", "source_id"))
        tables.write("articles", articles)
        tables.write("extraction_errors", cut(errors.unionByName(_shaped(fresh, "extraction_errors", tables)), "errors"))
        for n, df in zip(schemas.DATASETS, own):
            tables.write(n.lower(), extraction.linked(df, links, n))
    return count


def embed_inputs(tables: TableStore, now: datetime, model: embedder.Embedder | None = None, repair: bool = False, versions=inputs.VERSIONS, limit: int | None = None) -> dict[str, int]:
    """Bring article inputs up to date and embed what is missing or due; a repair also takes failures without a time.

    Counts of inputs looked at and of artifacts tried come back.
    """
    spark = tables.spark
    v, current, articles, gkg = inputs.versions_table(spark, versions), table(tables, "article_inputs"), table(tables, "articles"), table(tables, "gkg")
    due = cut(inputs.stale_inputs(articles, gkg, v, current, _at(now), repair, limit), "due")
    looked = due.count()
    titles = inputs.article_titles(articles, search.projected(gkg))
    wanted = inputs.candidate_inputs(titles.join(due.select("article_id").distinct(), "article_id", "left_semi"), v, current)
    wanted = cut(wanted.join(due.select("article_ref", "clustering_version_id"), ["article_ref", "clustering_version_id"], "left_semi"), "wanted")
    key = F.concat_ws("|", *inputs.ARTIFACT_KEY)
    artifacts = table(tables, "artifacts")
    fresh = inputs.missing_artifacts(wanted, artifacts).withColumns({"id": F.xxhash64(key), "status": F.lit("PENDING"), "attempt_count": F.lit(0)})
    artifacts = cut(artifacts.unionByName(_shaped(fresh, "artifacts", tables)), "artifacts")
    tried = cut(artifacts.where(inputs.retry_due(_at(now), repair)), "tried")
    outcomes = []
    for d in sorted({x.dimension for x in versions}):
        made = embedder.embed_texts(tried.where(F.col("embedding_dimension") == d).select(F.col("id").cast("string").alias("k"), "normalized_title"), "k", "normalized_title", d, model)
        outcomes.append(made.withColumn("e", vectors.encoded("vector", F.lit(d))))
    said = cut(outcomes[0] if len(outcomes) == 1 else outcomes[0].unionByName(outcomes[1]), "outcomes")
    rows = said.select(F.col("key").cast("long").alias("id"), F.col("e.bytes").alias("bytes"), F.col("e.hash").alias("hash"), F.col("e.norm").alias("norm"), F.coalesce("error", "e.error").alias("error"), F.coalesce("retryable", F.lit(False)).alias("retryable"), "retry_after")
    rows = rows.join(tried.select("id", *inputs.ARTIFACT_KEY), "id").drop("id")
    done = inputs.after_attempt(artifacts, rows, _at(now)).withColumn("id", F.xxhash64(key))
    done = cut(_shaped(done.join(artifacts.select("id", "normalized_title"), "id"), "artifacts", tables), "artifacts")
    tables.write("artifacts", done)
    history = inputs.synchronised(current, wanted.withColumns({"created_at": _at(now)}), _at(now))
    status = done.select(*inputs.ARTIFACT_KEY, F.col("id").alias("_artifact"), F.col("status").alias("_status"), F.col("attempt_count").alias("_attempts"), F.col("next_retry_at").alias("_retry"))
    named = history.drop(*[c for c in inputs.ARTIFACT_KEY if c in history.columns and c != "title_input_hash"]).join(v.select("clustering_version_id", *[c for c in inputs.ARTIFACT_KEY if c != "title_input_hash"]), "clustering_version_id", "left")
    named = named.join(status, inputs.ARTIFACT_KEY, "left")
    own = {"embedding_status": F.coalesce("_status", F.lit("NOT_NEEDED")), "embedding_artifact_id": F.col("_artifact"), "attempt_count": F.coalesce("_attempts", F.lit(0)), "next_retry_at": F.col("_retry"), "id": F.xxhash64("clustering_version_id", "article_ref", "article_input_fingerprint")}
    tables.write("article_inputs", cut(_shaped(named.withColumns(own), "article_inputs", tables), "inputs"))
    return {"inputs": looked, "artifacts": tried.count()}


def snapshot_all(tables: TableStore, now: datetime, mode: str = "INCREMENTAL", watermark: datetime | None = None, versions=inputs.VERSIONS) -> dict[str, str]:
    """Freeze and decide for each version on its own, up to a watermark: the present, or (a must for BACKFILL) a given one."""
    if mode == "BACKFILL" and watermark is None:
        raise ValueError("a backfill needs a watermark")
    ledger, upto = snapshots.RunLedger(tables), _at(watermark or now)
    ready = snapshots.ready_inputs(table(tables, "article_inputs"), table(tables, "artifacts"), upto)
    out: dict[str, str] = {}

    def work(v) -> None:
        own = ready.where(F.col("clustering_version_id") == v.id).withColumn("d", vectors.decoded("vector_bytes", F.lit(v.dimension), "vector_hash"))
        members = cut(own.select("article_ref", "effective_at", "article_input_fingerprint", "embedding_artifact_id", "vector_hash", F.col("d.vector").cast("array<double>").alias("vector")), "members")
        out[v.version_key] = snapshots.run_snapshot(tables, ledger, v, members, upto, now, mode)

    ended = snapshots.each_version(versions, work)
    return {k: out.get(k, how) if how == "COMPLETED" else how for k, how in ended.items()}


def retain(tables: TableStore, now: datetime, period: timedelta, rows: int = BATCH_ROWS, batches: int = BATCHES) -> dict[str, int]:
    """Let payloads go whose typed rows were parsed a period ago or earlier, the oldest first, in bounded batches."""
    retention.validate_period(period)

    def batch(dataset: str) -> int:
        gone = cut(retention.eligible(imports.payloads(tables.spark, tables, dataset), table(tables, dataset.lower()), _at(now - period), rows).select("id"), "gone")
        if not gone.isEmpty():
            tables.merge(f"payloads_gone_{dataset.lower()}", gone, ["id"], "keep")
        return gone.count()

    return {d: drained(lambda d=d: batch(d), batches) for d in schemas.DATASETS if tables.names(f"payloads_{d.lower()}")}


def revisit(tables: TableStore, now: datetime, hours: tuple[int, ...] = (24, 72)) -> DataFrame:
    """article_id, hours of articles whose revisit has come: first seen that long ago, and no current input made since."""
    made = table(tables, "article_inputs").where("current_marker = 1").groupBy("article_id").agg(F.max("created_at").alias("_made"))
    rows = table(tables, "articles").select(F.col("id").alias("article_id"), "first_seen_at").join(made, "article_id", "left")
    due = rows.withColumn("hours", F.explode(F.array(*[F.lit(h) for h in hours]))).withColumn("_due", F.timestamp_micros(F.unix_micros("first_seen_at") + F.col("hours").cast("long") * 3_600_000_000))
    return due.where((F.col("_due") <= _at(now)) & (F.col("_made").isNull() | (F.col("_made") < F.col("_due")))).select("article_id", "hours")
