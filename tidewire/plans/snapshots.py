"""Frozen member sets of a version, named by their content, and the runs over them."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions import hashing
from tidewire.lineage import cut, tree_hash
from tidewire.plans.pairs import pair_decisions, ranked
from tidewire.sources.store import TableStore

MODES = ("INCREMENTAL", "BACKFILL", "REPROCESSING")


def ready_inputs(inputs: DataFrame, artifacts: DataFrame, watermark: Column) -> DataFrame:
    """Current, usable inputs with a ready vector and an effective time up to the watermark."""
    now = inputs.where("current_marker = 1 AND title_usability = 'USABLE' AND embedding_status = 'READY'").where(F.col("effective_at") <= watermark)
    return now.join(_ready(artifacts), "embedding_artifact_id")


def _ready(artifacts: DataFrame) -> DataFrame:
    return artifacts.where("status = 'READY' AND vector_bytes IS NOT NULL AND vector_hash IS NOT NULL").select(F.col("id").alias("embedding_artifact_id"), "vector_bytes", "vector_hash", "vector_norm")


def snapshot_vectors(members: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Stored members with the vectors that they were frozen with: by artifact and vector hash, so a changed vector is not taken."""
    return members.join(_ready(artifacts), ["embedding_artifact_id", "vector_hash"])


def member_text() -> Column:
    """What a member adds to the hash of its snapshot."""
    return F.concat(hashing.framed("article_ref", F.col("article_ref")), hashing.framed("effective_at", hashing.instant_text(F.col("effective_at"))), hashing.framed("fingerprint", F.col("article_input_fingerprint")), hashing.framed("vector", F.col("vector_hash")))


def snapshot(members: DataFrame, version_key: Column, watermark: Column) -> DataFrame:
    """members (article_ref, effective_at, article_input_fingerprint, vector_hash) -> one row: input_hash, members, snapshot_key.

    The members' texts are hashed in the order of time and reference as a tree of blocks, so no task sees all of them.
    """
    head = F.concat(hashing.framed("version", version_key), hashing.framed("watermark", hashing.instant_text(watermark)))
    top = tree_hash(members, [F.col("effective_at"), F.col("article_ref")], member_text())
    hashed = top.select(hashing.sha256(F.concat(head, F.col("hash"))).alias("input_hash"), F.col("rows").alias("members"))
    key = hashing.framed_hash(version=version_key, watermark=hashing.instant_text(watermark), input=F.col("input_hash"))
    return hashed.select("input_hash", "members", key.alias("snapshot_key"))


def run_key(version_key: Column, input_hash: Column, mode: str, rule: str = "pair-rule-v1") -> Column:
    if mode not in MODES:
        raise ValueError(f"no such mode: {mode}")
    return hashing.framed_hash(version=version_key, input=input_hash, mode=F.lit(mode), rule=F.lit(rule))


class SnapshotChanged(RuntimeError):
    """A snapshot's key is taken by other members."""


MEMBER = ["article_ref", "effective_at", "article_input_fingerprint", "embedding_artifact_id", "vector_hash"]


def freeze(tables: TableStore, members: DataFrame, version_key: str, watermark: Column) -> tuple[str, str, int, bool]:
    """Write the members of a snapshot once, under its key: (snapshot_key, input_hash, members, whether it is new).

    A key that is there already must hold the same members, as many and with the same hash; else it raises.
    """
    columns = [c for c in MEMBER if c in members.columns]
    kept = cut(members.select(*columns), "members")
    one = snapshot(kept, F.lit(version_key), watermark).first()
    key, input_hash, n = one["snapshot_key"], one["input_hash"], one["members"]
    fresh = tables.write_once("snapshot_members", key, kept)
    if not fresh:
        stored = tables.spark.read.parquet(tables.part("snapshot_members", key))
        again = snapshot(stored, F.lit(version_key), watermark).first()
        if (again["input_hash"], again["members"]) != (input_hash, n):
            raise SnapshotChanged(f"{key}: {again['members']} members are stored, {n} were to be frozen")
    row = tables.spark.range(1).select(F.lit(key).alias("snapshot_key"), F.lit(version_key).alias("version_key"), watermark.alias("watermark"), F.lit(input_hash).alias("input_hash"), F.lit(n).cast("long").alias("members"))
    tables.write_once("snapshots", key, row)
    return key, input_hash, n, fresh


class RunLedger:
    """Runs by key with fencing tokens, as small files of a shared folder that are only ever created, never changed.

    A claim creates the file of the next token, which only one of several claimants can. A run may be claimed if it is new,
    if its last claim has failed, or has neither ended nor been renewed within the time-out. Decisions go to a folder of
    run and token and count only when the file that completes this token, the last one, is there, so a claimant that was
    overtaken changes nothing that a reader sees.
    """

    def __init__(self, tables: TableStore, timeout: timedelta = timedelta(minutes=30)):
        self.tables, self.timeout = tables, timeout

    def _read(self, key: str) -> dict[str, dict]:
        return self.tables.small_files(f"runs/{key}")

    def state(self, key: str) -> dict | None:
        """What is known of a run: its last token, status RUNNING, COMPLETED or FAILED, and when it was claimed and ended."""
        files = self._read(key)
        claims = sorted(n for n in files if n.startswith("claim-"))
        if not claims:
            return None
        claim = files[claims[-1]]
        end = files.get(claims[-1].replace("claim-", "end-"), {})
        return claim | {"status": "RUNNING"} | end

    def claim(self, key: str, now: datetime, **about: str) -> int | None:
        """The token of a new claim, or None if the run is done, is held by another, or is claimed by another just now."""
        last = self.state(key)
        if last and (last["status"] == "COMPLETED" or last["status"] == "RUNNING" and now - datetime.fromisoformat(last["claimed_at"]) < self.timeout):
            return None
        token = last["token"] + 1 if last else 0
        made = {"run_key": key, "token": token, "claimed_at": now.isoformat()} | about
        return token if self.tables.create_small(f"runs/{key}/claim-{token:08d}", made) else None

    def persist(self, key: str, token: int, decided: DataFrame) -> bool:
        """Write the decisions of a claim; False if a later claim has taken the run over."""
        if not self.holds(key, token):
            return False
        self.tables.write_once(f"decisions/{key}", f"token-{token:08d}", decided)
        return self.holds(key, token)

    def holds(self, key: str, token: int) -> bool:
        last = self.state(key)
        return last is not None and last["token"] == token and last["status"] == "RUNNING"

    def finish(self, key: str, token: int, now: datetime, status: str = "COMPLETED", error: str | None = None) -> bool:
        """End a claim; False, and without effect, if it isn't the last one or has ended already."""
        if not self.holds(key, token) or not self.tables.create_small(f"runs/{key}/end-{token:08d}", {"status": status, "ended_at": now.isoformat(), "error": error and error[:4000]}):
            return False
        return self.state(key)["token"] == token

    def decisions(self, key: str) -> DataFrame | None:
        """The decisions of the completed claim of a run."""
        last = self.state(key)
        if last is None or last["status"] != "COMPLETED":
            return None
        return self.tables.spark.read.parquet(self.tables.part(f"decisions/{key}", f"token-{last['token']:08d}"))

    def runs(self) -> DataFrame:
        """All runs as a table: run_key, snapshot_key, version_key, mode, status, token, claimed_at, ended_at, error."""
        found = [self.state(k) for k in self.tables.names("runs")]
        stamp = lambda x: None if x is None else datetime.fromisoformat(x)
        rows = [(r["run_key"], r.get("snapshot_key"), r.get("version_key"), r.get("mode"), r["status"], r["token"], stamp(r["claimed_at"]), stamp(r.get("ended_at")), r.get("error")) for r in found if r]
        return self.tables.spark.createDataFrame(rows, RUNS)


RUNS = "run_key STRING, snapshot_key STRING, version_key STRING, mode STRING, status STRING, token BIGINT, claimed_at TIMESTAMP, ended_at TIMESTAMP, error STRING"


def oldest_retryable(runs: DataFrame, snapshots: DataFrame, version_key: Column, now: Column, timeout_seconds: int = 1800) -> DataFrame:
    """One row at most: of a version's runs that failed, or run for too long, the one with the oldest watermark (then key), with its snapshot."""
    stale = (F.col("status") == "RUNNING") & (F.unix_micros("claimed_at") <= F.unix_micros(now) - timeout_seconds * 1_000_000)
    due = runs.where((F.col("version_key") == version_key) & ((F.col("status") == "FAILED") | stale))
    return due.join(snapshots.select("snapshot_key", "watermark", "input_hash", "members"), "snapshot_key").orderBy("watermark", "run_key").limit(1)


def operations_view(snapshots: DataFrame, members: DataFrame, runs: DataFrame) -> DataFrame:
    """A row per snapshot: members stored, runs, those completed, latest status by claim time; zeros where there is none."""
    stored = members.groupBy("snapshot_key").agg(F.count_distinct("article_ref").alias("stored_members"))
    ran = runs.groupBy("snapshot_key").agg(F.count_distinct("run_key").alias("runs"), F.count_if(F.col("status") == "COMPLETED").alias("completed"), F.max_by("status", F.struct("claimed_at", "run_key")).alias("latest_status"))
    out = snapshots.join(stored, "snapshot_key", "left").join(ran, "snapshot_key", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("stored_members", "runs", "completed")})


def run_snapshot(tables: TableStore, ledger: RunLedger, version, members: DataFrame, watermark: Column, now: datetime, mode: str = "INCREMENTAL") -> str:
    """Freeze, claim, decide, persist, complete: REUSED, COMPLETED, or OVERTAKEN if a later claim took the run over.

    A failure ends the claim as FAILED, with its message, and is raised again.
    """
    key, input_hash, _, _ = freeze(tables, members, version.version_key, watermark)
    run = tables.spark.range(1).select(run_key(F.lit(version.version_key), F.lit(input_hash), mode).alias("k")).first()["k"]
    token = ledger.claim(run, now, snapshot_key=key, version_key=version.version_key, mode=mode)
    if token is None:
        return "REUSED"
    try:
        decided = ranked(pair_decisions(members, version.window_hours, version.threshold))
        kept = ledger.persist(run, token, decided)
    except Exception as e:
        ledger.finish(run, token, now, "FAILED", f"{type(e).__name__}: {e}")
        raise
    return "COMPLETED" if kept and ledger.finish(run, token, now) else "OVERTAKEN"


def each_version(versions, work) -> dict[str, str]:
    """Runs work(version) for each; one that fails doesn't stop the others: version key -> COMPLETED, or FAILED with the error."""
    out = {}
    for v in versions:
        try:
            v.validate()
            work(v)
            out[v.version_key] = "COMPLETED"
        except Exception as e:  # isolation is the point: the outcome holds what went wrong
            out[v.version_key] = f"FAILED: {e}"[:4000]
    return out
