"""Staging, extraction, search, retention, windows, pairs and stories on small fixtures."""

import hashlib
import io
import json
import random
import re
import zipfile
from collections import Counter
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewire import lineage, schemas
from tidewire.operators import extraction, health, retention, search, staging, views
from tidewire.plans import clusters, evaluation, inputs, pairs, quality, snapshots
from tidewire.queries import QUERIES
from tidewire.sources import archives, embedder, files, masterfile, store
from tidewire.streaming import jobs, tumbling

BASE = datetime(2026, 7, 5, 12)


def now():
    return F.lit("2026-07-05 13:00:00").cast("timestamp")


def payload(spark, rows):
    return spark.createDataFrame([(i, 1, "f", BASE, i, raw, BASE) for i, raw in enumerate(rows, 1)], schemas.PAYLOADS)


def cells(n, **at):
    row = [""] * n
    for k, v in at.items():
        row[int(k[1:])] = v
    return "\t".join(row)


EVENT = cells(61, c0="123", c1="20260705", c5="USA", c26="042", c29="1", c30="-2.5", c34="-1.25", c60="https://example.org/a")
MENTION = cells(16, c0="123", c1="20260705120000", c2="20260705121500", c3="1", c4="example.org", c5="https://example.org/a", c11="80", c13="-1.5")
GKG = cells(27, c0="20260705120000-1", c1="20260705120000", c2="1", c4="https://example.org/a", c7="A;B;A", c9="1#Berlin#GM#GM16#52.5#13.4#-1", c11="Jane Doe", c15="-1.5,2,3,4,5,6,7", c18="https://i.example/x.png", c26="<PAGE_TITLE>A &amp; B</PAGE_TITLE>")


def test_stage_events_and_errors(spark):
    good, bad = staging.stage(payload(spark, [EVENT, "bad\trow", EVENT.replace("\t1\t", "\tno\t", 1), cells(61, c1="20260705")]), "EVENTS", now())
    row = good.collect()
    assert len(row) == 1 and row[0]["global_event_id"] == 123 and row[0]["quad_class"] == 1 and row[0]["avg_tone"] == -1.25
    assert {(r["source_row_id"], r["error_code"]) for r in bad.collect()} == {(2, "COLUMN_COUNT"), (3, "INVALID_NUMBER"), (4, "REQUIRED_FIELD")}


def test_stage_mentions_and_gkg(spark):
    assert staging.stage(payload(spark, [MENTION]), "MENTIONS", now())[0].first()["confidence"] == 80
    g = staging.stage(payload(spark, [GKG]), "GKG", now())[0].first()
    assert g["page_title"] == "A & B" and g["themes"] == ["A", "B"] and g["tone_word_count"] == 7 and g["main_image_source"] == "GKG_SHARING_IMAGE" and len(g["locations"]) == 1


def test_backoff_and_resolution(spark):
    files = spark.createDataFrame([(1, "EVENTS", "f", "u", BASE, "c", "COMPLETED", 1, BASE, BASE, None)], schemas.IMPORT_FILES)
    rows = payload(spark, [EVENT, "bad"])
    empty = spark.createDataFrame([], schemas.EVENTS)
    no_errors = spark.createDataFrame([], schemas.PROCESSING_ERRORS)
    first = staging.pending(rows, files, empty, no_errors, "EVENTS", now())
    good, bad = staging.stage(first, "EVENTS", now())
    errors = no_errors.unionByName(bad, allowMissingColumns=True)
    assert staging.pending(rows, files, good, errors, "EVENTS", now()).count() == 0
    assert staging.pending(rows, files, good, errors, "EVENTS", now(), retry_seconds=-1).count() == 1
    fixed = good.unionByName(staging.stage(payload(spark, [EVENT, EVENT]), "EVENTS", now())[0].where("id = 2"))
    assert staging.resolved(errors, fixed, "EVENTS", now()).where("resolved_at IS NOT NULL").count() == 1


def signal(spark, schema, column, rows):
    names = spark.createDataFrame([], schema).columns
    df = spark.createDataFrame(rows, f"id BIGINT, source_timestamp TIMESTAMP, {column} STRING, article_id BIGINT")
    return spark.createDataFrame([], schema).unionByName(df, allowMissingColumns=True).select(*names)


def test_extraction_is_idempotent(spark):
    t = lambda m: BASE + timedelta(minutes=m)
    e = signal(spark, schemas.EVENTS, "source_url", [(1, t(0), "https://example.org/a", None)])
    m = signal(spark, schemas.MENTIONS, "mention_identifier", [(1, t(-15), "https://EXAMPLE.org/a/", None), (2, t(5), "https://example.org/a?utm_source=x", None)])
    g = signal(spark, schemas.GKG, "document_identifier", [(1, t(5), "https://example.org/a#x", None), (2, t(5), "not a url", None)])
    none, no_errors = spark.createDataFrame([], schemas.ARTICLES), spark.createDataFrame([], schemas.EXTRACTION_ERRORS)
    out = extraction.extract(extraction.unlinked(extraction.signals(e, m, g), no_errors), none, now())
    article = out["articles"].collect()
    assert len(article) == 1 and article[0]["id"] == 1 and article[0]["first_seen_at"] == t(-15)
    assert out["links"].count() == 4 and [r["error_code"] for r in out["errors"].collect()] == ["INVALID_URL"]
    linked = [extraction.linked(df, out["links"], n) for n, df in zip(schemas.DATASETS, (e, m, g))]
    again = extraction.unlinked(extraction.signals(*linked), out["errors"])
    assert again.count() == 0
    later = extraction.extract(again, out["articles"], now())
    assert later["articles"].count() == 1 and later["links"].count() == 0
    assert health.pending_signals(extraction.signals(*linked), out["errors"]).collect() == [("EVENTS", 0), ("MENTIONS", 0), ("GKG", 0)]


def test_search_and_detail(spark):
    t = lambda m: BASE + timedelta(minutes=m)
    articles = spark.createDataFrame([(1, "u1", "h1", "alpha.example", t(0), t(0), t(0)), (2, "u2", "h2", "alpha.example", t(15), t(0), t(0)), (3, "u3", "h3", "beta.example", t(15), t(0), t(0))], schemas.ARTICLES)
    gkg = spark.createDataFrame([(1, t(15), "Climate 100% talk", 1, ["CLIMATE"]), (2, t(20), None, 2, ["CLIMATE_CHANGE", "B"]), (3, t(0), "Other", None, ["B"])], "id BIGINT, source_timestamp TIMESTAMP, page_title STRING, article_id BIGINT, themes ARRAY<STRING>")
    gkg = spark.createDataFrame([], schemas.GKG).unionByName(gkg, allowMissingColumns=True)
    events = signal(spark, schemas.EVENTS, "source_url", [(1, t(15), "u", 1)])
    mentions = signal(spark, schemas.MENTIONS, "mention_identifier", [(1, t(15), "u", 1)])
    rows, total = search.search(articles, events, mentions, gkg, limit=2)
    assert [r["id"] for r in rows.collect()] == [3, 2] and total.first()["total"] == 3
    assert [r["id"] for r in search.page(articles, offset=2, limit=2).collect()] == [1]
    found = lambda **k: [r["id"] for r in search.matching(articles, search.Criteria(**k), events, mentions, gkg).collect()]
    assert found(theme="CLIMATE") == [1] and found(q="100%") == [1] and found(q="100_") == [] and found(signal_type="EVENTS", domain="alpha.example") == [1]
    _, signals = search.detail(articles, events, mentions, gkg, 1)
    assert [r["signal_type"] for r in signals.collect()] == ["EVENTS", "MENTIONS", "GKG"]
    assert search.top_domains(articles, 2).collect() == [("alpha.example", 2), ("beta.example", 1)]
    assert search.top_themes(gkg, 3).collect() == [("B", 2), ("CLIMATE", 1), ("CLIMATE_CHANGE", 1)]
    summary = {r["id"]: r for r in views.signal_summary(articles, views.linked_signals(events, mentions, gkg)).collect()}
    assert (summary[1]["signal_count"], summary[1]["events_count"], summary[3]["signal_count"], summary[3]["first_signal_at"]) == (3, 1, 0, None)


def test_retention_batches(spark):
    p = spark.createDataFrame([(i,) for i in range(1, 5)], "id BIGINT")
    d = spark.createDataFrame([(1, BASE), (2, BASE + timedelta(hours=1)), (3, BASE + timedelta(days=9))], "id BIGINT, parsed_at TIMESTAMP")
    cutoff = F.lit("2026-07-06 00:00:00").cast("timestamp")
    assert retention.health(p, d, cutoff).first() == (2, 2)
    gone = []
    while True:
        batch = retention.eligible(retention.remaining(p, spark.createDataFrame([(x,) for x in gone], "id BIGINT")), d, cutoff, 1).collect()
        if not batch:
            break
        gone += [r["id"] for r in batch]
    assert gone == [1, 2]
    with pytest.raises(ValueError):
        retention.validate_period(timedelta(0))


def test_windows(spark):
    names = ["20260605113000.export.CSV.zip", "20260605113000.mentions.CSV.zip", "20260605113000.gkg.csv.zip", "20260605121500.export.CSV.zip", "20260605120000.translation.export.CSV.zip", "20260605120000.gkg.CSV.zip"]
    texts = [f"1 abc http://z/{n}" for n in names] + [f"1 abc http://a/{n}" for n in names[:1]] + ["", "malformed", "1 a not-a-file.zip"]
    lines = spark.createDataFrame(list(enumerate(texts)), "line BIGINT, value STRING")
    rows = masterfile.complete_windows(masterfile.files(lines)).collect()
    assert [r["source_timestamp"] for r in rows] == [datetime(2026, 6, 5, 11, 30)] and len(rows[0]["files"]) == 3
    assert rows[0]["files"]["EVENTS"] == f"http://a/{names[0]}" and rows[0]["files"]["GKG"] == f"http://z/{names[2]}"  # the last line counts


def test_archives(spark, tmp_path):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("a.csv", "x\ty\n\nlast")
    (tmp_path / "20260605113000.export.CSV.zip").write_bytes(buffer.getvalue())
    (tmp_path / "broken.zip").write_bytes(b"nothing")
    rows = archives.payload_lines(archives.read_archives(spark, str(tmp_path))).collect()
    assert sorted((r["row_number"], r["raw_tsv"]) for r in rows if r["error"] is None) == [(1, "x\ty"), (2, ""), (3, "last")]
    assert sum(r["error"] is not None for r in rows) == 1


def members(spark):
    v = {"a": (1.0, 0.0), "b": (0.8, 0.6), "c": (0.0, 1.0), "d": (-1.0, 0.0)}
    rows = [(k, BASE, list(x)) for k, x in v.items()] + [("e", BASE + timedelta(hours=25), [0.0, -1.0])]
    return spark.createDataFrame(rows, "article_ref STRING, effective_at TIMESTAMP, vector ARRAY<DOUBLE>")


def test_pair_decisions(spark):
    scored = pairs.scored_pairs(members(spark), 24)
    assert scored.count() == 6
    d = pairs.ranked(pairs.decisions(scored, 0.70)).orderBy("decision_rank").collect()
    assert [(r["left_ref"], r["right_ref"], str(r["similarity"]), r["decision_rank"], r["result"]) for r in d] == [("a", "b", "0.800000", 1, "SAME_STORY"), ("b", "c", "0.600000", 2, "UNCERTAIN"), ("c", "d", "0.000000", 3, "UNCERTAIN")]
    close = clusters.medoid_clusters(members(spark), scored.where("similarity >= 0.7"), 0.70, 24).collect()
    assert sorted((r["article_ref"], r["size"]) for r in close) == [("a", 2), ("b", 2), ("c", 1), ("d", 1), ("e", 1)]


def test_lineage(spark):
    old = spark.createDataFrame([("s1", BASE, "a", "a"), ("s1", BASE, "a", "b"), ("s2", BASE + timedelta(1), "c", "c")], "story_id STRING, created_at TIMESTAMP, anchor_ref STRING, article_ref STRING")
    merged = clusters.lineage(old, spark.createDataFrame([("x", r) for r in "abc"], "cluster_ref STRING, article_ref STRING"), "v").collect()
    assert sorted((r["story_id"], r["action"]) for r in merged) == [("s1", "EXTEND"), ("s2", "MERGE")]
    split = clusters.lineage(old, spark.createDataFrame([("x", "a"), ("y", "b"), ("z", "c"), ("w", "n")], "cluster_ref STRING, article_ref STRING"), "v").collect()
    assert {(r["cluster_ref"], r["action"]) for r in split} == {("x", "EXTEND"), ("y", "SPLIT"), ("z", "EXTEND"), ("w", "CREATE")}


def test_scd2_reactivates(spark):
    history = spark.createDataFrame([(1, "a", "f1", None, BASE, BASE), (1, "a", "f2", 1, BASE, None)], "clustering_version_id BIGINT, article_ref STRING, article_input_fingerprint STRING, current_marker SMALLINT, created_at TIMESTAMP, superseded_at TIMESTAMP")
    wanted = spark.createDataFrame([(1, "a", "f1")], "clustering_version_id BIGINT, article_ref STRING, article_input_fingerprint STRING")
    out = {r["article_input_fingerprint"]: r for r in inputs.synchronised(history, wanted, now()).collect()}
    assert len(out) == 2 and out["f1"]["current_marker"] == 1 and out["f1"]["superseded_at"] is None and out["f2"]["current_marker"] is None and out["f2"]["superseded_at"] is not None


def test_evaluation(spark):
    p = spark.createDataFrame([("p1", "a", "b", "SAME", "evaluation"), ("p2", "b", "c", "DIFFERENT", "evaluation"), ("p3", "a", "c", "UNCERTAIN", "evaluation")], "id STRING, left STRING, right STRING, label STRING, split STRING")
    q = spark.createDataFrame([("p1", True, True, 0.9), ("p2", True, True, 0.8), ("p3", False, False, 0.1)], "pairId STRING, sameStory BOOLEAN, candidate BOOLEAN, score DOUBLE")
    metrics, merges = evaluation.evaluate(p, q, "evaluation")
    m = metrics.first()
    assert (m["precision"], m["recall"], m["uncertain"]) == (0.5, 1.0, 1) and [r["id"] for r in merges.collect()] == ["p2"]
    with pytest.raises(ValueError):
        evaluation.evaluate(p, q.where("pairId != 'p1'"), "evaluation")


CORPUS = (
    "ref STRING, urlHash STRING, canonicalUrl STRING, domain STRING, title STRING, titleInputHash STRING, firstSeenAt STRING",
    "id STRING, left STRING, right STRING, label STRING, split STRING, category STRING, rationale STRING, hardNegative BOOLEAN, verification STRUCT<method: STRING, checkedAt: STRING, evidence: ARRAY<STRING>>",
    "id STRING, split STRING, articleRefs ARRAY<STRING>, rationale STRING",
)


def test_corpus_rules(spark):
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    art = lambda r, t="A  title &amp;": (r, sha(r), "u", "d", t, sha(" ".join(t.split())), "2026")
    fine = ("m", "2026", ["e"])
    good = [art("a"), art("b"), art("c")]
    pair = ("p1", "a", "b", "SAME_STORY", "evaluation", "c", "r", False, fine)
    story = ("s", "evaluation", ["a", "b", "c"], "r")
    frame = lambda *rows: [spark.createDataFrame(list(r), schema) for r, schema in zip(rows, CORPUS)]
    rules = lambda *rows, minimum=False: {r["rule"] for r in evaluation.corpus_violations(*frame(*rows), minimum=minimum).collect()}
    assert rules(good, [pair], [story]) == set()
    assert rules(good, [pair], [story], minimum=True) == {"few_definite", "few_same", "few_hard_negative", "few_stories"}
    articles = [*good, good[0], ("d", "XY", "u", "d", "t", "no", None)]
    pairs_ = [
        pair, pair, ("p2", "b", "a", "X", "other", "", "r", None, None), ("p3", "a", "a", "UNCERTAIN", "calibration", "c", "r", None, ("m", "d", [])), ("p4", "a", "zz", "SAME_STORY", "evaluation", "c", "r", None, fine),
    ]
    stories = [story, ("s", "x", ["a"], "r"), ("t", "calibration", ["b", "yy", "c"], None)]
    assert rules(articles, pairs_, stories) == {
        "missing_firstSeenAt", "duplicate_article", "duplicate_url_hash", "bad_url_hash", "title_hash_mismatch", "duplicate_pair", "repeated_ends", "bad_label", "bad_split", "missing_category", "missing_verification", "missing_verification_method",
        "missing_verification_checkedAt", "missing_verification_evidence", "self_pair", "unknown_article", "split_leakage", "duplicate_story", "bad_story_split", "small_story", "unknown_story_article", "article_in_several_stories", "story_split_mismatch", "missing_rationale",
    }


def test_corpus_build_and_strata(spark):
    rows = [(f"r{s}{i}", f"Story {s}!", f"d{i % 4}", f"{i}{s}") for s in "abc" for i in range(5)]
    articles = spark.createDataFrame(rows, "ref STRING, title STRING, domain STRING, url_hash STRING")
    stories = spark.createDataFrame([(f"story-{s}", f"story {s}", "evaluation") for s in "abc"], "story_id STRING, title_key STRING, split STRING")
    chosen = evaluation.story_articles(articles, stories)
    assert sorted(r["ref"] for r in chosen.collect()) == sorted(f"r{s}{i}" for s in "abc" for i in range(3))
    hard = spark.createDataFrame([("story-b", "story-a", "near")], "first STRING, second STRING, category STRING")
    reviewed = spark.createDataFrame([("ra0", "x", "UNCERTAIN", "evaluation", "odd")], "left STRING, right STRING, label STRING, split STRING, category STRING")
    out = evaluation.corpus_pairs(chosen, hard, reviewed, {"evaluation": 7}).collect()
    kinds = Counter((r["label"], r["category"], r["hardNegative"]) for r in out)
    assert kinds == {("SAME_STORY", "syndicated", False): 9, ("DIFFERENT_STORY", "near", True): 9, ("DIFFERENT_STORY", "clear-negative-control", False): 7, ("UNCERTAIN", "odd", False): 1}
    assert {(r["left"], r["right"]) for r in out if r["category"] == "clear-negative-control"} == {(f"ra{i}", f"rc{j}") for i, j in [(0, 0), (0, 1), (0, 2), (1, 0), (1, 1), (1, 2), (2, 0)]}
    a = spark.createDataFrame([("a", "Straße one two", "d", BASE, [1], ["P"], []), ("b", "STRASSE one two", "d", BASE + timedelta(hours=1), [1], ["P"], None), ("c", "else where", "e", BASE, [], ["P"], [])], "ref STRING, title STRING, domain STRING, at TIMESTAMP, event_ids ARRAY<BIGINT>, persons ARRAY<STRING>, organizations ARRAY<STRING>")
    p = spark.createDataFrame([("a", "b", 0.6), ("a", "c", 0.9), ("b", "c", 0.2)], "left STRING, right STRING, cosine DOUBLE")
    signals = evaluation.candidate_signals(p, a)
    one = signals.where("left = 'a' and right = 'b'").first()
    assert (one["lexical"], one["hours_apart"], one["same_domain"], one["same_title"], one["shared_events"], one["shared_organizations"]) == (1.0, 1.0, True, True, [1], [])
    strata = {(r["left"] + r["right"], r["stratum"]) for r in evaluation.candidate_strata(signals, 5).collect()}
    assert strata == {("ab", "conflict"), ("ab", "overlap"), ("ab", "low_positive"), ("ac", "hard"), ("ac", "conflict")}


def test_lexical_candidates(spark):
    rng = random.Random(2)
    rows = [(f"r{i:02d}", BASE + timedelta(hours=rng.randrange(60)), " ".join(rng.choice(["Eins", "zwei", "STRASSE", "straße", "vier"]) for _ in range(rng.randrange(4))), hashlib.sha256(str(i).encode()).hexdigest()) for i in range(40)]
    corpus = {r[0] for r in rows[::3]}
    words = {r[0]: set(re.findall(r"[^\W_]+", r[2].casefold())) for r in rows}
    want = {}
    for ref, at, _, _ in rows:
        near = [(o, tie) for o, t, _, tie in rows if o != ref and abs(t - at) <= timedelta(hours=24)]
        score = lambda o: len(words[ref] & words[o]) / len(words[ref] | words[o]) if words[ref] | words[o] else 0.0
        for rank, (o, _) in enumerate(sorted(near, key=lambda x: (-score(x[0]), x[1]))[:4], 1):
            if ref in corpus and o in corpus:
                pair = tuple(sorted((ref, o)))
                want[pair] = min(want.get(pair, (rank, score(o))), (rank, score(o)))
    df = spark.createDataFrame(rows, "ref STRING, at TIMESTAMP, title STRING, tie STRING")
    got = evaluation.lexical_top(df, 24, 4, spark.createDataFrame([(r,) for r in corpus], "ref STRING")).collect()
    assert {(r["left"], r["right"]): (r["rank"], r["similarity"]) for r in got} == want


def test_medoid_clusters_against_brute_force(spark):
    rng = np.random.default_rng(3)
    for seed in range(3):
        x = rng.normal(size=(3, 6))[rng.integers(0, 3, 24)] + rng.normal(size=(24, 6)) * 0.5
        rows = [(f"a{i:02d}", BASE + timedelta(hours=int(rng.integers(60))), [float(v) for v in x[i]]) for i in range(24)]
        df = spark.createDataFrame(rows, "article_ref STRING, effective_at TIMESTAMP, vector ARRAY<DOUBLE>")
        got = {r["article_ref"]: r["medoid_ref"] for r in clusters.medoid_clusters(df, pairs.scored_pairs(df, 48).where("similarity >= 0.7"), 0.7, 48).collect()}
        order = sorted(rows, key=lambda r: (r[1], r[0]))
        unit = np.array([r[2] for r in order])
        unit /= np.linalg.norm(unit, axis=1, keepdims=True)
        sim = np.floor(np.clip(unit @ unit.T, -1, 1) * 1e6 + 0.5) / 1e6
        near = lambda i, j: abs(order[i][1] - order[j][1]) <= timedelta(hours=48)
        own, medoid, rejected = {i: [i] for i in range(24)}, {i: i for i in range(24)}, set()
        while True:
            options = [(-sim[medoid[a], medoid[b]], a, b) for a in own for b in own if a < b and (a, b) not in rejected and sim[medoid[a], medoid[b]] >= 0.7 and near(medoid[a], medoid[b])]
            if not options:
                break
            _, a, b = min(options)
            joint = sorted(own[a] + own[b])
            new = max(joint, key=lambda m: (round((sum(sim[m, j] for j in joint) - 1) / max(1, len(joint) - 1), 12), -m))
            if all(j == new or sim[new, j] >= 0.7 and near(new, j) for j in joint):
                own[a], medoid[a] = joint, new
                del own[b], medoid[b]
                rejected = {r for r in rejected if a not in r and b not in r}
            else:
                rejected.add((a, b))
        assert got == {order[m][0]: order[medoid[c]][0] for c, ms in own.items() for m in ms}


def test_preselected_pairs_decide_like_all_pairs(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(10, 8))[rng.integers(0, 10, 300)] + rng.normal(size=(300, 8)) * 0.4
    df = spark.createDataFrame([(f"a{i:03d}", BASE + timedelta(minutes=int(rng.integers(6000))), [float(v) for v in x[i]]) for i in range(300)], "article_ref STRING, effective_at TIMESTAMP, vector ARRAY<DOUBLE>")
    flat = lambda d: sorted((r["left_ref"], r["right_ref"], r["similarity"], r["result"]) for r in d.collect())
    chosen = pairs.preselected_pairs(df, 24, 0.7, block_rows=16)
    assert flat(pairs.decisions(pairs.scored_selection(df, chosen), 0.7)) == flat(pairs.decisions(pairs.scored_pairs(df, 24), 0.7))
    assert chosen.count() < pairs.scored_pairs(df, 24).count() == pairs.window_pairs(df, 24).first()["compared"]


def test_order_over_ranges(spark):
    rng = random.Random(1)
    values = [(rng.randrange(50), i, rng.randrange(9)) for i in range(500)]
    df = spark.createDataFrame(values, "a INT, b INT, m INT").repartition(7)
    got = {(r["a"], r["b"]): (r["n"], r["s"]) for r in lineage.running(df, [F.col("a"), -F.col("b")], {"n": F.lit(1).cast("long"), "s": F.col("m")}).collect()}
    total, want = 0, {}
    for n, (a, b, m) in enumerate(sorted(values, key=lambda v: (v[0], -v[1])), 1):
        total += m
        want[a, b] = (n, total)
    assert got == want
    texts = [f"t{i}" for i in range(23)]
    sha = lambda parts: hashlib.sha256("".join(parts).encode()).hexdigest()
    level = texts
    while True:
        level = [sha(level[i : i + 4]) for i in range(0, len(level), 4)]
        if len(level) == 1:
            break
    df = spark.createDataFrame(list(enumerate(texts)), "i INT, t STRING").repartition(3)
    assert lineage.tree_hash(df, [F.col("i")], F.col("t"), 4).first() == (level[0], 23)
    assert lineage.tree_hash(df.limit(0), [F.col("i")], F.col("t"), 4).first() == (sha([]), 0)


def test_snapshots_runs_and_fencing(spark, tmp_path):
    tables = store.TableStore(spark, str(tmp_path))
    water = F.lit("2027-01-01 00:00:00").cast("timestamp")
    m = members(spark).withColumns({"article_input_fingerprint": F.col("article_ref"), "vector_hash": F.col("article_ref")})
    key, _, n, new = snapshots.freeze(tables, m, "v", water)
    assert n == 5 and new and snapshots.freeze(tables, m, "v", water)[3] is False
    m.limit(2).select("article_ref", "effective_at", "article_input_fingerprint", "vector_hash").write.mode("overwrite").parquet(tables.part("snapshot_members", key))
    with pytest.raises(snapshots.SnapshotChanged):
        snapshots.freeze(tables, m, "v", water)
    one, other = snapshots.RunLedger(tables), snapshots.RunLedger(store.TableStore(spark, str(tmp_path)))
    assert one.claim("k", BASE) == 0 and other.claim("k", BASE) is None
    assert tables.create_small("other/x/claim-0", {"token": 0}) and not tables.create_small("other/x/claim-0", {"token": 9})
    late = BASE + timedelta(hours=1)
    assert other.claim("k", late) == 1  # the first holder has timed out, and restarted ledgers know it
    decided = spark.createDataFrame([("a", "b")], "left_ref STRING, right_ref STRING")
    assert not one.persist("k", 0, decided) and not one.finish("k", 0, late) and one.decisions("k") is None
    assert other.persist("k", 1, decided) and other.finish("k", 1, late) and not other.finish("k", 1, late)
    assert snapshots.RunLedger(tables).claim("k", late + timedelta(days=9)) is None and one.decisions("k").count() == 1
    assert one.claim("f", BASE) == 0 and one.finish("f", 0, BASE, "FAILED", "why") and one.state("f")["error"] == "why" and other.claim("f", BASE) == 1
    states = {r["run_key"]: (r["status"], r["token"]) for r in one.runs().collect() if r["run_key"]}
    assert states["k"] == ("COMPLETED", 1) and states["f"] == ("RUNNING", 1)


def test_provider_contract():
    at = datetime(2026, 1, 1, tzinfo=timezone.utc)
    body = json.dumps({"data": [{"index": 1, "embedding": [2.0]}, {"index": 0, "embedding": [1.0]}]})
    assert embedder.parse_response(200, {}, body, 2, at) == [[1.0], [2.0]]
    seen = {}
    for status in (400, 408, 409, 429, 500, 503):
        with pytest.raises(embedder.EmbeddingFailed) as e:
            embedder.parse_response(status, {"Retry-After": "7"}, '{"error": {"code": "c", "message": "m"}}' if status == 400 else "<html>", 2, at)
        seen[status] = (e.value.code, e.value.retryable, e.value.retry_after)
    assert seen == {400: ("c", False, None), 408: ("HTTP_408", True, None), 409: ("HTTP_409", True, None), 429: ("HTTP_429", True, 7), 500: ("HTTP_500", True, None), 503: ("HTTP_503", True, None)}
    with pytest.raises(embedder.EmbeddingFailed, match="2 of 3"):
        embedder.parse_response(200, {}, body, 3, at)
    assert embedder.retry_after_seconds("Thu, 01 Jan 2026 00:01:00 GMT", at) == 60 and embedder.retry_after_seconds("Thu, 01 Jan 2025 00:01:00 GMT", at) == 0 and embedder.retry_after_seconds("soon", at) is None
    assert json.loads(embedder.request_body("m", ["a"], 3)) == {"model": "m", "input": ["a"], "encoding_format": "float", "dimensions": 3}

    def late(_):
        raise TimeoutError

    with pytest.raises(embedder.EmbeddingFailed) as e:
        embedder.TransportEmbedder(late, "m").embed(["a"], 1)
    assert e.value.code == "TIMEOUT" and e.value.retryable


def test_vector_cache(spark, tmp_path):
    texts = spark.createDataFrame([("1", "one"), ("2", "two")], "key STRING, text STRING")
    path = f"file://{tmp_path}/cache"
    first = {r["key"]: r["vector"] for r in embedder.cached_vectors(spark, path, texts, "m", 8).collect()}
    assert {r["key"]: r["vector"] for r in embedder.cached_vectors(spark, path, texts, "m", 8).collect()} == first
    for other, model in ((texts, "n"), (texts.limit(1), "m"), (texts.withColumn("text", F.lit("x")), "m")):
        with pytest.raises(embedder.CacheMismatch):
            embedder.cached_vectors(spark, path, other, model, 8)


def test_request_facade(spark):
    a = spark.createDataFrame([(1, "u", "h", "d.example", BASE, BASE, BASE)], schemas.ARTICLES)
    e, m, g = (spark.createDataFrame([], x) for x in (schemas.EVENTS, schemas.MENTIONS, schemas.GKG))
    f = search.Facade(a, e, m, g)
    rows, total = f.latest_articles(domain="d.example", limit="5")
    assert rows.count() == 1 and total.first()["total"] == 1 and f.article_detail("1")[0].count() == 1 and f.top_domains("1").count() == 1 and f.top_themes().count() == 0
    for bad in ({"page": "1"}, {"limit": "x"}, {"limit": "0"}, {"direction": "DESC"}, {"firstSeenFrom": "today"}):
        with pytest.raises(search.InvalidRequest):
            f.latest_articles(**bad)
    with pytest.raises(search.NotFound):
        f.article_detail("2")
    errors = [spark.createDataFrame([], x) for x in (schemas.EXTRACTION_ERRORS, schemas.PROCESSING_ERRORS)]
    assert f.extraction_health(*errors)["pending"].count() == 3


def test_observed_metrics(spark):
    df, o = health.observed(spark.range(10), "metrics", rows=F.count(F.lit(1)), big=F.count_if(F.col("id") > 6))
    assert df.count() == 10 and o.get == {"rows": 10, "big": 3}


def test_files(spark, tmp_path):
    (tmp_path / "p.csv").write_text("pair_id,label,left_article_id,right_article_id,category,languages,rationale\nx,positive,1,2,c,en,why\ny,hard_negative,1,9,c,en,why\n")
    rows = files.read_labelled_pairs(spark, f"file://{tmp_path}/p.csv")
    articles = spark.createDataFrame([(1, "a"), (2, "b")], "id BIGINT, title STRING")
    assert {(r["pair_id"], r["missing"]) for r in files.labelled_with_articles(rows, articles).collect()} == {("x", None), ("y", "right")}
    pair = {"id": "p", "left": "a", "right": "b", "label": "SAME_STORY", "split": "evaluation", "verification": {"method": "m", "evidence": ["e"]}}
    (tmp_path / "c.json").write_text(json.dumps({"schemaVersion": "1.0", "articles": [{"ref": "a", "title": "t"}], "pairs": [pair], "referenceStories": [{"id": "s", "articleRefs": ["a"]}]}, indent=1))
    c = files.read_corpus(spark, f"file://{tmp_path}/c.json").first()
    assert c["articles"][0]["ref"] == "a" and c["pairs"][0]["verification"]["evidence"] == ["e"] and c["referenceStories"][0]["articleRefs"] == ["a"]
    files.write_json(spark.createDataFrame([([("p", True, True, 0.5)],)], files.PREDICTIONS), f"file://{tmp_path}/q.json")
    assert files.read_predictions(spark, f"file://{tmp_path}/q.json").collect() == [("p", True, True, 0.5)]


def test_scheduled_jobs(spark, tmp_path):
    def zipped(name, *lines):
        with zipfile.ZipFile(tmp_path / name, "w") as z:
            z.writestr("x.csv", "".join(x + "\n" for x in lines))

    urls = []
    for stamp_ in ("20260705113000", "20260705114500"):
        zipped(f"{stamp_}.export.CSV.zip", EVENT, "bad\trow")
        zipped(f"{stamp_}.mentions.CSV.zip", MENTION)
        zipped(f"{stamp_}.gkg.csv.zip", GKG, GKG.replace("example.org/a", "example.org/b").replace("A &amp; B", "A &amp; C"))
        urls += [f"http://x/{stamp_}.{s}" for s in ("export.CSV.zip", "mentions.CSV.zip", "gkg.csv.zip")]
    (tmp_path / "list.txt").write_text("".join(f"1 abc {u}\n" for u in urls))
    tables = store.TableStore(spark, str(tmp_path / "lake"))
    at = lambda h: BASE + timedelta(hours=h)
    done = jobs.ingestion(tables, str(tmp_path / "list.txt"), lambda u: f"file://{tmp_path}/{u.rsplit('/', 1)[1]}", at(0))
    assert list(done.values()) == ["COMPLETED"] * 2
    assert jobs.stage_all(tables, at(1), rows=1) == {"EVENTS": 4, "MENTIONS": 2, "GKG": 4}
    assert tables.read("events").count() == 2 and tables.read("processing_errors").where("resolved_at IS NULL").count() == 2
    assert jobs.extract_all(tables, at(2)) == 8 and jobs.extract_all(tables, at(2)) == 0
    articles = tables.read("articles").collect()
    assert len(articles) == 2 and tables.read("events").where("article_id IS NULL").count() == 0
    versions = inputs.VERSIONS[:1]
    assert jobs.embed_inputs(tables, at(3), versions=versions) == {"inputs": 2, "artifacts": 2}
    assert jobs.embed_inputs(tables, at(4), versions=versions) == {"inputs": 0, "artifacts": 0}
    made = tables.read("article_inputs").collect()
    assert {(r["normalized_title"], r["embedding_status"], r["current_marker"]) for r in made} == {("A & B", "READY", 1), ("A & C", "READY", 1)}
    assert jobs.snapshot_all(tables, at(5), versions=versions) == {"shadow-24h": "COMPLETED"}
    assert jobs.snapshot_all(tables, at(5), versions=versions) in ({"shadow-24h": "COMPLETED"}, {"shadow-24h": "REUSED"})
    with pytest.raises(ValueError):
        jobs.snapshot_all(tables, at(5), mode="BACKFILL")
    ledger = snapshots.RunLedger(tables)
    found = ledger.decisions(ledger.runs().first()["run_key"]).collect()
    assert len(found) == 1 and found[0]["decision_rank"] == 1
    report = jobs.reprocess(tables, "GKG", at(6)).first()
    assert (report["before"], report["after"], report["kept"], report["added"], report["changed"]) == (4, 4, 0, 0, 0) and tables.read("gkg").where("article_id IS NULL").count() == 0
    assert {(r["article_id"], r["hours"]) for r in jobs.revisit(tables, at(30)).collect()} == {(1, 24), (2, 24)}
    assert jobs.retain(tables, at(9), timedelta(hours=1), rows=1) == {"EVENTS": 2, "MENTIONS": 2, "GKG": 4}
    assert jobs.imports.payloads(spark, tables, "EVENTS").count() == 2 and jobs.retain(tables, at(9), timedelta(hours=1)) == {"EVENTS": 0, "MENTIONS": 0, "GKG": 0}


def test_embedding_failures_are_kept_and_repaired(spark, tmp_path):
    class Failing:
        def __init__(self, status):
            self.status = status

        def embed(self, texts, dimension):
            raise embedder.EmbeddingFailed(f"HTTP_{self.status}", "no", self.status in embedder.RETRYABLE_STATUSES, 120)

    tables = store.TableStore(spark, str(tmp_path))
    at = lambda m: BASE + timedelta(minutes=m)
    tables.write("articles", spark.createDataFrame([(1, "u", "h", "d", BASE, BASE, BASE)], schemas.ARTICLES))
    gkg = spark.createDataFrame([(1, BASE, "A title", 1, BASE)], "id BIGINT, source_timestamp TIMESTAMP, page_title STRING, article_id BIGINT, created_at TIMESTAMP")
    tables.write("gkg", spark.createDataFrame([], schemas.GKG).unionByName(gkg, allowMissingColumns=True))
    versions = inputs.VERSIONS[:1]
    jobs.embed_inputs(tables, at(10), Failing(503), versions=versions)
    row = tables.read("artifacts").first()
    assert (row["status"], row["attempt_count"], row["next_retry_at"]) == ("RETRYABLE_FAILURE", 1, at(12))
    assert jobs.embed_inputs(tables, at(11), versions=versions) == {"inputs": 0, "artifacts": 0}
    assert jobs.embed_inputs(tables, at(13), versions=versions)["artifacts"] == 1 and tables.read("artifacts").first()["status"] == "READY"
    assert tables.read("article_inputs").where("current_marker = 1").first()["embedding_status"] == "READY"


def test_store(spark, tmp_path):
    s = store.TableStore(spark, str(tmp_path))
    s.merge("t", spark.createDataFrame([(1, "a"), (2, "b")], "k INT, v STRING"), ["k"])
    s.merge("t", spark.createDataFrame([(2, "c"), (3, "d")], "k INT, v STRING"), ["k"])
    assert sorted(s.read("t").collect()) == [(1, "a"), (2, "c"), (3, "d")]
    assert s.write_once("snap", "k1", s.read("t")) and not s.write_once("snap", "k1", s.read("t"))
    with pytest.raises(ValueError):
        s.merge("t", spark.createDataFrame([(7, "x"), (7, "y")], "k INT, v STRING"), ["k"])
    for i in range(20):
        s.merge("t", spark.createDataFrame([(i % 3, f"n{i}"), (None, f"m{i}")], "k INT, v STRING"), ["k"])
    assert sorted(s.read("t").collect(), key=str) == sorted([(0, "n18"), (1, "n19"), (2, "n17"), (3, "d"), (None, "m19")], key=str)


def test_embedder(spark):
    df = spark.createDataFrame([("1", "one two"), ("2", "one two"), ("3", "three")], "k STRING, t STRING")
    rows = {r["key"]: r["vector"] for r in embedder.embed_texts(df, "k", "t", 16).collect()}
    assert rows["1"] == rows["2"] != rows["3"]


def test_stream_equals_batch(spark, tmp_path):
    for i in range(3):
        spark.createDataFrame([(BASE + timedelta(minutes=7 * j + i), "a") for j in range(5)], "ts TIMESTAMP, k STRING").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    rows = spark.read.parquet(str(tmp_path / "in"))
    seen = []
    q = tumbling.run_available(tumbling.stream_files(spark, str(tmp_path / "in"), rows.schema, 1), lambda b, n: seen.extend(tumbling.tumbling_counts(b, "ts", 15, "k").collect()), str(tmp_path / "cp"))
    q.awaitTermination()
    total = {}
    for r in seen:
        total[r["window_start"]] = total.get(r["window_start"], 0) + r["rows"]
    assert total == {r["window_start"]: r["rows"] for r in tumbling.tumbling_counts(rows, "ts", 15, "k").collect()}


def test_imports(spark, tmp_path):
    from tidewire.operators import imports

    def zipped(name, body):
        with zipfile.ZipFile(tmp_path / name, "w") as z:
            z.writestr("x.csv", body)
        return f"file://{tmp_path / name}"

    tables = store.TableStore(spark, str(tmp_path / "lake"))
    good = {"EVENTS": zipped("1.export.CSV.zip", "a\nb\n"), "MENTIONS": zipped("1.mentions.CSV.zip", "c\n")}
    (tmp_path / "2.export.CSV.zip").write_bytes(b"broken")
    bad = {"EVENTS": f"file://{tmp_path}/2.export.CSV.zip", "MENTIONS": zipped("2.mentions.CSV.zip", "d\n")}
    out = imports.import_windows(spark, tables, [(BASE, bad), (BASE + timedelta(minutes=15), good)], BASE)
    assert [v.split(":")[0] for v in out.values()] == ["FAILED", "COMPLETED"]
    again = imports.import_window(spark, tables, good, BASE, BASE)
    assert [(r.row_count, r.skipped) for r in again] == [(2, True), (1, True)]
    assert sorted((r["row_number"], r["raw_tsv"]) for r in imports.payloads(spark, tables, "EVENTS").collect()) == [(1, "a"), (2, "b")]
    manifest = tables.read("import_files")
    assert {(r["source_file"], r["status"]) for r in manifest.collect()} == {("2.export.CSV.zip", "FAILED"), ("1.export.CSV.zip", "COMPLETED"), ("1.mentions.CSV.zip", "COMPLETED")}
    assert [r["source_timestamp"] for r in masterfile.failed_windows(manifest).collect()] == [BASE]


def test_daily_breakdown_counts_all_events(spark):
    rows = spark.createDataFrame([(BASE, "error"), (BASE, "view"), (BASE + timedelta(days=3), "error")], "ts TIMESTAMP, event_type STRING")
    got = quality.daily_breakdown(rows, "ts", errors=F.col("event_type") == "error").orderBy("day").collect()
    assert [(r["day"].day, r["rows"], r["errors"]) for r in got] == [(5, 2, 1), (6, 0, 0), (7, 0, 0), (8, 1, 1)]
    sf = "/root/testdata/sf0.001"
    events = spark.read.parquet(f"{sf}/events.parquet")
    total = QUERIES["daily_breakdown"](spark, sf).agg(F.sum("rows"), F.sum("errors")).first()
    assert tuple(total) == (events.count(), events.where("event_type = 'error'").count())


def test_connected_follows_long_paths(spark):
    names = [f"n{i:04d}" for i in range(400)]
    random.Random(4).shuffle(names)
    path, ring = names[:390], names[390:]
    edges = [*zip(path, path[1:]), *zip(ring, ring[1:]), (ring[0], ring[0]), (path[0], "elsewhere"), ("elsewhere", ring[0]), (path[0], None)]
    nodes = spark.createDataFrame([(x,) for x in [*names, "alone"]], "ref STRING")
    got = {r["node"]: r["component"] for r in clusters.connected(nodes, spark.createDataFrame(edges, "left_ref STRING, right_ref STRING")).collect()}
    assert got == {x: min(path) for x in path} | {x: min(ring) for x in ring} | {"alone": "alone"}


def test_versions_are_checked_and_fail_alone():
    for wrong in ({"window_hours": 12}, {"threshold": 0.6}, {"search_mode": "APPROXIMATE"}):
        with pytest.raises(ValueError):
            inputs.ClusteringVersion(**({"id": 1, "version_key": "v", "window_hours": 24} | wrong)).validate()
    seen = []

    def work(v):
        seen.append(v.version_key)
        if v.window_hours == 24:
            raise RuntimeError("no " + "x" * 5000)

    odd = inputs.ClusteringVersion(9, "odd", 12)
    out = snapshots.each_version([odd, *inputs.VERSIONS], work)
    assert seen == [v.version_key for v in inputs.VERSIONS] and out["shadow-48h"] == out["shadow-72h"] == "COMPLETED"
    assert out["odd"].startswith("FAILED: odd") and out["shadow-24h"].startswith("FAILED: no x") and len(out["shadow-24h"]) == 4000


def test_late_signals_lower_first_seen_and_are_past_a_watermark(spark):
    articles = spark.createDataFrame([(7, "https://example.org/a", hashlib.sha256(b"https://example.org/a").hexdigest(), "example.org", BASE, BASE, BASE)], schemas.ARTICLES)
    late = spark.createDataFrame([("GKG", 1, BASE - timedelta(hours=60), "https://example.org/a", None)], "signal_type STRING, source_id BIGINT, source_timestamp TIMESTAMP, raw_url STRING, article_id BIGINT")
    out = extraction.extract(late, articles, now())["articles"].collect()
    assert [(r["id"], r["first_seen_at"], r["created_at"]) for r in out] == [(7, BASE - timedelta(hours=60), BASE)]
    rows = spark.createDataFrame([(BASE,), (BASE + timedelta(hours=1),)], "ts TIMESTAMP")
    assert tumbling.late_rows(rows, F.col("ts"), F.lit(BASE).cast("timestamp")).count() == 1


def test_jobs_poll_a_stream(spark, tmp_path):
    spark.range(6).repartition(3).write.parquet(str(tmp_path / "in"))
    done = []
    stream = tumbling.stream_files(spark, str(tmp_path / "in"), "id BIGINT", 2)
    tumbling.run_available(stream, lambda b, n: done.append(b.count()), str(tmp_path / "cp")).awaitTermination()
    assert sum(done) == 6
    counts = iter([3, 2, 0, 5])
    assert tumbling.drained(lambda: next(counts)) == 5
