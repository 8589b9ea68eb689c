"""run() against its stages, each recomputed by brute force on a small corpus with nulls, repeats and clashing names."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import public_tokenizers
import pytest
import regex
import tiktoken
from pyspark.sql import functions as F
from tests.llm.test_llm import brute_mix, documents, shingles, spark_hash
from tidewire.llm import bpe

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def corpus(spark):
    """Documents of the test table, with odd rows, and columns that are named like those that stages make for themselves."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(90)
    first = docs.where("text is not null").first()
    odd = [(None, first["text"], "en", "a", 1), (9001, None, None, None, None), (9002, "", "en", None, 0), (9003, " \t ", None, "a", 3), (9004, "12 -- 34", "en", "a", 8), (9005, "word " * 20_000, "en", "a", 1), (first["doc_id"], first["text"], first["lang"], first["source"], 1)]
    extra = spark.createDataFrame(odd, "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT")
    docs = docs.unionByName(extra.select(*[F.col(f.name).cast(f.dataType) for f in docs.schema]))
    return docs.withColumns({c: F.lit("x") for c in ("of", "of_sha", "of_crc", "times", "copy", "dropped", "norm", "id", "comp", "token", "label")}).cache()


def test_pipeline(spark, corpus):
    kept, seen = corpus, []
    for name, stage in corpus_pipeline.STAGES:
        before = kept
        kept = corpus_pipeline.cut(stage(spark, before, SF), f"test-{name}")
        seen.append(kept)
        if name != "byte_bpe":
            assert kept.columns == corpus.columns
    rows = lambda df: [(r["doc_id"], r["text"]) for r in df.collect()]
    b, c, d, e = map(rows, seen[:4])
    assert Counter(b) == Counter(x for x in rows(corpus) if x[1] and regex.search(r"\p{L}", x[1]))

    groups = defaultdict(list)
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t)
    for i, t in b:
        groups[norm(t)].append(i)
    assert Counter((i, norm(t)) for i, t in c) == Counter((min((i for i in g if i is not None), default=None), t) for t, g in groups.items())

    sets = {i: shingles(t) for i, t in c if i is not None}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x in sets:
        for y in sets:
            if x < y and 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y]):
                p, q = root(x), root(y)
                parent[max(p, q)] = min(p, q)
    assert Counter(d) == Counter((i, t) for i, t in c if i is None or root(i) == i)

    source = {(r["doc_id"], r["text"]): r["source"] for r in corpus.collect()}
    mix, _ = brute_mix([(i, t, None, source[i, t]) for i, t in d], 7, 4096)
    taken = {(i, n): k for i, n, k, _ in mix}
    want = Counter()
    for i, t in d:
        size = len(re.findall(r"[^\x20\x09-\x0D]+", t))
        u = (spark_hash(("i", 7), *([] if i is None else [i]), zlib.crc32(t.encode())) % (1 << 20)) / (1 << 20)
        want[i, t] = math.floor(taken[i, size] / size + u) if taken[i, size] else 0
    assert Counter(e) == +want

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    sha = lambda x: hashlib.sha256(x).hexdigest()
    expected = Counter((i, tuple(ids := own.encode_ordinary(t)), sha(",".join(map(str, ids)).encode()), sha(t.encode())) for i, t in e)
    assert Counter((r["doc_id"], tuple(r["ids"]), r["ids_sha256"], r["decoded_sha256"]) for r in seen[4].collect()) == expected


def test_stages_on_an_empty_table(spark):
    empty = documents(spark, [])
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, empty, SF)
        assert out.count() == 0 and (name == "byte_bpe" or out.columns == empty.columns)


def test_every_stage_has_executors_collect_their_garbage(spark):
    beans = list(spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans())
    full = lambda: sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())
    docs = spark.createDataFrame([], "doc_id LONG, text STRING, lang STRING, source STRING")
    for _, stage in corpus_pipeline.STAGES:
        before = full()
        stage(spark, docs, "")
        assert full() > before
