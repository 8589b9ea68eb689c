"""The training-data operators against brute force, round trips and held-out accuracy, with nulls, ties, repeats and clashes."""

import hashlib
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict
from itertools import product

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from tidewire.llm import bpe, components, embedding_dedup, exact_dedup, language_id, license_scan, mixing, ngram_join, pii, sharding, warc

DOCS = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT, kept STRING, size STRING, shard STRING"


def documents(spark, rows):
    """(doc_id, text[, lang[, source]]) with extra columns whose names clash with results."""
    return spark.createDataFrame([(*r, *("en", "s")[len(r) - 2 :], None if r[1] is None else len(r[1]), "x", "y", "z") for r in rows], DOCS)


def words(rng, n, size=400):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


@pytest.fixture(scope="module")
def mixed_rows():
    rng = random.Random(3)
    rows = [(0, None, "en", None), (1, "", "en", None), (2, " \t\n", "en", "b"), (3, "One two", "en", "b"), (4, "one  two", "en", "a"), (5, "one two three four five", "en", "a"), (6, "x" * 3000, None, "a")]
    for i in range(10, 40):
        rows.append((i, words(rng, rng.randrange(1, 200)), "en", rng.choice(["a", "b", None, "c"])))
    base = words(rng, 120).split()
    for i in range(40, 60):
        t = list(base)
        for _ in range(rng.randrange(0, 6)):
            t[rng.randrange(len(t))] = f"e{i}"
        rows.append((i, " ".join(t), "en", "a"))
    rows += [(70, rows[12][1], "en", "c"), (71, rows[12][1].upper(), "en", "c"), (72, words(rng, 6000, 90000), "en", "a")]
    rows.append(rows[12])
    return rows


def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_warc(spark, tmp_path):
    rows = [(1, "http://a/", "x" * 1500), (2, None, "x" * 1500), (3, "http://b/ \n", "short"), (4, "u", "short"), (5, "u", None), (6, "u", "é" * 600), (6, "u", "é" * 600), (7, "u", "")]
    pages = spark.createDataFrame([(*r, "c") for r in rows], "page_id BIGINT, url STRING, html STRING, offset STRING")
    index = warc.write_archives(pages, f"file://{tmp_path}/w")
    got = warc.read_records(index).collect()
    found = {r["page_id"]: r for r in got}
    assert len(got) == 8 and found[1]["record_type"] == "revisit" and found[1]["refers_to"] == 2 and found[2]["record_type"] == "response"
    assert all(found[i]["record_type"] == "response" for i in (3, 4, 5, 6, 7))
    for i, _, html in rows:
        data = (html or "").encode()
        assert found[i]["payload_bytes"] == len(data) and found[i]["payload_digest"] == hashlib.sha1(data).hexdigest()
        assert found[i]["payload"] is None if i == 1 else bytes(found[i]["payload"]) == data
    one = warc.read_records(index.where("page_id = 4"), payloads=False).collect()
    assert len(one) == 1 and one[0]["payload"] is None and found[2]["url"] is None and "\n" not in found[3]["url"]
    assert warc.read_records(warc.write_archives(pages.limit(0))).count() == 0


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_ngram_join(spark, mixed_rows):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(documents(spark, mixed_rows)).collect()}
    sets = {r[0]: shingles(r[1]) for r in mixed_rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    assert got == {i: (len(s), root(i)) for i, s in sets.items()}
    kept = [r["doc_id"] for r in ngram_join.one_of_each(documents(spark, mixed_rows)).collect()]
    assert sorted(set(kept)) == sorted(i for i in sets if root(i) == i)
    assert ngram_join.jaccard_components(empty(spark)).count() == 0


def test_bitmap_bound_never_hides_overlap():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a = np.unique(rng.integers(0, 1 << 62, rng.integers(4, 300), dtype=np.uint64))
        b = np.unique(np.concatenate([rng.choice(a, rng.integers(1, len(a) + 1), replace=False), rng.integers(0, 1 << 62, rng.integers(0, 50), dtype=np.uint64)]))
        x, y = (np.frombuffer(ngram_join.bitmap(s), np.uint8) for s in (a, b))
        w = min(len(x), len(y))
        x, y = (np.bitwise_or.reduce(m.reshape(-1, w), axis=0) for m in (x, y))
        bound = min(len(a) - int(np.bitwise_count(x & ~y).sum()), len(b) - int(np.bitwise_count(y & ~x).sum()))
        assert bound >= len(np.intersect1d(a, b))


def test_shingles_are_counted_in_little_memory():
    rng = random.Random(3)
    texts = ["one two three four five"] * 400 + [" ".join(str(rng.random()) for _ in range(200)) for _ in range(400)]
    slices = [texts[i : i + 40] for i in range(0, len(texts), 40)]
    tracemalloc.start()
    (out,) = ngram_join._tally(pa.RecordBatch.from_arrays([pa.array(x)], ["text"]) for x in slices)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 48 << 20
    counts = np.zeros((ngram_join.SKETCH_PARTS, (1 << ngram_join.SKETCH_BITS) // ngram_join.SKETCH_PARTS), np.uint8)
    for part, found in zip(*(c.to_pylist() for c in out.columns)):
        counts[part] = np.frombuffer(found, np.uint8)
    every = Counter(int(h) >> (64 - ngram_join.SKETCH_BITS) for x in slices for h in ngram_join._rolled([t.encode() for t in x])[1])
    assert Counter({int(i): int(counts.reshape(-1)[i]) for i in np.flatnonzero(counts.reshape(-1))}) == Counter({k: min(n, 255) for k, n in every.items()})


def test_ngram_join_with_a_large_family_and_a_passage_in_every_text(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "FAMILY_ROWS", 64)
    monkeypatch.setattr(ngram_join, "TILE_ROWS", 100)
    rng = random.Random(8)
    passage, base = words(rng, 40, 10**6), words(rng, 90, 10**6).split()
    rows = []
    for i in range(900):
        t = list(base)
        for _ in range(rng.randrange(0, 5)):
            t[rng.randrange(len(t))] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(t)))
    rows += [(1000 + i, f"{passage} {words(rng, rng.randrange(0, 40), 10**6)}") for i in range(300)]
    rows += [(2000, rows[5][1]), (5, rows[5][1]), (5, rows[5][1]), (5, "another text with the id of one of them"), (None, rows[5][1])]
    got = ngram_join.jaccard_components(documents(spark, rows)).collect()
    known = [r for r in rows if r[0] is not None]
    sets, postings = [shingles(t) for _, t in known], defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            postings[x].append(i)
    shared = np.zeros((len(known), len(known)), np.int32)
    for p in postings.values():
        if len(p) > 1:
            shared[np.ix_(p, p)] += 1
    n = np.array([len(s) for s in sets])
    links = 100 * shared >= 80 * (n[:, None] + n[None] - shared)
    ids = np.array([i for i, _ in known])
    root = {int(i): int(i) for i in ids}
    while True:
        low = {i: min(root[i], min((root[int(ids[y])] for x in np.flatnonzero(ids == i) for y in np.flatnonzero(links[x])), default=i)) for i in root}
        if low == root:
            break
        root = low
    assert len(got) == len(rows)
    assert all(r["component_id"] == (None if r["doc_id"] is None else root[r["doc_id"]]) for r in got)
    assert Counter((r["doc_id"], r["n_shingles"]) for r in got) == Counter((i, len(shingles(t))) for i, t in rows)


def draw(key, parent, child, weight):
    digest = hashlib.sha256(f"{key}:{parent}:{child // 4}".encode()).hexdigest()
    return -np.log((int(digest[13 * (child % 4) :][:13], 16) + 0.5) / 16**13) / weight


def placed(key, tree):
    key = "" if key is None else key
    weight = lambda node: node[1] if isinstance(node, tuple) else sum(map(weight, node))
    path, node = [], tree
    while not isinstance(node, tuple):
        c = min(range(len(node)), key=lambda c: draw(key, ".".join(map(str, path)) or "root", c, weight(node[c])))
        path.append(c)
        node = node[c]
    return node[0]


def test_sharding(spark, mixed_rows):
    docs = documents(spark, [*mixed_rows, (None, "n"), (None, None), *[mixed_rows[8]] * 300])
    rows = sharding.shard_documents(docs).collect()
    text = defaultdict(list)
    for r in docs.collect():
        text[r["doc_id"]].append(r["text"] or "")
    tree = sharding.regular_tree(40)
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r)
        assert r["shard"] == placed(r["doc_id"], tree) and r["grown_shard"] == placed(r["doc_id"], sharding.grown(tree)) and r["grown_shard"] in (r["shard"], 40)
        assert any(r["text_crc32"] == zlib.crc32(t.encode()) and r["size"] == len(t.encode()) + 16 for t in text[r["doc_id"]]) and r["law"] == "key"
    key = lambda r: (int(hashlib.md5(f"{'' if r['doc_id'] is None else r['doc_id']}:{r['size']}:{r['text_crc32']}".encode()).hexdigest()[:8], 16) % 256, r["doc_id"] is not None, r["doc_id"], r["size"], r["text_crc32"])
    for own in slots.values():
        by_slot = sorted(own, key=lambda r: r["slot"])
        assert [r["slot"] for r in by_slot] == list(range(len(own))) and [key(r)[:2] for r in by_slot] == sorted(key(r)[:2] for r in own)
    assert len(rows) == docs.count() and sharding.shard_documents(empty(spark)).count() == 0


def test_sharding_is_balanced_and_moves_little(spark):
    ids = spark.range(20000).select(F.col("id").alias("k"))
    tree = sharding.regular_tree(40)
    heavy = [[[(0, 1.0), (1, 3.0)], [(2, 1.0)]], [[(3, 1.0)]]]
    changed = [[list(rack) for rack in region] for region in tree]
    changed[1][2][3] = (changed[1][2][3][0], 4.0)
    rows = sharding.place(ids, "k", {"a": tree, "b": sharding.grown(tree), "w": heavy, "c": changed}).collect()
    counts = Counter(r["a"] for r in rows)
    assert len(counts) == 40 and max(counts.values()) < 1.3 * 500 and min(counts.values()) > 0.7 * 500
    assert 300 < sum(r["b"] == 40 for r in rows) < 700 and all(r["b"] in (r["a"], 40) for r in rows)
    assert abs(Counter(r["w"] for r in rows)[1] / 20000 - 0.5) < 0.02
    moved = [(r["a"], r["c"]) for r in rows if r["a"] != r["c"]]
    assert abs(Counter(r["c"] for r in rows)[27] / 20000 - 4 / 43) < 0.01
    for x, y in moved:  # region 1 is shards 16 to 31, its rack 2 is 24 to 27
        assert (16 <= x < 32) or (16 <= y < 32)
        if 16 <= x < 32 and 16 <= y < 32:
            assert (24 <= x < 28) or (24 <= y < 28)
            assert not (24 <= x < 28 and 24 <= y < 28) or y == 27


def test_embeddings(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(40, 16))
    rows = [(i, [float(x) for x in base[i % 40] + rng.normal(size=16) * (0.02 if i % 3 else 0.3)], i % 40 % 4) for i in range(400)]
    rows += [(500 + i, rows[7][1], rows[7][2]) for i in range(30)] + [(600, rows[7][1], None), (601, None, 1), (602, [0.0] * 16, 1), (603, [float("nan")] * 16, 1), (604, [1.0], 1), (605, [], 1), (606, [None] * 16, 1), (607, [float(np.float32(x)) * 2 for x in rows[8][1]], rows[8][2])]
    df = spark.createDataFrame([(*r, "n", "k") for r in rows], "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT, n STRING, kept STRING")
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(df).collect()}
    good = [(i, np.array(v, np.float32).astype(float), lab) for i, v, lab in rows if lab is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    links = defaultdict(set)
    for i, v, lab in good:
        for j, w, other in good:
            if i != j and lab == other and len(v) == len(w) and v @ w / (np.linalg.norm(v) * np.linalg.norm(w)) >= 0.98:
                links[i].add(j)
    want, have = sum(map(len, links.values())), sum(r["n_links"] for r in got.values())
    assert have <= want and have >= 0.97 * want and len(got) == len(rows)
    for i in (600, 601, 602, 603, 604, 605, 606):
        assert got[i]["n_links"] == 0 and got[i]["kept"]
    assert got[500]["n_links"] == len(links[500]) and got[500]["component_id"] == got[7]["component_id"]
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_embeddings_with_repeated_ids(spark):
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=(2, 12))
    near = lambda v: [float(x) for x in v + rng.normal(size=12) * 0.01]
    rows = [(1, near(a), 5), (1, near(b), 5), (2, near(a), 5), (3, near(b), 5), (4, [float(x) for x in a], 6), (4, [float(x) for x in a], 6), (None, [float(x) for x in a], 6)]
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id BIGINT, embedding ARRAY<DOUBLE>, label INT")).collect()
    assert Counter((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got) == Counter({(1, 1, 1, True): 2, (2, 1, 1, False): 1, (3, 1, 1, False): 1, (4, 1, 4, True): 2, (None, 0, None, True): 1})


@pytest.mark.parametrize("d, mean, chunk_bits", [(64, 0.0, 15), (64, 2.0, 15), (64, 0.0, 24), (64, 2.0, 30), (768, 0.0, 15), (768, 2.0, 20)])
def test_embedding_recall_on_planted_links(d, mean, chunk_bits):
    rng = np.random.default_rng(4)
    common = rng.normal(size=d) * mean
    x = rng.normal(size=(20000, d)) + common
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    side = rng.normal(size=x.shape)
    side -= (side * x).sum(1, keepdims=True) * x
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    c = rng.uniform(0.98, 0.99, (len(x), 1))
    y = c * x + np.sqrt(1 - c * c) * side
    sample = x[: embedding_dedup.SAMPLE_ROWS]
    rotations, tables, radius, _ = embedding_dedup.fitted(sample, chunk_bits, 0.98)
    differ = embedding_dedup._bits(x, rotations, tables * chunk_bits) != embedding_dedup._bits(y, rotations, tables * chunk_bits)
    found = (differ.reshape(len(x), tables, -1).sum(2) <= 1).any(1) & (differ.sum(1) <= radius)
    print(d, mean, chunk_bits, tables, radius, found.mean())
    assert found.mean() >= 0.95


def brute_spans(t):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[ -]", "", m.group())
        if 16 <= len(d) <= 19 and sum(sum(divmod(int(x) * (1 + i % 2), 10)) for i, x in enumerate(d[::-1])) % 10 == 0:
            out.append(("card", m.start(), m.end()))
    return out + [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.sub("[^0-9]", "", m.group())) <= 15]


def test_pii_patterns_match_the_plain_ones():
    rng = random.Random(1)
    for alphabet in ("ab@@..-_%+ 0123456789()", "@.+- 12345(a", "a@.b ", "4111 -"):
        for _ in range(3000):
            t = "".join(rng.choice(alphabet) for _ in range(rng.randrange(60)))
            assert pii.base_spans(t) == brute_spans(t)


def test_pii_field(spark):
    crf = pii.trained()
    assert crf.splits
    for sentence, tags in pii.labelled_rows():
        best = crf.viterbi([crf.emissions(*crf.ids(sentence))], [True])[0]
        assert [pii._TAGS[t] for t in best] == tags
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["call", "555-867-5309", "the", "x@y.example", "12", "(555)", "123-4567", "token", "=", "9" * 40, "a"]) for _ in range(30)) for _ in range(200)]
    whole = pii.Crf.__new__(pii.Crf)
    whole.__dict__.update(crf.__dict__ | {"splits": False})
    assert pii.crf_spans(texts, crf) == pii.crf_spans(texts, whole)
    long = "word " * 200_000 + "mail a@b.example now"
    docs = documents(spark, [(1, None), (2, ""), (3, "mail a@b.example or 555-867-5309 or 4111 1111 1111 1111 from 10.0.0.1"), (4, "plain words only"), (None, "x@y.example"), (5, long), (5, long)])
    got = pii.digest(pii.find(docs)).collect()
    rows = {r["doc_id"]: r for r in got}
    assert len(got) == 7 and rows[None]["n_email"] == 1 and rows[5]["spans"] == f"email:{len(long) - 15}:{len(long) - 4}"
    assert (rows[3]["n_email"], rows[3]["n_ip"], rows[3]["n_card"], rows[3]["n_phone"]) == (1, 1, 1, 0)
    assert "phone:20:32" in rows[3]["spans"] and rows[1]["spans"] == rows[4]["spans"] == "" and rows[4]["n_found"] == 0 and pii.find(empty(spark)).count() == 0
    base = "email:5:16,ip:61:69,card:36:55"
    assert rows[3]["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()


def test_pii_field_against_all_tag_sequences():
    crf = pii.trained()
    k = len(pii._TAGS)
    for sentence in ("ssn 078-05-1120 or", "(555) 123-4567 ok", "key 12 a", "10.0.0.1"):
        data = sentence.split()
        ids = crf.ids(data)
        e = crf.emissions(*ids)
        score = lambda tags: e[np.arange(len(tags)), list(tags)].sum() + crf.a[-1, tags[0]] + sum(crf.a[x, y] for x, y in zip(tags, tags[1:]))
        every = {tags: score(tags) for tags in product(range(k), repeat=len(data))}
        assert tuple(crf.viterbi([e], [True])[0]) == max(every, key=every.get)
        node, edge, total = crf._marginals(e)
        weights = np.exp(np.array(list(every.values())) - total)
        assert abs(weights.sum() - 1) < 1e-9
        tags = np.array(list(every))
        for i, t in product(range(len(data)), range(k)):
            assert abs(node[i, t] - weights[tags[:, i] == t].sum()) < 1e-9
        for i in range(1, len(data)):
            assert abs(edge[i, 1, 2] - weights[(tags[:, i - 1] == 1) & (tags[:, i] == 2)].sum()) < 1e-9
    data = [(*crf.ids("call (555) 123-4567 or ssn 078-05-1120".split()), np.array([0, 4, 4, 0, 0, 5]))]
    _, *grads = crf.log_likelihood(data)
    for x, grad in zip((crf.w, crf.a, crf.c), grads):
        for at in np.argwhere(np.abs(grad) > 1e-6)[::17]:
            at, old = tuple(at), x[tuple(at)]
            x[at] = old + 1e-5
            high = crf.log_likelihood(data)[0]
            x[at] = old - 1e-5
            low = crf.log_likelihood(data)[0]
            x[at] = old
            assert abs((high - low) / 2e-5 - grad[at]) < 1e-4


HELD_OUT = """
you can phone me at (212)|phone 555-7788|phone tomorrow
our number is 555-998-1122|phone in the day
call +44|phone 161|phone 496|phone 0123|phone now
dial 555.321.9876|phone to order
her ssn 321-54-9876|id was on it
social security 111-22-3333|id please
token = "9b74c9897bac770ffc029102a200c5de0f5a1c2b"|secret in code
password = 5f4dcc3b5aa765d61d8327deb882cf99a1b2c3d4|secret .
key: a94a8fe5ccb19ba61c4c0873d391e987982fbbd3|secret was set
write to tom.b@site.example.com|email at once
the server 172.16.0.9|ip is down
paid with 4242|card 4242|card 4242|card 4242|card today
number +1|phone (415)|phone 555-2671|phone is mine
reach +49|phone 40|phone 123456|phone later
isbn 978-1-4028-9462-6 is out
in 1984 he had 17 of 20
version 3.1 from 2021-06-01
chapter 12 , section 9.1
it costs 2,499.00 or 3 a day
open 9-17 on 5 days
from 1939-1945 it went on
order 20230901042 was sent
page 45 of 300
room 12b on floor 2
"""


def test_pii_field_on_held_out_rows():
    right = found = want = 0
    for sentence, tags in pii.labelled_rows(HELD_OUT):
        best = [pii._TAGS[t] for t in pii.trained().viterbi([pii.trained().emissions(*pii.trained().ids(sentence))], [True])[0]]
        right += sum(x == y != "O" for x, y in zip(best, tags))
        found, want = found + sum(x != "O" for x in best), want + sum(y != "O" for y in tags)
    print("precision", right / found, "recall", right / want)
    assert right / found >= 0.9 and right / want >= 0.85


def test_licenses(spark):
    filler = " ".join(f"q{i}" for i in range(700))
    texts = {1: None, 2: "", 3: "The MIT-License. mit  license", 4: f"{filler}\nLicensed under CC BY-NC 4.0.\n{filler}", 5: f"{filler} GNU General Public License {filler}", 6: "licensed by nobody", 7: "Émit licenseé apache license"}
    rows = {r["doc_id"]: r for r in license_scan.scan_digest(documents(spark, list(texts.items()))).collect()}
    assert (rows[3]["n_base"], rows[3]["first_word"], rows[3]["last_word"], rows[3]["base_labels"]) == (2, 1, 3, "mit")
    assert rows[4]["labels"] == "cc-by-nc" and rows[4]["base_labels"] == "" and rows[4]["score"] == 1.0
    assert rows[5]["base_labels"] == "gpl" and rows[5]["first_word"] == 701 and rows[6]["labels"] == "" and rows[7]["n_base"] == 1 and rows[1]["n_words"] == 0 and rows[1]["first_word"] is None
    assert license_scan.scan(empty(spark)).count() == 0


def test_license_base_against_brute_force(spark):
    rng = random.Random(12)
    vocabulary = ["MIT", "License", "apache", "general", "PUBLIC", "license", "x", "é", "mit-license", "of", "the"]
    rows = [(i, " ".join(rng.choice(vocabulary) + rng.choice(["", ".", ",\n"]) for _ in range(rng.randrange(0, 60)))) for i in range(150)]
    rows += [(None, "mit license"), (7, rows[7][1]), (900, "a " * 300_000 + "MIT license")]
    for r in license_scan.scan_digest(documents(spark, rows)).collect():
        texts = [t for i, t in rows if i == r["doc_id"]]
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", texts[0].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        at = [(i, label) for phrase, label in license_scan.PHRASES.items() for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
        assert (r["n_words"], r["n_base"], r["base_labels"]) == (len(w), len(at), ",".join(sorted({x for _, x in at})))
        assert (r["first_word"], r["last_word"]) == ((min(at)[0], max(at)[0]) if at else (None, None)) and 0 <= r["score"] <= 1


def test_license_index_loses_no_template():
    rng = random.Random(2)
    index = license_scan.Index(license_scan.TEMPLATES, {b"the": 900, b"license": 50}, 0.9)
    for _ in range(300):
        t = rng.choice(index.templates)
        w = rng.sample(t.order, rng.randrange(1, len(t.order) + 1)) + [b"zz"]
        full = [x for x in index.templates if x.passages(w, set(w))]
        assert set(full) <= set(index.candidates(set(w))) and (len(w) - 1 < t.need or t in full)


def test_licenses_are_found_at_every_offset(spark):
    clear = "Redistribution and use in source and binary forms, with or without modification, are permitted (subject to the limitations in the disclaimer below) provided that the following conditions are met"
    texts = [(label, k, " ".join([f"q{i}" for i in range(k)] + [t] + [f"r{i}" for i in range(60)])) for label, t in (("bsd", clear), ("mit", "Released under the terms of the MIT License.")) for k in range(43)]
    rows = {r["doc_id"]: r for r in license_scan.scan(documents(spark, [(i, t) for i, (_, _, t) in enumerate(texts)])).collect()}
    for i, (label, k, text) in enumerate(texts):
        w = license_scan.words_of(text)
        for name, template in license_scan.TEMPLATES:
            t = license_scan.Template(name, template, {}, 0.9)
            shares = [len(set(w[a : a + 2 * t.length]) & set(t.order)) for a in range(len(w))]
            got = t.passages(w, set(w))
            starts = {a for a, n in enumerate(shares) if n >= t.need}
            assert bool(got) == bool(starts) and all(any(first - 2 * t.length <= a < end for first, end, _ in got) for a in starts)
            assert not got or max(c for _, _, c in got) == max(shares) / len(t.order)
        assert label in {b["label"] for b in rows[i]["blocks"]}, (label, k)


def brute_targets(sizes):
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, full, out = 1.5 * sum(sizes.values()), set(), {}
    while True:
        open_ = [s for s in order if s not in full]
        share = (left - sum(2 * sizes[s] for s in full)) / max(1, sum(weight[s] for s in open_))
        over = [s for s in open_ if share * weight[s] > 2 * sizes[s] + 1e-9]
        if not over:
            return {s: 2.0 * sizes[s] if s in full else share * weight[s] for s in order}
        full |= set(over)


def test_mixing(spark, mixed_rows):
    rng = random.Random(9)
    rows = [*mixed_rows, *[(100 + i, words(rng, rng.randrange(1, 400)), "en", rng.choice("abcdef")) for i in range(150)]]
    docs = documents(spark, rows)
    out = mixing.mix_documents(docs).collect()
    n = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += n(r[1])
    want = brute_targets(sizes)
    taken = defaultdict(int)
    for r in out:
        assert r["taken"] <= 2 * r["size"] and abs(r["target"] - want[r["source"]]) < 1e-6 and r["source_size"] == sizes[r["source"]]
        taken[r["source"]] += r["taken"]
    assert len(out) == len(rows) and all(abs(taken[s] - want[s]) <= 128 + 0.05 * want[s] for s in sizes)
    again = mixing.mix_documents(docs.repartition(3)).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))
    assert mixing.mix_documents(empty(spark)).count() == 0 and mixing.mixed(docs).columns == docs.columns and mixing.mixed(empty(spark)).count() == 0
    odd = docs.selectExpr("*", "1 AS `of`", "2 AS times", "3 AS copy")
    assert mixing.mixed(odd).columns == odd.columns


def spark_hash(*values):
    """xxhash64 as Spark has it: int 4 bytes ('i', n), long 8 bytes, string; the hash of one is the seed of the next."""
    h = 42
    for v in values:
        data = v.encode() if isinstance(v, str) else v[1].to_bytes(4, "little", signed=True) if isinstance(v, tuple) else v.to_bytes(8, "little", signed=True)
        h = xxhash.xxh64_intdigest(data, h)
    return h - (1 << 64) if h >> 63 else h


def permuted(index, n, *key, rounds=8):
    for r in range(rounds):
        other = (spark_hash(("i", r), "turn", *key) % n - index) % n
        if spark_hash(("i", r), "coin", max(index, other), *key) & 1:
            index = other
    return index


def brute_mix(rows, seed, shard_slots, block_words=64):
    """Counter of (doc_id, size, taken, first_shard), the mix recomputed slot by slot."""
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += count(r[1])
    order = sorted(s for s in sizes if s is not None) + [None] * (None in sizes)
    want = brute_targets(sizes)
    blocks = {s: -(-sizes[s] // block_words) for s in order}
    k = {s: min(2 * blocks[s], int(want[s] * blocks[s] / sizes[s] + 0.5)) if sizes[s] else 0 for s in order}
    total, tickets = sum(k.values()), [s for s in order for _ in range(k[s])]
    draws = defaultdict(lambda: defaultdict(int))
    for i in range(total):
        draws[i // shard_slots][tickets[spark_hash(("i", seed), "draw", i // shard_slots, i % shard_slots) % total]] += 1
    shard_of, over = {s: [] for s in order}, []
    for shard in sorted(draws):
        for s in order:
            shard_of[s] += [shard] * draws[shard][s]
    drawn = {s: len(x) for s, x in shard_of.items()}
    over = [x for s in order for x in shard_of[s][k[s] :]]
    for s in order:
        lack = max(0, k[s] - drawn[s])
        shard_of[s] = shard_of[s][: k[s]] + over[:lack]
        over = over[lack:]
    out = Counter()
    for no, s in enumerate(order, 1):
        times, first = Counter(), {}
        for slot, shard in enumerate(shard_of[s]):
            b = permuted(slot % blocks[s], blocks[s], ("i", seed), ("i", no), slot // blocks[s])
            times[b] += 1
            first[b] = min(first.get(b, shard), shard)
        at = 0
        own = [(r[0], zlib.crc32((r[1] or "").encode()), count(r[1])) for r in rows if r[3] == s]
        for i, crc, n in sorted(own, key=lambda x: (int(hashlib.md5(f"{'' if x[0] is None else x[0]}:{x[1]}".encode()).hexdigest()[:8], 16) % 512, x[0] is not None, x[0] or 0, x[1])):
            inside = Counter((at + j) // block_words for j in range(n))
            out[i, n, sum(c * times[b] for b, c in inside.items()), min((first[b] for b in inside if b in first), default=None)] += 1
            at += n
    return out, {shard: dict(x) for shard, x in draws.items()}


def test_mixing_recomputed(spark, mixed_rows):
    rng = random.Random(10)
    rows = [r for r in mixed_rows if r[1] != ""] + [(100 + i, words(rng, rng.randrange(1, 300)), "en", rng.choice("aaaaabcdef")) for i in range(200)] + [(None, words(rng, 50), "en", "b")]
    seen = []
    for seed in (7, 8):
        want, draws = brute_mix(rows, seed, 64)
        got = mixing.mix_documents(documents(spark, rows), shard_slots=64, seed=seed).collect()
        assert Counter((r["doc_id"], r["size"], r["taken"], r["first_shard"]) for r in got) == want
        seen.append(draws)
    assert seen[0] != seen[1] and len(seen[0]) > 3


def test_index_permutation(spark):
    for n in (1, 2, 7, 100):
        rows = spark.range(n).select(mixing.shuffle_index(F.col("id"), F.lit(n).cast("long"), [F.lit(5)]).alias("p")).collect()
        assert sorted(r["p"] for r in rows) == list(range(n))


def test_bpe(spark, mixed_rows):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    own = bpe.bpe(path, public_tokenizers.PATTERN)
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    odd = ["日本語のテキスト 한국어 текст\u0085\x1c​ x", "'s don't I'LL 1234567 ½²", "\U0001f600👩‍👩 é é", " " * 50 + "\t\r\n" * 9, "a" * 900, "=-=-==--__" * 30, "\x00\x7f\xa0ÿ"]
    rng = random.Random(5)
    odd += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0xA0, 0x250), 32, 10, rng.randrange(0x4E00, 0x4F00)])) for _ in range(200)) for _ in range(50)]
    for t in odd + [r[1] or "" for r in mixed_rows]:
        ids = own.encode(t)
        assert ids.tolist() == enc.encode_ordinary(t) and own.decode(ids) == t
        spans = own.offsets(t)
        assert all(t[a:b].encode().find(enc.decode_single_token_bytes(int(i))) >= 0 for i, (a, b) in zip(ids, spans))
    docs = documents(spark, mixed_rows)
    rows = bpe.encode_digests(docs, path, public_tokenizers.PATTERN).collect()
    text = {r[0]: (r[1] or "") for r in mixed_rows}
    for r in rows:
        ids = enc.encode_ordinary(text[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text[r["doc_id"]].encode()).hexdigest())
    back = bpe.decode_documents(bpe.encode_documents(docs, path, public_tokenizers.PATTERN), path, public_tokenizers.PATTERN).collect()
    assert len(back) == len(mixed_rows) and all(r["text"] == text[r["doc_id"]] for r in back)
    assert bpe.encode_digests(empty(spark), path, public_tokenizers.PATTERN).count() == 0


def test_exact_dedup(spark, mixed_rows):
    docs = documents(spark, mixed_rows)
    groups = defaultdict(list)
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    for r in mixed_rows:
        groups[norm(r[1])].append(r[0])
    got = exact_dedup.exact_duplicates(docs).collect()
    text = {r[0]: norm(r[1]) for r in mixed_rows}
    for r in got:
        own = groups[text[r["doc_id"]]]
        assert (r["keep_id"], r["group_size"], r["kept"]) == (min(own), len(own), r["doc_id"] == min(own)) and r["text_sha256"] == hashlib.sha256(text[r["doc_id"]].encode()).hexdigest()
    assert len(got) == len(mixed_rows) and exact_dedup.exact_duplicates(empty(spark)).count() == 0
    kept = exact_dedup.without_copies(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(min(g) for g in groups.values())


def test_quotient_filters_merge_without_loss():
    rng = np.random.default_rng(0)
    cqf = exact_dedup.CountingQuotientFilter
    pool = rng.integers(0, 1 << 34, 4000, dtype=np.uint64)
    parts = [rng.choice(pool, n) for n in (0, 1, 3000, 700, 5000)] + [np.full(100_000, pool[0])]
    packed = [cqf.build(p, 34).pack() for p in parts]
    for p, data in zip(parts, packed):
        back = cqf.unpack(data)
        assert dict(zip(back.fingerprints.tolist(), back.counts.tolist())) == Counter(p.tolist()) and back.pack() == data
    merged = cqf.merge([cqf.unpack(x) for x in packed])
    assert dict(zip(merged.fingerprints.tolist(), merged.counts.tolist())) == Counter(np.concatenate(parts).tolist())
    assert len(merged.pack()) < 5 * len(merged.fingerprints) and cqf.merge([merged, cqf.build(parts[0], 34)]).pack() == merged.pack()


def test_network_against_a_plain_one():
    rng = np.random.default_rng(0)
    texts = ["the thing there " * 9, "schön und gut " * 11, "çà et là eau " * 7, "a"]
    model = language_id.train(texts, ["en", "de", "fr", "en"], steps=3)
    scorer = language_id.Scorer(model, window=24, margin=8)
    h = model.recur.shape[1]
    squash = lambda x: x / (1 + abs(x))

    def states(data, d):
        state, out = np.zeros(h), []
        for byte in data:
            e, a = model.embed[d, byte], state @ model.recur[d]
            r, z = (0.5 + 0.5 * squash(e[i * h : i * h + h] + a[i * h : i * h + h]) for i in (0, 1))
            new = squash(e[2 * h :] + r * a[2 * h :])
            state = new + z * (state - new)
            out.append(state)
        return out

    for text, (lang, score) in zip(texts, scorer.score(texts)):
        data, total, letters = text.encode(), np.zeros(3), 0
        for s in range(0, len(data), 24):
            before, own, after = data[max(0, s - 8) : s], data[s : s + 24], data[s + 24 : s + 32]
            pad = bytes(24 - len(own))
            forward = states(before + own + pad, 0)[len(before) :]
            backward = states((own + pad + after)[::-1], 1)[len(after) :][::-1]
            for byte, f, b in zip(own + pad, forward, backward):
                if language_id._MASK[byte]:
                    logits = f @ model.out[0] + b @ model.out[1] + model.bias
                    p = np.exp(logits - logits.max())
                    total, letters = total + p / p.sum(), letters + 1
        assert abs((total / letters).max() - score) < 1e-4 and model.languages[int(total.argmax())] == lang
    p = {k: getattr(model, k).astype(np.float64) + rng.normal(0, 0.2, getattr(model, k).shape) for k in ("embed", "recur", "out", "bias")}
    x, y = rng.choice([32, 97, 98, 200], (7, 5)).astype(np.uint8), rng.integers(0, 3, 5)
    _, grad = language_id.gradients(p, x, y)
    for name, g in grad.items():
        for at in np.argwhere(np.abs(g) > 1e-5)[::23]:
            at, old = tuple(at), p[name][tuple(at)]
            p[name][at] = old + 1e-5
            high = language_id.gradients(p, x, y)[0]
            p[name][at] = old - 1e-5
            low = language_id.gradients(p, x, y)[0]
            p[name][at] = old
            assert abs((high - low) / 2e-5 - g[at]) < 1e-5 * max(1, abs(g[at]))


def test_language_id(spark):
    rng = random.Random(1)
    syllables = {"en": ["the", "ing", "th", "wh", "er"], "de": ["sch", "ung", "ä", "keit", "ein"], "fr": ["eau", "ç", "ê", "ment", "qu"]}
    make = lambda lang: " ".join("".join(rng.choice(syllables[lang]) for _ in range(3)) for _ in range(30))
    rows = [(i, make(lang), lang) for i, lang in enumerate(list(syllables) * 60)] + [(900, None, "en"), (901, "12 -- 34", "en"), (902, "", None), (903, make("de"), None)]
    docs = documents(spark, rows)
    got = {r["doc_id"]: r for r in language_id.identify(docs).collect()}
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i in got) and len(got) == len(rows)
    held = [i for i, _, lang in rows if lang and i < 900 and got[i]["held_out"]]
    assert np.mean([got[i]["lang_pred"] == rows[i][2] for i in held]) > 0.95
    assert [got[i]["lang_pred"] for i in (900, 901, 902, 903)] == ["und", "und", "und", "de"] and all(0 <= r["score"] <= 1 for r in got.values())
    kept = language_id.accepted(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == set(got) - {900, 901, 902}
    nothing = language_id.identify(documents(spark, [(1, "abc", None)])).collect()
    assert nothing[0]["lang_pred"] == "und" and language_id.identify(empty(spark)).count() == 0


def test_language_sample_holds_rare_languages(spark, monkeypatch):
    rows = [(i, f"common words {i}", "en") for i in range(2000)] + [(i, f"andere {i}", "de") for i in range(2000, 3000)] + [(i, f"rare {i}", "xx") for i in range(3000, 3006)] + [(None, "twin", "yy")] * 50
    seen = []
    monkeypatch.setattr(language_id, "train", lambda texts, labels: seen.append(Counter(labels)))
    language_id.fit(documents(spark, rows), sample_docs=40)
    rare = sum(zlib.crc32(str(i).encode()) % 4 != 2 for i in range(3000, 3006))
    assert seen[0]["xx"] == rare > 0 and seen[0]["yy"] == 1 and min(seen[0]["en"], seen[0]["de"]) >= 10 and sum(seen[0].values()) <= 40
    assert language_id.shares({"a": 10**9, "b": 1, "c": 0, "d": 50}, 100) == {"c": 0, "b": 1, "d": 49, "a": 50}


def test_components(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000, i) for i in range(1001, 1200)] + [(5, None)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a BIGINT, b BIGINT")).collect()}
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if b is not None and a != b:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    assert got == {x: root(x) for x in list(parent)}
    assert components.components(spark.createDataFrame([], "a BIGINT, b BIGINT")).count() == 0
