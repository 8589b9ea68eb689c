"""N-gram Jaccard join: near-duplicate documents by distinct 5-word shingles, exactly, at similarity 0.8 or more.

Documents with equal shingle sets are one class. Shingles are ordered by how often they stand in the corpus, rarest first,
so that passages which many documents share come last. Two sets that link share one of the `n - ceil(0.8 n) + 1` first
shingles of either (prefix), and their sizes differ by a factor of 1.25 at most. So candidates meet in tiles: a tile holds
the sets that share a prefix shingle and lie in one size band or the next. In a tile, the places of the shared shingle and
hashed bitmaps of the sets are compared: every bit that one set has and the other lacks is an element that they don't
share, so bit counts bound their overlap from above. Pairs that the bounds let through are verified by intersecting the
sorted hash arrays.

The order comes from counts of all shingles in a sketch of fixed size. Any order gives right results; a coarse one only
makes tiles larger.

Groups of near copies would meet whole in every tile. They are joined up first: sets that share a minhash are each
verified against one pivot, twice. The tiles compare only sets that are not yet in one component, which loses no link
between components. A shingle that only one component holds makes no tile at all; a large tile is cut into blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewire.llm.common import cut, give_back, join_checked, text_slices, unused
from tidewire.llm.components import components

WORDS, MINHASHES = 5, 6
#: Sets of one tile that are compared by one task at most, as against as many others, and pairs that are tested at once.
TILE_ROWS, TEST_PAIRS = 2048, 1 << 18
#: Tiles of more rows than this carry the sets' bitmaps; of smaller ones, pairs are formed first and bitmaps joined to them.
SMALL_TILE = 64
#: A family's sets are verified in blocks of about this many, or of this many shingles, and each pair of blocks on its own.
FAMILY_ROWS, FAMILY_SHINGLES = 256, 1 << 20
#: Counters of the sketch (2 to the power of SKETCH_BITS, a byte each once they are summed up), and its parts.
SKETCH_BITS, SKETCH_PARTS = 22, 1024
#: Shared shingles before its own that a row of a tile knows.
BEFORE = 3

_U = np.uint64
_rng = np.random.default_rng(20240101)
_BYTE_CODE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE_CODE[_IS_SPACE] = 0
_BYTE_CODE[0x41:0x5B] = _BYTE_CODE[0x61:0x7B]
_STEP, _PLACE = _U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93)
_SALTS = _rng.integers(1, 1 << 63, MINHASHES, dtype=np.uint64) * _U(2) + _U(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _rolled(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words and of the shingles that start at them, of all texts in a row; the first and last + 1 word of each."""
    data = np.frombuffer(b"\n".join([t or b"" for t in texts]) + b"\n", np.uint8)
    ends = np.cumsum(np.array([len(t or b"") + 1 for t in texts], np.int64))
    word = ~_IS_SPACE[data]
    start = word.copy()
    start[1:] &= ~word[:-1]
    at = np.flatnonzero(start)
    if not len(at):
        none = np.zeros(len(texts), np.int64)
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), none, none
    within = np.arange(len(data), dtype=np.int64) - np.repeat(np.concatenate(([0], at)), np.diff(np.concatenate(([0], at, [len(data)]))))
    longest = int(within[word].max()) + 1
    powers = np.multiply.accumulate(np.concatenate(([_U(1)], np.full(longest, _STEP, np.uint64))))
    terms = _BYTE_CODE[data] * powers[np.minimum(within, longest)]
    hashed = _mix(np.add.reduceat(terms, at))
    first = np.searchsorted(at, np.concatenate(([0], ends[:-1])))
    last = np.searchsorted(at, ends)
    rolled = np.zeros(len(hashed), np.uint64)
    for k in range(WORDS):
        rolled[: len(hashed) - k] = rolled[: len(hashed) - k] * _PLACE + hashed[k:] if k else hashed
    return hashed, _mix(rolled), first, last


def shingle_sets(texts: list[bytes | None]) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the 5-word shingles of each text; fewer words make one shingle, none an empty set.

    Words are [^\\x20\\x09-\\x0D]+ with A-Z in lower case. All texts are hashed together.
    """
    hashed, rolled, first, last = _rolled(texts)
    out = []
    for a, b in zip(first.tolist(), last.tolist()):
        if b - a >= WORDS:
            out.append(np.unique(rolled[a : b - WORDS + 1]))
        elif b > a:
            whole = np.zeros(1, np.uint64)
            for h in hashed[a:b]:
                whole = whole * _PLACE + h
            out.append(_mix(whole + _U(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def bitmap(hashes: np.ndarray) -> bytes:
    """As many bits as the next power of two over twice the number of hashes, from 512 to 32768 (larger sets get blunter bounds)."""
    bits = np.zeros(min(1 << 15, max(512, 2 << int(len(hashes) - 1).bit_length())), np.uint8)
    bits[(hashes & _U(len(bits) - 1)).astype(np.int64)] = 1
    return np.packbits(bits).tobytes()


def needed(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Smallest overlap i of sets of n and m elements with 100 i >= 80 (n + m - i)."""
    return -(-4 * (n + m) // 9)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    for b in text_slices(batches, most=1 << 19):
        yield b, pc.cast(b.column("text"), pa.large_binary()).to_pylist()


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The shingles of a task, counted by the leading bits of their hashes (to 255 at most), a row for each part of the counters."""
    counts = np.zeros(1 << SKETCH_BITS, np.uint32)
    for _, texts in _texts(batches):
        np.add.at(counts, (_rolled(texts)[1] >> _U(64 - SKETCH_BITS)).astype(np.int32), np.uint32(1))
    parts = np.minimum(counts, 255, out=counts).astype(np.uint8).reshape(SKETCH_PARTS, -1)
    del counts
    used = np.flatnonzero(parts.any(1))
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([parts[i].tobytes() for i in used], pa.binary())], ["part", "counts"])


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts of counters, added up where they arrive; each comes out as twice the logarithm of its counters, up to 127."""
    sums: dict[int, np.ndarray] = {}
    for b in batches:
        for part, counts in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            sums[part] = sums.get(part, 0) + np.frombuffer(counts, np.uint8).astype(np.int64)
    codes = [np.minimum(2 * np.log2(1 + c), 127).astype(np.uint8).tobytes() for c in sums.values()]
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(codes, pa.binary())], ["part", "codes"])


def frequency_codes(docs: DataFrame) -> np.ndarray:
    """How often shingles stand in all documents, as a code for each value of the leading SKETCH_BITS bits of their hashes."""
    parts = docs.select("text").mapInArrow(_tally, "part int, counts binary").repartition("part")
    out = np.zeros((SKETCH_PARTS, (1 << SKETCH_BITS) // SKETCH_PARTS), np.uint8)
    for r in parts.mapInArrow(_add_up, "part int, codes binary").collect():  # SKETCH_PARTS rows at most
        out[r["part"]] = np.frombuffer(r["codes"], np.uint8)
    return out.reshape(-1)


def in_order(hashes: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Tokens of the hashes, which sort as the corpus-wide order has them: 7 bits of frequency, then 57 bits of the hash."""
    return np.sort((codes[(hashes >> _U(64 - SKETCH_BITS)).astype(np.int64)].astype(np.uint64) << _U(57)) | (hashes >> _U(7)))


def _sign(codes: np.ndarray):
    """Signature rows: size, 128-bit key of the set, minhashes, prefix and bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, texts in _texts(batches):
            n, key, mins, prefix, maps = [], [], [], [], []
            for s in shingle_sets(texts):
                n.append(len(s))
                if len(s):
                    key.append(np.array([s.sum(dtype=np.uint64), _mix(s ^ _STEP).sum(dtype=np.uint64)]).tobytes())
                    mins.append(np.array([(s * x).min() for x in _SALTS]).tobytes())
                    prefix.append(in_order(s, codes)[: len(s) - (4 * len(s) + 4) // 5 + 1].tobytes())
                    maps.append(bitmap(s))
                else:
                    for x in (key, mins, prefix, maps):
                        x.append(b"")
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int32()), *[pa.array(x, pa.binary()) for x in (key, mins, prefix, maps)]], ["doc_id", "n", "set_key", "mins", "prefix", "bits"])

    return run


def _explode(column: str, keep: list[str]):
    """A row per hash in a binary column, with its number from 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, 256):
                part = b.slice(a, 256)
                hashes = [np.frombuffer(x, np.int64) for x in part.column(column).to_pylist()]
                counts = np.array([len(h) for h in hashes], np.int64)
                flat = np.concatenate(hashes)
                number = np.arange(len(flat)) - np.repeat(np.cumsum(counts) - counts, counts)
                rows = pa.array(np.repeat(np.arange(len(hashes)), counts))
                yield pa.RecordBatch.from_arrays([pa.array(flat), pa.array(number.astype(np.int32)), *[part.column(c).take(rows) for c in keep]], ["token", "slot", *keep])
        give_back()

    return run


def _intersect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (family, low, high, pair): first the texts of a place, then the pairs to intersect."""
    now, sets = None, {}
    for batch, texts in _texts(batches):
        found = []
        rows = zip(*(batch.column(c).to_pylist() for c in ("family", "low", "high", "pair", "a", "b")), shingle_sets(texts))
        for family, low, high, pair, a, b, s in rows:
            if (family, low, high) != now:
                now, sets = (family, low, high), {}
            if not pair:
                own = sets.setdefault(a, [])
                if len(s) and not any(np.array_equal(s, x) for x in own):
                    own.append(s)
            elif any(_links(x, y) for x in sets.get(a, ()) for y in sets.get(b, ())):
                found.append((a, b))
        yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in found], pa.int64()) for j in (0, 1)], ["a", "b"])


def _links(x: np.ndarray, y: np.ndarray) -> bool:
    small, large = (x, y) if len(x) <= len(y) else (y, x)
    least = int(needed(np.int64(len(x)), np.int64(len(y))))
    if len(small) < least:
        return False
    at = np.searchsorted(large, small)
    return int((large[np.minimum(at, len(large) - 1)] == small).sum()) >= least


def _families(pairs: DataFrame) -> DataFrame:
    """Pairs with a family: a label that goes down along two steps of pairs; the smaller end's where the ends differ."""
    both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    one = cut(both.groupBy("a").agg(F.min("b").alias("_m")).select(F.col("a").alias("x"), F.least("a", "_m").alias("l")), "jaccard-label")
    two = both.join(one, F.col("b") == F.col("x")).groupBy("a").agg(F.min("l").alias("_m"))
    label = cut(two.join(one, F.col("a") == F.col("x")).select("x", F.least("l", "_m").alias("l")), "jaccard-label")
    ends = pairs.join(label.select(F.col("x").alias("a"), F.col("l").alias("_la")), "a").join(label.select(F.col("x").alias("b"), F.col("l").alias("_lb")), "b")
    return cut(ends.select("a", "b", "na", "nb", F.least("_la", "_lb").alias("family")), "jaccard-ends")


def verified(docs: DataFrame, pairs: DataFrame, stars: bool) -> DataFrame:
    """Of pairs (a, b, na, nb) of ids and set sizes, those (a, b) whose sets link.

    Pairs are verified where the texts of a family lie together, so that a text travels once for all its pairs; the family
    of a star is its pivot a. Large families are cut into blocks by their members, and a pair goes to the place of its
    ends' blocks.
    """
    spark = docs.sparkSession
    if pairs.isEmpty():
        return pairs.select("a", "b")
    ends = pairs.withColumn("family", F.col("a")) if stars else _families(pairs)
    members = ends.select("family", F.col("a").alias("id"), F.col("na").alias("n")).unionByName(ends.select("family", F.col("b").alias("id"), F.col("nb").alias("n")))
    members = members.groupBy("family", "id").agg(F.max("n").alias("n")).groupBy("family").agg(F.count(F.lit(1)).alias("_n"), F.sum("n").alias("_s"))
    blocks = F.greatest(F.ceil(F.col("_n") / FAMILY_ROWS), F.ceil(F.col("_s") / FAMILY_SHINGLES), F.lit(1))
    size = members.select("family", blocks.cast("int").alias("_blocks"))
    block = lambda c: F.pmod(F.xxhash64(c), F.col("_blocks")).cast("int")
    placed = ends.join(size, "family").withColumn("_x", block("a")).withColumn("_y", block("b"))
    placed = cut(placed.select("family", F.least("_x", "_y").alias("low"), F.greatest("_x", "_y").alias("high"), "a", "b"), "jaccard-places")
    of = [placed.select(F.col(c).alias("id"), "family", "low", "high") for c in ("a", "b")]
    roles = cut(of[0].unionByName(of[1]).distinct(), "jaccard-roles")
    texts = join_checked(docs.select(F.col("doc_id").alias("_id"), "text"), roles, F.col("_id") == F.col("id"), "inner")
    rows = texts.select("family", "low", "high", F.lit(0).alias("pair"), F.col("id").alias("a"), F.lit(None).cast("long").alias("b"), "text")
    rows = rows.unionByName(placed.select("family", "low", "high", F.lit(1).alias("pair"), "a", "b", F.lit(None).cast("string").alias("text")))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), roles.count() // 20_000 + 1)
    dealt = rows.repartition(tasks, "family", "low", "high").sortWithinPartitions("family", "low", "high", "pair")
    return cut(dealt.mapInArrow(_intersect, "a long, b long").distinct(), "jaccard-links")


def _fold(maps: list[bytes], width: int) -> np.ndarray:
    """Bitmaps as rows of 64-bit words, all folded to a width (in bytes) that none is below."""
    return np.stack([np.bitwise_or.reduce(np.frombuffer(m, np.uint8).reshape(-1, width), axis=0) for m in maps]).view(np.uint64)


def _may_link(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Which pairs of sets of n and m elements with bitmaps x and y can overlap enough."""
    bound = np.minimum(n - np.bitwise_count(x & ~y).sum(1, dtype=np.int64), m - np.bitwise_count(y & ~x).sum(1, dtype=np.int64))
    return bound >= needed(n, m)


def _bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b, na, nb) with both bitmaps -> those that bit counts let through."""
    for batch in batches:
        for a in range(0, batch.num_rows, 2048):
            t = batch.slice(a, 2048)
            n, m = (t.column(c).to_numpy() for c in ("na", "nb"))
            left, right = t.column("bits_a").to_pylist(), t.column("bits_b").to_pylist()
            width = np.array([min(len(x), len(y)) for x, y in zip(left, right)], np.int64)
            keep = np.zeros(t.num_rows, bool)
            for w in np.unique(width):
                at = np.flatnonzero(width == w)
                keep[at] = _may_link(_fold([left[i] for i in at], w), _fold([right[i] for i in at], w), n[at], m[at])
            yield pa.RecordBatch.from_arrays([t.column(c).filter(pa.array(keep)) for c in ("a", "b", "na", "nb")], ["a", "b", "na", "nb"])


def _tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by tile -> pairs (a, b, na, nb), a < b, of different components that sizes and places (and bit counts, if
    rows have bitmaps) let through.

    A pair that is seen to share an earlier shingle is left to the tile of that shingle (of its earliest one at the latest).
    Whole tiles are gathered up to a bound; pairs are tested as they come, and only those that pass are held.
    """
    keys = ("token", "band", "low", "high")

    def compare(t: pa.Table) -> pa.RecordBatch:
        ids, comp, n, slot = (t.column(c).to_numpy() for c in ("id", "comp", "n", "slot"))
        home, side = t.column("home").to_numpy(), t.column("block").to_numpy()
        one_block = t.column("low").to_numpy() == t.column("high").to_numpy()
        group = np.concatenate(([0], np.cumsum(np.any([x[1:] != x[:-1] for x in (t.column(c).to_numpy() for c in keys)], axis=0))))
        maps = t.column("bits").to_pylist() if "bits" in t.column_names else None
        width = None if maps is None else np.array([len(m) for m in maps])
        before = np.stack([t.column(f"before{k}").to_numpy() for k in range(BEFORE)], axis=1)
        n = n.astype(np.int64)
        left = n - slot  # elements from the shared shingle on
        folded: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        kept: list[np.ndarray] = []

        def test(i: np.ndarray, j: np.ndarray) -> None:
            known = ((before[i][:, :, None] == before[j][:, None]) & (before[i] != 0)[:, :, None]).any((1, 2))
            i, j = i[~known], j[~known]
            if maps is None:
                kept.append(np.stack([i, j]))
                return
            common = np.minimum(width[i], width[j])
            for w in np.unique(common):
                if w not in folded:
                    wide = np.flatnonzero(width >= w)
                    place = np.zeros(len(width), np.int64)
                    place[wide] = np.arange(len(wide))
                    folded[w] = place, _fold([maps[k] for k in wide], w)
                place, bits = folded[w]
                some = np.flatnonzero(common == w)
                step = max(1, (1 << 23) // int(w))
                for s in range(0, len(some), step):
                    p, q = i[some[s : s + step]], j[some[s : s + step]]
                    ok = _may_link(bits[place[p]], bits[place[q]], n[p], n[q])
                    kept.append(np.stack([p[ok], q[ok]]))

        rows, lag, some, count = np.arange(len(ids)), 0, [], 0
        while len(rows):
            lag += 1
            rows = rows[rows + lag < len(ids)]
            rows = rows[group[rows] == group[rows + lag]]
            least = needed(n[rows], n[rows + lag])
            near = n[rows] >= least  # rows are in order of size: too far apart now, too far from here on
            rows, least = rows[near], least[near]
            i, j = rows, rows + lag
            ok = (comp[i] != comp[j]) & (home[i] | home[j]) & (one_block[i] | (side[i] != side[j])) & (np.minimum(left[i], left[j]) >= least)
            if ok.any():
                some.append((i[ok], j[ok]))
                count += int(ok.sum())
                if count >= TEST_PAIRS:
                    test(*map(np.concatenate, zip(*some)))
                    some, count = [], 0
        if some:
            test(*map(np.concatenate, zip(*some)))
        i, j = np.concatenate(kept, axis=1) if kept else np.zeros((2, 0), np.int64)
        swap = ids[i] > ids[j]
        i, j = np.where(swap, j, i), np.where(swap, i, j)
        pairs = np.unique(np.stack([ids[i], ids[j], n[i], n[j]]), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in pairs], ["a", "b", "na", "nb"])

    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) < 20_000 and sum(x.nbytes for x in held) < 32 << 20:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        same = np.logical_and.reduce([t.column(c).to_numpy() == t.column(c)[-1].as_py() for c in keys])
        stop = int(np.flatnonzero(same)[0])
        if stop:
            yield compare(t.slice(0, stop))
        held = t.slice(stop).combine_chunks().to_batches()
    if held:
        yield compare(pa.Table.from_batches(held).combine_chunks())
    held.clear()
    give_back()


def tile_pairs(kept: DataFrame, moved: DataFrame) -> DataFrame:
    """Candidate pairs (a, b, na, nb) of the kept sets (doc_id, n, prefix, bits), given what components they are in already.

    Of a pair's first shared shingle, at least ceil(8 n / 9) elements of the smaller set are left, so a tile is of use only
    if it holds two components and a set of its own band that has the shingle as early as that. Tiles are sorted out by
    narrow rows; bitmaps are joined to what remains.
    """
    spark = kept.sparkSession
    sets = _with_component(kept.select(F.col("doc_id").alias("id"), "n", "prefix"), moved)
    explode = lambda keep, schema: sets.mapInArrow(_explode("prefix", keep), f"token long, slot int, {schema}")
    early = F.col("n") - F.col("slot") >= F.ceil(F.col("n") * 8 / F.lit(9.0) - 1e-9)
    two = [F.min("comp").alias("_least"), F.max("comp").alias("_most")]
    shared = explode(["n", "comp"], "n int, comp long").groupBy("token").agg(*two, F.max(early).alias("_early"))
    shared = cut(shared.where("_least < _most and _early").select(F.col("token").alias("_token")), "jaccard-shared")
    hits = join_checked(explode(["n", "comp", "id"], "n int, comp long, id long"), shared, F.col("token") == F.col("_token"), "left_semi")
    order = Window.partitionBy("id", "n").orderBy("slot")
    before = [f"before{k}" for k in range(BEFORE)]
    hits = hits.select("*", *[F.coalesce(F.lag("token", k + 1).over(order), F.lit(0).cast("long")).alias(c) for k, c in enumerate(before)])
    hits = cut(hits, "jaccard-hits")
    # a set is at home in its band, and a visitor to the band below
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(float(np.log(1.2501)))).cast("int")
    rows = hits.withColumn("home", F.explode(F.array(F.lit(True), F.lit(False)))).withColumn("band", band - F.when(F.col("home"), 0).otherwise(1))
    tiles = rows.groupBy("token", "band").agg(*two, F.max(F.col("home") & early).alias("_early"), F.count(F.lit(1)).alias("_rows"))
    tiles = tiles.where("_least < _most and _early").select(F.col("token").alias("_token"), F.col("band").alias("_band"), "_rows")
    rows = join_checked(rows, cut(tiles, "jaccard-tiles"), (F.col("token") == F.col("_token")) & (F.col("band") == F.col("_band")), "inner").drop("_token", "_band")
    rows = cut(rows, "jaccard-tile-rows")
    few = rows.count()
    maps = kept.select(F.col("doc_id").alias("_id"), F.col("n").alias("_n"), "bits")
    columns = ["token", "band", "low", "high", "block", "home", "id", "comp", "n", "slot", *before]
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), few // 20_000 + 1)
    paired = lambda df: df.repartition(tasks, "token", "band", "low", "high").sortWithinPartitions("token", "band", "low", "high", "n").mapInArrow(_tile, PAIRS)
    distinct = lambda df: df.groupBy("a", "b").agg(F.max("na").alias("na"), F.max("nb").alias("nb"))
    zero = F.lit(0)
    small = rows.where(F.col("_rows") <= SMALL_TILE).withColumns({c: zero for c in ("low", "high", "block")}).select(*columns)
    small = cut(distinct(paired(small)), "jaccard-small")
    end = lambda c: maps.select(F.col("_id").alias(f"_{c}"), F.col("_n").cast("long").alias(f"_n{c}"), F.col("bits").alias(f"bits_{c}"))
    on = lambda c: (F.col(c) == F.col(f"_{c}")) & (F.col(f"n{c}") == F.col(f"_n{c}"))
    small = small.join(end("a"), on("a")).join(end("b"), on("b")).select("a", "b", "na", "nb", "bits_a", "bits_b").mapInArrow(_bounded, PAIRS)

    large = rows.where(F.col("_rows") > SMALL_TILE).withColumn("_blocks", F.ceil(F.col("_rows") / TILE_ROWS).cast("int")).join(maps, (F.col("id") == F.col("_id")) & (F.col("n") == F.col("_n")))
    large = large.withColumn("block", F.pmod(F.xxhash64("id"), F.col("_blocks")).cast("int")).withColumn("_other", F.explode(F.sequence(zero, F.col("_blocks") - 1)))
    large = large.withColumn("low", F.least("block", "_other")).withColumn("high", F.greatest("block", "_other")).select(*columns, "bits")
    return cut(distinct(paired(large).unionByName(small)), "jaccard-candidates")


PAIRS = "a long, b long, na long, nb long"


def _moved(links: DataFrame) -> DataFrame:
    return cut(components(links).where("node != component").select(F.col("node").alias("_node"), "component"), "jaccard-merged")


def _with_component(df: DataFrame, moved: DataFrame) -> DataFrame:
    joined = join_checked(df, moved, F.col("id") == F.col("_node"), "left")
    return joined.withColumn("comp", F.coalesce("component", "id")).drop("_node", "component")


def star_pairs(mins: DataFrame, votes: bool) -> DataFrame:
    """mins (slot, token, id, n, comp) -> pairs (a, b, na, nb) of sets b and pivots a of other components that share a minhash.

    votes: of the pivots of a set only the one with which it shares most minhashes.
    """
    groups = mins.groupBy("slot", "token").agg(F.min(F.struct("comp", "id", "n")).alias("_p"), F.max("comp").alias("_last")).where("_p.comp < _last")
    pivots = cut(groups.select(F.col("slot").alias("_s"), F.col("token").alias("_t"), F.col("_p.comp").alias("_pc"), F.col("_p.id").alias("a"), F.col("_p.n").alias("na")), "jaccard-pivots")
    star = mins.join(pivots, (F.col("slot") == F.col("_s")) & (F.col("token") == F.col("_t"))).where("comp != _pc")
    star = star.groupBy(F.col("id").alias("b"), "a").agg(F.max("n").cast("long").alias("nb"), F.max("na").cast("long").alias("na"), F.count(F.lit(1)).alias("_votes"))
    if votes:
        star = star.groupBy("b").agg(F.min(F.struct(-F.col("_votes"), F.col("a"), F.col("na"), F.col("nb"))).alias("_best")).select("_best.a", "b", "_best.na", "_best.nb")
    return cut(star.select("a", "b", "na", "nb"), "jaccard-stars")


def jaccard_components(docs: DataFrame) -> DataFrame:
    """documents (doc_id, text) -> doc_id, n_shingles, component_id; a row per row of documents.

    component_id is the smallest doc_id reachable by links, itself included. Documents without words or text have no
    shingles and link with nothing. Rows that repeat a doc_id are one node, with a size for each row; rows with a null
    doc_id link with nothing and have a null component. An empty table gives an empty result; other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = cut(docs.mapInArrow(_sign(frequency_codes(docs)), "doc_id long, n int, set_key binary, mins binary, prefix binary, bits binary"), "jaccard-signed")
    known = signed.where("doc_id is not null and n > 0")
    classes = known.groupBy(F.col("set_key").alias("_key"), F.col("n").alias("_n")).agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("_rows"), F.count_distinct("doc_id").alias("_ids"))
    classes = cut(classes, "jaccard-classes")
    same_set = (F.col("set_key") == F.col("_key")) & (F.col("n") == F.col("_n"))
    several = classes.where("_rows > 1").select("_key", "_n", "rep")
    copies = cut(join_checked(known.select("doc_id", "n", "set_key"), cut(several, "jaccard-several"), same_set, "inner").where("doc_id != rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"), F.col("set_key").alias("_key")).distinct(), "jaccard-copies")
    kept = join_checked(known, copies.select(F.col("a").alias("_a"), "_key"), (F.col("doc_id") == F.col("_a")) & (F.col("set_key") == F.col("_key")), "left_anti")
    if not classes.where("_rows > _ids").isEmpty():  # rows that repeat an id with its text
        kept, docs = kept.dropDuplicates(["doc_id", "set_key"]), docs.distinct()

    mins = cut(kept.select("mins", F.col("doc_id").alias("id"), "n").mapInArrow(_explode("mins", ["id", "n"]), "token long, slot int, id long, n int"), "jaccard-mins")
    first = verified(docs, star_pairs(mins.withColumn("comp", F.col("id")), votes=True), stars=True)
    second = verified(docs, star_pairs(_with_component(mins, _moved(first)), votes=False), stars=True)
    linked = first.unionByName(second)
    rest = verified(docs, tile_pairs(kept, _moved(linked)), stars=False)

    edges = copies.select("a", "b").unionByName(linked).unionByName(rest)
    ends = cut(components(edges).where("node != component").select(F.col("node").alias("_node"), "component"), "jaccard-ends")
    out = join_checked(signed.select("doc_id", "n"), ends, F.col("doc_id") == F.col("_node"), "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents with the smallest doc_id of their component, with their own columns. Null doc_ids stay."""
    (name,) = unused(docs, "dropped")
    dropped = jaccard_components(docs).where("doc_id != component_id").select(F.col("doc_id").alias(name)).distinct()
    return join_checked(docs, cut(dropped, "jaccard-dropped"), docs["doc_id"] == F.col(name), "left_anti")
