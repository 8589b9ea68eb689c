"""Near-duplicate vectors by iterative quantisation.

A rotation of the principal axes is learned so that signs of the rotated coordinates lose least (Gong and Lazebnik,
2011). Codes are cut into chunks, one hash table a chunk; a vector looks up its chunk and all chunks one bit away in
every table (multi-index hashing: of m chunks that differ in fewer than 2 m bits together, one differs in at most one).
What is found within a Hamming radius of the whole codes is reranked with the original vectors, in double precision.
Chunks have as many bits as the number of vectors has, so that a bucket holds about as many unrelated vectors at every
size. How many tables there are and the radius come from the sample: each of its vectors gets a planted partner at the
threshold itself, and tables are added until nearly all partners are found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import cut, join_checked
from tidewire.llm.components import components

#: Bound of the sample that rotations are learned from; every vector is indexed.
SAMPLE_ROWS = 4096
#: Numbers of tables that are tried in turn, and the share of planted partners that is enough.
TABLES, ENOUGH = (4, 6, 8, 12, 16, 24, 32, 48), 0.995


def learn_rotation(x: np.ndarray, seed: int, rounds: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection d x d) from unit vectors x: principal axes, then the rotation that iterative quantisation finds."""
    d, rng = x.shape[1], np.random.default_rng(seed)
    mean = x.mean(0)
    _, axes = np.linalg.eigh(np.cov((x - mean).T) if len(x) > 1 else np.eye(d))
    v = (x - mean) @ axes
    r, _ = np.linalg.qr(rng.normal(size=(d, d)))
    for _ in range(rounds):
        u, _, w = np.linalg.svd(np.sign(v @ r).T @ v)
        r = (u @ w).T
    return mean, axes @ r


def _bits(x: np.ndarray, rotations: list[tuple[np.ndarray, np.ndarray]], count: int) -> np.ndarray:
    with np.errstate(all="ignore"):
        unit = np.nan_to_num(x / np.linalg.norm(x, axis=1, keepdims=True))
    return np.concatenate([(unit - m) @ p > 0 for m, p in rotations], axis=1)[:, :count]


def fitted(x: np.ndarray, chunk_bits: int, threshold: float, seed: int = 11) -> tuple[list[tuple[np.ndarray, np.ndarray]], int, int, float]:
    """(rotations, tables, radius, recall) for unit vectors x: the fewest tables that find ENOUGH of the planted partners.

    The partner of a vector lies at the cosine `threshold` in a random direction, where links are hardest to find. Rotations
    are learned from two thirds of the vectors, and the others get partners (all do both, if there are few).
    """
    d, rng = x.shape[1], np.random.default_rng(seed)
    learn, x = (x, x) if len(x) < 64 else (x[: 2 * len(x) // 3], x[2 * len(x) // 3 :])
    side = rng.normal(size=x.shape)
    side -= (side * x).sum(1, keepdims=True) * x
    with np.errstate(all="ignore"):
        side = np.nan_to_num(side / np.linalg.norm(side, axis=1, keepdims=True))
    partner = threshold * x + np.sqrt(max(0.0, 1 - threshold**2)) * side
    rotations: list[tuple[np.ndarray, np.ndarray]] = []
    for tables in TABLES:
        while len(rotations) * d < tables * chunk_bits:
            rotations.append(learn_rotation(learn, len(rotations)))
        differ = _bits(x, rotations, tables * chunk_bits) != _bits(partner, rotations, tables * chunk_bits)
        hit = (differ.reshape(len(x), tables, chunk_bits).sum(2) <= 1).any(1)
        recall = float(hit.mean()) if len(x) else 1.0
        if recall >= ENOUGH or d == 1:
            break
    return rotations, tables, int(np.ceil(1.5 * differ.sum(1).max(initial=0))) + 1, recall


def _tables(d: int, rotations: list[tuple[np.ndarray, np.ndarray]], tables: int, chunk_bits: int):
    weights = (np.int64(1) << np.arange(chunk_bits, dtype=np.int64)).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 2048):
                b = batch.slice(a, 2048)
                rows = b.column("vector").to_pylist()
                x = np.zeros((len(rows), d))
                for i, v in enumerate(rows):
                    x[i, : min(d, len(v))] = v[:d]
                bits = _bits(x, rotations, tables * chunk_bits)
                chunks = bits.reshape(len(rows), tables, chunk_bits) @ weights
                code = np.packbits(bits, axis=1)
                code = np.pad(code, ((0, 0), (0, -code.shape[1] % 8))).view(np.int64)
                again = pa.array(np.repeat(np.arange(len(rows)), tables))
                codes = pa.ListArray.from_arrays(pa.array(np.arange(0, code.size + 1, code.shape[1], dtype=np.int32)), pa.array(code.reshape(-1)))
                yield pa.RecordBatch.from_arrays(
                    [b.column("cls").take(again), b.column("place").take(again), pa.array(np.tile(np.arange(tables, dtype=np.int32), len(rows))), pa.array(chunks.reshape(-1)), codes.take(again)],
                    ["cls", "place", "table", "chunk", "code"],
                )

    return run


def linked_pairs(classes: DataFrame, threshold: float, sample_rows: int = SAMPLE_ROWS, chunk_bits: int | None = None) -> DataFrame:
    """classes (cls, place, vector of double, norm) -> a, b with a < b, equal place, cosine >= threshold; each pair once.

    Of two chunks that differ in one bit, the one with the bit unset looks the other up, so each pair meets once a table.
    """
    n = classes.count()
    sample = classes.select("vector").orderBy(F.xxhash64("vector"), "cls").limit(sample_rows).collect()
    d = max((len(r["vector"]) for r in sample), default=1)
    x = np.array([list(r["vector"]) + [0.0] * (d - len(r["vector"])) for r in sample]).reshape(len(sample), d)
    with np.errstate(all="ignore"):
        x = np.nan_to_num(x / np.linalg.norm(x, axis=1, keepdims=True))
    chunk_bits = chunk_bits or int(np.clip(np.ceil(np.log2(max(n, 2))), 8, 30))
    rotations, tables, radius, _ = fitted(x if len(x) else np.zeros((1, d)), chunk_bits, threshold)
    index = cut(classes.select("cls", "place", "vector").mapInArrow(_tables(d, rotations, tables, chunk_bits), "cls long, place string, table int, chunk long, code array<long>"), "itq-index")
    unset = F.filter(F.array(*[F.lit(1 << i).cast("long") for i in range(chunk_bits)]), lambda f: F.col("chunk").bitwiseAND(f) == 0)
    probes = index.select(F.col("cls").alias("a"), "place", "table", F.col("chunk").alias("_own"), F.col("code").alias("_ca"), F.explode(F.concat(F.array(F.lit(0).cast("long")), unset)).alias("_flip"))
    probes = probes.withColumn("chunk", F.col("_own").bitwiseXOR(F.col("_flip"))).drop("_own")
    found = probes.join(index.select(F.col("cls").alias("b"), "place", "table", "chunk", F.col("code").alias("_cb")), ["place", "table", "chunk"]).where("_flip > 0 or a < b")
    differ = F.aggregate(F.zip_with("_ca", "_cb", lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, v: s + v)
    found = found.where(differ <= radius).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    left = classes.select(F.col("cls").alias("a"), F.col("vector").alias("_va"), F.col("norm").alias("_na"))
    right = classes.select(F.col("cls").alias("b"), F.col("vector").alias("_vb"), F.col("norm").alias("_nb"))
    both = found.join(left, "a").join(right, "b")
    dot = F.aggregate(F.zip_with("_va", "_vb", lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    return both.where(dot / (F.col("_na") * F.col("_nb")) >= threshold).select("a", "b")


def near_duplicates(vectors: DataFrame, threshold: float = 0.98) -> DataFrame:
    """embeddings (vec_id, embedding, label) -> vec_id, n_links, component_id, kept; a row per row of embeddings.

    Vectors link when their labels are equal and not null and their cosine is at least threshold. Vectors that are null,
    empty, zero, or hold null or non-finite components, and rows with a null label, link with nothing, as vectors of
    unequal length do with each other. Equal vectors of a label are one class in the search, with a number of its own, and
    count one by one in n_links. A null vec_id links with nothing. Rows that repeat a vec_id are vectors of their own: equal
    ones link, and different ones share nothing but the id. An empty table gives an empty result; other columns are ignored.
    """
    as_double = F.col("embedding").cast("array<double>")
    finite = F.size("embedding") > 0
    finite &= ~F.exists(as_double, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    place = F.concat_ws(":", F.col("label").cast("string"), F.size("embedding").cast("string"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label")
    norm = F.sqrt(F.aggregate(F.col("vector"), F.lit(0.0), lambda s, v: s + v * v))
    usable = rows.where(F.coalesce(finite, F.lit(False)) & F.col("label").isNotNull() & F.col("vec_id").isNotNull())
    usable = usable.select("vec_id", place.alias("place"), as_double.alias("vector")).where(norm > 0)
    prints = [F.xxhash64("vector").alias("_h"), F.xxhash64(F.lit(1), "vector").alias("_g")]
    classes = usable.groupBy("place", "vector").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n")).withColumn("norm", norm)
    classes = cut(classes.select(F.monotonically_increasing_id().alias("cls"), "*", *prints), "itq-classes")
    pairs = cut(linked_pairs(classes, threshold), "itq-links")
    sizes = classes.select(F.col("cls").alias("_cls"), F.col("n").alias("_n"))
    ends = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    others = ends.join(sizes, F.col("b") == F.col("_cls")).groupBy("a").agg(F.sum("_n").alias("_others"))
    merged = components(pairs).withColumnRenamed("node", "_node")
    facts = classes.select("cls", "place", "_h", "_g", "rep", "n").join(others, F.col("cls") == F.col("a"), "left").join(merged, F.col("cls") == F.col("_node"), "left")
    facts = facts.withColumn("_root", F.coalesce("component", "cls"))
    facts = cut(facts.select("cls", "place", "_h", "_g", "rep", "_root", (F.coalesce("_others", F.lit(0)) + F.col("n") - 1).alias("n_links")), "itq-facts")
    least = cut(facts.groupBy(F.col("_root").alias("_r")).agg(F.min("rep").alias("component_id")), "itq-least")
    facts = cut(join_checked(facts, least, F.col("_root") == F.col("_r"), "inner").select("cls", F.col("place").alias("_place"), F.col("_h").alias("_fh"), F.col("_g").alias("_fg"), "n_links", "component_id"), "itq-named")
    # a row finds its class by a hash of 128 bits; were two classes to share one, by the vector itself
    same = (F.col("_p") == F.col("_place")) & (F.col("_h") == F.col("_fh")) & (F.col("_g") == F.col("_fg"))
    own = rows.withColumn("vector", as_double).withColumn("_p", F.when(F.coalesce(finite, F.lit(False)) & F.col("vec_id").isNotNull() & F.col("label").isNotNull(), place))
    if facts.groupBy("_place", "_fh", "_fg").count().where("count > 1").isEmpty():
        own = own.select("vec_id", "_p", *prints)
    else:
        facts = facts.join(classes.select("cls", F.col("vector").alias("_vector")), "cls")
        own, same = own.select("vec_id", "_p", "vector", *prints), same & (F.col("vector") == F.col("_vector"))
    out = own.join(facts, same, "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
