"""The registered queries of the training-data operators, thin over the operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidewire.llm import bpe, embedding_dedup, exact_dedup, language_id, license_scan, mixing, ngram_join, pii, sharding, warc
from tidewire.llm.common import table


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.write_archives(table(spark, sf_dir, "pages"))
    return warc.read_records(index, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(table(spark, sf_dir, "documents")))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_digest(table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "first_shard")


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encode_digests(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_ngram_jaccard": op2_ngram_jaccard,
    "op3_sharding": op3_sharding,
    "op4_embedding_dedup": op4_embedding_dedup,
    "op5_pii": op5_pii,
    "op6_license_scan": op6_license_scan,
    "op7_mixing": op7_mixing,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_language_id": op10_language_id,
}

ORACLES: dict[str, str] = {
    "op1_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
g AS (SELECT page_id, payload, strlen(payload) AS n, CASE WHEN strlen(payload) >= 1000 THEN max(page_id) OVER (PARTITION BY payload) END AS last FROM p)
SELECT page_id, n AS payload_bytes, sha1(payload) AS payload_digest,
       CASE WHEN last > page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN last > page_id THEN last END AS refers_to
FROM g
""",
    "op2_ngram_jaccard": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS g FROM w),
s AS (SELECT DISTINCT doc_id, len(g) AS n, unnest(g) AS h FROM g),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i, any_value(a.n) + any_value(b.n) AS nm FROM s a JOIN s b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p WHERE 100 * i >= 80 * (nm - i) UNION ALL SELECT y, x FROM p WHERE 100 * i >= 80 * (nm - i)),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
c AS (SELECT x, min(y) AS component_id FROM r GROUP BY x)
SELECT doc_id, len(g)::BIGINT AS n_shingles, component_id FROM g JOIN c ON x = doc_id
""",
    # CRC-32 by its polynomial, and the levels of the tree one after another
    "op3_sharding": r"""
WITH d AS (SELECT doc_id, coalesce(doc_id::VARCHAR, '') AS key, (strlen(coalesce(text, '')) + 16)::BIGINT AS size, hex(encode(coalesce(text, ''))) AS hex FROM documents),
t AS (SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 1, 2, 3, 4, 5, 6, 7], lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS tab),
b AS (SELECT doc_id, key, size, xor(list_reduce([4294967295::BIGINT] || list_transform(regexp_extract_all(hex, '..'), lambda h: ('0x' || h)::BIGINT), lambda c, b: xor(c // 256, tab[xor(c, b) % 256 + 1])), 4294967295) AS text_crc32 FROM d, t),
k AS (SELECT DISTINCT key FROM d),
q AS (SELECT key, c, -ln((('0x' || substr(sha256(key || ':root:0'), 1 + 13 * c, 13))::BIGINT + 0.5) / 4503599627370496) / [16, 16, 8, 1][c + 1] AS d FROM k, (SELECT unnest([0, 1, 2, 3]) AS c)),
r AS (SELECT key, arg_min(c, d) FILTER (c < 3) AS region, arg_min(c, d) = 3 AS moves FROM q GROUP BY key),
x AS (SELECT key, region, moves, arg_min(c, -ln((('0x' || substr(sha256(key || ':' || region || ':0'), 1 + 13 * c, 13))::BIGINT + 0.5) / 4503599627370496)) AS rack FROM r, (SELECT unnest([0, 1, 2, 3]) AS c) WHERE c < CASE WHEN region = 2 THEN 2 ELSE 4 END GROUP BY 1, 2, 3),
s AS (SELECT key, moves, 16 * region + 4 * rack + arg_min(c, -ln((('0x' || substr(sha256(key || ':' || region || '.' || rack || ':0'), 1 + 13 * c, 13))::BIGINT + 0.5) / 4503599627370496)) AS shard FROM x, (SELECT unnest([0, 1, 2, 3]) AS c) GROUP BY key, moves, region, rack)
SELECT doc_id, size, text_crc32, 'key' AS law, shard::INTEGER AS shard, CASE WHEN moves THEN 40 ELSE shard::INTEGER END AS grown_shard,
 row_number() OVER (PARTITION BY shard ORDER BY ('0x' || substr(md5(key || ':' || size || ':' || text_crc32), 1, 8))::BIGINT % 256, doc_id NULLS FIRST, size, text_crc32) - 1 AS slot
FROM b JOIN s USING (key)
""",
    "op4_embedding_dedup": """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b
      ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.98),
r AS (SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
c AS (SELECT x, min(y) AS component_id FROM r GROUP BY x),
n AS (SELECT x, count(*) AS n FROM l GROUP BY x)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e LEFT JOIN c ON c.x = e.vec_id LEFT JOIN n ON n.x = e.vec_id
""",
    "op9_exact_dedup": """
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id IS NOT DISTINCT FROM min(doc_id) OVER g AS kept, sha256(norm) AS text_sha256
FROM t WINDOW g AS (PARTITION BY norm)
""",
}
