"""The registered queries over these operators."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clearcase.llm import bpe, codes, lm, near, packing, pii, quality, repair, sharding, suffixes, toxicity, trie, vectors
from clearcase.llm.common import in_fold, table

WORD_BPE = "word_bpe_49k.json"


def op1_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of every text, learnt from six sevenths of the documents."""
    return lm.scored(table(spark, sf_dir, "documents"), 7, 2)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The probability that each document is of good quality, by its text, host and path; learnt outside fold 0 of 5."""
    docs = table(spark, sf_dir, "documents")
    rows = quality.scored(docs, quality.trained(docs, table(spark, sf_dir, "labels")))
    return rows.select("doc_id", in_fold(F.col("doc_id"), 5, 0).alias("held_out"), "evidence", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents that share three quarters of their 5-word shingles."""
    return near.near_duplicates(table(spark, sf_dir, "documents"))


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every text: counts and digests of the base spans, and all spans."""
    rows = pii.personal_data(table(spark, sf_dir, "documents"))
    counts = [F.expr(f"cast(size(filter(base, c -> c.kind = {k})) AS long)").alias(f"n_{name}") for k, name in enumerate(pii.KINDS)]
    return rows.select("doc_id", *counts, F.sha2(F.expr(pii.joined("base")).cast("binary"), 256).alias("base_sha256"), F.expr(pii.joined("spans")).alias("spans"))


def op5_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of all vectors with cosine 0.95 or more."""
    return vectors.linked_vectors(table(spark, sf_dir, "embeddings"), 0.95)


def op6_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest sign codes, among all rows, of every row whose id is divisible by 20."""
    every = codes.sign_codes(table(spark, sf_dir, "embeddings"))
    return codes.nearest(every, every.filter(F.col("id") % 20 == 0), 10)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in 8 shards of near-equal bytes."""
    rows = sharding.sharded(table(spark, sf_dir, "documents"), 8)
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"),
        F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document tokens in sequences of at most 4096."""
    rows = packing.packed(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))
    return rows.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every text's ids and of their decoded text."""
    rows = bpe.encoded(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))
    return rows.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score for every document, learnt outside fold 0 of 5."""
    docs = table(spark, sf_dir, "documents")
    rows = toxicity.scored(docs, toxicity.trained(docs, table(spark, sf_dir, "labels")))
    return rows.select(
        "doc_id", in_fold(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "gain",
    )


def op11_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct prefix of the rebuilt conversations, with sums over its subtree."""
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damaged conversations and their cheapest repair."""
    return repair.after_damage(table(spark, sf_dir, "conversations"))


def op13_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text without the bytes that 400-byte strings repeat elsewhere."""
    rows = suffixes.without_repeats(table(spark, sf_dir, "documents"), 400)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return rows.select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_scores": op1_scores,
    "op2_quality": op2_quality,
    "op3_near_duplicates": op3_near_duplicates,
    "op4_personal_data": op4_personal_data,
    "op5_vectors": op5_vectors,
    "op6_codes": op6_codes,
    "op7_sharding": op7_sharding,
    "op8_packing": op8_packing,
    "op9_bpe": op9_bpe,
    "op10_toxicity": op10_toxicity,
    "op11_trie": op11_trie,
    "op12_repair": op12_repair,
    "op13_suffixes": op13_suffixes,
}

#: Brute force over the same sign codes.
CODES_SQL = """
WITH c AS (
  SELECT vec_id AS id, bit_string AS code FROM (
    SELECT vec_id, array_to_string([CASE WHEN x > 0 THEN '1' ELSE '0' END FOR x IN embedding[1:64]], '') AS bit_string
    FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding[1:64] IF x IS NULL]) = 0)
), d AS (
  SELECT q.id AS query_id, c.id AS neighbour_id, CASE WHEN q.code = c.code THEN 0 ELSE hamming(q.code, c.code) END AS distance
  FROM (SELECT * FROM c WHERE id % 20 = 0) q, c WHERE q.id <> c.id
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbour_id) AS rank FROM d
)
SELECT query_id, neighbour_id, distance::INT AS distance, rank::INT AS rank FROM r WHERE rank <= 10
"""

#: The same trie by comparing whole prefixes; CRC-32 is worked out bit by bit.
TRIE_SQL = """
WITH o AS (
  SELECT conv_id, coalesce(text, '') AS text, sha256(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS digest,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) AS r
  FROM conversations WHERE conv_id IS NOT NULL
), c AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base, xor(4294967295, list_reduce(
      list_concat([4294967295::BIGINT], list_transform(string_split(conv_id::VARCHAR, ''), lambda s: ascii(s)::BIGINT)),
      lambda a, b: list_reduce(list_concat([xor(a, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, z: xor(x >> 1, 3988292384 * (x & 1))))) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM o)
), b AS (
  SELECT c.conv_id, 0 AS own, o.r, o.digest, o.text FROM c JOIN o ON o.conv_id = c.base AND o.r <= c.h
  UNION ALL SELECT c.conv_id, 1, o.r, o.digest, o.text FROM c JOIN o ON o.conv_id = c.conv_id AND o.r > c.h
), t AS (
  SELECT conv_id, text, row_number() OVER w AS depth, md5(string_agg(digest, ',') OVER w) AS node FROM b WINDOW w AS (PARTITION BY conv_id ORDER BY own, r ROWS UNBOUNDED PRECEDING)
), l AS (
  SELECT c.conv_id, coalesce(max(t.depth), 0) AS turns FROM c LEFT JOIN t USING (conv_id) GROUP BY ALL
), p AS (
  SELECT conv_id, depth, node, coalesce(lag(node) OVER (PARTITION BY conv_id ORDER BY depth), 'root') AS parent,
         len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS words FROM t
  UNION ALL SELECT conv_id, 0, 'root', NULL, 0 FROM c
), n AS (
  SELECT node, any_value(depth) AS depth, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words FROM p GROUP BY node
), k AS (
  SELECT n.*, (SELECT count(*) FROM n AS m WHERE m.parent = n.node) AS n_children FROM n
), s AS (
  SELECT p.node, sum((k.n_children = 0)::INT) AS n_leaves, sum((k.n_convs - 1) * k.words) AS saved_tokens
  FROM k JOIN p ON p.conv_id = k.conv_id AND p.depth <= k.depth GROUP BY p.node
), e AS (
  SELECT p.node, sha256(string_agg(p.conv_id::VARCHAR, ',' ORDER BY p.conv_id)) AS ends FROM p JOIN l ON l.conv_id = p.conv_id AND l.turns = p.depth GROUP BY p.node
)
SELECT k.conv_id, k.depth::BIGINT AS depth, m.conv_id AS parent_conv_id, k.n_convs, k.n_children, s.n_leaves::BIGINT AS n_leaves,
       s.saved_tokens::BIGINT AS saved_tokens, coalesce(e.ends, sha256('')) AS ends_sha256
FROM k JOIN s USING (node) LEFT JOIN e USING (node) LEFT JOIN n AS m ON m.node = k.parent
"""

ORACLES: dict[str, str] = {"op6_codes": CODES_SQL, "op11_trie": TRIE_SQL}
