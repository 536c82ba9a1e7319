"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import (
    byte_bpe,
    conversation_trie,
    decontamination,
    lm_scoring,
    merkle_manifest,
    ngram_jaccard,
    quality_classifier,
    quality_rules,
    sharding,
    token_counts,
    token_output,
    toxicity,
    url_filters,
)
from docloom.sources.inputs import spread

RULES = [
    url_filters.Rule("net/", "block"),
    url_filters.Rule("example.net/en/", "allow"),
    url_filters.Rule("example.com/de/", "block"),
    url_filters.Rule("org/fr/", "allow"),
]


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.url_filter(_read(spark, sf_dir, "pages"), RULES)


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.ngram_jaccard(_read(spark, sf_dir, "documents"), size=4, num=85, den=100)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(_read(spark, sf_dir, "documents"))


def op4_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.token_output(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0)


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return byte_bpe.digests(byte_bpe.byte_bpe(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.lm_scores(_read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.byte_shards(_read(spark, sf_dir, "documents"), shards=24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.toxicity(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"), threshold=0.3)
    return scored.select("doc_id", "held_out", "score", "predicted")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), max_tokens=2048)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    n_chars = F.when(tampered, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    shown = merkle_manifest.leaf(*[n_chars if c == "n_chars" else F.col(c) for c in merkle_manifest.COLUMNS])
    rows = merkle_manifest.merkle_manifest(docs, carried={"shown": F.when(tampered, shown)})
    found = merkle_manifest.folded(F.coalesce("shown", "leaf"), F.col("proof"))
    out = rows.select("doc_id", "leaf", "subroot", "root", merkle_manifest.proof_digest(F.col("proof")).alias("proof_sha256"), found.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality_classifier.quality_classifier(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"), threshold=0.5)
    return scored.select("doc_id", "held_out", "score", "predicted")


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = F.col("conv")
    heads = (conv - conv % 100, F.crc32(conv.cast("string").cast("binary")) % 6, 5)
    nodes, _ = conversation_trie.conversation_trie(_read(spark, sf_dir, "conversations"), heads=heads)
    return nodes.select(
        conv.alias("conv_id"), "depth", F.col("parent_conv").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), "ends_sha256"
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filters": op1_url_filters,
    "op2_ngram_jaccard": op2_ngram_jaccard,
    "op3_quality_rules": op3_quality_rules,
    "op4_token_output": op4_token_output,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_lm_scoring": op6_lm_scoring,
    "op7_sharding": op7_sharding,
    "op8_toxicity": op8_toxicity,
    "op9_token_counts": op9_token_counts,
    "op10_decontamination": op10_decontamination,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_quality_classifier": op12_quality_classifier,
    "op13_conversation_trie": op13_conversation_trie,
}

#: Exact Jaccard links and their components, for op2.
_OP2 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(
    CASE WHEN ws IS NULL OR len(ws) = 0 THEN []
         WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
         ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(list_slice(ws, i, i + 3), ' ')) END) AS g
  FROM w
), n AS (
  SELECT d.doc_id, count(s.g) AS n FROM documents d LEFT JOIN s ON d.doc_id = s.doc_id GROUP BY d.doc_id
), ov AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k
  FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), e AS (
  SELECT ov.a, ov.b FROM ov JOIN n x ON x.doc_id = ov.a JOIN n y ON y.doc_id = ov.b
  WHERE 100 * k >= 85 * (x.n + y.n - k)
), u AS (
  SELECT a, b FROM e UNION ALL SELECT b, a FROM e
), r(doc_id, root) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT r.doc_id, u.b FROM r JOIN u ON u.a = r.root
)
SELECT n.doc_id, n.n AS n_shingles, min(r.root) AS component_id, coalesce(any_value(l.n_links), 0) AS n_links
FROM n JOIN r ON r.doc_id = n.doc_id LEFT JOIN (SELECT a, count(*) AS n_links FROM u GROUP BY a) l ON l.a = n.doc_id GROUP BY n.doc_id, n.n
"""

#: Prefix sums and shards, for op7; the CRC-32 table is built by its polynomial.
_OP7 = r"""
WITH tab AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END, i)) AS t),
h AS (SELECT doc_id, coalesce(text, '') AS text, hex(encode(coalesce(text, ''))) AS x FROM documents),
b AS (SELECT doc_id, CAST(length(x) // 2 AS BIGINT) + 8 AS size, list_transform(string_split(regexp_replace(x, '(..)', '\1,', 'g'), ',')[1:length(x) // 2], lambda p: CAST(('0x' || p) AS BIGINT)) AS bytes FROM h),
r AS (SELECT doc_id, size, xor(4294967295, list_reduce(bytes, lambda c, y: xor(c // 256, t[xor(c % 256, y) + 1]), 4294967295)) AS text_crc32 FROM b, tab),
p AS (SELECT *, sum(size) OVER (ORDER BY doc_id, text_crc32, size ROWS UNBOUNDED PRECEDING) - size AS before, sum(size) OVER () AS total, row_number() OVER (ORDER BY doc_id, text_crc32, size) AS n FROM r),
s AS (SELECT *, least(CAST((2 * before + size) * 24 // (2 * total) AS INTEGER), 23) AS shard FROM p)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, n - min(n) OVER (PARTITION BY shard) AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM s
"""

#: CRC-32 of a short text, by bytes; the table is built by its polynomial.
_CRC = r"""tab AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END, i)) AS t)"""
_CRC_OF = "xor(4294967295, list_reduce(list_transform(range(1, length({0}) + 1), lambda j: CAST(ascii(substring({0}, j, 1)) AS BIGINT)), lambda c, y: xor(c // 256, t[xor(c % 256, y) + 1]), 4294967295))"

#: Leaves, levels, proofs and folds, for op11.
_OP11 = rf"""
WITH RECURSIVE {_CRC},
rows AS (SELECT row_number() OVER (ORDER BY doc_id) AS r, *, CAST(doc_id AS VARCHAR) AS i, coalesce('=' || lang, '') AS tree FROM documents),
shown AS (SELECT *, n_chars + CASE WHEN {_CRC_OF.format("i")} % 7 = 0 THEN 1 ELSE 0 END AS m FROM rows, tab),
leaves AS (SELECT r, doc_id, tree, sha256(replace(head, '#', coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-')) || tail) AS own,
  sha256(replace(head, '#', coalesce(strlen(CAST(m AS VARCHAR)) || ':' || m, '-')) || tail) AS other
  FROM (SELECT *, coalesce(strlen(i) || ':' || i, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || '#' AS head,
    coalesce(strlen(text) || ':' || text, '-') AS tail FROM shown)),
placed AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, own) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM leaves),
t AS (SELECT tree, 0 AS lvl, pos, n, own AS digest FROM placed
  UNION ALL
  SELECT tree, lvl + 1, pos // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY pos)) FROM t WHERE n > 1 GROUP BY tree, lvl, pos // 2, n),
s AS (SELECT tree, digest, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM t WHERE n = 1),
u AS (SELECT 0 AS lvl, pos, n, digest FROM s
  UNION ALL
  SELECT lvl + 1, pos // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY pos)) FROM u WHERE n > 1 GROUP BY lvl, pos // 2, n),
steps AS (
  SELECT p.r, t.lvl, t.digest, t.pos < (p.pos >> t.lvl) AS is_left FROM placed p JOIN t ON t.tree = p.tree AND t.n > 1 AND t.pos = xor(p.pos >> t.lvl, 1)
  UNION ALL
  SELECT p.r, 100 + u.lvl, u.digest, u.pos < (s.pos >> u.lvl) FROM placed p JOIN s ON s.tree = p.tree JOIN u ON u.n > 1 AND u.pos = xor(s.pos >> u.lvl, 1)),
heights AS (SELECT tree, max(lvl) AS h FROM t GROUP BY tree),
every AS (
  SELECT p.r, k AS lvl FROM placed p JOIN heights USING (tree), range(0, 100) AS g(k) WHERE k < h
  UNION ALL
  SELECT p.r, 100 + k FROM placed p, range(0, 100) AS g(k) WHERE k < (SELECT max(lvl) FROM u)),
proofs AS (SELECT e.r, list({{'d': coalesce(st.digest, ''), 'l': coalesce(st.is_left, false)}} ORDER BY e.lvl) AS p FROM every e LEFT JOIN steps st ON st.r = e.r AND st.lvl = e.lvl GROUP BY e.r),
f AS (SELECT p.doc_id, p.own AS leaf, s.digest AS subroot, (SELECT digest FROM u WHERE n = 1) AS root,
  sha256(coalesce(array_to_string(list_transform(q.p, lambda x: x.d), ''), '')) AS proof_sha256,
  list_reduce(coalesce(q.p, []), lambda a, x: {{'d': CASE WHEN x.l THEN sha256(x.d || a.d) ELSE sha256(a.d || x.d) END, 'l': false}}, {{'d': p.other, 'l': false}}).d AS folded_root
  FROM placed p JOIN s ON s.tree = p.tree LEFT JOIN proofs q ON q.r = p.r)
SELECT *, folded_root = root AS verified FROM f
"""

#: Rebuilt conversations, their prefixes and the prefixes' subtrees, for op13.
_OP13 = rf"""
WITH {_CRC},
c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
g AS (SELECT conv_id, turn, length(text) AS w, sha256(strlen(role) || ':' || role || strlen(text) || ':' || text) AS d FROM c),
o AS (SELECT conv_id, w, d, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, d) - 1 AS pos FROM g),
n AS (SELECT conv_id, count(*) AS n, CAST(conv_id AS VARCHAR) AS i FROM o GROUP BY conv_id),
h AS (SELECT conv_id, n, conv_id - conv_id % 100 AS base, {_CRC_OF.format("i")} % 6 AS h FROM n, tab),
k AS (SELECT h.conv_id, h.base, h.h, least(h.h, coalesce(b.n, 0)) AS k FROM h LEFT JOIN n b ON b.conv_id = h.base),
r AS (
  SELECT k.conv_id, o.pos + 1 AS depth, w, d FROM k JOIN o ON o.conv_id = k.base AND o.pos < k.h
  UNION ALL
  SELECT k.conv_id, k.k + o.pos - k.h + 1, w, d FROM k JOIN o ON o.conv_id = k.conv_id WHERE o.pos >= k.h),
p AS (
  SELECT conv_id, depth, w, string_agg(d, '') OVER (PARTITION BY conv_id ORDER BY depth) AS key FROM r
  UNION ALL
  SELECT conv_id, 0, 0, '' FROM k),
l AS (SELECT conv_id, max(depth) AS len FROM p GROUP BY conv_id),
nodes AS (
  SELECT depth, key, min(conv_id) AS conv_id, count(*) AS n_convs, max(w) AS w, max(len) AS longest,
    coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE depth = len), '') AS ends
  FROM p JOIN l USING (conv_id) GROUP BY depth, key)
SELECT a.conv_id, a.depth, any_value(u.conv_id) AS parent_conv_id, any_value(a.n_convs) AS n_convs, count(*) FILTER (WHERE b.depth = a.depth + 1) AS n_children,
  CAST(sum(CASE WHEN b.longest = b.depth THEN 1 ELSE 0 END) AS BIGINT) AS n_leaves, CAST(sum((b.n_convs - 1) * b.w) AS BIGINT) AS saved_tokens, sha256(any_value(a.ends)) AS ends_sha256
FROM nodes a JOIN nodes b ON b.depth >= a.depth AND left(b.key, 64 * a.depth) = a.key
LEFT JOIN nodes u ON u.depth = a.depth - 1 AND u.key = left(a.key, 64 * (a.depth - 1))
GROUP BY a.conv_id, a.depth
"""

ORACLES: dict[str, str] = {"op2_ngram_jaccard": _OP2, "op7_sharding": _OP7, "op11_merkle_manifest": _OP11, "op13_conversation_trie": _OP13}
