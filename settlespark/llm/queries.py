"""The registered queries of the operators, with SQL where SQL can state the result."""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from settlespark.llm import hard_negatives, jaccard, line_dedup, packing, quality, secrets, sharding, substring_dedup, suffix_dedup, tokens, toxicity, vectors, whitening
from settlespark.llm.common import ship, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    @functools.wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return fn(spark, sf_dir)

    QUERIES[fn.__name__] = run
    return run


@query
def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = tokens.encode_decode(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    )
    return coded.select("doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("text_bytes", 256).alias("decoded_sha256"))


@query
def op6_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), 16)


@query
def op9_balanced_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packed.select(
        "doc_id", "start", "length", F.crc32("token_ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


@query
def op1_robust_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


@query
def op2_kneser_ney_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op5_secret_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.find(table(spark, sf_dir, "documents")))


SQL["op10_prefix_tree_join"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))) END AS grams FROM w),
g AS (SELECT doc_id, len(grams) AS n, unnest(grams) AS gram FROM s),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id, doc_id AS spot FROM documents UNION SELECT r.doc_id, e.y FROM reach r JOIN both_ways e ON e.x = r.spot)
SELECT s.doc_id, CAST(len(s.grams) AS BIGINT) AS n_shingles, r.component_id FROM s JOIN (SELECT doc_id, min(spot) AS component_id FROM reach GROUP BY doc_id) r ON r.doc_id = s.doc_id"""


@query
def op10_prefix_tree_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"), n=4, percent=85)


SQL["op3_suffix_dedup"] = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
starts AS (SELECT doc_id, h, unnest(range(0, greatest(0, len(h) // 2 - 99))) AS i FROM d),
strings AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 200)) AS s FROM starts),
ranked AS (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS nth FROM strings),
later AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM ranked WHERE nth > 1),
marked AS (SELECT doc_id, i, sum(CASE WHEN before IS NULL OR i > before + 100 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM later),
runs AS (SELECT doc_id, run, min(i) AS a, max(i) + 100 AS z FROM marked GROUP BY doc_id, run),
gaps AS (SELECT doc_id, run, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY run), 0) AS from_ FROM runs),
told AS (
  SELECT d.doc_id, any_value(d.h) AS h, count(g.run) AS n_spans, coalesce(sum(g.z - g.a), 0) AS n_removed, coalesce(max(g.z), 0) AS last,
    coalesce(string_agg(substr(d.h, 2 * g.from_ + 1, 2 * (g.a - g.from_)), '' ORDER BY g.run), '') AS head
  FROM d LEFT JOIN gaps g ON g.doc_id = d.doc_id GROUP BY d.doc_id)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(n_removed AS BIGINT) AS n_removed, n_spans, sha256(unhex(head || substr(h, 2 * last + 1))) AS kept_sha256 FROM told"""


@query
def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    n_removed = F.aggregate(F.zip_with("starts", "ends", lambda a, b: b - a), F.lit(0).cast("bigint"), lambda a, b: a + b)
    return cut.select(
        "doc_id", "n_bytes", n_removed.alias("n_removed"), F.size("starts").cast("bigint").alias("n_spans"), F.sha2("kept_bytes", 256).alias("kept_sha256")
    )


@query
def op7_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_lines", F.greatest("n_removed", F.lit(0)).alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256")
    )


SQL["op8_pruned_graph"] = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) >= 0.93),
reach AS (SELECT vec_id, vec_id AS spot FROM embeddings UNION SELECT r.vec_id, l.y FROM reach r JOIN links l ON l.x = r.spot)
SELECT m.vec_id, coalesce(n.n_links, 0) AS n_links, m.component_id, m.vec_id = m.component_id AS kept
FROM (SELECT vec_id, min(spot) AS component_id FROM reach GROUP BY vec_id) m LEFT JOIN (SELECT x, count(*) AS n_links FROM links GROUP BY x) n ON n.x = m.vec_id"""


@query
def op8_pruned_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


SQL["op13_suffix_automata"] = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
starts AS (SELECT doc_id, ws, unnest(range(1, greatest(1, len(ws) - 48))) AS i FROM w),
windows AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS s FROM starts),
firsts AS (SELECT s, min(doc_id) AS first_doc FROM windows GROUP BY s),
later AS (SELECT v.doc_id, v.i, lag(v.i) OVER (PARTITION BY v.doc_id ORDER BY v.i) AS before FROM windows v JOIN firsts f ON f.s = v.s WHERE f.first_doc < v.doc_id),
marked AS (SELECT doc_id, i, sum(CASE WHEN before IS NULL OR i > before + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM later),
runs AS (SELECT doc_id, run, min(i) AS a, max(i) + 50 AS z FROM marked GROUP BY doc_id, run),
gaps AS (SELECT doc_id, run, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY run), 1) AS from_ FROM runs),
told AS (
  SELECT w.doc_id, any_value(w.ws) AS ws, coalesce(sum(g.z - g.a), 0) AS n_removed, coalesce(max(g.z), 1) AS last,
    coalesce(string_agg(CASE WHEN g.a > g.from_ THEN array_to_string(w.ws[g.from_:g.a - 1], ' ') || ' ' ELSE '' END, '' ORDER BY g.run), '') AS head
  FROM w LEFT JOIN gaps g ON g.doc_id = w.doc_id GROUP BY w.doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(n_removed AS BIGINT) AS n_removed,
  sha256(rtrim(head || array_to_string(ws[last:], ' '), ' ')) AS kept_sha256 FROM told"""


@query
def op13_suffix_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring_dedup.remove_passages(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query
def op11_polarised_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    white = whitening.whiten(table(spark, sf_dir, "embeddings"))
    return white.withColumn("deviation", F.expr("try_cast(deviation as bigint)"))


SQL["op12_segment_negatives"] = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda c: floor(256 * CAST(c AS DOUBLE))) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
u AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY label, x) = 1),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.x, b.x) AS BIGINT) AS score
  FROM u a JOIN u b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank,
  s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same
  AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) <= 3"""


@query
def op12_segment_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    relabelled = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, relabelled)
