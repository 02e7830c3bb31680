"""The queries of this subpackage, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausula.llm import embedding_dedup, exact_dedup, hamming_search, hard_negatives, lm, near_dedup, packing, part_codes, pieces, secrets, sharding, token_files, toxicity
from clausula.llm.shared import documents, scratch


def tokenizer_file(name: str) -> str:
    """Place of a public tokenizer's file; it is never copied."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(documents(spark, sf_dir), k=2, percent=80)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.placed(sharding.sharded(documents(spark, sf_dir), scratch(spark, "shards"))).drop("shard")


def op4_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_ids(documents(spark, sf_dir), tokenizer_file("word_bpe_49k.json"), end_id=1)


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.lm_scores(documents(spark, sf_dir))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(documents(spark, sf_dir))


def op7_hamming_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hamming_search.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("id") % 20 == 0, k=10)


def op8_unigram_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encoded(documents(spark, sf_dir), tokenizer_file("piece_bpe_32k.model"))


def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets(documents(spark, sf_dir))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(documents(spark, sf_dir), tokenizer_file("byte_bpe_50k.json"), end_id=0, capacity=2048)


def op11_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), threshold=0.95)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet").withColumn("label", label), F.col("id") % 50 == 0)


def op13_part_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_codes.part_codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP2_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) >= 2 THEN list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) WHEN len(w) = 1 THEN w ELSE [] END AS g FROM d),
c AS (SELECT g, n_shingles, min(doc_id) AS rep, list(doc_id) AS ids FROM (SELECT list_sort(g) AS g, len(g) AS n_shingles, doc_id FROM s) GROUP BY ALL),
x AS (SELECT rep, n_shingles, unnest(g) AS h FROM c),
p AS (
  SELECT a.rep AS a, b.rep AS b FROM x a JOIN x b ON a.h = b.h AND a.rep <> b.rep AND 100 * a.n_shingles >= 80 * b.n_shingles AND 100 * b.n_shingles >= 80 * a.n_shingles
  GROUP BY a.rep, b.rep, a.n_shingles, b.n_shingles HAVING 100 * count(*) >= 80 * (a.n_shingles + b.n_shingles - count(*))),
r(node, reached) AS (SELECT rep, rep FROM c UNION SELECT r.node, p.b FROM r JOIN p ON r.reached = p.a),
m AS (SELECT node, min(reached) AS component_id FROM r GROUP BY node)
SELECT doc_id, n_shingles, CASE WHEN n_shingles = 0 THEN doc_id ELSE component_id END AS component_id, n_shingles = 0 OR doc_id = component_id AS kept
FROM (SELECT unnest(ids) AS doc_id, n_shingles, rep FROM c) JOIN m ON rep = node
"""

OP3_SQL = "SELECT doc_id, md5(coalesce(text, '')) AS text_md5, true AS listed FROM documents"

OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
  row_number() OVER w = 1 AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY length(t) DESC, doc_id)
"""

OP7_SQL = """
WITH c AS (SELECT vec_id, list_transform(embedding, lambda x: x > 0) AS bits FROM embeddings),
p AS (
  SELECT q.vec_id AS query_id, v.vec_id, CAST(list_sum(list_transform(range(1, 65), lambda i: CASE WHEN q.bits[i] <> v.bits[i] THEN 1 ELSE 0 END)) AS INTEGER) AS distance
  FROM c q JOIN c v ON q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, distance
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM p) WHERE rank <= 10
"""

_SOUND = "embedding IS NOT NULL AND coalesce(list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))), true)"

OP11_SQL = f"""
WITH RECURSIVE u AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE {_SOUND} AND list_sum(list_transform(embedding, lambda x: abs(x))) > 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
r(node, reached) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.node, p.b FROM r JOIN p ON r.reached = p.a),
m AS (SELECT node, min(reached) AS component_id FROM r GROUP BY node)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN m ON node = vec_id LEFT JOIN (SELECT a, count(*) AS n FROM p GROUP BY a) ON a = vec_id
"""

OP12_SQL = f"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings WHERE label IS NOT NULL AND {_SOUND}),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.e, b.e) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score
  FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 3
"""


def _assign(codebook: str) -> str:
    """SQL of the parts with their nearest entry (entry, distance)."""
    return f"""SELECT v.vec_id, v.label, part, x, m.e AS entry, m.d AS distance FROM (
    SELECT vec_id, part, min({{'d': CAST(list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - c[i]) * (x[i] - c[i]))) AS BIGINT), 'e': entry}}) AS m
    FROM v JOIN {codebook} USING (part) GROUP BY vec_id, part) JOIN v USING (vec_id, part)"""


def _means(before: str, assigned: str) -> str:
    """SQL of a codebook after a round."""
    return f"""SELECT b.part, b.entry, coalesce(n.c, b.c) AS c FROM {before} b LEFT JOIN (
    SELECT part, entry, list(m ORDER BY i) AS c FROM (
      SELECT part, entry, i, CAST(floor(CAST(sum(x[i]) AS DOUBLE) / count(*)) AS BIGINT) AS m
      FROM {assigned}, (SELECT unnest(range(1, 1 + (SELECT max(len(x)) FROM v))) AS i) GROUP BY part, entry, i) GROUP BY part, entry) n ON n.part = b.part AND n.entry = b.entry"""


OP13_SQL = f"""
WITH k AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e, row_number() OVER (ORDER BY vec_id) - 1 AS nth
  FROM embeddings WHERE {_SOUND}),
v AS (SELECT vec_id, label, nth, part, e[part * len(e) // 16 + 1 : (part + 1) * len(e) // 16] AS x FROM k, (SELECT unnest(range(16)) AS part)),
c0 AS (SELECT part, nth AS entry, x AS c FROM v WHERE nth < 64),
a0 AS ({_assign("c0")}),
c1 AS ({_means("c0", "a0")}),
a1 AS ({_assign("c1")}),
c2 AS ({_means("c1", "a1")}),
a2 AS ({_assign("c2")}),
f AS (SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(distance) AS BIGINT) AS error FROM a2 GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) FROM c2) AS codebooks_sha256
FROM f
"""

_ALL = (op1_toxicity, op2_minhash_near_dedup, op3_sharding, op4_token_ids, op5_lm_scoring, op6_exact_dedup, op7_hamming_top_k, op8_unigram_pieces, op9_secret_scans, op10_best_fit_packing, op11_embedding_near_dedup, op12_hard_negatives, op13_part_codes)


def queries() -> dict:
    return {f.__name__: f for f in _ALL}


def oracle_sql() -> dict[str, str]:
    return {"op2_minhash_near_dedup": OP2_SQL, "op3_sharding": OP3_SQL, "op6_exact_dedup": OP6_SQL, "op7_hamming_top_k": OP7_SQL, "op11_embedding_near_dedup": OP11_SQL, "op12_hard_negatives": OP12_SQL, "op13_part_codes": OP13_SQL}
