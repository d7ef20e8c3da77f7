"""Named queries of the text operators, each over its whole table, and SQL twins where SQL can say them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattloom.llm import (bpe, codes, decontaminate, html, jaccard, licenses, negatives, packing, quality, secrets, sharding, topk,
                          wavelet)
from wattloom.llm.common import table
from wattloom.session import shared_folder


def op1_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(topk.scaled(table(spark, sf_dir, "embeddings")), F.col("vec_id") % 50 == 0, 5)


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(table(spark, sf_dir, "documents"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_round_trip(table(spark, sf_dir, "documents"))


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(table(spark, sf_dir, "pages"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.token_id_files(table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.quality_scores(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op9_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole documents are written by shard; the rows come from the files."""
    docs, folder = table(spark, sf_dir, "documents"), shared_folder(spark, "shards")
    sharding.write_shards(docs, folder)
    doc_id = docs.schema["doc_id"].dataType.simpleString()
    return spark.read.schema(f"doc_id {doc_id}, slot int, shard string").parquet(folder)


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.piece_digests(packing.pack(table(spark, sf_dir, "documents")))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(negatives.usable_rows(vectors.withColumn("label", moved)), F.col("vec_id") % 50 == 0)


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (
    op1_top_k, op2_licenses, op3_secrets, op4_bpe, op5_main_text, op6_decontaminate, op7_token_files, op8_quality,
    op9_shards, op10_near_duplicates, op11_packing, op12_hard_negatives, op13_vector_codes)}

_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""


def _codes_sql(rounds: int = 4) -> str:
    """Product codes in plain SQL: all distances in every round."""
    def near(r: int) -> str:
        return f"""a{r} AS MATERIALIZED (SELECT vec_id, p, min({{'d': list_dot_product(x, x) - 2 * list_dot_product(x, c) + list_dot_product(c, c),
    'e': e}}) AS m FROM x JOIN c{r} USING (p) GROUP BY vec_id, p)"""

    def moved(r: int) -> str:
        return f"""c{r + 1} AS MATERIALIZED (SELECT c.p, c.e, coalesce(n.c, c.c) AS c FROM c{r} c LEFT JOIN (
    SELECT p, e, list(s ORDER BY i) AS c FROM (SELECT x.p, m.e AS e, i, floor(sum(x[i]) / count(*)) AS s
      FROM x JOIN a{r} USING (vec_id, p), unnest(generate_series(1, len(x))) AS g(i) GROUP BY x.p, m.e, i) GROUP BY p, e) n
    ON n.p = c.p AND n.e = c.e)"""
    steps = ",\n".join(f"{near(r)},\n{moved(r)}" for r in range(rounds))
    return f"""
WITH k AS MATERIALIZED (SELECT vec_id, label, [floor(x::DOUBLE * 1024) FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND list_bool_and([x IS NOT NULL AND isfinite(x) FOR x IN embedding])),
x AS MATERIALIZED (SELECT vec_id, p, v[p * len(v) // 4 + 1:(p + 1) * len(v) // 4] AS x FROM k, unnest([0, 1, 2, 3]) AS q(p)),
c0 AS MATERIALIZED (SELECT p, x AS c, dense_rank() OVER (ORDER BY vec_id) - 1 AS e FROM x QUALIFY e < 256),
{steps},
{near(rounds)},
d AS (SELECT vec_id, string_agg(printf('%02x', (m.e)::INT), '' ORDER BY p) AS code, sum(m.d)::BIGINT AS error FROM a{rounds} GROUP BY vec_id),
h AS (SELECT sha256(string_agg(y::BIGINT::VARCHAR, ',' ORDER BY p, e, i)) AS h
      FROM (SELECT p, e, i, c[i] AS y FROM c{rounds}, unnest(generate_series(1, len(c))) AS g(i)))
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h AS codebooks_sha256
FROM d JOIN k USING (vec_id), h"""


SQL = {
    "op1_top_k": """
WITH v AS (SELECT vec_id, [floor(x::DOUBLE * 256) FOR x IN embedding] AS v FROM embeddings
           WHERE embedding IS NOT NULL AND list_bool_and([x IS NOT NULL AND isfinite(x) FOR x IN embedding])),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 5""",
    "op6_decontaminate": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS t
       FROM b, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS r(i) WHERE len(w) > 0),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS t
       FROM d, (SELECT DISTINCT n FROM bw) AS s, unnest(range(1, len(w) - n + 2)) AS r(i) WHERE len(w) >= n),
h AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN bw ON dw.t = bw.t AND dw.n = bw.n),
p AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM h, unnest(range(i, i + n)) AS r(x) GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item_id) AS n_items,
             string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM h GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN t USING (doc_id)""",
    "op12_hard_negatives": """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  [floor(x::DOUBLE * 256) FOR x IN embedding] AS v FROM embeddings
           WHERE label IS NOT NULL AND embedding IS NOT NULL AND list_bool_and([x IS NOT NULL AND isfinite(x) FOR x IN embedding])),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, c.vec_id AS vec_id, a.label = c.label AS same, list_dot_product(a.v, c.v)::BIGINT AS score
      FROM v a JOIN v c ON a.vec_id <> c.vec_id AND len(a.v) = len(c.v) WHERE a.vec_id % 50 = 0),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
             row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS rank
      FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3""",
    "op13_vector_codes": _codes_sql(),
}
