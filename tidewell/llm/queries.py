"""The queries of this package: opN_<name>(spark, sf_dir), each over its whole table, and their DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm import ann, bpe, chat, licenses, lm_score, near_embed, ngram_join, packing, quality, repeats
from tidewell.llm.common import prepare, table


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(prepare(spark), sf_dir, "documents"), keep_ids=False)


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(prepare(spark), sf_dir, "documents"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(prepare(spark), sf_dir, "documents"), keep_ids=False)


def op4_near_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_embed.near(table(prepare(spark), sf_dir, "embeddings"))


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate(table(prepare(spark), sf_dir, "conversations"))


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(table(prepare(spark), sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepare(spark), sf_dir, "documents")
    got = quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))
    return got.select("doc_id", F.coalesce(quality.fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(prepare(spark), sf_dir, "embeddings")
    return ann.search(rows, rows.where("vec_id % 20 = 0"))


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.dedup(table(prepare(spark), sf_dir, "documents"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(prepare(spark), sf_dir, "documents")).drop("spans")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_ngram_join": op2_ngram_join,
    "op3_bpe": op3_bpe,
    "op4_near_embeddings": op4_near_embeddings,
    "op5_chat": op5_chat,
    "op6_lm_score": op6_lm_score,
    "op7_quality": op7_quality,
    "op8_neighbours": op8_neighbours,
    "op9_repeats": op9_repeats,
    "op10_licenses": op10_licenses,
}
_REACH = """r(id, c) AS (
  SELECT id, id FROM n UNION SELECT both_ways.b, r.c FROM r JOIN both_ways ON both_ways.a = r.id
)"""
ORACLES: dict[str, str] = {
    "op2_ngram_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS shingle FROM w
), n AS (
  SELECT w.id, count(shingle) AS n FROM w LEFT JOIN s USING (id) GROUP BY 1
), links AS (
  SELECT p.a, p.b FROM (SELECT x.id AS a, y.id AS b, count(*) AS o FROM s x JOIN s y ON x.shingle = y.shingle AND x.id < y.id GROUP BY 1, 2) p
  JOIN n na ON na.id = p.a JOIN n nb ON nb.id = p.b WHERE 100 * o >= 75 * (na.n + nb.n - o)
), both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links), """ + _REACH + """
SELECT n.id AS doc_id, CAST(n.n AS BIGINT) AS n_shingles, min(r.c) AS component_id FROM n JOIN r ON r.id = n.id GROUP BY 1, 2
""",
    "op4_near_embeddings": """
WITH RECURSIVE n AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
u AS (SELECT id, v, sqrt(list_dot_product(v, v)) AS norm FROM n WHERE list_dot_product(v, v) > 0),
both_ways AS (SELECT x.id AS a, y.id AS b FROM u x JOIN u y ON x.id <> y.id AND list_dot_product(x.v, y.v) / (x.norm * y.norm) >= 0.95), """ + _REACH + """,
d AS (SELECT a AS id, count(*) AS k FROM both_ways GROUP BY 1)
SELECT n.id AS vec_id, CAST(coalesce(max(d.k), 0) AS BIGINT) AS n_links, min(r.c) AS component_id, n.id = min(r.c) AS kept FROM n JOIN r ON r.id = n.id LEFT JOIN d ON d.id = n.id GROUP BY n.id
""",
    "op5_chat": chat.ORACLE,
}
