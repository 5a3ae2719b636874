"""Queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.llm.ann import ann_search
from docquarry.llm.base import read_table
from docquarry.llm.jaccard import jaccard_join
from docquarry.llm.knn_join import knn_join
from docquarry.llm.mixing import mix
from docquarry.llm.packing import pack
from docquarry.llm.passages import repeated_passages
from docquarry.llm.token_counts import token_counts
from docquarry.llm.token_store import token_output
from docquarry.llm.toolcalls import CHAT_SCHEMAS, conversation_calls, link_tool_calls
from docquarry.llm.toxicity import held_out, score_toxicity

TOKENIZER = "word_bpe_49k.json"


def op2_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(read_table(spark, sf_dir, "documents"))


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "embeddings")
    return knn_join(rows.filter(F.col("vec_id") % 50 == 0), rows, k=5)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "embeddings")
    return ann_search(rows.filter(F.col("vec_id") % 20 == 0), rows, k=20)


def op7_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output(read_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    domain = F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 0)
    labelled = read_table(spark, sf_dir, "labels").select("doc_id", domain.alias("domain"))
    out = mix(read_table(spark, sf_dir, "documents"), labelled, ["good", "poor", "toxic"], [0.90, 0.08, 0.02])
    p = F.col("mix_posterior")
    return out.select("doc_id", F.col("mix_tokens").alias("n_tokens"), p[0].alias("p_good"), p[1].alias("p_poor"), p[2].alias("p_toxic"), F.col("mix_rate").alias("rate"), F.col("mix_copies").alias("copies"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = score_toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity_score").alias("score"), F.col("toxicity").alias("predicted"))


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(read_table(spark, sf_dir, "documents"), k=3, num=90)


def op10_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_tool_calls(*conversation_calls(read_table(spark, sf_dir, "conversations")), CHAT_SCHEMAS)


QUERIES = {f.__name__: f for f in (op1_mixing, op2_passages, op3_exact_topk, op4_packing, op5_ann, op6_toxicity, op7_token_ids, op8_token_counts, op9_jaccard, op10_tool_calls)}

SQL = {
    "op3_exact_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
""",
    "op10_tool_calls": """
WITH RECURSIVE t AS (SELECT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
calls AS (SELECT conv_id || ':' || turn AS id, conv_id || ':' || (turn - 2) AS after, CASE WHEN role = 'user' THEN 'ask' ELSE 'configure' END AS name, turn, text FROM t WHERE role IN ('user', 'system')),
res AS (SELECT conv_id || ':' || (turn - 1) AS id, text AS content FROM t WHERE role = 'assistant'),
deep AS (
  SELECT id, CAST(0 AS BIGINT) AS level FROM calls WHERE after NOT IN (SELECT id FROM calls)
  UNION ALL SELECT c.id, d.level + 1 FROM calls c JOIN deep d ON c.after = d.id)
SELECT coalesce(c.id, r.id) AS id, c.name, CASE WHEN c.id IS NULL THEN 'orphan' WHEN r.id IS NULL THEN 'unanswered' ELSE 'linked' END AS status, d.level,
  d.level IS NOT NULL AS ordered,
  CASE WHEN c.id IS NULL THEN NULL WHEN c.name = 'configure' THEN 'missing mode' WHEN c.text IS NULL THEN 'missing text' END AS problem,
  CAST(c.id IS NOT NULL AS BIGINT) AS n_calls, CAST(r.id IS NOT NULL AS BIGINT) AS n_results,
  '{"arguments":' || CASE WHEN c.id IS NULL THEN 'null' WHEN c.text IS NULL THEN CAST(json_object('turn', c.turn) AS VARCHAR) ELSE CAST(json_object('text', c.text, 'turn', c.turn) AS VARCHAR) END
    || ',"id":' || CAST(to_json(coalesce(c.id, r.id)) AS VARCHAR) || ',"level":' || coalesce(CAST(d.level AS VARCHAR), 'null') || ',"name":' || coalesce(CAST(to_json(c.name) AS VARCHAR), 'null')
    || ',"result":' || coalesce(CAST(to_json(r.content) AS VARCHAR), 'null') || '}' AS message
FROM calls c FULL OUTER JOIN res r ON c.id = r.id LEFT JOIN deep d ON d.id = c.id
""",
}
