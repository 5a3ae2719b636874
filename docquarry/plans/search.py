"""Retrieval queries: DataFrame operators on one side, SQL on the other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docquarry.operators.chunking import chunk_documents
from docquarry.operators.pages import merge_document_pages, merge_page_blocks, reflow_documents
from docquarry.operators.retrieval import cosine, diversify, fuse, keyword_search, semantic_search, words_of
from docquarry.operators.retrieval import semantic_batch as nearest
from docquarry.plans.dialect import CHECK, SPARK, views
from docquarry.plans.relational import blocks, markdown

KEYWORDS = 'the "of the" -zzz or les des'


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return [float(x) for x in table(spark, sf_dir, "embeddings").filter("vec_id = 0").first().embedding]


def semantic_topk(spark, sf_dir):
    return semantic_search(table(spark, sf_dir, "embeddings"), query_vector(spark, sf_dir))


def semantic_filtered(spark, sf_dir):
    return semantic_search(table(spark, sf_dir, "embeddings").filter("label = 3"), query_vector(spark, sf_dir))


def semantic_batch(spark, sf_dir):
    """Every row whose id is divisible by 50, against all rows."""
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def keyword_topk(spark, sf_dir):
    return keyword_search(table(spark, sf_dir, "documents"), KEYWORDS)


def keyword_phrase(spark, sf_dir):
    return keyword_search(table(spark, sf_dir, "documents"), '"of the"', 20)


def keyword_not(spark, sf_dir):
    return keyword_search(table(spark, sf_dir, "documents"), "the -and", 20)


def hybrid_search(spark, sf_dir):
    """Both legs at 100, fused by reciprocal ranks, twenty best with their payload."""
    semantic = semantic_search(table(spark, sf_dir, "embeddings"), query_vector(spark, sf_dir), 100)
    keyword = keyword_search(table(spark, sf_dir, "documents"), KEYWORDS, 100)
    best = fuse([semantic, keyword])
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "source", "lang")
    return F.broadcast(best).join(docs, "chunk_id", "left").select("chunk_id", "score", "source", "lang")  # best: twenty rows


def rrf_single_leg(spark, sf_dir):
    semantic = semantic_search(table(spark, sf_dir, "embeddings"), query_vector(spark, sf_dir), 100)
    return fuse([semantic, keyword_search(table(spark, sf_dir, "documents"), "zzz", 100)]).select("chunk_id", "score")


def rerank_lexical(spark, sf_dir):
    """The default pair scorer: Jaccard similarity of word sets with the query, ten best of the fused twenty."""
    query = F.array(F.lit("the"), F.lit("of"), F.lit("and"), F.lit("les"))
    best = hybrid_search(spark, sf_dir).select("chunk_id")
    docs = table(spark, sf_dir, "documents").join(F.broadcast(best), F.col("doc_id") == F.col("chunk_id"))
    held = F.array_distinct(words_of(F.col("text")))
    score = F.round(F.size(F.array_intersect(held, query)) / F.size(F.array_union(held, query)), 9)
    return docs.select("chunk_id", score.alias("score")).orderBy(F.desc("score"), "chunk_id").limit(10)


def mmr_select(spark, sf_dir):
    """Five diverse rows of the best ten of every row whose id is divisible by 50."""
    e = table(spark, sf_dir, "embeddings")
    top = nearest(e, F.col("vec_id") % 50 == 0, 10)
    return diversify(top.join(e, "vec_id").select("query_id", F.col("vec_id").alias("chunk_id"), "embedding", "score"))


def retrieval_pipeline(spark, sf_dir):
    """Both legs, fusion to twenty, lexical rerank to ten, five diverse ones: (position, chunk_id, score, title, block)."""
    best = rerank_lexical(spark, sf_dir)  # ten rows
    vectors = table(spark, sf_dir, "embeddings").join(F.broadcast(best), F.col("vec_id") == F.col("chunk_id"), "right")
    picks = diversify(vectors.select(F.lit(0).cast("long").alias("query_id"), "chunk_id", "score", "embedding"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.coalesce("source", F.lit("Unknown Source")).alias("title"), "text")
    found = docs.join(F.broadcast(picks.join(best, "chunk_id")), "chunk_id")
    block = F.concat(F.lit("["), "position", F.lit("] "), "title", F.lit("\n"), F.coalesce("text", F.lit("")))
    return found.select("position", "chunk_id", "score", "title", block.alias("block")).orderBy("position")


def context_assembly(spark, sf_dir):
    best = semantic_search(table(spark, sf_dir, "embeddings"), query_vector(spark, sf_dir), 5).withColumn("n", F.row_number().over(Window.orderBy(F.desc("score"), "vec_id")))
    docs = table(spark, sf_dir, "documents").join(F.broadcast(best), F.col("doc_id") == F.col("vec_id"))
    block = F.concat(F.lit("["), "n", F.lit("] "), F.coalesce("source", F.lit("Unknown Source")), F.lit(" — "), "lang", F.lit("\n"), "text")
    return docs.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", block.alias("b")))), lambda x: x.b), "\n\n").alias("context"), F.count("*").alias("blocks"))


def retrieval_metrics(spark, sf_dir):
    """Precision and reciprocal rank at 5 with the label as relevance."""
    ranked = semantic_batch(spark, sf_dir)
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    q = e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("label").alias("wanted"))
    hit = (F.col("label") == F.col("wanted")).cast("int")
    return ranked.join(e, "vec_id").join(q, "query_id").groupBy("query_id").agg(F.round(F.sum(hit) / 5, 6).alias("precision_at_5"), F.round(F.coalesce(F.max(hit / F.col("rank")), F.lit(0.0)), 6).alias("reciprocal_rank"))


def chunk_markdown(spark, sf_dir):
    text = f"SELECT doc_id, {SPARK['agg']('line', 'chr(10)', 'ln')} AS text FROM {markdown(SPARK)} m GROUP BY doc_id"
    views(spark, sf_dir, text)
    return chunk_documents(spark.sql(text), 256, 32)


def reflow_lines(spark, sf_dir):
    return reflow_documents(table(spark, sf_dir, "documents"))


def paragraph_merge(spark, sf_dir):
    text = f"SELECT doc_id, CAST(seq DIV 40 AS INT) AS page, seq, text, x0, y0, x1, y1, font_size, is_bold FROM {blocks(SPARK)} b"
    views(spark, sf_dir, text)
    return merge_page_blocks(spark.sql(text))


def cross_page_merge(spark, sf_dir):
    text = f"SELECT doc_id, CAST(ln DIV 5 AS INT) AS page, {SPARK['agg']('line', 'chr(10)', 'ln')} AS text FROM {SPARK['lines']} l GROUP BY doc_id, ln DIV 5"
    views(spark, sf_dir, text)
    return merge_document_pages(spark.sql(text))


def stream_ingest(spark, sf_dir):
    from docquarry.streaming.ingest import ingest_available

    return ingest_available(spark, f"{sf_dir}/documents.parquet")


QUERIES = {f.__name__: f for f in (semantic_topk, semantic_filtered, semantic_batch, keyword_topk, keyword_phrase, keyword_not, hybrid_search, rrf_single_leg, rerank_lexical, mmr_select, retrieval_pipeline, context_assembly, retrieval_metrics, chunk_markdown, reflow_lines, paragraph_merge, cross_page_merge, stream_ingest)}

_DOT = CHECK["dot"]
_RAW = lambda a, b: f"{_DOT(a, b)} / (sqrt({_DOT(a, a)}) * sqrt({_DOT(b, b)}))"
_COS = lambda a, b: f"round({_RAW(a, b)}, 6)"
_SEM = lambda where, k: f"SELECT c.vec_id, {_COS('c.embedding', 'q.embedding')} AS score FROM embeddings c, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE {where} ORDER BY {_RAW('c.embedding', 'q.embedding')} DESC, vec_id LIMIT {k}"
_PAD = "(SELECT doc_id, ' ' || array_to_string(ws, ' ') || ' ' AS p, ws FROM (SELECT doc_id, list_filter(string_split_regex(lower(text), '[ \\n\\t\\r]+'), lambda w: w <> '') AS ws FROM documents))"
_KEY = lambda where, words, k: f"SELECT doc_id, round(len(list_filter(ws, lambda w: w IN ({words}))) * 0.1, 6) + 0.0::DOUBLE AS score FROM {_PAD} t WHERE {where} ORDER BY score DESC, doc_id LIMIT {k}"
_HELD = "(contains(p, ' the ') AND contains(p, ' of the ') AND NOT contains(p, ' zzz ')) OR (contains(p, ' les ') AND contains(p, ' des '))"
_WANT = "'the', 'of', 'les', 'des'"
_BATCH = f"SELECT query_id, vec_id, score, rank FROM (SELECT q.vec_id AS query_id, c.vec_id, {_COS('c.embedding', 'q.embedding')} AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_RAW('c.embedding', 'q.embedding')} DESC, c.vec_id) AS rank FROM embeddings q JOIN embeddings c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id) r"
_FUSED = f"""SELECT chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, min(leg * 1000 + rank) AS first FROM (
 SELECT vec_id AS chunk_id, 0 AS leg, row_number() OVER (ORDER BY score DESC, vec_id) AS rank FROM ({_SEM('true', 100)}) s UNION ALL
 SELECT doc_id, 1, row_number() OVER (ORDER BY score DESC, doc_id) FROM ({_KEY(_HELD, _WANT, 100)}) k) u GROUP BY chunk_id ORDER BY score DESC, first LIMIT 20"""

SQL = {
    "semantic_topk": _SEM("true", 20),
    "semantic_filtered": _SEM("c.label = 3", 20),
    "semantic_batch": f"{_BATCH} WHERE rank <= 5",
    "keyword_topk": _KEY(_HELD, _WANT, 20),
    "keyword_phrase": _KEY("contains(p, ' of the ')", "'of', 'the'", 20),
    "keyword_not": _KEY("contains(p, ' the ') AND NOT contains(p, ' and ')", "'the'", 20),
    "hybrid_search": f"SELECT f.chunk_id, f.score, d.source, d.lang FROM ({_FUSED}) f LEFT JOIN documents d ON d.doc_id = f.chunk_id",
    "rrf_single_leg": f"SELECT vec_id AS chunk_id, round(1.0::DOUBLE / (60 + row_number() OVER (ORDER BY score DESC, vec_id)), 9) AS score FROM ({_SEM('true', 100)}) s ORDER BY score DESC LIMIT 20",
    "rerank_lexical": f"SELECT chunk_id, round(len(list_intersect(h, q)) / CAST(len(list_distinct(list_concat(h, q))) AS DOUBLE), 9) AS score FROM (SELECT f.chunk_id, list_distinct(ws) AS h, ['the', 'of', 'and', 'les'] AS q FROM ({_FUSED}) f JOIN {_PAD} t ON t.doc_id = f.chunk_id) x ORDER BY score DESC, chunk_id LIMIT 10",
    "context_assembly": f"SELECT string_agg('[' || n || '] ' || source || ' — ' || lang || chr(10) || text, chr(10) || chr(10) ORDER BY n) AS context, count(*) AS blocks FROM (SELECT vec_id, row_number() OVER (ORDER BY score DESC, vec_id) AS n FROM ({_SEM('true', 5)}) s) r JOIN documents d ON d.doc_id = r.vec_id",
    "retrieval_metrics": f"SELECT r.query_id, round(sum(CASE WHEN e.label = w.label THEN 1 ELSE 0 END) / 5.0::DOUBLE, 6) AS precision_at_5, round(max(CASE WHEN e.label = w.label THEN 1.0::DOUBLE / rank ELSE 0 END), 6) AS reciprocal_rank FROM ({_BATCH}) r JOIN embeddings e ON e.vec_id = r.vec_id JOIN embeddings w ON w.vec_id = r.query_id WHERE rank <= 5 GROUP BY r.query_id",
    "stream_ingest": "SELECT min(doc_id) AS doc_id, sha256(text) AS checksum FROM documents GROUP BY text",
}
