"""Questions to cited answers: routing, retrieval, generation, citations (inventory G1, G8, G9, T1-T5, Q3, Q6, A3)."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docquarry.functions.healing import ROUTE, SOURCES_TAIL
from docquarry.operators.embedding import Embedder, HashingEmbedder, embed
from docquarry.operators.generation import ChatClient, ExtractiveClient, generate
from docquarry.operators.nearest import nearest

SYSTEM = "Answer from the numbered source documents alone, and cite them as [n]."


def route(question) -> F.Column:
    """structured where a routing term stands in the question, else retrieval."""
    return F.when(F.coalesce(question.rlike(ROUTE), F.lit(False)), "structured").otherwise("retrieval")


def context_blocks(questions: DataFrame, chunks: DataFrame, k: int = 5, embedder: Callable[[], Embedder] = HashingEmbedder) -> DataFrame:
    """(query_id, ref, doc_id, title, section, text) of each question's k nearest chunks.

    questions: query_id, embedding; chunks: doc_id, title, section, text and, if they have any, embedding (else that of
    the text). The questions, a stated set, meet all chunks in blocks; ids and scores alone are ranked, texts joined after the cut.
    """
    kinds = {"query_id": dict(questions.dtypes)["query_id"], "doc_id": dict(chunks.dtypes)["doc_id"]}
    vectors = chunks if "embedding" in chunks.columns else embed(chunks.select("doc_id", "text"), embedder)
    found = nearest(vectors.select(F.col("doc_id").alias("id"), F.col("embedding").alias("v")), questions.select(F.col("query_id").alias("id"), F.col("embedding").alias("v")), k, False)
    scored = found.select(F.col("query_id").cast(kinds["query_id"]), F.col("id").cast(kinds["doc_id"]).alias("doc_id"), "score")
    ranked = scored.withColumn("ref", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")).cast("long")).filter(F.col("ref") <= k)
    return chunks.drop("embedding").join(F.broadcast(ranked), "doc_id").select("query_id", "ref", "doc_id", "title", "section", "text")  # ranked: k ids a question


def postprocess(answers: DataFrame, blocks: DataFrame) -> DataFrame:
    """answers(query_id, raw_answer, ..) with answer, citations and sources_section; valid references are those of blocks(query_id, ref, title, section, doc_id)."""
    known = blocks.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("ref", "title", "section", "doc_id"))).alias("known"))  # k a question
    return cited(answers.join(known, "query_id", "left"), answers.columns)


def cited(held: DataFrame, columns: list[str]) -> DataFrame:
    """postprocess of held, whose rows carry their blocks as known."""
    held = held.withColumn("known", F.coalesce("known", F.array().cast("array<struct<ref:bigint,title:string,section:string,doc_id:bigint>>")))
    body = F.trim(F.regexp_replace(F.coalesce("raw_answer", F.lit("")), SOURCES_TAIL, ""))
    # References go one by one: a fold over those of the text that no block has.
    body = F.aggregate(
        F.array_except(F.array_distinct(F.regexp_extract_all(body, F.lit(r"\[(\d+)\]"), 1)), F.transform("known", lambda b: b.ref.cast("string"))),
        body,
        lambda text, ref: F.replace(text, F.concat(F.lit("["), ref, F.lit("]")), F.lit("")),
    )
    held = held.withColumn("body", F.trim(F.regexp_replace(body, "  +", " ")))
    used = F.filter("known", lambda b: F.contains("body", F.concat(F.lit("["), b.ref.cast("string"), F.lit("]"))))
    held = held.withColumn("citations", used)
    entry = lambda b: F.concat(F.lit("- ["), b.ref.cast("string"), F.lit("] "), F.coalesce(b.title, F.lit("Unknown Source")), F.when(F.coalesce(b.section, F.lit("")) != "", F.concat(F.lit(" — "), b.section)).otherwise(""))
    held = held.withColumn("sources_section", F.array_join(F.concat(F.array(F.lit("## Sources")), F.transform("citations", entry)), "\n"))
    answer = F.when(F.size("citations") > 0, F.concat("body", F.lit("\n\n"), "sources_section")).otherwise(F.col("body"))
    return held.select(*columns, answer.alias("answer"), "citations", "sources_section")


def answer_questions(questions: DataFrame, chunks: DataFrame, make: Callable[[], ChatClient] = ExtractiveClient, embedder: Callable[[], Embedder] = HashingEmbedder, k: int = 5) -> DataFrame:
    """questions(query_id, question) routed, retrieved for whatever the route, generated, post-processed; query_type is the route's.

    A question without any chunk goes to the client with an empty context.
    """
    asked = embed(questions.select("query_id", F.col("question").alias("text")), embedder)
    blocks = context_blocks(asked, chunks, k, embedder)
    block = F.concat(F.lit("["), "ref", F.lit("] "), F.coalesce("title", F.lit("Unknown Source")), F.when(F.coalesce("section", F.lit("")) != "", F.concat(F.lit(" — "), "section")).otherwise(""), F.lit("\n"), F.coalesce("text", F.lit("")))
    # The blocks are found once: what the answers' citations need of them goes through the client's pass beside the context.
    context = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ref", block.alias("b")))), lambda x: x.b), "\n\n").alias("context")
    known = F.sort_array(F.collect_list(F.struct("ref", "title", "section", "doc_id"))).alias("known")
    held = questions.filter("query_id IS NOT NULL").select("query_id", "question").join(blocks.groupBy("query_id").agg(context, known, F.count("*").alias("n_blocks")), "query_id", "left")
    held = held.withColumn("query_type", route(F.col("question"))).withColumn("n_blocks", F.coalesce("n_blocks", F.lit(0)))
    said = generate(held, SYSTEM, make, ("query_type", "n_blocks", "known"))
    return cited(said, [c for c in said.columns if c != "known"])


def list_documents(documents: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of the catalogue, newest first; 1 to 500 rows."""
    if not 1 <= limit <= 500 or offset < 0:
        raise ValueError("limit must be 1 to 500 and offset 0 at least")
    return documents.orderBy(F.desc("doc_id")).offset(offset).limit(limit)


def health(spark: SparkSession, embedder: Callable[[], Embedder] = HashingEmbedder) -> dict[str, str]:
    """healthy where the session answers and the embedder embeds, else degraded, by part."""

    def state(probe) -> str:
        try:
            probe()
            return "ok"
        except Exception as e:  # noqa: BLE001 - a failing part is the answer
            return f"error: {type(e).__name__}"

    parts = {"database": state(lambda: spark.sql("SELECT 1").collect()), "embedder": state(lambda: embedder().embed(["probe"]))}
    return {"status": "healthy" if set(parts.values()) == {"ok"} else "degraded", **parts}


def ingest_files(scanned: DataFrame, known: DataFrame, read: Callable[[bytes], str]) -> DataFrame:
    """(path, checksum, status, error, text) of scanned(path, content): ingested, skipped (checksum known, or of an earlier path) or failed with its error.

    read turns a file's bytes into text; one file's failure is that file's row, not the job's.
    """

    def run(batches):
        for batch in batches:
            texts, errors = [], []
            for path, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                text, error = None, None
                try:
                    text = read(raw)
                except Exception as e:  # noqa: BLE001
                    error = f"{path.rsplit('/', 1)[-1]}: {e}"
                texts.append(text)
                errors.append(error)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(texts, pa.string()), pa.array(errors, pa.string())], ["path", "checksum", "text", "error"])

    summed = scanned.select("path", "content", F.sha2("content", 256).alias("checksum"))
    first = summed.groupBy("checksum").agg(F.min("path").alias("path"))
    fresh = first.join(known.select("checksum").distinct(), "checksum", "left_anti")
    done = summed.join(fresh, ["checksum", "path"], "left_semi").select("path", "content", "checksum").mapInArrow(run, "path string, checksum string, text string, error string")
    skipped = summed.join(fresh, ["checksum", "path"], "left_anti").select("path", "checksum", F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("error"), F.lit("skipped").alias("status"))
    made = done.withColumn("status", F.when(F.col("error").isNull(), "ingested").otherwise("failed"))
    return made.unionByName(skipped).select("path", "checksum", "status", "error", "text")
