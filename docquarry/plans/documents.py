"""Layout, full-text and answer queries: DataFrame operators on one side, SQL written apart from them on the other."""

from __future__ import annotations

from pyspark.sql import functions as F

from docquarry.functions.healing import BOILERPLATE, CAPTION, SOURCES_TAIL, STOP_WORDS
from docquarry.operators.answers import answer_questions, ingest_files, postprocess
from docquarry.operators.embedding import embed
from docquarry.operators.fulltext import postings, search_postings
from docquarry.operators.layout import assign_columns, body_sizes, caption_tables, column_gaps, extract_pages, heading_spaces, order_pages, reading_order, tag_margins, tighten
from docquarry.plans.dialect import CHECK, SPARK, views
from docquarry.plans.relational import answers

KEYS = ["doc_id", "page", "seq"]


def page_blocks(d) -> str:
    """Blocks of pages of twenty lines in three uneven columns, with full-width lines, tables and captions; the driver's tables hold no coordinates."""
    div = (lambda a, b: f"{a} div {b}") if d["r"] else (lambda a, b: f"{a} // {b}")
    return f"""(SELECT doc_id, CAST({div('ln', 20)} AS INT) AS page, ln AS seq, CASE WHEN ln % 40 = 13 THEN 'Figure ' || ln ELSE line END AS text,
 CAST(CASE WHEN ln % 9 = 4 THEN 50 ELSE 50 + (doc_id + ln) % 3 * 170 END AS DOUBLE) AS x0, CAST(CASE WHEN ln % 9 = 4 THEN 540 ELSE 190 + (doc_id + ln) % 3 * 170 + ln % 4 * 5 END AS DOUBLE) AS x1,
 CAST(30 + {div('ln % 20', 3)} * 110 AS DOUBLE) AS y0, CAST(42 + {div('ln % 20', 3)} * 110 AS DOUBLE) AS y1, CAST(CASE WHEN ln % 9 = 4 THEN 14 WHEN ln % 5 = 2 THEN 10.5 ELSE 10 END AS DOUBLE) AS font_size,
 ln % 11 = 3 AS is_bold, CASE WHEN ln % 60 = 31 THEN 'table' ELSE 'text' END AS block_type, CAST(600 AS DOUBLE) AS page_width, CAST(800 AS DOUBLE) AS page_height FROM {d['lines']} l)"""


def frame(spark, sf_dir, text):
    views(spark, sf_dir, text)
    return spark.sql(f"SELECT * FROM {text} t")


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tagged(spark, sf_dir):
    return tag_margins(frame(spark, sf_dir, page_blocks(SPARK)))


def page_margins(spark, sf_dir):
    return tagged(spark, sf_dir).select(*KEYS, "block_type")


def page_body_sizes(spark, sf_dir):
    return body_sizes(tagged(spark, sf_dir))


def page_gaps(spark, sf_dir):
    return column_gaps(tagged(spark, sf_dir).filter("block_type = 'text' AND font_size < 12"))


def column_assign(spark, sf_dir):
    return assign_columns(tagged(spark, sf_dir)).select(*KEYS, "layout", F.col("num_columns").cast("long").alias("num_columns"), F.coalesce("col", F.lit(-1)).cast("long").alias("col"))


def page_order(spark, sf_dir):
    return reading_order(assign_columns(tagged(spark, sf_dir))).select(*KEYS, "position")


def page_inserts(spark, sf_dir):
    return order_pages(tagged(spark, sf_dir)).filter("position IS NOT NULL").select(*KEYS, "position")


def page_extraction(spark, sf_dir):
    made = extract_pages(frame(spark, sf_dir, page_blocks(SPARK)))
    return made.select("doc_id", "page", "layout", "n_blocks", F.sha2(F.encode("text", "UTF-8"), 256).alias("rendered"))


def bbox_tighten(spark, sf_dir):
    blocks = frame(spark, sf_dir, page_blocks(SPARK))
    words = blocks.filter("seq % 3 = 0").select("doc_id", "page", F.col("seq").alias("block_no"), F.explode(F.array(F.lit(1.0), F.lit(2.0))).alias("k"), "x0", "y0", "x1", "y1")
    words = words.select("doc_id", "page", "block_no", (F.col("x0") + 3 * F.col("k")).alias("x0"), (F.col("y0") + F.col("k")).alias("y0"), (F.col("x1") - 4 * F.col("k")).alias("x1"), (F.col("y1") - F.col("k")).alias("y1"))
    return tighten(blocks, words).select(*KEYS, "x0", "y0", "x1", "y1")


def heading_repair(spark, sf_dir):
    """First lines as glyphs 5.5 wide every 6, with 3 more after each seventh."""
    lines = frame(spark, sf_dir, SPARK["lines"]).filter("ln = 0 AND length(line) > 0")
    each = lines.selectExpr("doc_id", "line AS t", "explode(sequence(1, length(line))) AS n")
    glyphs = each.selectExpr("doc_id", "0 AS page", "0 AS block_no", "0 AS line", "n", "substr(t, n, 1) AS c", "n * 6.0D + n div 7 * 3 AS x0", "n * 6.0D + n div 7 * 3 + 5.5D AS x1", "10.0D AS font_size")
    return heading_spaces(glyphs).select("doc_id", "text")


def word_tables(spark, sf_dir):
    """Captions over rows of a document's words in columns 100 apart; no SQL: the cells' folds follow one another."""
    words = frame(spark, sf_dir, SPARK["words"]).selectExpr("doc_id", "CAST(wn div 40 AS INT) AS page", "50.0D + wn % 4 * 100 AS x0", "90.0D + wn % 4 * 100 AS x1", "100.0D + wn % 40 div 4 * 20 AS y0", "110.0D + wn % 40 div 4 * 20 AS y1", "word AS text")
    regions = words.groupBy("doc_id", "page").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")).selectExpr("doc_id", "page", "0L AS seq", "'Table ' || page AS caption", "'Table ' || page AS raw", "x0", "y0", "x1", "y1")
    return caption_tables(regions, words)


def postings_digest(spark, sf_dir):
    found = postings(table(spark, sf_dir, "documents"))
    return found.groupBy("lexeme").agg(F.count("*").alias("df"), F.sum(F.size("positions")).alias("tf"), F.min("doc_id").alias("first_id"), F.max(F.element_at("positions", -1)).cast("long").alias("last_position"))


def fts_topk(spark, sf_dir):
    return search_postings(postings(table(spark, sf_dir, "documents")), 'thon thre or erin -anea or "ha er"', 20).withColumn("score", F.round("score", 6))


def embed_documents(spark, sf_dir):
    return embed(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def answer_run(spark, sf_dir):
    """Every benchmark text asked of all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("title"), F.col("lang").alias("section"), "text")
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    return answer_questions(asked, docs).select("query_id", "query_type", "n_blocks", "answer", "sources_section", F.size("citations").cast("long").alias("n_citations"))


def ingest_errors(spark, sf_dir):
    """Texts as files; those of an even id and no words fail."""
    files = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.encode("text", "UTF-8").alias("content"))
    known = table(spark, sf_dir, "documents").filter("lang = 'fr'").select(F.sha2(F.encode("text", "UTF-8"), 256).alias("checksum"))

    def read(raw: bytes) -> str:
        if len(raw) % 2 == 0:
            raise ValueError("odd sizes only")
        return raw.decode()

    return ingest_files(files, known, read).select("path", "checksum", "status", F.coalesce("error", F.lit("")).alias("error"))


def citation_blocks(spark, sf_dir):
    """Answers against their own context: 1 to 4 blocks a conversation."""
    said = frame(spark, sf_dir, answers(SPARK)).select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), "conv_id", F.col("answer").alias("raw_answer"))
    docs = table(spark, sf_dir, "documents").filter("doc_id between 1 and 4").select("doc_id", "source", "lang")  # at most four ids
    refs = said.select("query_id", F.explode(F.sequence(F.lit(1).cast("long"), 1 + F.col("conv_id") % 4)).alias("ref"))
    blocks = refs.join(docs, refs.ref == docs.doc_id).select("query_id", "ref", F.col("source").alias("title"), F.when(F.col("ref") % 2 == 0, F.col("lang")).alias("section"), "doc_id")
    return postprocess(said.drop("conv_id"), blocks).select("query_id", "answer", "sources_section", F.size("citations").cast("long").alias("n_citations"))


QUERIES = {f.__name__: f for f in (page_margins, page_body_sizes, page_gaps, column_assign, page_order, page_inserts, page_extraction, bbox_tighten, heading_repair, word_tables, postings_digest, fts_topk, embed_documents, answer_run, ingest_errors, citation_blocks)}

_T = f"t AS (SELECT *, CASE WHEN y0 < 40 OR y1 > 760 THEN 'header_footer' ELSE block_type END AS kind FROM {page_blocks(CHECK)} b)"
_TAGGED = f"""t AS (SELECT *, CASE WHEN m <> 'text' THEN m WHEN regexp_matches(text, '{BOILERPLATE}') THEN 'boilerplate' WHEN regexp_matches(text, '{CAPTION}') THEN 'caption' ELSE m END AS kind
 FROM (SELECT *, CASE WHEN y0 < 40 OR y1 > 760 THEN 'header_footer' ELSE block_type END AS m FROM {page_blocks(CHECK)} b) x)"""
_BODY = """sizes AS (SELECT doc_id, page, round(font_size, 1) AS size, count(*) FILTER (kind = 'text') AS n, min(seq) AS first FROM t GROUP BY ALL),
 body AS (SELECT doc_id, page, coalesce(first(size ORDER BY n DESC, first) FILTER (n > 0), 10.0) AS body FROM sizes GROUP BY ALL)"""
_COLUMNS = f"""{_BODY},
 near AS (SELECT t.* FROM t JOIN body USING (doc_id, page) WHERE kind = 'text' AND abs(font_size - body) / body < 0.15),
 cuts AS (SELECT doc_id, page, (prev + x0) / 2 AS cut FROM (SELECT *, max(x1) OVER (PARTITION BY doc_id, page ORDER BY x0, x1, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM near) g
          WHERE x0 - prev >= 6 AND (doc_id, page) IN (SELECT (doc_id, page) FROM near GROUP BY doc_id, page HAVING count(*) >= 2)),
 placed AS (SELECT t.doc_id, t.page, t.seq, any_value(t.y0) AS y0, count(*) FILTER (cut <= t.x0) AS s, count(*) FILTER (cut <= t.x1) AS e FROM t LEFT JOIN cuts c ON c.doc_id = t.doc_id AND c.page = t.page WHERE kind = 'text' GROUP BY t.doc_id, t.page, t.seq),
 kept AS (SELECT doc_id, page, count(DISTINCT s) AS n FROM placed WHERE s = e GROUP BY ALL),
 cols AS (SELECT p.doc_id, p.page, p.seq, p.y0, greatest(1, coalesce(n, 0)) AS num_columns,
          CASE WHEN coalesce(n, 0) <= 1 THEN 0 WHEN s <> e THEN -1 ELSE (SELECT count(DISTINCT u.s) FROM placed u WHERE u.doc_id = p.doc_id AND u.page = p.page AND u.s = u.e AND u.s < p.s) END AS col
          FROM placed p LEFT JOIN kept k ON k.doc_id = p.doc_id AND k.page = p.page)"""
_ORDER = f"""{_COLUMNS},
 banded AS (SELECT c.doc_id, c.page, c.seq, c.y0, c.col, count(w.seq) AS total, count(*) FILTER (w.y0 <= c.y0) AS above, count(*) FILTER (w.y0 = c.y0) AS level, count(*) FILTER ((w.y0, w.seq) < (c.y0, c.seq)) AS before
            FROM cols c LEFT JOIN cols w ON w.doc_id = c.doc_id AND w.page = c.page AND w.col = -1 GROUP BY ALL),
 ordered AS (SELECT doc_id, page, seq, row_number() OVER (PARTITION BY doc_id, page ORDER BY CASE WHEN col = -1 THEN before ELSE above END, col = -1, greatest(col, 0), y0, seq) AS position
             FROM banded WHERE col = -1 OR above = total OR (level = 0 AND y0 > 0))"""
_INSERTED = f"""{_ORDER},
 inserted AS (SELECT doc_id, page, seq, row_number() OVER (PARTITION BY doc_id, page ORDER BY CASE WHEN mixed THEN y0 END, coalesce(position, 4611686018427387904), seq) AS position, text, kind, font_size, is_bold
              FROM (SELECT t.*, o.position, bool_or(o.position IS NULL) OVER (PARTITION BY t.doc_id, t.page) AS mixed FROM t LEFT JOIN ordered o USING (doc_id, page, seq) WHERE o.position IS NOT NULL OR kind IN ('table', 'caption')) x)"""
_STEM = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(word, '^(.+)ies$', '\\1y'), '^(.+(?:s|x|z|ch|sh))es$', '\\1'), '^(.{2,}[^s])s$', '\\1'), '^(.{3,}?)(?:ing|ed)$', '\\1')"


def _checked_answers() -> str:
    """References 0 to 9 go one by one where the conversation has no such block."""
    body = f"trim(regexp_replace(answer, '{SOURCES_TAIL}', ''))"
    for r in range(10):
        body = f"replace({body}, CASE WHEN {r} BETWEEN 1 AND 1 + conv_id % 4 THEN '[none]' ELSE '[{r}]' END, '')"
    return f"trim(regexp_replace({body}, '  +', ' ', 'g'))"


SQL = {
    "page_margins": f"WITH {_T} SELECT doc_id, page, seq, kind AS block_type FROM t",
    "page_body_sizes": f"WITH {_T}, {_BODY} SELECT doc_id, page, CAST(body AS DOUBLE) AS body FROM body",
    "page_gaps": f"WITH {_T} SELECT doc_id, page, prev AS gap_from, x0 AS gap_to FROM (SELECT *, max(x1) OVER (PARTITION BY doc_id, page ORDER BY x0, x1, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM t WHERE kind = 'text' AND font_size < 12) g WHERE x0 - prev >= 6",
    "column_assign": f"WITH {_T}, {_COLUMNS} SELECT doc_id, page, seq, CASE num_columns WHEN 1 THEN 'single' WHEN 2 THEN 'two_columns' WHEN 3 THEN 'three_columns' ELSE num_columns || '_columns' END AS layout, CAST(num_columns AS BIGINT) AS num_columns, CAST(col AS BIGINT) AS col FROM cols",
    "page_order": f"WITH {_T}, {_ORDER} SELECT doc_id, page, seq, position FROM ordered",
    "page_inserts": f"WITH {_T}, {_INSERTED} SELECT doc_id, page, seq, position FROM inserted",
    "page_extraction": f"""WITH {_TAGGED}, {_INSERTED}, lines AS (SELECT doc_id, page, position, CASE WHEN kind = 'caption' THEN '[Figure: ' || text || ']' WHEN kind = 'text' AND (font_size > 1.2 * body OR (is_bold AND length(text) > 5 AND length(text) < 100))
 THEN CASE WHEN font_size / body > 1.8 THEN '#' WHEN font_size / body > 1.4 THEN '##' ELSE '###' END || ' ' || text ELSE text END AS line FROM inserted JOIN body USING (doc_id, page)),
 made AS (SELECT doc_id, page, count(*) AS n, string_agg(line, chr(10) || chr(10) ORDER BY position) AS text FROM lines GROUP BY ALL), lay AS (SELECT doc_id, page, max(num_columns) AS c FROM cols GROUP BY ALL)
 SELECT p.doc_id, p.page, CASE WHEN c = 1 THEN 'single' WHEN c = 2 THEN 'two_columns' WHEN c = 3 THEN 'three_columns' WHEN c > 3 THEN c || '_columns' WHEN n IS NULL THEN 'empty' ELSE 'single' END AS layout, coalesce(n, 0) AS n_blocks, sha256(coalesce(text, '')) AS rendered
 FROM (SELECT DISTINCT doc_id, page FROM t) p LEFT JOIN made m ON m.doc_id = p.doc_id AND m.page = p.page LEFT JOIN lay l ON l.doc_id = p.doc_id AND l.page = p.page""",
    "bbox_tighten": f"SELECT doc_id, page, seq, CASE WHEN seq % 3 = 0 THEN x0 + 3 ELSE x0 END AS x0, CASE WHEN seq % 3 = 0 THEN y0 + 1 ELSE y0 END AS y0, CASE WHEN seq % 3 = 0 THEN x1 - 4 ELSE x1 END AS x1, CASE WHEN seq % 3 = 0 THEN y1 - 1 ELSE y1 END AS y1 FROM {page_blocks(CHECK)} b",
    "heading_repair": f"SELECT doc_id, trim(string_agg(CASE WHEN n > 1 AND n // 7 > (n - 1) // 7 AND c <> ' ' AND p <> ' ' THEN ' ' || c ELSE c END, '' ORDER BY n)) AS text FROM (SELECT doc_id, n, substr(line, n, 1) AS c, substr(line, n - 1, 1) AS p FROM {CHECK['lines']} l, unnest(range(1, length(line) + 1)) u(n) WHERE ln = 0) g GROUP BY doc_id",
    "postings_digest": f"SELECT {_STEM} AS lexeme, count(DISTINCT doc_id) AS df, count(*) AS tf, min(doc_id) AS first_id, max(i) AS last_position FROM (SELECT doc_id, i, s[i] AS word FROM (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^0-9a-zß-ɏ]+'), lambda w: w <> '') AS s FROM documents) d, unnest(range(1, len(s) + 1)) u(i)) w WHERE word NOT IN ({', '.join(repr(w) for w in sorted(STOP_WORDS))}) GROUP BY ALL",
    "ingest_errors": "SELECT CAST(doc_id AS VARCHAR) AS path, checksum, CASE WHEN CAST(doc_id AS VARCHAR) <> first OR checksum IN (SELECT sha256(text) FROM documents WHERE lang = 'fr') THEN 'skipped' WHEN size % 2 = 0 THEN 'failed' ELSE 'ingested' END AS status, CASE WHEN CAST(doc_id AS VARCHAR) <> first OR checksum IN (SELECT sha256(text) FROM documents WHERE lang = 'fr') OR size % 2 = 1 THEN '' ELSE doc_id || ': odd sizes only' END AS error FROM (SELECT doc_id, sha256(text) AS checksum, octet_length(encode(text)) AS size, min(CAST(doc_id AS VARCHAR)) OVER (PARTITION BY sha256(text)) AS first FROM documents) f",
    "citation_blocks": f"""WITH a AS (SELECT conv_id * 1000 + turn AS query_id, conv_id, {_checked_answers()} AS body FROM {answers(CHECK)} x),
 u AS (SELECT query_id, d.doc_id AS ref, '- [' || d.doc_id || '] ' || source || CASE WHEN d.doc_id % 2 = 0 AND lang <> '' THEN ' — ' || lang ELSE '' END AS entry FROM a JOIN documents d ON d.doc_id BETWEEN 1 AND 1 + conv_id % 4 AND contains(body, '[' || d.doc_id || ']')),
 g AS (SELECT query_id, count(*) AS n, string_agg(entry, chr(10) ORDER BY ref) AS entries FROM u GROUP BY query_id)
 SELECT a.query_id, CASE WHEN n > 0 THEN body || chr(10) || chr(10) || '## Sources' || chr(10) || entries ELSE body END AS answer, '## Sources' || coalesce(chr(10) || entries, '') AS sources_section, coalesce(n, 0) AS n_citations FROM a LEFT JOIN g ON g.query_id = a.query_id""",
}
