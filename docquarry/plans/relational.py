"""Catalogue, ingestion, text, layout, routing and citation queries, written once for both engines."""

from __future__ import annotations

from docquarry.functions.healing import BOILERPLATE, CAPTION, DOC_CODE, NOISE, ROUTE, SOURCES_TAIL, TAIL
from docquarry.plans.dialect import both

#: Layout blocks made of document lines; the driver's tables hold no coordinates.
BLOCKS = """(SELECT doc_id, ln AS seq, line AS text, CAST(50 + (doc_id + ln) % 3 * 150 AS DOUBLE) AS x0, CAST(150 + (doc_id + ln) % 3 * 150 + ln % 4 * 20 AS DOUBLE) AS x1,
 CAST(ln * 37 % 800 AS DOUBLE) AS y0, CAST(ln * 37 % 800 + 12 AS DOUBLE) AS y1, CAST(8 + (doc_id * 7 + ln * 3) % 4 * 2 AS DOUBLE) AS font_size, (doc_id + ln) % 5 = 0 AS is_bold FROM {lines} l)"""


def blocks(d):
    return BLOCKS.format(lines=d["lines"])


def answers(d):
    """Model answers with references and a sources tail."""
    return "(SELECT conv_id, turn, text || ' [' || (conv_id % 9) || '] and [' || (turn % 4) || ']' || CASE WHEN conv_id % 2 = 0 THEN chr(10) || '## Sources' || chr(10) || '- [1] made up' ELSE '' END AS answer FROM conversations WHERE role = 'assistant')"


def markdown(d):
    """Lines of a markdown rendering: a heading before every fourth line, some table and figure lines."""
    return f"(SELECT doc_id, ln, CASE WHEN ln % 8 = 0 THEN '# ' || source WHEN ln % 4 = 0 THEN '## Part ' || ln WHEN ln % 7 = 3 THEN '| a | ' || ln || ' |' WHEN ln % 11 = 5 THEN '[Figure: ' || ln || ']' WHEN ln % 13 = 6 THEN '' ELSE line END AS line FROM {d['lines']} l)"


def noise(d):
    """Whether a line is noise: by its pattern, or as a document code."""
    return f"{d['like']}(trim(line), {d['r']}'{NOISE}') OR {d['like']}(trim(line), {d['r']}'{DOC_CODE}')"


def quality(d):
    """The text's facts in one pass, beside the layout's facts of its blocks (two columns at least: 1 + gaps)."""
    words = "filter(split(text, r'[ \\n\\t\\r]+'), w -> w <> '')" if d["r"] else "list_filter(string_split_regex(text, '[ \\n\\t\\r]+'), lambda w: w <> '')"
    size = "size" if d["r"] else "len"
    longer = f"filter({words}, w -> length(w) > 40)" if d["r"] else f"list_filter({words}, lambda w: length(w) > 40)"
    return f"""SELECT doc_id, CAST(round(greatest(0, 1 - CASE WHEN n / 400000.0 < 0.0005 THEN 0.3 WHEN n / 400000.0 < 0.001 THEN 0.1 ELSE 0 END - CASE WHEN blocks > 0 AND content < 0.3 * blocks THEN 0.2 ELSE 0 END
 - CASE WHEN long_words > 0.05 * words THEN 0.3 WHEN long_words > 0 THEN 0.1 ELSE 0 END - CASE WHEN cols >= 5 THEN 0.2 WHEN cols >= 4 THEN 0.1 ELSE 0 END - CASE WHEN cols >= 2 AND least_col < 0.1 * most_col THEN 0.15 ELSE 0 END), 2) AS DOUBLE) AS score,
 CASE WHEN n / 400000.0 < 0.0005 THEN 'low_text_density' WHEN n / 400000.0 < 0.001 THEN 'sparse_text' ELSE '' END AS density_issue, CASE WHEN blocks > 0 AND content < 0.3 * blocks THEN 'low_content_ratio' ELSE '' END AS content_issue,
 CASE WHEN long_words > 0.05 * words THEN 'garbled_text_detected' WHEN long_words > 0 THEN 'possible_garbled_text' ELSE '' END AS garbled_issue,
 CASE WHEN cols >= 5 THEN 'uncertain_layout' WHEN cols >= 4 THEN 'complex_layout' ELSE '' END AS layout_issue, CASE WHEN cols >= 2 AND least_col < 0.1 * most_col THEN 'unbalanced_columns' ELSE '' END AS balance_issue
 FROM (SELECT t.doc_id, n, words, long_words, coalesce(blocks, 0) AS blocks, coalesce(content, 0) AS content, coalesce(cols, 1) AS cols, coalesce(least_col, 0) AS least_col, coalesce(most_col, 0) AS most_col
 FROM (SELECT doc_id, CAST(length(text) AS BIGINT) AS n, CAST({size}({words}) AS BIGINT) AS words, CAST({size}({longer}) AS BIGINT) AS long_words FROM documents) t
 LEFT JOIN (SELECT doc_id, CAST(sum(k) AS BIGINT) AS blocks, CAST(sum(c) AS BIGINT) AS content, count(*) AS cols, min(c) AS least_col, max(c) AS most_col
 FROM (SELECT doc_id, x0, count(*) AS k, sum(CASE WHEN y0 < 0.05 * 800 OR y1 > 0.95 * 800 THEN 0 ELSE 1 END) AS c FROM {blocks(d)} b GROUP BY doc_id, x0) g GROUP BY doc_id) l ON l.doc_id = t.doc_id) q"""


_WORDS = r"filter(split(lower(text), r'[ \n\t\r]+'), w -> w <> '')"
#: Words are counted document by document: once each for tf, and the distinct ones for df. Rows that share an id are one document.
SPARK_INDEX = f"""SELECT u.word AS lexeme, CAST(sum(u.df) AS BIGINT) AS df, CAST(sum(u.tf) AS BIGINT) AS tf FROM (
 SELECT explode(concat(transform(ws, w -> struct(w AS word, 0 AS df, 1 AS tf)), CASE WHEN doc_id IS NULL THEN array() ELSE transform(array_distinct(ws), w -> struct(w AS word, 1 AS df, 0 AS tf)) END)) AS u FROM (
 SELECT doc_id, {_WORDS} AS ws FROM documents LEFT ANTI JOIN (SELECT doc_id FROM documents GROUP BY doc_id HAVING count(*) > 1) m USING (doc_id)
 UNION ALL SELECT doc_id, flatten(collect_list({_WORDS})) FROM documents LEFT SEMI JOIN (SELECT doc_id FROM documents GROUP BY doc_id HAVING count(*) > 1) m USING (doc_id) GROUP BY doc_id) t) v GROUP BY u.word"""


def last_words(n):
    """The last words of each document, cut before any shuffle, with their places."""
    return f"(SELECT doc_id, CAST(size(ws) - size(tail) + p AS BIGINT) AS wn, word FROM (SELECT doc_id, ws, slice(ws, greatest(1, size(ws) - {n - 1}), {n}) AS tail FROM (SELECT doc_id, {_WORDS} AS ws FROM documents) a) b LATERAL VIEW posexplode(tail) x AS p, word)"


WRITERS = {
    # catalogue
    "documents_list": lambda d: "SELECT d.doc_id, d.source, count(l.turn) AS chunk_count FROM documents d LEFT JOIN conversations l ON d.doc_id = l.conv_id GROUP BY d.doc_id, d.source ORDER BY d.doc_id DESC LIMIT 50 OFFSET 20",
    "documents_total": lambda d: "SELECT count(*) AS total FROM documents",
    "library_view": lambda d: "SELECT doc_id, upper(source) AS type, coalesce(nullif(lang, 'en'), '—') AS mission, replace(source, '_', ' ') AS title FROM documents",
    "library_metrics": lambda d: "SELECT greatest(1, CAST(ceil(count(*) / 20.0) AS BIGINT)) AS pages, count(DISTINCT source) AS types, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents",
    "checksum": lambda d: f"SELECT doc_id, {d['sha']('text')} AS checksum FROM documents",
    "dedup_checksum": lambda d: f"SELECT min(doc_id) AS doc_id, checksum FROM (SELECT doc_id, {d['sha']('text')} AS checksum FROM documents) h GROUP BY checksum",
    "ingest_new_only": lambda d: f"SELECT n.doc_id FROM (SELECT doc_id, {d['sha']('text')} AS c FROM documents) n LEFT JOIN (SELECT DISTINCT {d['sha']('text')} AS c FROM documents WHERE lang = 'en') o ON n.c = o.c WHERE o.c IS NULL",
    "ingest_report": lambda d: f"SELECT CAST(sum(n) AS BIGINT) AS total, CAST(sum(CASE WHEN empty THEN 0 ELSE 1 END) AS BIGINT) AS ingested, CAST(sum(n - 1) AS BIGINT) AS skipped, CAST(sum(CASE WHEN empty THEN 1 ELSE 0 END) AS BIGINT) AS failed FROM (SELECT count(*) AS n, max(CASE WHEN text = '' THEN 1 ELSE 0 END) = 1 AS empty FROM documents GROUP BY {d['sha']('text')}) r",
    "document_rows": lambda d: "SELECT doc_id, 'doc_' || doc_id AS title, 'pdf' AS source_type, CAST(1 + n_chars / 3000 AS BIGINT) AS total_pages FROM documents WHERE text IS NOT NULL" if not d["r"] else "SELECT doc_id, concat('doc_', doc_id) AS title, 'pdf' AS source_type, CAST(rint(1 + n_chars / 3000) AS BIGINT) AS total_pages FROM documents WHERE text IS NOT NULL",
    "chunk_rows": lambda d: "SELECT d.doc_id, e.vec_id, e.label FROM documents d JOIN embeddings e ON d.doc_id = e.vec_id",
    "seed_chunks_resolved": lambda d: "SELECT l.doc_id, l.quality, d.source FROM labels l JOIN documents d ON l.doc_id = d.doc_id WHERE d.doc_id % 2 = 0",
    "seed_chunks_rejected": lambda d: "SELECT l.doc_id FROM labels l WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = l.doc_id AND d.doc_id % 2 = 0)",
    "seed_guard": lambda d: "SELECT count(*) > 0 AS seeded FROM documents",
    "dimension_guard": lambda d: "SELECT vec_id, " + ("size" if d["r"] else "len") + "(embedding) = 64 AS right_dimension FROM embeddings",
    "cascade_delete": lambda d: "SELECT l.doc_id, l.quality FROM labels l WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = l.doc_id AND d.lang = 'fr')",
    "duplicate_keys": lambda d: f"SELECT checksum, count(*) AS copies, min(doc_id) AS first_id FROM (SELECT doc_id, {d['sha']('text')} AS checksum FROM documents) h GROUP BY checksum HAVING count(*) > 1",
    "satellite_filter": lambda d: "SELECT p_partkey + 10000 AS norad_id, p_name AS name, p_size * CAST(1.5 AS DOUBLE) AS inclination FROM part WHERE p_size * CAST(1.5 AS DOUBLE) BETWEEN 50 AND 60",
    "satellites_by_type": lambda d: "SELECT p_type AS object_type, count(*) AS n, round(avg(p_size * CAST(1.5 AS DOUBLE)), 6) AS mean_inclination, max(p_retailprice) AS apoapsis_km FROM part GROUP BY p_type",
    # text healing
    "hyphen_rejoin": lambda d: f"SELECT doc_id, regexp_replace(regexp_replace(wrapped, {d['r']}'([0-9A-Za-z_])-\\n *([a-z])', '{'$1$2' if d['r'] else chr(92) + '1' + chr(92) + '2'}'{d['g']}), {d['r']}'([A-Z])-\\n *([A-Z])', '{'$1$2' if d['r'] else chr(92) + '1' + chr(92) + '2'}'{d['g']}) AS healed FROM (SELECT doc_id, replace(text, ' th', 'a-' || chr(10) || ' th') AS wrapped FROM documents) w",
    "noise_lines": lambda d: f"SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN {noise(d)} THEN 1 ELSE 0 END) AS BIGINT) AS n_noise FROM (SELECT doc_id, trim(CASE WHEN ln % 9 = 4 THEN 'Page ' || ln WHEN ln % 9 = 7 THEN '© 2020 publisher' WHEN ln % 9 = 2 THEN 'SP/1240 code' ELSE line END) AS line FROM {d['lines']} a) l GROUP BY doc_id",
    "boilerplate_tag": lambda d: f"SELECT doc_id, ln, {d['like']}(line, {d['r']}'{BOILERPLATE}') AS boilerplate FROM {d['lines']} l",
    "caption_tag": lambda d: f"SELECT doc_id, ln, {d['like']}(line, {d['r']}'{CAPTION}') AS caption FROM (SELECT doc_id, ln, CASE WHEN ln % 6 = 2 THEN 'Fig. ' || ln || ' ' || line WHEN ln % 6 = 4 THEN 'figures ' || line ELSE line END AS line FROM {d['lines']} a) l",
    "reference_tail": lambda d: f"SELECT doc_id, regexp_replace(text, {d['r']}'(?s){TAIL}.*', '') AS kept FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN text || chr(10) || '## References' || chr(10) || '[1] x' WHEN 1 THEN text || chr(10) || '### Author and Affiliations ' || chr(10) || 'x' WHEN 2 THEN text || chr(10) || '#Declaration' ELSE text || chr(10) || '## References of note' END AS text FROM documents) t",
    "quality_score": quality,
    "issue_histogram": lambda d: "SELECT issue, count(*) AS n FROM (SELECT CASE WHEN n_chars / 400000.0 < 0.0005 THEN 'low_text_density' WHEN n_chars / 400000.0 < 0.001 THEN 'sparse_text' ELSE 'none' END AS issue FROM documents) i GROUP BY issue",
    "low_quality_pages": lambda d: "SELECT doc_id, n_chars FROM documents WHERE n_chars / 400000.0 < 0.0005",
    "extraction_report": lambda d: "SELECT source, count(*) AS pages, CAST(sum(n_chars) AS BIGINT) AS char_count, CAST(sum(CASE WHEN lang = 'en' THEN 1 ELSE 0 END) AS BIGINT) AS single_pages FROM documents GROUP BY source",
    "document_render": lambda d: f"SELECT doc_id, count(*) AS n_pages, {d['sha'](d['agg'](chr(39) + '---' + chr(39) + ' || chr(10) || ' + chr(39) + '*Page ' + chr(39) + ' || page || ' + chr(39) + '*' + chr(39) + ' || chr(10) || body', 'chr(10)', 'page'))} AS rendered FROM (SELECT doc_id, {'ln div 5' if d['r'] else 'ln // 5'} AS page, {d['agg']('line', 'chr(10)', 'ln')} AS body FROM {d['lines']} l GROUP BY doc_id, {'ln div 5' if d['r'] else 'ln // 5'}) p GROUP BY doc_id",
    # layout
    "margin_tags": lambda d: f"SELECT doc_id, seq, CASE WHEN y0 < 40 OR y1 > 760 THEN 'header_footer' ELSE 'text' END AS block_type FROM {blocks(d)} b",
    "font_split": lambda d: f"SELECT doc_id, seq, CAST(sum(flip) OVER (PARTITION BY doc_id ORDER BY seq) AS BIGINT) AS font_group FROM (SELECT doc_id, seq, CASE WHEN lag(is_bold) OVER w <> is_bold OR abs(font_size - lag(font_size) OVER w) / lag(font_size) OVER w > 0.15 THEN 1 ELSE 0 END AS flip FROM {blocks(d)} b WINDOW w AS (PARTITION BY doc_id ORDER BY seq)) f",
    "block_fonts": lambda d: f"SELECT doc_id, round(avg(font_size), 6) AS mean_size, avg(CASE WHEN is_bold THEN 1.0 ELSE 0.0 END) > 0.5 AS is_bold, min(x0) AS x0, max(x1) AS x1, min(y0) AS y0, max(y1) AS y1 FROM {blocks(d)} b GROUP BY doc_id",
    "body_font_mode": lambda d: f"SELECT doc_id, body FROM (SELECT doc_id, body, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first_seq) AS r FROM (SELECT doc_id, round(font_size, 1) AS body, count(*) AS n, min(seq) AS first_seq FROM {blocks(d)} b GROUP BY doc_id, round(font_size, 1)) c) m WHERE r = 1",
    "heading_levels": lambda d: f"SELECT doc_id, seq, CASE WHEN font_size > 12 OR (is_bold AND length(text) > 5 AND length(text) < 100) THEN CASE WHEN font_size / 10 > 1.8 THEN '#' WHEN font_size / 10 > 1.4 THEN '##' ELSE '###' END ELSE '' END AS mark FROM {blocks(d)} b",
    "column_gaps": lambda d: f"""SELECT doc_id, hi AS gap_from, next_lo AS gap_to FROM (SELECT doc_id, hi, lead(lo) OVER (PARTITION BY doc_id ORDER BY lo) AS next_lo FROM (SELECT doc_id, island, min(x0) AS lo, max(x1) AS hi FROM (SELECT doc_id, x0, x1, sum(fresh) OVER (PARTITION BY doc_id ORDER BY x0, x1, seq) AS island
 FROM (SELECT doc_id, seq, x0, x1, CASE WHEN x0 <= max(x1) OVER (PARTITION BY doc_id ORDER BY x0, x1, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM {blocks(d)} b) s) i GROUP BY doc_id, island) m) g WHERE next_lo - hi >= 6""",
    "reading_order": lambda d: f"SELECT doc_id, seq, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN x0 >= 175 THEN 1 ELSE 0 END + CASE WHEN x0 >= 325 THEN 1 ELSE 0 END, y0, seq) + CAST(0 AS BIGINT) AS position FROM {blocks(d)} b",
    "bbox_overlap": lambda d: f"WITH b AS {blocks(d)}, t AS (SELECT doc_id, seq, x0, x1, y0, y1, {'explode(sequence' if d['r'] else 'unnest(generate_series'}(CAST(floor((y0 - 5) / 64) AS BIGINT), CAST(floor((y1 + 5) / 64) AS BIGINT))) AS strip FROM b WHERE seq % 10 = 3), hit AS (SELECT DISTINCT a.doc_id, a.seq FROM (SELECT *, {'explode(sequence' if d['r'] else 'unnest(generate_series'}(CAST(floor(y0 / 64) AS BIGINT), CAST(floor(y1 / 64) AS BIGINT))) AS strip FROM b) a JOIN t ON t.doc_id = a.doc_id AND t.strip = a.strip AND a.x0 < t.x1 + 5 AND t.x0 < a.x1 + 5 AND a.y0 < t.y1 + 5 AND t.y0 < a.y1 + 5) SELECT b.doc_id, b.seq FROM b LEFT JOIN hit ON hit.doc_id = b.doc_id AND hit.seq = b.seq WHERE hit.doc_id IS NULL",
    "table_extent": lambda d: f"SELECT doc_id, min(seq) AS stop_seq FROM {blocks(d)} b WHERE seq > 0 AND (trim(text) = '' OR (font_size > 11.5 AND length(text) < 200) OR (is_bold AND length(text) < 100) OR (length(text) > 120 AND {d['like']}(text, {d['r']}'[.!?]$'))) GROUP BY doc_id",
    "table_filter": lambda d: "SELECT n_nationkey, n_regionkey FROM nation WHERE n_nationkey % 5 + 1 >= 2 AND NOT (n_regionkey / 5.0 > 0.5 OR (n_regionkey / 5.0 > 0.3 AND n_nationkey % 5 + 1 < 3))",
    "markdown_table": lambda d: f"SELECT n_regionkey, '| key | name |' || chr(10) || '| --- | --- |' || chr(10) || {d['agg'](chr(39) + '| ' + chr(39) + ' || n_nationkey || ' + chr(39) + ' | ' + chr(39) + ' || replace(n_name, ' + chr(39) + '|' + chr(39) + ', ' + chr(39) + chr(92) * (1 if not d['r'] else 2) + '|' + chr(39) + ') || ' + chr(39) + ' |' + chr(39), 'chr(10)', 'n_nationkey')} AS markdown FROM nation GROUP BY n_regionkey",
    # chunking
    "strip_metadata": lambda d: f"SELECT doc_id, regexp_replace(text, {d['r']}'^# Extracted:[^\\n]*\\n', '') AS body FROM (SELECT doc_id, '# Extracted: ' || source || chr(10) || text AS text FROM documents) t",
    "section_paths": lambda d: f"SELECT doc_id, ln, concat_ws(' > ', top, sub) AS path FROM (SELECT doc_id, ln, line, top, CASE WHEN sub_at > top_at THEN sub END AS sub FROM (SELECT doc_id, ln, line, last_value(h1) IGNORE NULLS OVER w AS top, last_value(h2) IGNORE NULLS OVER w AS sub, coalesce(max(CASE WHEN h1 IS NOT NULL THEN ln END) OVER w, -1) AS top_at, coalesce(max(CASE WHEN h2 IS NOT NULL THEN ln END) OVER w, -1) AS sub_at FROM (SELECT doc_id, ln, line, CASE WHEN line LIKE '# %' THEN substr(line, 3) END AS h1, CASE WHEN line LIKE '## %' THEN substr(line, 4) END AS h2 FROM {markdown(d)} m) h WINDOW w AS (PARTITION BY doc_id ORDER BY ln)) s) p".replace("last_value(h1) IGNORE NULLS", "last_value(h1) IGNORE NULLS" if d["r"] else "last_value(h1 IGNORE NULLS)").replace("last_value(h2) IGNORE NULLS", "last_value(h2) IGNORE NULLS" if d["r"] else "last_value(h2 IGNORE NULLS)"),
    "block_kinds": lambda d: f"SELECT doc_id, kind, count(*) AS n FROM (SELECT doc_id, CASE WHEN trim(line) = '' THEN 'blank' WHEN line LIKE '|%|' THEN 'table' WHEN line LIKE '[Figure:%]' THEN 'figure' WHEN {d['like']}(line, {d['r']}'^#+ +') THEN 'heading' ELSE 'paragraph' END AS kind FROM {markdown(d)} m) k GROUP BY doc_id, kind",
    "sentences": lambda d: f"SELECT doc_id, CAST({'size(split(marked, chr(1)))' if d['r'] else 'len(string_split(marked, chr(1)))'} AS BIGINT) AS n_sentences FROM (SELECT doc_id, regexp_replace(text, {d['r']}'([.!?])[ \\n\\t\\r]+([A-Z])', {('concat(' + chr(39) + '$1' + chr(39) + ', chr(1), ' + chr(39) + '$2' + chr(39) + ')') if d['r'] else (chr(39) + chr(92) + '1' + chr(39) + ' || chr(1) || ' + chr(39) + chr(92) + '2' + chr(39))}{d['g']}) AS marked FROM documents) s",
    "token_windows": lambda d: f"SELECT doc_id, wn // 64 AS window_no, count(*) AS n_tokens, min(wn) AS first_token FROM {d['words']} w GROUP BY doc_id, wn // 64" if not d["r"] else f"SELECT doc_id, wn div 64 AS window_no, count(*) AS n_tokens, min(wn) AS first_token FROM {d['words']} w GROUP BY doc_id, wn div 64",
    "overlap_tail": lambda d: f"SELECT doc_id, {d['agg']('word', chr(39) + ' ' + chr(39), 'wn')} AS tail FROM (SELECT doc_id, wn, word, row_number() OVER (PARTITION BY doc_id ORDER BY wn DESC) AS back FROM {last_words(16) if d['r'] else d['words']} w) b WHERE back <= 16 GROUP BY doc_id",
    "chunk_flags": lambda d: f"SELECT doc_id, max(CASE WHEN line LIKE '|%|' THEN 1 ELSE 0 END) = 1 AS has_table, max(CASE WHEN line LIKE '[Figure:%]' THEN 1 ELSE 0 END) = 1 AS has_figure, sum(length(line)) > 5000 AS is_oversized FROM {markdown(d)} m GROUP BY doc_id",
    "neighbour_expand": lambda d: f"SELECT c.doc_id, c.ln, coalesce(b.ln, -1) AS before_ln, coalesce(a.ln, -1) AS after_ln FROM (SELECT doc_id, ln FROM {d['lines']} x) c LEFT JOIN (SELECT doc_id, ln FROM {d['lines']} y) b ON b.doc_id = c.doc_id AND b.ln = c.ln - 1 LEFT JOIN (SELECT doc_id, ln FROM {d['lines']} z) a ON a.doc_id = c.doc_id AND a.ln = c.ln + 1",
    "token_counts_simple": lambda d: f"SELECT doc_id, count(*) AS n_tokens FROM {d['words']} w GROUP BY doc_id",
    "inverted_index": lambda d: f"SELECT word AS lexeme, count(DISTINCT doc_id) AS df, count(*) AS tf FROM {d['words']} w GROUP BY word" if not d["r"] else SPARK_INDEX,
    # routing, prompts
    "route_keyword": lambda d: f"SELECT conv_id, turn, CASE WHEN {d['like']}(q, {d['r']}'{ROUTE}') THEN 'structured' ELSE 'retrieval' END AS query_type, CASE WHEN {d['like']}(q, {d['r']}'{ROUTE}') THEN 0.95 ELSE 0.5 END + CAST(0 AS DOUBLE) AS confidence FROM (SELECT conv_id, turn, CASE conv_id % 4 WHEN 0 THEN text || ' NORAD ID?' WHEN 1 THEN 'turtles ' || text WHEN 2 THEN 'the orbital period of ' || text ELSE text END AS q FROM conversations WHERE role = 'user') c",
    "route_json": lambda d: (
        "SELECT conv_id, turn, CASE WHEN kind IN ('retrieval', 'structured', 'hybrid') THEN kind ELSE 'retrieval' END AS query_type, CASE WHEN kind IN ('retrieval', 'structured', 'hybrid') THEN coalesce(conf, 0.8) ELSE 0.5 END AS confidence FROM (SELECT conv_id, turn, "
        + ("get_json_object(j, '$.query_type') AS kind, try_cast(get_json_object(j, '$.confidence') AS DOUBLE) AS conf" if d["r"] else "CASE WHEN json_valid(j) THEN json_extract_string(j, '$.query_type') END AS kind, CASE WHEN json_valid(j) THEN try_cast(json_extract_string(j, '$.confidence') AS DOUBLE) END AS conf")
        + """ FROM (SELECT conv_id, turn, CASE conv_id % 4 WHEN 0 THEN '{"query_type": "hybrid", "confidence": 0.7}' WHEN 1 THEN '{"query_type": "structured"}' WHEN 2 THEN '{"query_type": "other"}' ELSE 'no json' END AS j FROM conversations WHERE role = 'user') c) p"""
    ),
    "prompt_user": lambda d: "SELECT doc_id, 'Source Documents:' || chr(10) || text || chr(10) || chr(10) || 'Question: ' || source AS prompt FROM documents",
    # citations
    "citation_refs": lambda d: f"SELECT conv_id, turn, CAST(ref AS BIGINT) AS ref, count(*) AS uses FROM (SELECT conv_id, turn, {'explode' if d['r'] else 'unnest'}({d['all']('answer', d['r'] + chr(39) + chr(92) + '[([0-9]+)' + chr(92) + ']' + chr(39))}) AS ref FROM {answers(d)} a) r GROUP BY conv_id, turn, ref",
    "citation_strip_sources": lambda d: f"SELECT conv_id, turn, regexp_replace(answer, {d['r']}'{SOURCES_TAIL}', '') AS body FROM {answers(d)} a",
    "citation_validate": lambda d: f"SELECT conv_id, turn, trim(regexp_replace(regexp_replace(answer, {d['r']}'\\[(0|[6-9]|[0-9][0-9]+)\\]', ''{d['g']}), {d['r']}'  +', ' '{d['g']})) AS valid FROM {answers(d)} a",
    "citation_sources": lambda d: f"SELECT conv_id, turn, '## Sources' || chr(10) || {d['agg'](chr(39) + '- [' + chr(39) + ' || r || ' + chr(39) + '] ' + chr(39) + ' || source', 'chr(10)', 'r')} AS sources FROM (SELECT DISTINCT a.conv_id, a.turn, a.r, k.source FROM (SELECT conv_id, turn, conv_id % 9 AS r FROM conversations WHERE role = 'assistant' UNION SELECT conv_id, turn, turn % 4 FROM conversations WHERE role = 'assistant') a JOIN documents k ON k.doc_id = a.r WHERE a.r BETWEEN 1 AND 5) s GROUP BY conv_id, turn",
    "citation_postprocess": lambda d: f"""SELECT p.conv_id, p.turn, CASE WHEN s.sources IS NULL THEN p.valid ELSE concat(p.valid, chr(10), chr(10), s.sources) END AS answer, coalesce(s.sources, '') AS sources
 FROM (SELECT conv_id, turn, trim(regexp_replace(regexp_replace(body, {d['r']}'\\[(0|[6-9]|[0-9][0-9]+)\\]', ''{d['g']}), {d['r']}'  +', ' '{d['g']})) AS valid FROM (SELECT conv_id, turn, regexp_replace(answer, {d['r']}'{SOURCES_TAIL}', '') AS body FROM {answers(d)} a) b) p
 LEFT JOIN (SELECT conv_id, turn, '## Sources' || chr(10) || {d['agg'](chr(39) + '- [' + chr(39) + ' || r || ' + chr(39) + '] ' + chr(39) + ' || source', 'chr(10)', 'r')} AS sources FROM (SELECT DISTINCT a.conv_id, a.turn, a.r, k.source FROM (SELECT conv_id, turn, CAST(ref AS BIGINT) AS r FROM (SELECT conv_id, turn, {'explode' if d['r'] else 'unnest'}({d['all']('answer', d['r'] + chr(39) + chr(92) + '[([0-9]{1,9})' + chr(92) + ']' + chr(39))}) AS ref
 FROM (SELECT conv_id, turn, regexp_replace(answer, {d['r']}'{SOURCES_TAIL}', '') AS answer FROM {answers(d)} x) y) z) a JOIN documents k ON k.doc_id = a.r WHERE a.r BETWEEN 1 AND 5) u GROUP BY conv_id, turn) s ON s.conv_id = p.conv_id AND s.turn = p.turn""",
    "noise_filtered": lambda d: f"SELECT doc_id, {d['agg']('line', 'chr(10)', 'ln')} AS kept FROM (SELECT doc_id, ln, CASE WHEN ln % 9 = 4 THEN 'Page ' || ln WHEN ln % 9 = 7 THEN '© 2020 publisher' ELSE line END AS line FROM {d['lines']} a) l WHERE NOT ({noise(d)}) GROUP BY doc_id",
    "citation_rates": lambda d: f"SELECT count(*) AS answers, CAST(sum(CASE WHEN conv_id % 9 BETWEEN 1 AND 5 THEN 1 ELSE 0 END) AS BIGINT) AS valid_first, round(avg(CASE WHEN conv_id % 9 BETWEEN 1 AND 5 THEN CAST(1 AS DOUBLE) ELSE 0 END), 4) AS accuracy FROM {answers(d)} a",
    # other sources
    "html_text": lambda d: f"SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, {d['r']}'(?is)<(script|style)[^>]*>.*?</(script|style)>', ' '{d['g']}), {d['r']}'<[^>]*>', ' '{d['g']}), {d['r']}'[ \\n\\t\\r]+', ' '{d['g']})) AS body FROM pages",
    "bulletin_json": lambda d: "SELECT event_id, " + ("get_json_object(props, '$.k')" if d["r"] else "json_extract_string(props, '$.k')") + " AS k, event_type FROM events",
    "status_map": lambda d: "SELECT user_id, CASE WHEN bad = 0 THEN 'green' WHEN bad < n THEN 'amber' ELSE 'red' END AS status FROM (SELECT user_id, count(*) AS n, sum(CASE WHEN value < 10 THEN 1 ELSE 0 END) AS bad FROM events GROUP BY user_id) u",
}

QUERIES, SQL = {}, {}
for _name, _write in WRITERS.items():
    QUERIES[_name], SQL[_name] = both(_write)
