"""Sections, blocks and token-bounded chunks of markdown texts (inventory C1-C13)."""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.functions.healing import ABBREVIATIONS
from docquarry.operators.batches import pieces, release

CHUNKS = "doc_id long, chunk_index int, section_path string, content string, token_count int, has_table boolean, has_figure boolean, is_oversized boolean"
_HEADING = re.compile(r"^(#{1,6})\s+(.+)$")
_FIGURE = re.compile(r"^\[Figure:.*\]$")


def strip_metadata(text: str) -> str:
    """Without the extraction title and the page separators."""
    text = re.sub(r"\A# Extracted:[^\n]*\n*", "", text)
    return re.sub(r"(?s)\n?---\n\*Page \d+.*?\*\n?", "\n", text).strip()


def sections(text: str) -> list[tuple[str | None, str]]:
    """(path, body) in order; the path joins the open headings, the preamble has none."""
    out, open_, body = [], [], []

    def flush():
        joined = "\n".join(body).strip()
        if joined or open_:
            out.append((" > ".join(t for _, t in open_) or None, joined))
        body.clear()

    for line in text.split("\n"):
        if m := _HEADING.match(line):
            flush()
            level = len(m[1])
            while open_ and open_[-1][0] >= level:
                open_.pop()
            open_.append((level, m[2].strip()))
        else:
            body.append(line)
    flush()
    return out


def blocks(body: str) -> list[tuple[str, str]]:
    """(kind, text): runs of table lines, figure lines, and paragraphs up to a blank line."""
    out: list[tuple[str, list[str]]] = []
    for line in body.split("\n"):
        bare = line.strip()
        kind = "" if not bare else "table" if bare.startswith("|") and bare.endswith("|") else "figure" if _FIGURE.match(bare) else "paragraph"
        if kind == "figure" or (kind and (not out or out[-1][0] != kind)):
            out.append((kind, [line]))
        elif kind:
            out[-1][1].append(line)
        else:
            out.append(("", []))
    return [(k, "\n".join(lines).strip()) for k, lines in out if k]


def sentences(text: str) -> list[str]:
    """Split after . ! ? and white space before A-Z, not behind an abbreviation."""
    parts: list[str] = []
    for piece in re.split(r"(?<=[.!?])\s+(?=[A-Z])", text):
        last = re.search(r"(\S+)\.$", parts[-1]) if parts else None
        if last and last[1].lstrip("([") in ABBREVIATIONS:
            parts[-1] += " " + piece
        else:
            parts.append(piece)
    return [p for p in parts if p.strip()]


def chunk_markdown(text: str, max_tokens: int = 1024, overlap: int = 128, encode: Callable = str.split, decode: Callable = " ".join) -> list[dict]:
    """Greedy chunks by section. Sizes count the overlap and the blocks, not separators; a block behind an overlap may exceed the bound (flagged)."""
    out: list[dict] = []
    if not text or not text.strip():
        return out

    def emit(path, parts, kinds):
        content = "\n\n".join(p for p in parts if p)
        n = len(encode(content))
        out.append({"chunk_index": len(out), "section_path": path, "content": content, "token_count": n, "has_table": "table" in kinds, "has_figure": "figure" in kinds, "is_oversized": n > max_tokens})

    def tail():
        tokens = encode(out[-1]["content"]) if out and overlap > 0 else []
        return decode(tokens[-overlap:]) if tokens else ""

    for path, body in sections(strip_metadata(text)):
        flat: list[tuple[str, str]] = []
        for kind, block in blocks(body):
            if kind != "paragraph" or len(encode(block)) <= max_tokens:
                flat.append((kind, block))
                continue
            for s in sentences(block):
                tokens = encode(s)
                flat += [("sentence", s)] if len(tokens) <= max_tokens else [("fragment", decode(tokens[i : i + max_tokens])) for i in range(0, len(tokens), max_tokens)]
        parts, kinds, size = [], [], 0
        for kind, block in flat:
            n = len(encode(block))
            if kind == "table" and n > max_tokens:
                if parts:
                    emit(path, parts, kinds)
                emit(path, [block], [kind])
                parts, kinds, size = [], [], 0
            elif size + n <= max_tokens:
                parts.append(block)
                kinds.append(kind)
                size += n
            else:
                if parts:
                    emit(path, parts, kinds)
                before = tail()
                parts, kinds, size = [before, block], [kind], n + (len(encode(before)) if before else 0)
        if parts:
            emit(path, parts, kinds)
    return out


def chunk_documents(docs: DataFrame, max_tokens: int = 1024, overlap: int = 128) -> DataFrame:
    """CHUNKS of docs(doc_id, text): one narrow Arrow pass, a document's chunks follow its order.

    Null and empty texts have no chunks; rows with null or repeated ids are chunked each; further columns are ignored.
    """
    names = [c.split()[0] for c in CHUNKS.split(", ")]

    def run(batches):
        kinds = (pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.bool_(), pa.bool_(), pa.bool_())
        for batch in batches:
            for part in pieces(batch, 1):
                rows = [(key, *(c[n] for n in names[1:])) for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()) for c in chunk_markdown(text or "", max_tokens, overlap)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), kinds)], names)
            release()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, CHUNKS)
