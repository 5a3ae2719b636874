"""Sequential text operators over lines, blocks and pages (inventory X2, X21, X28)."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.functions.healing import BULLETS
from docquarry.operators.batches import by_group, pieces, release


def reflow(text: str) -> str:
    """Join wrapped lines: blank lines end a paragraph, bullets begin one, a final hyphen takes no space."""
    out: list[str] = []
    held = ""
    for line in text.split("\n"):
        bare = line.strip()
        if not bare:
            if held:
                out.append(held)
            out.append("")
            held = ""
        elif bare[:1] in BULLETS and bare[1:2] == " ":
            if held:
                out.append(held)
            held = bare
        else:
            held = bare if not held else held + ("" if held.endswith("-") else " ") + bare
    if held:
        out.append(held)
    return "\n".join(out)


def reflow_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, text) in pieces of bounded size; null texts are empty."""

    def run(batches):
        for batch in batches:
            for part in pieces(batch, 1):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([reflow(t or "") for t in part.column(1).to_pylist()], pa.string())], ["doc_id", "text"])
            release()

    kept = docs.select("doc_id", "text")
    return kept.mapInArrow(run, kept.schema)


def merge_paragraphs(page: list[dict], body: float) -> list[dict]:
    """One page's blocks in reading order; each step looks at the merged box so far."""
    out: list[dict] = []
    for b in page:
        p = out[-1] if out else None
        joins = False
        if p is not None:
            overlap = min(p["x1"], b["x1"]) - max(p["x0"], b["x0"])
            narrow = min(p["x1"] - p["x0"], b["x1"] - b["x0"])
            gap = b["y0"] - p["y1"]
            joins = (
                abs(p["font_size"] - b["font_size"]) < 0.15 * body and narrow > 0 and overlap / narrow > 0.5 and 0 <= gap < 1.8 * body
                and not re.search(r"[.!?:;]$", p["text"]) and not p["is_bold"] and not b["is_bold"] and b["text"][:1] not in BULLETS
            )
        if joins:
            p["text"] = p["text"][:-1] + b["text"] if p["text"].endswith("-") else p["text"] + " " + b["text"]
            p |= {"x0": min(p["x0"], b["x0"]), "x1": max(p["x1"], b["x1"]), "y1": max(p["y1"], b["y1"])}
        else:
            out.append(dict(b))
    return out


def merge_page_blocks(blocks: DataFrame, body: float = 10.0) -> DataFrame:
    """blocks(doc_id, page, seq, text, x0, y0, x1, y1, font_size, is_bold), merged page by page; a page is bounded."""
    names = blocks.columns

    def make(rows):
        return [tuple(b.values()) for b in merge_paragraphs([dict(zip(names, r)) for r in rows], body)]

    return by_group(blocks, ["doc_id", "page"], "seq", make, "text")


def merge_pages(texts: list[str], passes: int = 4, reach: int = 3) -> list[str]:
    """Move the continuation of a sentence that a page break cut back to its page."""
    pages = [t.split("\n") for t in texts]
    for _ in range(passes):
        locked: set[int] = set()
        moved = False
        for i in range(len(pages)):
            if i in locked:
                continue
            last = next((n for n in range(len(pages[i]) - 1, -1, -1) if pages[i][n].strip()), None)
            if last is None or pages[i][last][:1] in "#[" or re.search(r"[.!?:;)]\s*$", pages[i][last]):
                continue
            tail = pages[i][last].rstrip()
            for j in range(i + 1, min(i + 1 + reach, len(pages))):
                first = next((n for n, line in enumerate(pages[j]) if line.strip() and line.strip()[:1] not in "|[#"), None)
                if j in locked or first is None:
                    continue
                line = pages[j][first].strip()
                if (line[:1] in BULLETS and line[1:2] == " ") or not (line[:1].islower() or tail[-1:].islower() or tail.endswith("-")):
                    continue
                cut = re.search(r"[.!?:;)](\s)", line)
                head, rest = (line[: cut.start() + 1], line[cut.end() :]) if cut else (line, "")
                pages[i][last] = tail[:-1] + head if tail.endswith("-") else tail + " " + head
                pages[j][first : first + 1] = [rest] if rest else []
                locked |= {i, j}
                moved = True
                break
        if not moved:
            break
    return ["\n".join(p) for p in pages]


def merge_document_pages(pages: DataFrame) -> DataFrame:
    """pages(doc_id, page, text); the pages of one document are one group, bounded by the document."""

    def make(rows):
        return [(*r[:2], text) for r, text in zip(rows, merge_pages([r[2] or "" for r in rows]))]

    return by_group(pages.select(F.col("doc_id").cast("long"), F.col("page").cast("int"), "text"), ["doc_id"], "page", make, "text")
