"""Page layout over block tables: margins, columns, reading order, word tables, heading spaces, whole pages (inventory X3, X4, X14-X20, X24, X27).

A block table has doc_id, page, seq, text, x0, y0, x1, y1, font_size, is_bold, block_type, page_width, page_height.
A page is a bounded group; all else is columns and joins on (doc_id, page). Ties in y keep the order of seq. Empty
tables give empty tables; blocks with null coordinates are placed nowhere and keep their type.
"""

from __future__ import annotations

from bisect import bisect_right

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquarry.functions.healing import BOILERPLATE, CAPTION
from docquarry.operators.batches import values

PAGE = ["doc_id", "page"]


def tag_margins(blocks: DataFrame, share: float = 0.05) -> DataFrame:
    """block_type header_footer where a block reaches into a page's upper or lower margin."""
    outside = (F.col("y0") < F.col("page_height") * share) | (F.col("y1") > F.col("page_height") * (1 - share))
    return blocks.withColumn("block_type", F.when(outside, "header_footer").otherwise(F.col("block_type")))


def tag_texts(blocks: DataFrame) -> DataFrame:
    """boilerplate and caption types of text blocks."""
    text = F.col("block_type") == "text"
    kind = F.when(text & F.col("text").rlike(BOILERPLATE), "boilerplate").when(text & F.col("text").rlike(CAPTION), "caption")
    return blocks.withColumn("block_type", F.coalesce(kind, "block_type"))


def tighten(blocks: DataFrame, words: DataFrame) -> DataFrame:
    """Boxes drawn in to the words of the block with that number; a block without words keeps its own."""
    box = words.groupBy(*PAGE, F.col("block_no").alias("seq")).agg(F.min("x0").alias("wx0"), F.min("y0").alias("wy0"), F.max("x1").alias("wx1"), F.max("y1").alias("wy1"))
    drawn = [F.coalesce(f"w{c}", c).alias(c) if c in ("x0", "y0", "x1", "y1") else F.col(c) for c in blocks.columns]
    return blocks.join(box, [*PAGE, "seq"], "left").select(*drawn)


def body_sizes(blocks: DataFrame) -> DataFrame:
    """(doc_id, page, body): the commonest font size of text blocks to a tenth, of equals the first to come; 10 where there is none."""
    sizes = blocks.groupBy(*PAGE, F.round("font_size", 1).alias("size")).agg(F.count(F.when(F.col("block_type") == "text", 1)).alias("n"), F.min("seq").alias("first"))
    best = sizes.groupBy(*PAGE).agg(F.max(F.when(F.col("n") > 0, F.struct("n", -F.col("first"), "size"))).alias("best"))
    return best.select(*PAGE, F.coalesce("best.size", F.lit(10.0)).alias("body"))


def _gap(among: Column, share: float, most: float) -> tuple[Column, Column]:
    """(farthest x1 of those among before a block, whether its x0 leaves a gap after it); blocks stand in the order of their x-ranges."""
    order = Window.partitionBy(*PAGE).orderBy("x0", "x1", "seq")
    least = F.greatest(F.lit(6.0), F.least(F.col("page_width") * share, F.lit(most)))
    return F.max(F.when(among, F.col("x1"))).over(order.rowsBetween(Window.unboundedPreceding, -1)), among & (F.col("x0") - F.col("before") >= least)


def column_gaps(blocks: DataFrame, share: float = 0.01, most: float = 20.0) -> DataFrame:
    """(doc_id, page, gap_from, gap_to) between the merged x-ranges of blocks, at least max(6, min(share * width, most)) wide."""
    before, wide = _gap(F.lit(True), share, most)
    return blocks.withColumn("before", before).filter(wide).select(*PAGE, F.col("before").alias("gap_from"), F.col("x0").alias("gap_to"))


def _with_columns(blocks: DataFrame, tolerance: float) -> DataFrame:
    """All blocks with body, and those of type text on a page with keys with (layout, num_columns, col) and on: windows over pages dealt once."""
    page = Window.partitionBy(*PAGE)
    text = F.col("block_type") == "text"
    of_size = Window.partitionBy(*PAGE, "size")
    held = blocks.repartition(*PAGE).withColumn("size", F.round("font_size", 1))  # the windows below need no other exchange
    held = held.withColumn("n", F.count(F.when(text, 1)).over(of_size)).withColumn("first", F.min("seq").over(of_size))
    held = held.withColumn("best", F.max(F.when(F.col("n") > 0, F.struct("n", -F.col("first"), "size"))).over(page))
    held = held.withColumn("body", F.coalesce("best.size", F.lit(10.0)))
    held = held.withColumn("on", F.coalesce(text & F.col("doc_id").isNotNull() & F.col("page").isNotNull(), F.lit(False)))
    held = held.withColumn("near", F.coalesce(F.when(F.col("on"), F.abs(F.col("font_size") - F.col("body")) / F.col("body") < tolerance), F.lit(False)))
    before, wide = _gap(F.col("near"), 0.01, 20.0)
    held = held.withColumn("before", before).withColumn("cut", F.when(wide, (F.col("before") + F.col("x0")) / 2))
    held = held.withColumn("bodies", F.count(F.when(F.col("near"), 1)).over(page)).withColumn("cuts", F.sort_array(F.collect_list("cut").over(page)))  # a page's gaps
    held = held.withColumn("cuts", F.when(F.col("bodies") >= 2, F.col("cuts")).otherwise(F.array().cast("array<double>")))
    start, end = F.size(F.filter("cuts", lambda c: F.col("x0") >= c)), F.size(F.filter("cuts", lambda c: F.col("x1") >= c))
    held = held.withColumn("raw", F.when(F.col("on") & (start == end), start))
    held = held.withColumn("used", F.sort_array(F.collect_set("raw").over(page)))
    n = F.when(F.size("used") <= 1, 1).otherwise(F.size("used"))
    name = F.when(n == 1, "single").when(n == 2, "two_columns").when(n == 3, "three_columns").otherwise(F.concat(n.cast("string"), F.lit("_columns")))
    col = F.when(n == 1, 0).when(F.col("raw").isNotNull(), F.array_position("used", F.col("raw")).cast("int") - 1)
    return held.select(*blocks.columns, "body", "on", *(F.when(F.col("on"), c).alias(k) for k, c in (("layout", name), ("num_columns", n), ("col", col))))


def assign_columns(blocks: DataFrame, tolerance: float = 0.15) -> DataFrame:
    """Blocks of type text with (layout, num_columns, col): col counts kept columns from 0; null: full width. Columns come from blocks near the body size."""
    return _with_columns(blocks, tolerance).filter("on").select(*blocks.columns, "layout", "num_columns", "col")


def _with_places(held: DataFrame, on: Column) -> DataFrame:
    """held with position: of those on, the place in reading order; null where there is none."""
    page = Window.partitionBy(*PAGE)
    wide = F.col("col").isNull()
    held = held.withColumn("cuts", F.sort_array(F.collect_list(F.when(on & wide, F.struct("y0", "seq"))).over(page)))
    above = F.size(F.filter("cuts", lambda c: c.y0 <= F.col("y0")))
    level = F.exists("cuts", lambda c: c.y0 == F.col("y0"))
    lost = ~wide & (F.size("cuts") > above) & (level | (F.col("y0") <= 0))
    place = F.when(wide, F.array_position("cuts", F.struct("y0", "seq")).cast("int") - 1).otherwise(above)
    held = held.withColumn("placed", F.coalesce(on & ~lost, F.lit(False))).withColumn("band", place)
    order = page.orderBy(F.desc("placed"), "band", wide.cast("int"), F.coalesce("col", F.lit(0)), "y0", "seq")
    return held.withColumn("position", F.when(F.col("placed"), F.row_number().over(order).cast("long"))).drop("cuts", "band", "placed")


def reading_order(assigned: DataFrame) -> DataFrame:
    """assigned with position (from 1): columns from left to right within the bands between full-width blocks.

    Bands are open on both sides: a column block that begins level with an earlier full-width block, or above 0 where there is one, has no place and goes.
    """
    return _with_places(assigned, F.lit(True)).filter(F.col("position").isNotNull())


def _with_extra(held: DataFrame) -> DataFrame:
    """held with the position of its tables and captions too: a page that has any goes by y0; other blocks without position keep none."""
    extra = F.col("block_type").isin("table", "caption") & F.col("position").isNull()
    held = held.withColumn("extra", F.coalesce(extra, F.lit(False))).withColumn("mixed", F.max("extra").over(Window.partitionBy(*PAGE)))
    kept = F.col("extra") | F.col("position").isNotNull()
    order = Window.partitionBy(*PAGE).orderBy(F.desc("kept"), F.when(F.col("mixed"), F.col("y0")), F.coalesce("position", F.lit(2**62)), "seq")
    return held.withColumn("kept", kept).withColumn("position", F.when(F.col("kept"), F.row_number().over(order).cast("long"))).drop("extra", "mixed", "kept")


def with_inserted(ordered: DataFrame, blocks: DataFrame) -> DataFrame:
    """ordered and the page's tables and captions; where there are any, the page goes by y0 instead."""
    more = blocks.filter(F.col("block_type").isin("table", "caption"))
    extra = more.select(*blocks.columns, F.lit(None).cast("long").alias("position"))
    return _with_extra(ordered.select(*extra.columns).unionByName(extra))


def order_pages(blocks: DataFrame, tolerance: float = 0.15) -> DataFrame:
    """All blocks with body, layout and position: what assign_columns, reading_order and with_inserted give, in one reading and one exchange; null position: not on its page."""
    return _with_extra(_with_places(_with_columns(blocks, tolerance), F.col("on"))).select(*blocks.columns, "body", "layout", "position")


def heading_marks(blocks: DataFrame) -> Column:
    """#, ## or ### of a heading, else empty; blocks hold body."""
    size, text = F.col("font_size"), F.length("text")
    heading = (F.col("block_type") == "text") & ((size > 1.2 * F.col("body")) | (F.col("is_bold") & (text > 5) & (text < 100)))
    ratio = size / F.col("body")
    return F.when(heading, F.when(ratio > 1.8, "#").when(ratio > 1.4, "##").otherwise("###")).otherwise("")


def heading_spaces(glyphs: DataFrame) -> DataFrame:
    """(doc_id, page, block_no, text) of glyphs(.., block_no, line, n, c, x0, x1, font_size): a space where a gap passes a tenth of the size."""
    line = Window.partitionBy(*PAGE, "block_no", "line").orderBy("n")
    before, gap = F.lag("c").over(line), F.col("x0") - F.lag("x1").over(line)
    wide = (gap > F.lag("font_size").over(line) * 0.1) & (before != " ") & (F.col("c") != " ")
    put = glyphs.withColumn("put", F.concat(F.when(wide, " ").otherwise(""), "c"))
    joined = lambda key, value, sep: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, value))), lambda z: z[value]), sep)
    lines = put.groupBy(*PAGE, "block_no", "line").agg(F.trim(joined("n", "put", "")).alias("words"))
    return lines.groupBy(*PAGE, "block_no").agg(joined("line", "words", "\n").alias("text"))


def words_to_table(words: list[tuple[float, float, float, float, str]], box: tuple[float, float, float, float]) -> list[list[str]] | None:
    """Rows of cells from words (x0, y0, x1, y1, text) whose centre lies in box; none where no table of two rows and columns shows."""
    bx0, by0, bx1, by1 = box
    held = [w for w in words if by0 <= (w[1] + w[3]) / 2 <= by1 and bx0 - 5 <= (w[0] + w[2]) / 2 <= bx1 + 5]
    if len(held) < 4:
        return None
    cuts, reach = [], None
    for x0, x1 in sorted((w[0], w[2]) for w in held):
        if reach is not None and x0 > reach + 2 and x0 - reach >= max(12.0, 0.03 * (bx1 - bx0)):
            cuts.append((reach + x0) / 2)
        reach = x1 if reach is None else max(reach, x1)
    apart = max(6.0, (by1 - by0) / len(held) * 2)
    rows: list[list] = []
    for w in sorted(held, key=lambda w: w[1]):
        if not rows or w[1] - rows[-1][-1][1] > apart:
            rows.append([])
        rows[-1].append(w)
    table: list[list[str]] = []
    for row in rows:
        cells: list[list[str]] = [[] for _ in range(len(cuts) + 1)]
        for w in sorted(row, key=lambda w: w[0]):
            cells[bisect_right(cuts, (w[0] + w[2]) / 2)].append(w[4])
        texts = [" ".join(c) for c in cells]
        if any(t.strip() for t in texts):
            table.append(texts)
    if not cuts or len(rows) < 2 or len(table) < 2:
        return None
    out = table[:1]
    for texts in table[1:]:
        if texts[0].strip():
            out.append(texts)
        else:  # a row that goes on in the one above
            out[-1] = [" ".join(x for x in (a, b) if x.strip()) for a, b in zip(out[-1], texts)]
    return out if len(out) >= 2 else None


def markdown_table(rows: list[list[str | None]]) -> str:
    """Short rows are filled up; line ends become blanks and bars are escaped."""
    width = max(map(len, rows))
    cell = lambda x: " ".join((x or "").split("\n")).replace("|", "\\|").strip()
    lines = ["| " + " | ".join(cell(x) for x in [*r, *[""] * (width - len(r))]) + " |" for r in rows]
    return "\n".join([lines[0], "| " + " | ".join(["---"] * width) + " |", *lines[1:]])


def caption_tables(regions: DataFrame, words: DataFrame) -> DataFrame:
    """(doc_id, page, seq, text) of regions(doc_id, page, seq, caption, raw, x0, y0, x1, y1): a markdown table of the page's words, else the raw text in brackets."""

    box = ("x0", "y0", "x1", "y1")
    held = words.groupBy(*PAGE).agg(F.collect_list(F.struct(*box, "text")).alias("words"))  # a page's words
    asked = regions.join(held, PAGE, "left").select(*PAGE, "seq", "caption", "raw", *box, "words")

    def build(batches):
        for batch in batches:
            texts = []
            # The words column by column: a struct at a time costs far more than its table.
            lists = batch.column(9)
            inside = lists.flatten()
            columns = [values(c) for c in inside.flatten()]
            at = 0
            for caption, raw, *corners, size in zip(*(batch.column(i).to_pylist() for i in range(3, 9)), pc.list_value_length(lists).to_pylist()):
                size = size or 0
                rows = words_to_table(list(zip(*(c[at : at + size] for c in columns))), tuple(corners))
                at += size
                texts.append(f"[Table: {caption}]\n\n{markdown_table(rows)}" if rows else f"[Table: {raw}]")
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(texts, pa.string())], [*PAGE, "seq", "text"])

    return asked.mapInArrow(build, "doc_id long, page int, seq long, text string")


def extract_pages(blocks: DataFrame) -> DataFrame:
    """(doc_id, page, layout, n_blocks, text) of raw blocks: tagging, columns, order, headings, rendering. A page without text is layout empty."""
    ordered = order_pages(tag_texts(tag_margins(blocks)))
    mark = heading_marks(ordered)
    line = F.when(F.col("block_type") == "caption", F.concat(F.lit("[Figure: "), "text", F.lit("]"))).when(mark != "", F.concat(mark, F.lit(" "), "text")).otherwise(F.col("text"))
    # A page without an id has no text.
    kept = F.col("position").isNotNull() & F.col("doc_id").isNotNull() & F.col("page").isNotNull()
    lines = F.array_sort(F.collect_list(F.when(kept, F.struct("position", line.alias("line")))))
    made = ordered.groupBy(*PAGE).agg(F.count(F.when(kept, 1)).alias("n_blocks"), F.array_join(F.transform(lines, lambda z: z.line), "\n\n").alias("text"), F.max("layout").alias("layout"))
    return made.select(*PAGE, F.coalesce("layout", F.when(F.col("n_blocks") == 0, "empty").otherwise("single")).alias("layout"), "n_blocks", "text")
