"""Document structure: blocks, links, offsets, section trees, tables in plain text, OCR regions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def line_blocks(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", apart: str = "\n") -> DataFrame:
    """Non-blank pieces between `apart`: doc_id, ordinal (from 0, blank pieces not counted), block_text."""
    return docs.select(F.col(doc_id).alias("doc_id"), F.posexplode(_pieces(text, apart)).alias("ordinal", "block_text"))


def _pieces(text: str, apart: str) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), apart), lambda x: F.trim(x)), lambda x: x != "")


def _from_heads(lines: Column, most: int) -> Column:
    """`lines` cut before each of at most `most` characters: an array of (at, part)."""
    let = lambda value, body: F.transform(F.array(value), body)[0]

    def cut(v: Column) -> Column:
        heads = F.filter(F.transform(v, lambda t, i: F.when(F.char_length(t) <= most, i)), lambda i: i.isNotNull())
        starts = F.array_distinct(F.concat(F.array(F.lit(0)), heads))
        return let(starts, lambda s: F.transform(s, lambda a, k: F.struct(a.alias("at"), F.slice(v, a + 1, F.coalesce(F.get(s, k + 1), F.size(v)) - a).alias("part"))))

    return let(lines, cut)


def headed_blocks(docs: DataFrame, head: int, top: int, *more: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`line_blocks` with section and top, and the columns `more`: the ordinals of the last blocks so far of at most `head`, and of at most `top`
    characters (`top` <= `head`; null: none). A document's lines are cut where they stand, so that no text is shuffled; rows that share an id are cut each by itself."""
    from_ = lambda n: F.when(F.char_length(F.get("s.part", 0)) <= n, F.col("at"))
    d = docs.select(F.col(doc_id).alias("doc_id"), *more, F.explode(_from_heads(_pieces(text, "\n"), top)).alias("s")).withColumn("at", F.col("s.at"))
    d = d.select("doc_id", *more, from_(top).alias("top"), F.col("at").alias("before"), F.explode(_from_heads(F.col("s.part"), head)).alias("s")).withColumn("at", F.col("before") + F.col("s.at"))
    d = d.select("doc_id", *more, "top", from_(head).alias("section"), "at", F.posexplode("s.part").alias("k", "block_text"))
    return d.select("doc_id", (F.col("at") + F.col("k")).alias("ordinal"), "block_text", "section", "top", *more)


def linked(blocks: DataFrame, gap: int = 2) -> DataFrame:
    """Adds previous, next, char_start and char_end: offsets in the canonical text, blocks `gap` characters apart."""
    w = Window.partitionBy("doc_id").orderBy("ordinal")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.char_length("block_text").cast("long") + gap).over(before), F.lit(0)).cast("long")
    b = blocks.withColumns({"previous": F.lag("ordinal").over(w), "next": F.lead("ordinal").over(w), "char_start": start})
    return b.withColumn("char_end", F.col("char_start") + F.char_length("block_text"))


def visible_text(html: Column) -> Column:
    """Text of a page without scripts, styles and tags: blocks on lines of their own, blanks collapsed."""
    out = F.regexp_replace(html, r"(?is)<(?:script|style|noscript|template)[^>]*>.*?</(?:script|style|noscript|template)>", " ")
    out = F.regexp_replace(out, r"(?i)<br[ ]*/?>|</(?:p|li|div|h[1-6]|tr|article|section|title)>", "\n")
    out = F.regexp_replace(out, r"(?i)</t[dh]>", " | ")
    out = F.regexp_replace(out, r"<[^>]*>", " ")
    for a, b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        out = F.replace(out, F.lit(a), F.lit(b))
    out = F.regexp_replace(F.regexp_replace(out, r"[ \t]+", " "), r" *\n[ \n]*", "\n")
    return F.regexp_replace(out, r"^[ \n]+|[ \n]+$", "")


def islands(rows: DataFrame, by: str, order: str, inside: Column) -> DataFrame:
    """Rows that satisfy `inside`, with `island`: a number shared by neighbours without a gap between them."""
    w = Window.partitionBy(by).orderBy(order)
    numbered = rows.withColumn("_n", F.row_number().over(w)).filter(inside)
    return numbered.withColumn("island", F.col("_n") - F.row_number().over(w)).drop("_n")


def table_groups(lines: DataFrame, apart: str = r"\s{2,}", least_rows: int = 3) -> DataFrame:
    """The lines of layout tables: runs of lines with two cells or more, `least_rows` of them, widths within one of each
    other, and a digit in a row after the first.

    `lines` has doc_id, ordinal (without gaps) and block_text; returns doc_id, table (its first ordinal), ordinal and cells.
    """
    cells = F.filter(F.transform(F.split(F.trim("block_text"), apart), lambda c: F.trim(c)), lambda c: c != "")
    runs = islands(lines.withColumn("cells", cells), "doc_id", "ordinal", F.size("cells") >= 2)
    w = Window.partitionBy("doc_id", "island")
    runs = runs.withColumn("table", F.min("ordinal").over(w))
    digit = F.exists("cells", lambda c: c.rlike("[0-9]")) & (F.col("ordinal") > F.col("table"))
    n = F.size("cells")
    kept = runs.withColumns({"_n": F.count("*").over(w), "_low": F.min(n).over(w), "_high": F.max(n).over(w), "_digit": F.bool_or(digit).over(w)})
    return kept.filter((F.col("_n") >= least_rows) & (F.col("_high") - F.col("_low") <= 1) & F.col("_digit")).select("doc_id", "table", "ordinal", "cells")


def table_row_blocks(rows: DataFrame) -> DataFrame:
    """`rows` of tables (doc_id, table, ordinal, cells) as blocks: the header, then each row with its positional headers."""
    w = Window.partitionBy("doc_id", "table").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    head = F.first("cells").over(w)
    named = F.zip_with("head", "cells", lambda h, c: F.when(c.isNotNull(), F.concat(F.coalesce(h, F.lit("(no header)")), F.lit(": "), c)))
    text = F.array_join(F.filter(named, lambda v: v.isNotNull()), "; ")
    own = rows.withColumn("head", head)
    first = F.col("ordinal") == F.col("table")
    return own.select("doc_id", "table", "ordinal", F.when(first, "table_header").otherwise("table_row").alias("kind"), F.when(first, F.array_join("cells", " | ")).otherwise(text).alias("block_text"))


def spatial_text(boxes: DataFrame) -> DataFrame:
    """(page, text) of recognised regions (page, x0, y0, x1, y1, text): rows from the top, each from the left.

    Regions come by their top; one joins the row before it if its centre is within half the lower of the two heights from
    the centre of the region that opened the row. The regions of a page are one array.
    """
    packed = boxes.groupBy("page").agg(F.sort_array(F.collect_list(F.struct("y0", "x0", "y1", "x1", "text"))).alias("r"))
    kind = "array<struct<mid:double,tall:double,x:double,row:int,text:string>>"
    start = F.struct(F.array().cast(kind).alias("done"), F.lit(None).cast("double").alias("mid"), F.lit(None).cast("double").alias("tall"), F.lit(-1).alias("row"))

    def step(acc: Column, r: Column) -> Column:
        mid, tall = ((r["y0"] + r["y1"]) / 2).cast("double"), (r["y1"] - r["y0"]).cast("double")
        same = F.coalesce(F.abs(mid - acc["mid"]) <= 0.5 * F.least(tall, acc["tall"]), F.lit(False))
        row = F.when(same, acc["row"]).otherwise(acc["row"] + 1)
        own = F.struct(mid.alias("mid"), tall.alias("tall"), r["x0"].cast("double").alias("x"), row.alias("row"), r["text"].alias("text"))
        return F.struct(F.concat(acc["done"], F.array(own)).alias("done"), F.when(same, acc["mid"]).otherwise(mid).alias("mid"), F.when(same, acc["tall"]).otherwise(tall).alias("tall"), row.alias("row"))

    placed = packed.select("page", F.posexplode(F.aggregate("r", start, step, lambda a: a["done"])).alias("n", "v")).select("page", "n", "v.*")
    line = placed.groupBy("page", "row").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x", "n", "text"))), lambda v: v["text"]), "    ").alias("line"))
    return line.groupBy("page").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("row", "line"))), lambda v: v["line"]), "\n").alias("text"))


def render_dimensions(width: Column, height: Column, dpi: int = 200, most_side: int = 4000, most_pixels: int = 8_000_000) -> Column:
    """struct<width, height>: pixels of a page (in points) under three limits; a scale whose rounding exceeds them shrinks by a thousandth, and again."""
    scale = F.least(F.lit(dpi / 72), most_side / width, most_side / height, F.sqrt(most_pixels / (width * height)))
    size = lambda s: (F.ceil(width * s), F.ceil(height * s))
    steps = F.sequence(F.lit(0), F.lit(12))

    def fits(s: Column) -> Column:
        w, h = size(s)
        return (w * h <= most_pixels) & (F.greatest(w, h) <= most_side)

    found = F.filter(F.transform(steps, lambda k: scale * F.pow(F.lit(0.999), k)), fits)[0]
    return F.struct(size(found)[0].cast("long").alias("width"), size(found)[1].cast("long").alias("height"))


def section_rollup(sections: DataFrame) -> DataFrame:
    """Totals over each section and its descendants, by the pre-order interval: sections has doc_id, section, path, first,
    last and tokens, where path names the ancestors from the root on."""
    up = sections.select("doc_id", F.explode("path").alias("section"), "first", "last", "tokens")
    return up.groupBy("doc_id", "section").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("tokens").alias("tokens"), F.count("*").alias("n_sections"))


def regions(words: DataFrame, scale: float = 1.0) -> DataFrame:
    """Boxes of lines from boxes of words (page, line, x, y, w, h, word)."""
    return words.groupBy("page", "line").agg(
        F.round(F.min("x") * scale, 4).alias("x0"), F.round(F.min("y") * scale, 4).alias("y0"),
        F.round(F.max(F.col("x") + F.col("w")) * scale, 4).alias("x1"), F.round(F.max(F.col("y") + F.col("h")) * scale, 4).alias("y1"),
        F.count("*").alias("n_words"),
    )
