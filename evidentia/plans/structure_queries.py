"""Queries over document structure. Lines of `documents` are blocks; `lineitem` gives intervals and boxes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import structure as s
from .registry import dealt, query

_BLOCKS = r"""
l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda v: trim(v)), lambda v: v <> '') AS l FROM documents),
b AS (SELECT doc_id, generate_subscripts(l, 1) - 1 AS ordinal, unnest(l) AS block_text FROM l)"""


@query("SC4 D5 W9", f"WITH {_BLOCKS} SELECT doc_id, ordinal, sha256(block_text) AS text_sha256 FROM b")
def plain_blocks(x):
    return s.line_blocks(x.documents).select("doc_id", F.col("ordinal").cast("long"), F.sha2(F.col("block_text").cast("binary"), 256).alias("text_sha256"))


@query("W7 W8 D5", f"""WITH {_BLOCKS} SELECT doc_id, ordinal, lag(ordinal) OVER w AS previous, lead(ordinal) OVER w AS next,
CAST(coalesce(sum(length(block_text) + 2) OVER (PARTITION BY doc_id ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS char_start,
CAST(coalesce(sum(length(block_text) + 2) OVER (PARTITION BY doc_id ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(block_text) AS BIGINT) AS char_end FROM b WINDOW w AS (PARTITION BY doc_id ORDER BY ordinal)""")
def block_links(x):
    out = s.linked(s.line_blocks(x.documents))
    return out.select("doc_id", *[F.col(c).cast("long") for c in ("ordinal", "previous", "next", "char_start", "char_end")])


@query("A10 A15 A36", f"WITH {_BLOCKS} SELECT lang, count(DISTINCT doc_id) AS documents, count(*) AS blocks, CAST(sum(length(block_text)) AS BIGINT) AS chars, count(*) = (SELECT count(*) FROM b JOIN documents e USING (doc_id) WHERE e.lang = d.lang) AS reconciled FROM b JOIN documents d USING (doc_id) GROUP BY lang")
def corpus_totals(x):
    b = s.line_blocks(x.documents).join(x.documents.select("doc_id", "lang"), "doc_id")
    out = b.groupBy("lang").agg(F.countDistinct("doc_id").alias("documents"), F.count("*").alias("blocks"), F.sum(F.char_length("block_text").cast("long")).alias("chars"))
    expected = x.documents.select("lang", F.size(F.filter(F.split("text", "\n"), lambda v: F.trim(v) != "")).cast("long").alias("n")).groupBy("lang").agg(F.sum("n").alias("n"))
    return out.join(expected, "lang").withColumn("reconciled", F.col("blocks") == F.col("n")).drop("n")


@query("SC6 SC7", r"""
WITH a AS (SELECT page_id, regexp_replace(html, '(?is)<(?:script|style|noscript|template)[^>]*>.*?</(?:script|style|noscript|template)>', ' ', 'g') AS t FROM pages),
b AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(t, '(?i)<br[ ]*/?>|</(?:p|li|div|h[1-6]|tr|article|section|title)>', chr(10), 'g'), '(?i)</t[dh]>', ' | ', 'g'), '<[^>]*>', ' ', 'g') AS t FROM a),
c AS (SELECT page_id, replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&') AS t FROM b),
d AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(t, '[ \t]+', ' ', 'g'), ' *\n[ \n]*', chr(10), 'g'), '^[ \n]+|[ \n]+$', '', 'g') AS t FROM c)
SELECT page_id, length(t) AS chars, sha256(t) AS text_sha256 FROM d""")
def html_visible_text(x):
    t = s.visible_text(F.col("html"))
    return x.pages.select("page_id", t.alias("t")).select("page_id", F.char_length("t").cast("long").alias("chars"), F.sha2(F.col("t").cast("binary"), 256).alias("text_sha256"))


#: Lines of a page in SQL: three or four cells of an order line apart by blanks, some plain.
_LAYOUT = """
b AS (SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS ordinal, l_partkey AS p, l_suppkey AS s, CAST(l_quantity AS BIGINT) AS q FROM lineitem),
c AS (SELECT doc_id, ordinal, CASE WHEN p % 9 = 0 THEN ['plain words only'] WHEN p % 4 = 0 THEN ['item ' || chr(CAST(97 + p % 26 AS INT)), CASE WHEN q > 25 THEN CAST(q AS VARCHAR) ELSE 'none' END, 'x'] WHEN p % 31 = 0 THEN ['a', 'b', 'c', 'd', 'e'] ELSE ['item ' || chr(CAST(97 + p % 26 AS INT)), CASE WHEN q > 25 THEN CAST(q AS VARCHAR) ELSE 'none' END] END AS cells FROM b),
i AS (SELECT *, ordinal - row_number() OVER (PARTITION BY doc_id ORDER BY ordinal) AS island FROM c WHERE len(cells) >= 2),
f AS (SELECT *, min(ordinal) OVER (PARTITION BY doc_id, island) AS tab FROM i),
g AS (SELECT doc_id, island FROM f GROUP BY ALL HAVING count(*) >= 3 AND max(len(cells)) - min(len(cells)) <= 1 AND bool_or(ordinal > tab AND len(list_filter(cells, lambda v: regexp_matches(v, '[0-9]'))) > 0))"""


def _layout(x):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    p, q = F.col("l_partkey"), F.col("l_quantity").cast("long")
    item, value = F.concat(F.lit("item "), F.char((97 + p % 26).cast("int"))), F.when(q > 25, q.cast("string")).otherwise("none")
    text = F.when(p % 9 == 0, "plain words only").when(p % 4 == 0, F.concat_ws("   ", item, value, F.lit("x"))).when(p % 31 == 0, "a  b  c  d  e").otherwise(F.concat_ws("   ", item, value))
    return x.lineitem.select(F.col("l_orderkey").alias("doc_id"), F.row_number().over(w).cast("long").alias("ordinal"), text.alias("block_text"))


@query("SC12", f"WITH {_LAYOUT} SELECT doc_id, tab AS first_ordinal, count(*) AS n_rows, min(len(cells)) AS least_cells, max(len(cells)) AS most_cells FROM f JOIN g USING (doc_id, island) GROUP BY ALL")
def layout_table_groups(x):
    """Runs of three or more cell lines of like width with a digit below the first."""
    t = s.table_groups(_layout(x))
    return t.groupBy("doc_id", F.col("table").alias("first_ordinal")).agg(F.count("*").alias("n_rows"), F.min(F.size("cells")).cast("long").alias("least_cells"), F.max(F.size("cells")).cast("long").alias("most_cells"))


@query("SC13 R3", f"""WITH {_LAYOUT}, r AS (SELECT f.*, first_value(cells) OVER (PARTITION BY f.doc_id, tab ORDER BY ordinal) AS head FROM f JOIN g USING (doc_id, island))
SELECT doc_id, ordinal, CASE WHEN ordinal = tab THEN 'table_header' ELSE 'table_row' END AS kind, CASE WHEN ordinal = tab THEN array_to_string(cells, ' | ') ELSE array_to_string(list_transform(generate_series(1, len(cells)), lambda k: coalesce(head[k], '(no header)') || ': ' || cells[k]), '; ') END AS block_text FROM r""")
def table_rows(x):
    """Rows of layout tables as blocks that name each cell by the header of its place."""
    return s.table_row_blocks(s.table_groups(_layout(x))).select("doc_id", "ordinal", "kind", "block_text")


@query("SC16", """
WITH RECURSIVE b AS (SELECT l_orderkey AS page, CAST(l_extendedprice AS DOUBLE) AS x0, CAST(l_quantity * 4 AS DOUBLE) AS y0, CAST(l_quantity * 4 + 6 + l_partkey % 7 AS DOUBLE) AS y1, 'w' || l_partkey || '.' || l_suppkey AS t FROM lineitem),
o AS (SELECT *, (y0 + y1) / 2 AS mid, y1 - y0 AS tall, row_number() OVER (PARTITION BY page ORDER BY y0, x0, y1, t) AS n FROM b),
w(page, n, row, hm, ht, x0, t) AS (SELECT page, n, 0, mid, tall, x0, t FROM o WHERE n = 1 UNION ALL
  SELECT o.page, o.n, CASE WHEN abs(o.mid - hm) <= 0.5 * least(o.tall, ht) THEN row ELSE row + 1 END, CASE WHEN abs(o.mid - hm) <= 0.5 * least(o.tall, ht) THEN hm ELSE o.mid END, CASE WHEN abs(o.mid - hm) <= 0.5 * least(o.tall, ht) THEN ht ELSE o.tall END, o.x0, o.t FROM w JOIN o ON o.page = w.page AND o.n = w.n + 1),
l AS (SELECT page, row, string_agg(t, '    ' ORDER BY x0, n) AS line FROM w GROUP BY ALL)
SELECT page, string_agg(line, chr(10) ORDER BY row) AS text FROM l GROUP BY page""")
def spatial_text(x):
    """Recognised regions of a page as lines, from the top and from the left."""
    q, p = F.col("l_quantity"), F.col("l_partkey")
    boxes = x.lineitem.select(F.col("l_orderkey").alias("page"), F.col("l_extendedprice").cast("double").alias("x0"), (q * 4).cast("double").alias("y0"), (q * 4 + 6 + p % 7).cast("double").alias("y1"), F.col("l_extendedprice").cast("double").alias("x1"), F.concat(F.lit("w"), p.cast("string"), F.lit("."), F.col("l_suppkey").cast("string")).alias("text"))
    return s.spatial_text(boxes)


@query("SC17", """
WITH p AS (SELECT p_partkey, 100e0 + p_size * 97 AS w, 50e0 + p_partkey % 40 * 83 AS h FROM part), c AS (SELECT *, least(200 / 72e0, 4000 / w, 4000 / h, sqrt(8000000 / (w * h))) AS scale FROM p),
k AS (SELECT *, unnest(generate_series(0, 12)) AS k FROM c), f AS (SELECT p_partkey, k, CAST(ceil(w * (scale * pow(0.999e0, k))) AS BIGINT) AS width, CAST(ceil(h * (scale * pow(0.999e0, k))) AS BIGINT) AS height FROM k)
SELECT p_partkey, arg_min(width, k) AS width, arg_min(height, k) AS height FROM f WHERE width * height <= 8000000 AND greatest(width, height) <= 4000 GROUP BY p_partkey""")
def render_dimensions(x):
    """Pixels of each page: the least of four bounds, shrunk until rounding keeps to them."""
    d = s.render_dimensions(100.0 + F.col("p_size") * 97, 50.0 + F.col("p_partkey") % 40 * 83)
    return x.part.select("p_partkey", d.alias("d")).select("p_partkey", "d.width", "d.height")


@query("SC6 SC8 SC5", """
WITH b AS (SELECT c_custkey AS k, c_name AS name, c_mktsegment AS seg, c_nationkey AS n FROM customer),
e AS (SELECT k, 'html' AS form, unnest(['section_header:' || name, 'prose:about ' || seg || chr(10) || 'and more', 'definition:' || seg || '; alias: the segment', 'orphan_term:lost ' || n, 'table_header:Key | Nation', 'table_row:' || k || ' | ' || n, 'list_item:one ' || n, 'preformatted:a  b' || chr(10) || ' c']) AS block,
  generate_subscripts([1, 2, 3, 4, 5, 6, 7, 8], 1) - 1 AS ordinal FROM b
UNION ALL SELECT k, 'md', unnest(['section_header:' || name, 'prose:about ' || seg || ' and more', 'section_header:Part ' || n, 'table_header:Key | Nation', 'table_row:' || k || ' | ' || n, 'list_item:- one', 'list_item:- two ' || n, 'prose:end']), generate_subscripts([1, 2, 3, 4, 5, 6, 7, 8], 1) - 1 FROM b)
SELECT k, form, ordinal, block FROM e""")
def parsed_structures(x):
    """Pages and Markdown texts written from customers, parsed into blocks: headings, prose, definitions, tables, lists."""
    from ..sources import documents as d

    k, n, name, seg = F.col("c_custkey").cast("string"), F.col("c_nationkey").cast("string"), F.col("c_name"), F.col("c_mktsegment")
    html = F.concat(
        F.lit("<html><head><style>p{}</style></head><body><h1>"), name, F.lit("</h1><script>var a='<p>';</script><p>about  "), seg, F.lit("<br>and more</p><dl><dt>"), seg, F.lit("</dt><dt>alias</dt><dd>the segment</dd><dt>lost "), n,
        F.lit("</dt></dl><table><tr><th>Key</th><th>Nation</th></tr><tr><td>"), k, F.lit("</td><td>"), n, F.lit("</td></tr><tr><td></td></tr></table><ul><li>one "), n, F.lit("</li></ul><pre>a  b\n c</pre></body></html>"),
    )
    md = F.concat(name, F.lit("\n=====\n\nabout "), seg, F.lit(" and more\n\n## Part "), n, F.lit(" ##\n| Key | Nation |\n|:--|--:|\n| "), k, F.lit(" | "), n, F.lit(" |\n\n- one\n- two "), n, F.lit("\n\nend\n"))
    out = None
    for form, text, parser in (("html", html, d.html_blocks), ("md", md, d.markdown_blocks)):
        found = d.parsed(dealt(x.customer).select("c_custkey", text.alias("t")), "c_custkey", "t", parser).select(F.col("doc_id").alias("k"), F.lit(form).alias("form"), "ordinal", F.concat("kind", F.lit(":"), "block_text").alias("block"))
        out = found if out is None else out.unionByName(found)
    return out


@query("A14 G6 D4", """
WITH s AS (SELECT l_orderkey AS doc, CAST(l_linenumber AS BIGINT) AS section, l_partkey AS tokens FROM lineitem),
u AS (SELECT doc, unnest(list_filter([section, section // 2, section // 4], lambda v: v > 0)) AS section, section AS leaf, tokens FROM s)
SELECT doc, section, min(leaf) AS first, max(leaf) AS last, CAST(sum(tokens) AS BIGINT) AS tokens, count(*) AS n_sections FROM u GROUP BY ALL""")
def section_rollup(x):
    """Sections as a binary heap: 2 and 3 below 1, 4 and 5 below 2."""
    n = F.col("l_linenumber").cast("long")
    halves = F.array(n, F.floor(n / 2), F.floor(n / 4))
    own = x.lineitem.select(F.col("l_orderkey").alias("doc_id"), n.alias("first"), n.alias("last"), F.filter(halves, lambda v: v > 0).alias("path"), F.col("l_partkey").alias("tokens"))
    return s.section_rollup(own).withColumnRenamed("doc_id", "doc")


@query("G6 A14 D22", """
WITH RECURSIVE e AS (SELECT n_nationkey AS node, CASE WHEN n_nationkey = 0 THEN NULL ELSE (n_nationkey - 1) // 3 END AS parent FROM nation),
d AS (SELECT node AS root, node, 0 AS depth FROM e UNION ALL SELECT d.root, e.node, depth + 1 FROM d JOIN e ON e.parent = d.node)
SELECT root, CAST(count(*) AS BIGINT) AS members, CAST(max(depth) AS BIGINT) AS depth FROM d GROUP BY root""")
def section_descendants(x):
    """Members and depth of every subtree of a ternary tree, by a recursive query."""
    return x.spark.sql("""
      WITH RECURSIVE e AS (SELECT n_nationkey AS node, IF(n_nationkey = 0, NULL, (n_nationkey - 1) DIV 3) AS parent FROM {sections}),
      d AS (SELECT node AS root, CAST(node AS BIGINT) AS node, 0 AS depth FROM e UNION ALL SELECT d.root, CAST(e.node AS BIGINT), depth + 1 FROM d JOIN e ON e.parent = d.node)
      SELECT root, count(*) AS members, CAST(max(depth) AS BIGINT) AS depth FROM d GROUP BY root""", sections=x.nation)


@query("PF8", f"""WITH {_BLOCKS} SELECT q.doc_id, ordinal FROM (SELECT doc_id, doc_id % 7 AS lo, doc_id % 7 + doc_id % 5 AS hi FROM documents) q JOIN b ON b.doc_id = q.doc_id AND ordinal BETWEEN lo AND hi""")
def subtree_blocks(x):
    """Blocks of a section's interval; the document is the equi key of the range join."""
    q = x.documents.select("doc_id", (F.col("doc_id") % 7).alias("lo"), (F.col("doc_id") % 7 + F.col("doc_id") % 5).alias("hi"))
    b = s.line_blocks(x.documents).withColumn("ordinal", F.col("ordinal").cast("long"))
    return b.join(q, (b["doc_id"] == q["doc_id"]) & F.col("ordinal").between(F.col("lo"), F.col("hi"))).select(b["doc_id"], "ordinal")


@query("SC15", """
SELECT l_orderkey AS page, CAST(l_linenumber AS BIGINT) AS line, round(min(l_extendedprice) * 0.75, 4) AS x0, round(min(l_quantity) * 0.75, 4) AS y0,
  round(max(l_extendedprice + l_quantity) * 0.75, 4) AS x1, round(max(l_quantity + 10) * 0.75, 4) AS y1, count(*) AS n_words FROM lineitem GROUP BY ALL""")
def ocr_regions(x):
    w = x.lineitem.select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").cast("long").alias("line"), F.col("l_extendedprice").alias("x"), F.col("l_quantity").alias("y"), F.col("l_quantity").alias("w"), F.lit(10).alias("h"))
    return s.regions(w, 0.75)


@query("G10 G9", f"""WITH {_BLOCKS}, h AS (SELECT doc_id, ordinal FROM b WHERE regexp_matches(block_text, '[0-9]{{3}}'))
SELECT DISTINCT h.doc_id, h.ordinal AS anchor, b.ordinal FROM h JOIN b ON b.doc_id = h.doc_id AND b.ordinal BETWEEN h.ordinal - 2 AND h.ordinal + 1""")
def local_scope(x):
    """Two blocks before and one after each block with a number."""
    b = s.line_blocks(x.documents).select("doc_id", F.col("ordinal").cast("long"), F.col("block_text").rlike("[0-9]{3}").alias("hit"))
    h = b.filter("hit").select("doc_id", F.col("ordinal").alias("anchor"), F.explode(F.sequence(F.col("ordinal") - 2, F.col("ordinal") + 1)).alias("ordinal"))
    return h.join(b.select("doc_id", "ordinal"), ["doc_id", "ordinal"]).select("doc_id", "anchor", "ordinal")


@query("G11", """
WITH s AS (SELECT l_orderkey AS packet, count(*) AS n, max(l_linenumber) - min(l_linenumber) + 1 AS width, count(DISTINCT l_suppkey) AS tables FROM lineitem GROUP BY ALL)
SELECT packet, n, n <= 4 AND (width = n OR tables = 1) AS atomic FROM s""")
def atomic_spans(x):
    g = x.lineitem.groupBy(F.col("l_orderkey").alias("packet")).agg(F.count("*").alias("n"), (F.max("l_linenumber") - F.min("l_linenumber") + 1).alias("width"), F.countDistinct("l_suppkey").alias("tables"))
    return g.select("packet", "n", ((F.col("n") <= 4) & ((F.col("width") == F.col("n")) | (F.col("tables") == 1))).alias("atomic"))


@query("SC5", r"""
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), b AS (SELECT doc_id, generate_subscripts(l, 1) AS line, unnest(l) AS t FROM l),
h AS (SELECT doc_id, line, t, length(t) <= 40 AS heading FROM b)
SELECT doc_id, line, max(CASE WHEN heading THEN line END) OVER (PARTITION BY doc_id ORDER BY line) AS section_line FROM h""")
def heading_sections(x):
    """The latest heading (a line of 40 characters at most) at or above each line."""
    b = x.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "t")).withColumn("line", F.col("line").cast("long") + 1)
    w = Window.partitionBy("doc_id").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return b.select("doc_id", "line", F.max(F.when(F.char_length("t") <= 40, F.col("line"))).over(w).alias("section_line"))
