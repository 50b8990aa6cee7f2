"""Queries over releases, requests, generations and Word files, made of the tables' own values."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import spans
from ..functions import text as t
from ..session import shared_dir
from ..sources import documents as docs
from ..sources import generations as g
from ..sources import office
from .registry import dealt, query


@query("SK7 F31", "WITH c AS (SELECT doc_id, text || CASE doc_id % 6 WHEN 0 THEN ' see /home/ann/x' WHEN 1 THEN ' http://u:pw@host/' WHEN 2 THEN ' Bearer abcdefghij0123456789' ELSE '' END AS t FROM documents WHERE text IS NOT NULL)\nSELECT doc_id, concat_ws(',', " + ", ".join(f"CASE WHEN regexp_matches(t, '{p.replace(chr(39), chr(39) * 2)}') THEN '{k}' END" for k, p in t.CREDENTIALS.items()) + ") AS kinds FROM c")
def credential_kinds(x):
    """Which kinds of credentials and private paths a text would carry into a release."""
    k = F.col("doc_id") % 6
    more = F.when(k == 0, " see /home/ann/x").when(k == 1, " http://u:pw@host/").when(k == 2, " Bearer abcdefghij0123456789").otherwise("")
    return x.documents.filter("text is not null").select("doc_id", t.credential_kinds(F.concat("text", more)).alias("kinds"))


@query("C8 SK7", r"""
WITH p AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'src/' WHEN 1 THEN '.git/' WHEN 2 THEN 'a/../' WHEN 3 THEN '/abs/' ELSE 'docs/deep/' END || replace(p_name, ' ', '_') || CASE p_size % 4 WHEN 0 THEN '.py' WHEN 1 THEN '.md' WHEN 2 THEN '.exe' ELSE '' END AS path FROM part)
SELECT p_partkey, path, NOT starts_with(path, '/') AND len(list_filter(string_split(path, '/'), lambda v: v IN ('', '..', '.git', '__pycache__', '.env', 'secrets', 'node_modules'))) = 0 AND regexp_extract(path, '\.([A-Za-z0-9]+)$', 1) IN ('py', 'md', 'json', 'txt', 'toml') AS released FROM p""")
def release_paths(x):
    """Which paths may go into a release."""
    k, n = F.col("p_partkey") % 5, F.col("p_size") % 4
    lead = F.when(k == 0, "src/").when(k == 1, ".git/").when(k == 2, "a/../").when(k == 3, "/abs/").otherwise("docs/deep/")
    path = F.concat(lead, F.replace("p_name", F.lit(" "), F.lit("_")), F.when(n == 0, ".py").when(n == 1, ".md").when(n == 2, ".exe").otherwise(""))
    return x.part.select("p_partkey", path.alias("path"), t.releasable(path).alias("released"))


@query("PF16", r"""
WITH r AS (SELECT conv_id, turn, CASE conv_id % 5 WHEN 0 THEN 'run:' || conv_id WHEN 1 THEN '-bad' ELSE 'r' || conv_id END AS id, CASE turn % 3 WHEN 0 THEN 'auto' WHEN 1 THEN 'deep' ELSE 'overview' END AS mode, text, CAST(turn AS BIGINT) * 3 - 2 AS most FROM conversations),
v AS (SELECT conv_id, turn, unnest(list_filter([CASE WHEN NOT regexp_matches(id, '^[A-Za-z0-9][A-Za-z0-9_.:-]{0,159}$') THEN 'id' END, CASE WHEN mode NOT IN ('auto', 'targeted', 'overview', 'exhaustive') THEN 'mode' END,
  CASE WHEN text IS NULL OR length(text) NOT BETWEEN 1 AND 400 THEN 'question' END, CASE WHEN most NOT BETWEEN 1 AND 512 THEN 'limit' END], lambda e: e IS NOT NULL)) AS issue FROM r)
SELECT conv_id, turn, issue FROM v""")
def request_rejects(x):
    """Why requests are refused: identifiers, modes, lengths and limits, a row for each violation."""
    k, n = F.col("conv_id"), F.col("turn")
    ident = F.when(k % 5 == 0, F.concat(F.lit("run:"), k.cast("string"))).when(k % 5 == 1, "-bad").otherwise(F.concat(F.lit("r"), k.cast("string")))
    mode = F.when(n % 3 == 0, "auto").when(n % 3 == 1, "deep").otherwise("overview")
    length = F.char_length("text")
    checks = [
        F.when(~ident.rlike(r"^[A-Za-z0-9][A-Za-z0-9_.:-]{0,159}$"), "id"), F.when(~mode.isin("auto", "targeted", "overview", "exhaustive"), "mode"),
        F.when(F.col("text").isNull() | ~length.between(1, 400), "question"), F.when(~(n.cast("long") * 3 - 2).between(1, 512), "limit"),
    ]
    return x.conversations.select("conv_id", "turn", F.explode(F.filter(F.array(*checks), lambda e: e.isNotNull())).alias("issue"))


@query("G9 C32", """
WITH b AS (SELECT l_orderkey AS doc, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS block, l_quantity FROM lineitem),
s AS (SELECT *, block // 4 AS section, count(*) OVER (PARTITION BY doc, block // 4) AS size FROM b), a AS (SELECT doc, block AS anchor, section, size FROM s WHERE l_quantity > 45)
SELECT a.doc, anchor, s.block FROM a JOIN s ON s.doc = a.doc AND s.section = a.section AND (a.size <= 3 OR abs(s.block - anchor) <= 2)""")
def revisit_windows(x):
    """What is read again around an anchor: its whole section if that is short, else two blocks to either side in it."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    b = x.lineitem.select(F.col("l_orderkey").alias("doc"), F.row_number().over(w).cast("long").alias("block"), "l_quantity").withColumn("section", F.floor(F.col("block") / 4))
    own = Window.partitionBy("doc", "section").orderBy("block")
    near = F.when(F.count("*").over(Window.partitionBy("doc", "section")) <= 3, F.collect_list("block").over(own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).otherwise(F.collect_list("block").over(own.rowsBetween(-2, 2)))
    return b.withColumn("near", near).filter("l_quantity > 45").select("doc", F.col("block").alias("anchor"), F.explode("near").alias("block"))


@query("F18", r"""
SELECT doc_id, length(regexp_extract(substr(text, 1, length(text) // 2) || ' ', '(?s)^(.*[.!?]["'')\]]*)[ \t\n\r\f\x0B]', 1)) AS kept FROM documents WHERE text IS NOT NULL""")
def complete_parts(x):
    """How much of a text that breaks off in the middle ends with a sentence."""
    half = F.substring("text", F.lit(1), F.floor(F.char_length("text") / 2).cast("int"))
    return x.documents.filter("text is not null").select("doc_id", F.char_length(spans.applied(spans.complete_part, "string", half)).cast("long").alias("kept"))


@query("F19", """
SELECT o_orderkey, 'so ' || CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE '[S' || (1 + o_orderkey % 2) || ']' END || CASE WHEN o_custkey % 2 = 0 AND NOT (o_orderkey % 3 <> 0 AND o_orderkey % 2 = 1) THEN '[S2]' ELSE '' END || ' it is.' AS shown FROM orders""")
def expanded_markers(x):
    """Markers of a draft as the labels that readers see, once each; a marker without a known source goes."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    one = F.when(k % 3 == 0, "zz").when(k % 2 == 0, "a").otherwise("b")
    text = F.concat(F.lit("so [E:"), one, F.when(c % 2 == 0, ", C2").otherwise(""), F.lit("] it is."))
    return x.orders.select("o_orderkey", spans.applied(lambda v: spans.expand_markers(v, {"a": ["S1"], "b": ["S2"], "C2": ["S2"]}), "string", text).alias("shown"))


@query("SK2 SK8", "SELECT n_nationkey, 'third' AS generation FROM nation WHERE n_regionkey < 3")
def current_generation(x):
    """Three generations published one after the other, one step back and forth again: readers see the last pointer's."""
    root = f"{shared_dir(x.spark)}/generations-{uuid.uuid4().hex}"
    rows = lambda name, most: x.nation.filter(F.col("n_regionkey") < most).select("n_nationkey", F.lit(name).alias("generation"))
    for name, most in (("first", 1), ("second", 2), ("third", 3)):
        g.publish(rows(name, most).withColumnRenamed("generation", "name"), root, name)
    g.rolled_back(x.spark, root)
    g.rolled_back(x.spark, root)
    return g.current(x.spark, root).select("n_nationkey", F.col("name").alias("generation"))


@query("SC9 SC10", """
WITH b AS (SELECT c_custkey AS k, c_name AS name, c_mktsegment AS seg, c_nationkey AS n FROM customer)
SELECT k, unnest(['section_header:' || name, 'prose:about ' || seg, 'list_item:one ' || n, 'table_header:Key | Nation', 'table_row:' || k || ' | ' || n, 'table_row: | more', 'footnote:see ' || seg]) AS block, generate_subscripts([1, 2, 3, 4, 5, 6, 7], 1) - 1 AS ordinal FROM b""")
def word_documents(x):
    """Word files written from customers and parsed again: headings by style, lists, merged cells, footnotes."""

    def write(text):
        import io
        import zipfile

        k, name, seg, n = text.split("\t")
        ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
        p = lambda body, style="": f"<w:p>{style}<w:r><w:t>{body}</w:t></w:r></w:p>"
        cell = lambda body, merged="": f"<w:tc><w:tcPr>{merged}</w:tcPr>{p(body)}</w:tc>"
        again, first = "<w:vMerge/>", '<w:vMerge w:val="restart"/>'
        rows = [cell("Key") + cell("Nation"), cell(k, first) + cell(n), cell("", again) + cell("more")]
        heading, item = '<w:pPr><w:pStyle w:val="Heading1"/></w:pPr>', "<w:pPr><w:numPr/></w:pPr>"
        body = p(name, heading) + p(f"about {seg}") + p(f"one {n}", item) + "<w:tbl>" + "".join(f"<w:tr>{r}</w:tr>" for r in rows) + "</w:tbl>"
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr("word/document.xml", f"<w:document {ns}><w:body>{body}</w:body></w:document>")
            z.writestr("word/footnotes.xml", f'<w:footnotes {ns}><w:footnote w:id="1">{p(f"see {seg}")}</w:footnote></w:footnotes>')
        return office.docx_blocks(out.getvalue())

    line = F.concat_ws("\t", F.col("c_custkey").cast("string"), "c_name", "c_mktsegment", F.col("c_nationkey").cast("string"))
    found = docs.parsed(dealt(x.customer).select("c_custkey", line.alias("t")), "c_custkey", "t", write)
    return found.select(F.col("doc_id").alias("k"), F.concat("kind", F.lit(":"), "block_text").alias("block"), "ordinal")
