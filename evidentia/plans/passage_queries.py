"""Hybrid retrieval over passages, end to end: authorized passages, lanes, fusion, selection with neighbours, budgets, merging.

Two benchmark items are the query variants of one question, the facets of an answer are questions of a group of four
items. Passages are word windows of documents; a document is one block in the corpus's own order.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import answers as a
from ..operators import retrieval as r
from ..operators import sequential as q
from ..session import materialized
from .registry import query
from .retrieval_queries import _SCOPED, _scoped

_SIZE = 16
_PASSAGES = rf"""
w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+') AS w FROM ({_SCOPED}) q),
p AS (SELECT doc_id, w, unnest(generate_series(0, greatest(1, CAST(ceil((len(w) - 32) / 128.0) AS BIGINT)) - 1)) AS seq FROM w WHERE len(w) > 0),
pw AS (SELECT doc_id * 1048576 + seq AS key, doc_id, seq, w[seq * 128 + 1:seq * 128 + 160] AS w, array_to_string(w[seq * 128 + 1:seq * 128 + 160], ' ') AS text FROM p),
st AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM pw),
tf AS (SELECT key, term, count(*) AS tf, max(dl) AS dl FROM (SELECT key, unnest(w) AS term, len(w) AS dl FROM pw) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
qt AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+')) AS term FROM benchmark),
sc AS (SELECT query_id, key, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 9) AS score FROM qt JOIN tf USING (term) JOIN df USING (term), st GROUP BY ALL),
lex AS (SELECT query_id, key, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) AS rank FROM sc QUALIFY rank <= 128),
cnt AS (SELECT 'p' AS side, key, list_transform(generate_series(0, {_SIZE - 1}), lambda k: len(list_filter(w, lambda v: length(v) % {_SIZE} = k)) + 0.2e0) AS c FROM pw
  UNION ALL SELECT 'q', item_id, list_transform(generate_series(0, {_SIZE - 1}), lambda k: len(list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+'), lambda v: length(v) % {_SIZE} = k)) + 0.2e0) FROM benchmark),
vec AS (SELECT side, key, list_transform(c, lambda x: x / sqrt(list_sum(list_transform(c, lambda y: y * y)))) AS e FROM cnt),
den AS (SELECT a.key AS query_id, b.key, round(list_dot_product(a.e, b.e), 9) AS score FROM vec a, vec b WHERE a.side = 'q' AND b.side = 'p'),
near AS (SELECT query_id, key, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) AS rank FROM den QUALIFY rank <= 128),
f AS (SELECT coalesce(lex.query_id, near.query_id) AS query_id, coalesce(lex.key, near.key) AS key, lex.rank AS lr, near.rank AS nr, coalesce(1.0 / (60 + lex.rank), 0) + coalesce(1.0 / (60 + near.rank), 0) AS part FROM lex FULL JOIN near USING (query_id, key)),
g AS (SELECT query_id // 2 AS question, key, round(sum(part), 9) AS score, string_agg(query_id || ':' || coalesce(CAST(lr AS VARCHAR), '-') || ':' || coalesce(CAST(nr AS VARCHAR), '-'), ' ' ORDER BY query_id) AS found FROM f GROUP BY ALL)"""


def _passages(x):
    """key, doc_id, seq, text of the passages that the asker may see."""
    p = r.passages(_scoped(x))
    return p.select((F.col("doc_id") * (1 << 20) + F.col("seq")).alias("key"), "doc_id", "seq", "word_start", "word_end", F.col("passage_text").alias("text"))


def _variants(x):
    return x.benchmark.select(F.floor(F.col("item_id") / 2).alias("question"), F.col("item_id").alias("query_id"), "text")


def _search(x, passages=None):
    """Both lanes read the passages, so these are a table of their own."""
    return r.search(materialized(_passages(x), "passages") if passages is None else passages, _variants(x), r.letter_vector(_SIZE))


@query("J17 J18 J19 A6 A7 W3 U1 M4 PF1 D9", f"WITH {_PASSAGES} SELECT question, key, round(score, 6) AS score, found, row_number() OVER (PARTITION BY question ORDER BY score DESC, key) AS rank FROM g QUALIFY rank <= 32")
def passage_search(x):
    """Both lanes over authorized passages, fused over a question's variants, with the ranks that each variant gave."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    s = _search(x)
    one = F.transform("evidence", lambda e: F.concat_ws(":", e["query_id"].cast("string"), F.coalesce(e["lexical_rank"].cast("string"), F.lit("-")), F.coalesce(e["dense_rank"].cast("string"), F.lit("-"))))
    return s.select("question", "key", F.round("score", 6).alias("score"), F.array_join(one, " ").alias("found"), "rank")


def _placed(p):
    """Passages with a block of four each, a section of two blocks, and every fifth block a table's header."""
    block = F.floor(F.col("seq") / 4)
    return p.withColumns({"doc": F.col("doc_id"), "block": block, "section": F.floor(block / 2), "kind": F.when(block % 5 == 4, "table_header").otherwise("prose")})


@query("J20 W7", f"""WITH {_PASSAGES.split("st AS")[0].rstrip().rstrip(",")},
b AS (SELECT key, doc_id, seq, seq // 4 AS block, seq // 8 AS section, (seq // 4) % 5 = 4 AS header FROM pw),
e AS (SELECT doc_id, block, min(section) AS section, bool_or(header) AS header, min(key) AS first, max(key) AS last FROM b GROUP BY ALL)
SELECT b.key, array_to_string(list_filter([p.key, n.key, CASE WHEN q.section = b.section OR q.header THEN q.last END, CASE WHEN r.section = b.section OR r.header THEN r.first END], lambda v: v IS NOT NULL), ',') AS near
FROM b LEFT JOIN b p ON p.doc_id = b.doc_id AND p.block = b.block AND p.seq = b.seq - 1 LEFT JOIN b n ON n.doc_id = b.doc_id AND n.block = b.block AND n.seq = b.seq + 1
LEFT JOIN e q ON q.doc_id = b.doc_id AND q.block = b.block - 1 LEFT JOIN e r ON r.doc_id = b.doc_id AND r.block = b.block + 1""")
def neighbor_passages(x):
    """Each passage with those beside it in its block and across the block's edges."""
    out = r.neighbours(_placed(_passages(x).drop("text")), F.struct("key"))
    return out.select("key", F.array_join(F.transform("near", lambda v: v["key"].cast("string")), ",").alias("near"))


def _hits(x):
    """The hits of each question with their spans, costs and the passages next to them; facets are questions of an answer."""
    every = materialized(_passages(x), "passages")
    hits = materialized(_search(x, every).select("question", "key", "score", "rank"), "hits")
    # neighbours are of the same document, so only documents with a hit are placed
    found = hits.join(every.select("key", "doc_id"), "key").select("doc_id").distinct()
    p = _placed(every.join(found, "doc_id", "left_semi"))
    place = F.struct("doc", "block")
    row = F.struct(F.col("key").alias("passage"), F.col("doc"), place.alias("block"), F.col("word_start").alias("start"), F.col("word_end").alias("end"), "cost")
    title = x.documents.select("doc_id", F.col("source").alias("title"))
    p = p.join(title, "doc_id").withColumn("cost", t.passage_cost(F.col("text"), F.col("title"), F.concat(F.lit("words "), F.col("word_start").cast("string")), F.array().cast("array<string>"))).drop("text", "title")
    return hits.join(r.neighbours(p, row), "key").select(
        F.floor(F.col("question") / 4).alias("answer"), F.col("question").alias("facet"), "rank", "score", F.col("key").alias("passage"), "doc", place.alias("block"),
        F.col("word_start").alias("start"), F.col("word_end").alias("end"), "cost", "near",
    )


@query("G1 W4 W5 A13 J20 F24")
def greedy_select(x):
    """Evidence for answers of four facets out of their hits: facet first, diversity, neighbours, the rest of the budget."""
    return q.greedy_select(_hits(x), "answer", 4000)


@query("F22 F23 F21", r"""
WITH t AS (SELECT doc_id, text, '["' || source || '", "words ' || CAST(doc_id AS VARCHAR) || '", []]' AS j FROM documents),
p AS (SELECT doc_id, 0 AS part, unnest(regexp_extract_all(text, '[A-Za-z0-9]+|[ \t\n\r\f\x0B]+|[^A-Za-z0-9 \t\n\r\f\x0B]+')) AS p FROM t UNION ALL SELECT doc_id, 1, unnest(regexp_extract_all(j, '[A-Za-z0-9]+|[ \t\n\r\f\x0B]+|[^A-Za-z0-9 \t\n\r\f\x0B]+')) FROM t),
c AS (SELECT doc_id, part, CASE WHEN regexp_matches(p, '^[A-Za-z0-9]') THEN CASE WHEN regexp_matches(p, '[0-9]') THEN length(p) ELSE CAST(ceil(length(p) / 4.0) AS BIGINT) END
   WHEN regexp_matches(p, '^[ \t\n\r\f\x0B]') THEN greatest(1, CAST(ceil(strlen(p) / 4.0) AS BIGINT)) ELSE strlen(p) END AS c FROM p)
SELECT t.doc_id, CAST(32 + coalesce(sum(c), 0) AS BIGINT) AS passage_cost, CAST(128 + coalesce(sum(c) FILTER (part = 0), 0) + 32 AS BIGINT) AS block_cost FROM t LEFT JOIN c USING (doc_id) GROUP BY t.doc_id""")
def evidence_costs(x):
    """What a text costs as a passage (with its title, place and headers as JSON) and as a block of a request."""
    place = F.concat(F.lit("words "), F.col("doc_id").cast("string"))
    return x.documents.select("doc_id", t.passage_cost(F.col("text"), F.col("source"), place, F.array().cast("array<string>")).alias("passage_cost"), (128 + t.conservative_tokens(F.col("text")) + 32).alias("block_cost"))


@query("F24 J23", """
WITH m AS (SELECT conv_id, unnest(regexp_extract_all(text, '[A-Za-z0-9]+|[ \\t\\n\\r\\f\\x0B]+|[^A-Za-z0-9 \\t\\n\\r\\f\\x0B]+')) AS p FROM conversations),
c AS (SELECT conv_id, sum(CASE WHEN regexp_matches(p, '^[A-Za-z0-9]') THEN CASE WHEN regexp_matches(p, '[0-9]') THEN length(p) ELSE CAST(ceil(length(p) / 4.0) AS BIGINT) END
   WHEN regexp_matches(p, '^[ \\t\\n\\r\\f\\x0B]') THEN greatest(1, CAST(ceil(strlen(p) / 4.0) AS BIGINT)) ELSE strlen(p) END) AS n FROM m GROUP BY conv_id)
SELECT v.conv_id, CAST(128 + coalesce(n, 0) + 6 + 640 + 512 AS BIGINT) AS cost, 128 + coalesce(n, 0) + 6 + 640 + 512 <= 2048 AS admitted FROM (SELECT DISTINCT conv_id FROM conversations) v LEFT JOIN c USING (conv_id)""")
def request_budgets(x):
    """Whether a conversation fits a request: messages, an answer's schema, the output and its reserves within the context."""
    schema = F.lit('{"a":{}}')
    cost = x.conversations.groupBy("conv_id").agg(F.sum(t.conservative_tokens(F.col("text"))).alias("n"))
    total = (128 + F.col("n") + t.conservative_tokens(schema) - 2 + 640 + 512).cast("long")
    return cost.select("conv_id", total.alias("cost"), (total <= 2048).alias("admitted"))


_MERGE = """
WITH RECURSIVE c AS (SELECT l_orderkey AS q, l_partkey % 50 AS span, min(l_linenumber * 1000 + 20 + CAST(l_quantity AS BIGINT)) AS v FROM lineitem GROUP BY ALL),
k AS (SELECT q, span, v // 1000 <= 2 AS prior, v % 1000 AS cost, row_number() OVER (PARTITION BY q ORDER BY v // 1000 > 2, v // 1000, span) AS n FROM c),
w(q, n, span, used, kept, taken, prior) AS (
  SELECT DISTINCT q, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), false, false FROM k
  UNION ALL SELECT k.q, k.n, k.span, CASE WHEN k.prior OR (kept < 4 AND used + cost <= 150) THEN used + cost ELSE used END, CASE WHEN k.prior OR (kept < 4 AND used + cost <= 150) THEN kept + 1 ELSE kept END,
    k.prior OR (kept < 4 AND used + cost <= 150), k.prior FROM w JOIN k ON k.q = w.q AND k.n = w.n + 1)
SELECT q, span, 'P' || CAST(kept AS VARCHAR) AS alias, prior, used FROM w WHERE taken"""


@query("S6 A34", _MERGE)
def merge_evidence(x):
    """Prior evidence stays; spans not seen before follow while they fit the budget and the limit, each with a fresh alias."""
    c = x.lineitem.select(F.col("l_orderkey").alias("q"), F.col("l_linenumber").alias("pos"), (F.col("l_partkey") % 50).alias("span"), (F.col("l_linenumber") <= 2).alias("prior"), (20 + F.col("l_quantity").cast("long")).alias("cost"))
    return a.merged_evidence(c, "q", "pos", "span", budget=150, most=4).select("q", "span", "alias", "prior", "used")
