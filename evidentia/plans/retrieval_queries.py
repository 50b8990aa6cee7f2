"""Queries over retrieval operators. Every benchmark item, whole, is a query; documents are the corpus."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import retrieval as r
from .registry import query

#: The bm25 lane in SQL; {docs} is the corpus that statistics are taken from.
_BM25 = r"""
tok AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+')) AS term FROM ({docs}) q),
tf AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY ALL),
dl AS (SELECT d.doc_id, len(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+')) AS dl FROM ({docs}) d),
st AS (SELECT count(*) AS n, coalesce(nullif(avg(dl), 0), 1) AS avgdl FROM dl),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
qt AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+')) AS term FROM benchmark),
sc AS (SELECT query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 9) AS score
  FROM qt JOIN tf USING (term) JOIN df USING (term) JOIN dl USING (doc_id), st GROUP BY ALL),
lex AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM sc QUALIFY rank <= 128)"""
_ALL = "SELECT doc_id, text FROM documents"
#: Documents that a grant of the fixture allows: source and language are the granted scopes.
_SCOPED = "SELECT doc_id, text FROM documents WHERE lang IN ('en', 'fr') AND source NOT IN ('src3', 'src7')"


def _queries(x):
    return x.benchmark.select(F.col("item_id").alias("query_id"), "text")


def _scoped(x):
    granted = x.documents.filter(F.col("lang").isin("en", "fr")).select("doc_id").distinct()
    denied = x.documents.filter(F.col("source").isin("src3", "src7")).select("doc_id").distinct()
    return x.documents.join(granted, "doc_id", "left_semi").join(denied, "doc_id", "left_anti")


def _shown(lane):
    return lane.select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@query("J17 A2 A4 A5 W1 M1 M2 C5 D11", f"WITH {_BM25.format(docs=_ALL)} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM lex")
def bm25_topk(x):
    return _shown(r.bm25(x.documents, _queries(x)))


@query("PF1 A3 A4 J5", f"WITH {_BM25.format(docs=_SCOPED)} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM lex")
def bm25_topk_scoped(x):
    """Statistics and ranks within the authorized documents only."""
    return _shown(r.bm25(_scoped(x), _queries(x)))


_DENSE = """
dense AS (SELECT q.vec_id AS query_id, e.vec_id, round(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 9) AS score FROM embeddings q, embeddings e WHERE {where}),
lane AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM dense QUALIFY rank <= 128)"""


def _vector_queries(x):
    return x.embeddings.select(F.col("vec_id").alias("query_id"), "embedding")


@query("J18 M3 W2 D10", f"WITH {_DENSE.format(where='q.vec_id % 20 = 0')} SELECT query_id, vec_id, round(score, 6) AS score, rank FROM lane")
def dense_topk(x):
    """The stated query set, ids divisible by 20, against all vectors."""
    out = r.dense(x.embeddings, _vector_queries(x).filter("query_id % 20 = 0"))
    return out.select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


@query("PF22", """
SELECT vec_id, len(embedding) = 64 AS shape_ok, abs(sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda v: v * v))) - 1) <= 0.002 AS norm_ok,
  round(list_max(list_transform(CAST(embedding AS DOUBLE[]), lambda v: abs(v))), 6) AS top FROM embeddings""")
def embedding_checks(x):
    e = x.embeddings.withColumn("e", F.col("embedding").cast("array<double>"))
    norm = F.sqrt(F.aggregate("e", F.lit(0.0), lambda a, v: a + v * v))
    return e.select("vec_id", (F.size("e") == 64).alias("shape_ok"), (F.abs(norm - 1) <= 0.002).alias("norm_ok"), F.round(F.array_max(F.transform("e", F.abs)), 6).alias("top"))


@query("J19 A6 A7 W3", f"""WITH {_BM25.format(docs=_ALL)}, {_DENSE.format(where='q.vec_id IN (SELECT item_id FROM benchmark)')},
f AS (SELECT query_id, key, round(sum(1.0 / (60 + rank)), 9) AS score, count(*) AS n_lanes FROM (SELECT query_id, doc_id AS key, rank FROM lex UNION ALL SELECT query_id, vec_id, rank FROM lane) GROUP BY ALL)
SELECT query_id, key, round(score, 6) AS score, n_lanes, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) AS rank FROM f QUALIFY rank <= 128""")
def rrf_fusion(x):
    """Both lanes of every benchmark item; its vector is the one with its id."""
    lexical = r.bm25(x.documents, _queries(x)).select("query_id", F.col("doc_id").alias("key"), "rank")
    asked = _vector_queries(x).join(_queries(x).select("query_id"), "query_id", "left_semi")
    near = r.dense(x.embeddings, asked).select("query_id", F.col("vec_id").alias("key"), "rank")
    out = r.fuse([lexical, near])
    return out.select("query_id", "key", F.round("score", 6).alias("score"), "n_lanes", "rank")


@query("W5", f"""WITH {_DENSE.format(where='q.vec_id % 20 = 0')},
h AS (SELECT query_id, vec_id, score, lane.rank, label, row_number() OVER (PARTITION BY query_id, label ORDER BY lane.rank) - 1 AS nth FROM lane JOIN embeddings USING (vec_id)),
a AS (SELECT *, round(score / (1 + 0.12 * nth), 9) AS adjusted FROM h)
SELECT query_id, vec_id, CAST(label AS BIGINT) AS label, round(adjusted, 6) AS adjusted, nth = 0 AS first_of_label, row_number() OVER (PARTITION BY query_id ORDER BY adjusted DESC, rank) AS new_rank FROM a""")
def diversity_static(x):
    hits = r.dense(x.embeddings, _vector_queries(x).filter("query_id % 20 = 0")).join(x.embeddings.select("vec_id", "label"), "vec_id")
    first = F.row_number().over(Window.partitionBy("query_id", "label").orderBy("rank")) == 1
    out = r.diversified(hits.withColumn("first_of_label", first), "label")
    return out.select("query_id", "vec_id", F.col("label").cast("long"), F.round("adjusted", 6).alias("adjusted"), "first_of_label", "new_rank")


_WINDOWS = r"""
w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(generate_series(0, greatest(1, CAST(ceil((len(w) - 32) / 128.0) AS BIGINT)) - 1)) AS seq FROM w WHERE len(w) > 0),
pw AS (SELECT doc_id, seq, seq * 128 AS word_start, least(seq * 128 + 160, len(w)) AS word_end, array_to_string(w[seq * 128 + 1:seq * 128 + 160], ' ') AS passage_text FROM p)"""


@query("F26 D9", f"WITH {_WINDOWS} SELECT doc_id, seq, word_start, word_end, sha256(passage_text) AS text_sha256 FROM pw")
def passage_windows(x):
    return r.passages(x.documents).select("doc_id", "seq", "word_start", "word_end", F.sha2(F.col("passage_text").cast("binary"), 256).alias("text_sha256"))


@query("W7", f"WITH {_WINDOWS} SELECT doc_id, seq, lag(seq) OVER d AS previous_seq, lead(seq) OVER d AS next_seq, word_start < coalesce(lag(word_end) OVER d, 0) AS overlaps FROM pw WINDOW d AS (PARTITION BY doc_id ORDER BY seq)")
def neighbor_context(x):
    d = Window.partitionBy("doc_id").orderBy("seq")
    return r.passages(x.documents).select("doc_id", "seq", F.lag("seq").over(d).alias("previous_seq"), F.lead("seq").over(d).alias("next_seq"), (F.col("word_start") < F.coalesce(F.lag("word_end").over(d), F.lit(0))).alias("overlaps"))


_SPANS = "s AS (SELECT l_orderkey AS block, l_linenumber * 10 + CAST(l_quantity AS BIGINT) % 10 AS s, l_linenumber * 10 + CAST(l_quantity AS BIGINT) % 10 + 5 + CAST(l_quantity AS BIGINT) AS e FROM lineitem)"


def _spans(x):
    start = F.col("l_linenumber") * 10 + F.col("l_quantity").cast("long") % 10
    return x.lineitem.select(F.col("l_orderkey").alias("block"), start.cast("long").alias("start"), (start + 5 + F.col("l_quantity").cast("long")).alias("end"))


@query("J21", f"""WITH {_SPANS}
SELECT DISTINCT a.block, a.s AS a_start, a.e AS a_end, b.s AS b_start, b.e AS b_end, greatest(0, least(a.e, b.e) - greatest(a.s, b.s)) AS shared
FROM s a JOIN s b ON a.block = b.block AND (a.s < b.s OR (a.s = b.s AND a.e < b.e)) WHERE greatest(0, least(a.e, b.e) - greatest(a.s, b.s)) >= 0.65 * least(a.e - a.s, b.e - b.s)""")
def overlap_dedup(x):
    return r.overlapping(_spans(x))


@query("W6", """
WITH m AS (SELECT o_custkey AS doc, o_orderkey % 7 AS bundle, o_orderkey AS sel_pos FROM orders),
p AS (SELECT *, min(sel_pos) OVER (PARTITION BY doc, bundle) AS first_pos FROM m)
SELECT doc, bundle, sel_pos, row_number() OVER (PARTITION BY doc ORDER BY first_pos, sel_pos) AS shown FROM p""")
def bundle_order(x):
    m = x.orders.select(F.col("o_custkey").alias("doc"), (F.col("o_orderkey") % 7).alias("bundle"), F.col("o_orderkey").alias("sel_pos"))
    p = m.withColumn("first_pos", F.min("sel_pos").over(Window.partitionBy("doc", "bundle")))
    return p.select("doc", "bundle", "sel_pos", F.row_number().over(Window.partitionBy("doc").orderBy("first_pos", "sel_pos")).cast("long").alias("shown"))


@query("W22 A36", """
SELECT l_orderkey, l_linenumber, running FROM (SELECT l_orderkey, l_linenumber, CAST(sum(32 + CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running FROM lineitem) WHERE running <= 200""")
def prefix_fit(x):
    rows = x.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", (32 + F.col("l_quantity").cast("long")).alias("cost"))
    return r.fitting_prefix(rows, "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity"], "cost", 200).select("l_orderkey", "l_linenumber", "running")


_MATCH = r"SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents"
_TOKENS = ["the", "of", "that"]


@query("PF9 J4", f"WITH w AS ({_MATCH}) SELECT doc_id, CAST(3 AS BIGINT) AS n_matched FROM w WHERE list_has_all(w, ['the', 'of', 'that'])")
def discover_all(x):
    return r.match_documents(x.documents, _TOKENS, "all")


@query("PF9", f"WITH w AS ({_MATCH}) SELECT doc_id, CAST(len(list_intersect(w, ['the', 'of', 'that'])) AS BIGINT) AS n_matched FROM w WHERE list_has_any(w, ['the', 'of', 'that'])")
def discover_any(x):
    return r.match_documents(x.documents, _TOKENS, "any")


@query("PF9 PF10", f"WITH w AS ({_MATCH}) SELECT doc_id, CAST(2 AS BIGINT) AS n_matched FROM w WHERE contains(' ' || array_to_string(w, ' ') || ' ', ' of the ')")
def discover_phrase(x):
    return r.match_documents(x.documents, ["of", "the"], "phrase")


@query("W13 A9 J3", f"""WITH w AS ({_MATCH}), m AS (SELECT doc_id FROM w WHERE list_has_all(w, ['the', 'of', 'that'])),
n AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS rn, count(*) OVER () AS total FROM m)
SELECT doc_id, rn, total, CASE WHEN total > 20 THEN 20 END AS next_offset, total <= 20 AS exhausted FROM n WHERE rn BETWEEN 11 AND 20""")
def discover_page(x):
    """A page of a match: rows 11 to 20 by id (the paging feature itself), with the total."""
    m = r.match_documents(x.documents, _TOKENS, "all").select("doc_id")
    total = m.agg(F.count("*").alias("total"))
    page = m.orderBy("doc_id").offset(10).limit(10)
    n = page.withColumn("rn", F.row_number().over(Window.orderBy("doc_id")).cast("long") + 10).join(total)
    return n.select("doc_id", "rn", "total", F.when(F.col("total") > 20, F.lit(20)).alias("next_offset"), (F.col("total") <= 20).alias("exhausted"))


@query("S2 J3", r"""
SELECT doc_id, 'email' AS kind FROM documents WHERE regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}') UNION SELECT doc_id, 'phrase' FROM documents WHERE contains(lower(text), ' of the ')""")
def exact_union_matches(x):
    a = x.documents.filter(F.col("text").rlike(t.SURFACES["email"])).select("doc_id", F.lit("email").alias("kind"))
    return a.union(x.documents.filter(F.contains(F.lower("text"), F.lit(" of the "))).select("doc_id", F.lit("phrase").alias("kind"))).distinct()


@query("A19 A11", r"""
WITH s AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '[0-9]+(?:[.,][0-9]+)*')) AS s FROM documents), d AS (SELECT doc_id, s, count(*) OVER (PARTITION BY s) AS df FROM s)
SELECT doc_id, round(sum(1.0 / df), 6) AS specificity, count(*) AS surfaces FROM d GROUP BY doc_id""")
def specificity(x):
    s = x.documents.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(t.SURFACES["number"]), F.lit(0)))).alias("s"))
    df = s.groupBy("s").agg(F.count("*").alias("df"))
    return s.join(df, "s").groupBy("doc_id").agg(F.round(F.sum(1.0 / F.col("df")), 6).alias("specificity"), F.count("*").alias("surfaces"))


@query("A20", r"""
WITH t AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS w FROM documents), n AS (SELECT count(*) AS n FROM documents),
d AS (SELECT w, count(*) AS df FROM t GROUP BY w), k AS (SELECT doc_id, df, row_number() OVER (PARTITION BY doc_id ORDER BY df, w) AS rn FROM t JOIN d USING (w))
SELECT doc_id, round(sum(1.0 / df - 1.0 / n), 6) AS weight FROM k, n WHERE rn <= 8 GROUP BY doc_id""")
def navigation_weight(x):
    """The sum over each document's eight rarest words of 1/df - 1/N."""
    w = x.documents.select("doc_id", F.explode(F.array_distinct(t.words(F.col("text")))).alias("w"))
    df = w.groupBy("w").agg(F.count("*").alias("df"))
    k = w.join(df, "w").withColumn("rn", F.row_number().over(Window.partitionBy("doc_id").orderBy("df", "w"))).filter("rn <= 8")
    return k.join(x.documents.agg(F.count("*").alias("n"))).groupBy("doc_id").agg(F.round(F.sum(1.0 / F.col("df") - 1.0 / F.col("n")), 6).alias("weight"))


@query("A22 A23", r"""
WITH b AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM documents), sig AS (SELECT DISTINCT w FROM b), s AS (SELECT count(*) AS s FROM sig),
f AS (SELECT t, count(*) AS f FROM (SELECT DISTINCT w, unnest(list_distinct(w)) AS t FROM sig) GROUP BY t),
q AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS t FROM benchmark),
m AS (SELECT doc_id, len(w) AS n, unnest(list_distinct(w)) AS t FROM b)
SELECT doc_id, round(sum(ln(1 + s / (1.0 + f))) / sqrt(1 + max(n) / 80.0), 6) AS score FROM m JOIN q USING (t) JOIN f USING (t), s GROUP BY doc_id""")
def signature_scores(x):
    """Term frequencies over distinct token sequences, so that copies count once."""
    b = x.documents.select("doc_id", t.words(F.col("text")).alias("w"))
    sig = b.withColumn("h", F.sha2(F.array_join("w", " ").cast("binary"), 256)).groupBy("h").agg(F.any_value("w").alias("w"))
    f = sig.select(F.explode(F.array_distinct("w")).alias("t")).groupBy("t").agg(F.count("*").alias("f"))
    asked = x.benchmark.select(F.explode(t.words(F.col("text"))).alias("t")).distinct()
    m = b.select("doc_id", F.size("w").alias("n"), F.explode(F.array_distinct("w")).alias("t")).join(asked, "t", "left_semi")
    part = F.log(1 + F.col("s") / (1.0 + F.col("f")))
    return m.join(f, "t").join(sig.agg(F.count("*").alias("s"))).groupBy("doc_id").agg(F.round(F.sum(part) / F.sqrt(1 + F.max("n") / 80.0), 6).alias("score"))


@query("W20", """
WITH p AS (SELECT l_suppkey AS doc, l_orderkey * 10 + l_linenumber AS packet FROM lineitem), n AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY packet) AS turn FROM p)
SELECT doc, packet, turn FROM n WHERE turn <= 25""")
def fair_round_robin(x):
    """Turn of each packet when no document gets a second one before all have had a first; 25 turns."""
    p = x.lineitem.select(F.col("l_suppkey").alias("doc"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("packet"))
    n = p.withColumn("turn", F.row_number().over(Window.partitionBy("doc").orderBy("packet")).cast("long"))
    return n.filter("turn <= 25")


@query("A21 W25 G17", r"""
WITH t AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS w FROM benchmark),
d AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS w FROM documents), f AS (SELECT w, count(*) AS df FROM d GROUP BY w),
k AS (SELECT item_id, w, df, row_number() OVER (PARTITION BY item_id ORDER BY df, length(w) DESC, w) AS rn FROM t JOIN f USING (w))
SELECT item_id, w AS literal, df, rn FROM k WHERE rn <= 2""")
def literal_candidates(x):
    """The two rarest words of each item that the corpus has."""
    asked = x.benchmark.select("item_id", F.explode(F.array_distinct(t.words(F.col("text")))).alias("w"))
    own = x.documents.select("doc_id", F.explode(F.array_distinct(t.words(F.col("text")))).alias("w")).join(asked.select("w").distinct(), "w", "left_semi")
    df = own.groupBy("w").agg(F.count("*").alias("df"))
    k = asked.join(df, "w").withColumn("rn", F.row_number().over(Window.partitionBy("item_id").orderBy("df", F.desc(F.length("w")), "w")).cast("long"))
    return k.filter("rn <= 2").select("item_id", F.col("w").alias("literal"), "df", "rn")
