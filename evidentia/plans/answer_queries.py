"""Queries over drafts and answers. Orders are drafts, lineitems claims, suppliers sources, parts facets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import answers as a
from .registry import query


def _claims(x):
    own = F.array("l_suppkey", F.col("l_suppkey") + 3, F.when(F.col("l_quantity") > 25, F.col("l_suppkey") + 90))
    return x.lineitem.select(
        F.col("l_orderkey").alias("draft"), F.concat(F.lit("C"), F.col("l_linenumber").cast("string")).alias("claim_id"), (F.col("l_partkey") % 40).alias("facet"),
        F.filter(own, lambda v: v.isNotNull() & (F.col("l_quantity") > 2)).alias("sources"),
    )


@query("K4 J23 A37", """
WITH c AS (SELECT l_orderkey AS draft, 'C' || CAST(l_linenumber AS VARCHAR) AS claim_id, CAST(l_partkey % 40 AS BIGINT) AS facet, l_suppkey, l_quantity FROM lineitem),
s AS (SELECT *, list_filter([l_suppkey, l_suppkey + 3, CASE WHEN l_quantity > 25 THEN l_suppkey + 90 END], lambda v: v IS NOT NULL AND l_quantity > 2) AS sources, count(*) OVER (PARTITION BY draft, claim_id) AS copies FROM c),
bad AS (SELECT DISTINCT draft, claim_id FROM (SELECT draft, claim_id, unnest(sources) AS source FROM s) q WHERE source NOT IN (SELECT l_suppkey FROM lineitem l WHERE l.l_orderkey = q.draft) AND source NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 2 = 0)),
v AS (SELECT s.draft, s.claim_id, CASE WHEN copies > 1 THEN 'duplicate' WHEN NOT len(sources) BETWEEN 1 AND 6 THEN 'source count' WHEN facet >= 35 THEN 'unknown facet' WHEN bad.draft IS NOT NULL THEN 'unknown source' ELSE 'ok' END AS verdict FROM s LEFT JOIN bad USING (draft, claim_id))
SELECT draft, verdict, count(*) AS n FROM v GROUP BY ALL""")
def claim_rejects(x):
    """Evidence of a draft: the suppliers of its own lines, and the even-numbered ones."""
    drafts = x.lineitem.select(F.col("l_orderkey").alias("draft"), F.col("l_suppkey").alias("source"))
    even = x.supplier.filter("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("source"))
    # shared sources count for every draft, so they are told apart before the join instead of multiplied by the drafts
    claims = _claims(x)
    shared = claims.select("draft", F.explode("sources").alias("source")).join(even, "source", "left_semi")
    facets = x.part.select((F.col("p_partkey") % 40).alias("facet")).filter("facet < 35")
    v = a.claim_verdicts(claims, drafts.unionByName(shared).distinct(), facets)
    return v.groupBy("draft", "verdict").agg(F.count("*").alias("n"))


@query("F33 W6", """
WITH f AS (SELECT l_orderkey AS answer, l_suppkey AS source, min(l_linenumber) AS first_use FROM lineitem GROUP BY ALL), l AS (SELECT *, 'S' || CAST(row_number() OVER (PARTITION BY answer ORDER BY first_use, source) AS VARCHAR) AS label FROM f)
SELECT answer, string_agg('[' || label || ']', '' ORDER BY first_use, source) AS citations, count(*) AS n FROM l GROUP BY answer""")
def citation_labels(x):
    uses = x.lineitem.select(F.col("l_orderkey").alias("answer"), F.col("l_suppkey").alias("source"), F.col("l_linenumber").alias("position"))
    lab = a.citation_labels(uses, "answer", "source", "position")
    g = lab.groupBy("answer").agg(F.sort_array(F.collect_list(F.struct("first_use", "source", "label"))).alias("s"), F.count("*").alias("n"))
    return g.select("answer", F.array_join(F.transform("s.label", lambda v: F.concat(F.lit("["), v, F.lit("]"))), "").alias("citations"), "n")


@query("A16", """
WITH f AS (SELECT l_orderkey AS draft, l_partkey % 6 AS facet FROM lineitem), w AS (SELECT DISTINCT draft, unnest([0, 1, 2, 3, 4, 5]) AS facet FROM f)
SELECT draft, string_agg(CAST(facet AS VARCHAR), ',' ORDER BY facet) AS gaps FROM (SELECT draft, facet FROM w EXCEPT SELECT draft, facet FROM f) GROUP BY draft""")
def facet_gaps(x):
    g = x.lineitem.groupBy(F.col("l_orderkey").alias("draft")).agg(F.collect_set((F.col("l_partkey") % 6).cast("int")).alias("f"))
    gaps = F.array_sort(F.array_except(F.array(*map(F.lit, range(6))), "f"))
    return g.select("draft", F.array_join(F.transform(gaps, lambda v: v.cast("string")), ",").alias("gaps")).filter("gaps <> ''")


@query("A17 A18", """
WITH b AS (SELECT l_orderkey AS doc, l_linenumber AS block, l_quantity >= 10 AS presented_whole FROM lineitem)
SELECT o_custkey AS question, count(DISTINCT doc) AS documents_read, count(DISTINCT CASE WHEN fully THEN doc END) AS fully_read, CAST(sum(n) AS BIGINT) AS blocks FROM (SELECT doc, bool_and(presented_whole) AS fully, count(*) AS n FROM b GROUP BY doc) JOIN orders ON doc = o_orderkey GROUP BY o_custkey""")
def coverage_summary(x):
    d = x.lineitem.groupBy(F.col("l_orderkey").alias("doc")).agg(F.bool_and(F.col("l_quantity") >= 10).alias("fully"), F.count("*").alias("n"))
    j = d.join(x.orders.select(F.col("o_orderkey").alias("doc"), F.col("o_custkey").alias("question")), "doc")
    return j.groupBy("question").agg(F.countDistinct("doc").alias("documents_read"), F.countDistinct(F.when(F.col("fully"), F.col("doc"))).alias("fully_read"), F.sum("n").alias("blocks"))


@query("PF24 C38", """
SELECT o_orderkey, CASE WHEN c > 0 AND g = 0 AND clear AND NOT (ex AND e > 0) THEN 'answer' WHEN c > 0 THEN 'partial' WHEN e > 0 THEN 'error' ELSE 'not_found' END AS status
FROM (SELECT o_orderkey, o_orderkey % 4 AS c, o_custkey % 3 AS g, o_orderstatus <> 'P' AS clear, o_custkey % 2 AS e, o_orderkey % 5 = 0 AS ex FROM orders)""")
def answer_statuses(x):
    k, u = F.col("o_orderkey"), F.col("o_custkey")
    return x.orders.select("o_orderkey", a.answer_status(k % 4, u % 3, F.col("o_orderstatus") != "P", u % 2, k % 5 == 0).alias("status"))


_CHECKS = "c AS (SELECT l_orderkey AS case_id, l_linenumber AS method, l_returnflag AS category, l_linestatus AS regime, l_quantity > 20 AS passed FROM lineitem)"


def _checks(x):
    return x.lineitem.select(F.col("l_orderkey").alias("case_id"), F.col("l_linenumber").alias("method"), F.col("l_returnflag").alias("category"), F.col("l_linestatus").alias("regime"), (F.col("l_quantity") > 20).alias("passed"))


@query("A28 C7", f"WITH {_CHECKS} SELECT method, category, regime, count(*) FILTER (passed) AS numerator, count(*) AS denominator, round(avg(CAST(passed AS DOUBLE)), 6) AS rate FROM c GROUP BY GROUPING SETS ((method), (method, category), (method, regime))")
def eval_grouping_sets(x):
    return a.rates(_checks(x), F.col("passed"))


@query("A27 J28 S4", f"WITH {_CHECKS} SELECT o_orderkey AS case_id, count(c.case_id) AS checks, count(*) FILTER (passed) AS passed, coalesce(bool_and(passed), false) AS all_passed, count(c.case_id) = 0 AS missing FROM orders LEFT JOIN c ON c.case_id = o_orderkey GROUP BY o_orderkey")
def eval_checks(x):
    j = x.orders.select(F.col("o_orderkey").alias("case_id")).join(_checks(x), "case_id", "left")
    return j.groupBy("case_id").agg(F.count("passed").alias("checks"), F.count_if("passed").alias("passed"), F.coalesce(F.bool_and("passed"), F.lit(False)).alias("all_passed"), (F.count("passed") == 0).alias("missing"))


@query("A29 A31 J29", """
WITH p AS (SELECT o_custkey % 50 AS scope, b.l_extendedprice AS base, c.l_extendedprice AS cand, b.l_quantity AS bq, c.l_quantity AS cq FROM orders JOIN lineitem b ON b.l_orderkey = o_orderkey AND b.l_linenumber = 1 JOIN lineitem c ON c.l_orderkey = o_orderkey AND c.l_linenumber = 2)
SELECT scope, count(*) AS pairs, round(sum(cand) / sum(base), 6) AS ratio, count(*) FILTER (cand < base) AS wins, count(*) >= 8 AND avg(CASE WHEN cq >= bq THEN 1.0 ELSE 0.0 END) >= 0.5 AND sum(cand) / sum(base) <= 1.0 AS promoted FROM p GROUP BY scope""")
def efficiency_gate(x):
    """Paired observations: work ratio, wins, and the promotion rule."""
    l = x.lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")
    one = l.filter("l_linenumber = 1").select("l_orderkey", F.col("l_extendedprice").alias("base"), F.col("l_quantity").alias("bq"))
    two = l.filter("l_linenumber = 2").select("l_orderkey", F.col("l_extendedprice").alias("cand"), F.col("l_quantity").alias("cq"))
    p = x.orders.select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_custkey") % 50).alias("scope")).join(one, "l_orderkey").join(two, "l_orderkey")
    ratio = F.sum("cand") / F.sum("base")
    good = (F.count("*") >= 8) & (F.avg((F.col("cq") >= F.col("bq")).cast("double")) >= 0.5) & (ratio <= 1.0)
    return p.groupBy("scope").agg(F.count("*").alias("pairs"), F.round(ratio, 6).alias("ratio"), F.count_if(F.col("cand") < F.col("base")).alias("wins"), good.alias("promoted"))


@query("W19 M10 D23", """
WITH s AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS k FROM events)
SELECT user_id, round(sum(pow(0.9, k) * (value - 0.05)), 4) AS ret, count(*) AS steps FROM s GROUP BY user_id""")
def discounted_returns(x):
    s = x.events.withColumn("k", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1)
    return s.groupBy("user_id").agg(F.round(F.sum(F.pow(F.lit(0.9), F.col("k")) * (F.col("value") - 0.05)), 4).alias("ret"), F.count("*").alias("steps"))


@query("A33 A35 C27", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, count(DISTINCT o_custkey) AS scopes FROM orders GROUP BY ALL")
def status_counts(x):
    return x.orders.groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.countDistinct("o_custkey").alias("scopes"))


@query("C23", r"""
WITH l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda v: trim(v) <> '') AS l FROM documents)
SELECT doc_id, sha256(substr(array_to_string(l[1:3], chr(10)), 1, 1600)) AS lead_sha, CASE WHEN len(l) > 20 THEN 'long' ELSE 'short' END AS note FROM l""")
def manifest_leads(x):
    """The first three blocks of each document, 1600 characters at most: the manifest's own lead."""
    lines = F.filter(F.split("text", "\n"), lambda v: F.trim(v) != "")
    lead = F.substring(F.array_join(F.slice(lines, 1, 3), "\n"), 1, 1600)
    return x.documents.select("doc_id", F.sha2(lead.cast("binary"), 256).alias("lead_sha"), F.when(F.size(lines) > 20, "long").otherwise("short").alias("note"))


@query("J1 J16 D3 SC18", "SELECT d.doc_id, d.lang, d.source, l.quality, l.doc_id IS NOT NULL AS judged FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def snapshot_documents(x):
    j = x.documents.select("doc_id", "lang", "source").join(x.labels.select("doc_id", "quality", F.lit(True).alias("j")), "doc_id", "left")
    return j.select("doc_id", "lang", "source", "quality", F.coalesce("j", F.lit(False)).alias("judged"))


@query("SC19 PF7", "SELECT item_id AS pos, d.doc_id, n_chars FROM benchmark b JOIN documents d ON d.doc_id = (b.item_id * 7919) % (SELECT max(doc_id) + 1 FROM documents) ORDER BY item_id")
def point_lookups(x):
    """Rows by a list of ids, in the caller's order, repeated ids kept."""
    top = x.documents.agg((F.max("doc_id") + 1).alias("top"))
    asked = x.benchmark.crossJoin(F.broadcast(top)).select(F.col("item_id").alias("pos"), ((F.col("item_id") * 7919) % F.col("top")).alias("doc_id"))  # one row
    return asked.join(x.documents.select("doc_id", "n_chars"), "doc_id").orderBy("pos").select("pos", "doc_id", "n_chars")
