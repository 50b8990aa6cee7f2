"""Queries over parsers of model output: raw JSON is made of order lines, and SQL says what the parsers must find in it."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..operators import drafts as d
from .registry import query

_FACETS = [f"F{k}" for k in range(1, 7)]
_SOURCES = {f"P{k}": f"source number {k}" for k in range(9)}
_LINES = """
c AS (SELECT l_orderkey AS draft, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS n, count(*) OVER (PARTITION BY l_orderkey) AS lines, l_linenumber, l_partkey, l_suppkey, l_quantity FROM lineitem),
k AS (SELECT * FROM c WHERE draft % 7 <> 0 AND (draft % 5 <> 0 OR n < lines))"""


def _raw(x, record, field, rest="{}"):
    """The JSON of each order: an array of records and what follows it; some break off in the last record, some repeat a key."""
    own = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", F.to_json(record).alias("json"))
    rows = x.lineitem.groupBy(F.col("l_orderkey").alias("draft")).agg(F.sort_array(F.collect_list(own)).alias("r"))
    tail = F.lit("]" + rest)
    whole = F.concat(F.lit(f'{{"{field}":['), F.array_join("r.json", ","), tail)
    cut = F.substring(whole, F.lit(1), F.char_length(whole) - F.char_length(tail) - 3)
    raw = F.when(F.col("draft") % 7 == 0, F.concat(F.lit(f'{{"{field}":[],'), F.substring(whole, 2, 1 << 30))).when(F.col("draft") % 5 == 0, cut).otherwise(F.concat(F.lit("```json\n"), whole, F.lit("\n```")))
    return rows.select("draft", raw.alias("raw"))


@query("K4 J23 K1 K2 C9", f"""WITH {_LINES},
v AS (SELECT *, count(*) OVER (PARTITION BY draft, l_linenumber) AS copies FROM k),
g AS (SELECT *, copies = 1 AND l_linenumber <= 32 AND l_partkey % 10 <> 0 AND l_partkey % 7 < 6 AND l_suppkey % 10 < 9 AND (l_suppkey // 10) % 10 < 9 AS good FROM v),
a AS (SELECT draft, coalesce(string_agg('C' || l_linenumber || ':F' || (1 + l_partkey % 7) || ':' || CASE WHEN l_suppkey % 10 = (l_suppkey // 10) % 10 THEN 1 ELSE 2 END, ' ' ORDER BY n) FILTER (good), '') AS claims, list(DISTINCT 1 + l_partkey % 7) FILTER (good) AS f, count(*) FILTER (NOT good) AS bad FROM g GROUP BY draft),
o AS (SELECT DISTINCT draft, lines FROM c)
SELECT o.draft, coalesce(claims, '') AS claims, array_to_string(list_filter([1, 2, 3, 4, 5, 6], lambda x: NOT coalesce(list_contains(f, x), false) OR (x = 1 AND o.draft % 7 <> 0 AND o.draft % 5 <> 0)), ',') AS gaps,
  CASE WHEN o.draft % 7 = 0 OR a.draft IS NULL THEN 1 WHEN o.draft % 5 = 0 THEN 1 + bad ELSE bad END AS rejects FROM o LEFT JOIN a ON a.draft = o.draft""")
def parsed_drafts(x):
    """Claims, open facets and the number of rejects of every draft; whole, broken and ambiguous ones."""
    text = F.when(F.col("l_partkey") % 10 == 0, F.lit("as shown [S1]")).otherwise(F.concat(F.lit("claim  of\n"), F.col("l_partkey").cast("string")))
    source = lambda v: F.concat(F.lit("P"), v.cast("string"))
    record = F.struct(
        F.concat(F.lit("C"), F.col("l_linenumber").cast("string")).alias("id"), text.alias("text"), F.array(F.concat(F.lit("F"), (1 + F.col("l_partkey") % 7).cast("string"))).alias("facet_ids"),
        F.array(source(F.col("l_suppkey") % 10), source(F.floor(F.col("l_suppkey") / 10) % 10)).alias("source_ids"),
    )

    def parse(draft, raw):
        claims, gaps, rejects = d.parse_draft(raw, _FACETS, _SOURCES)
        yield draft, " ".join(f"{c[0]}:{c[2][0]}:{len(c[3])}" for c in claims), ",".join(g[1:] for g in gaps), len(rejects)

    return d.parsed(_raw(x, record, "claims", ',"missing_facet_ids":["F1"]}'), "draft", ["raw"], parse, "draft long, claims string, gaps string, rejects long")


@query("K3", f"""WITH {_LINES},
g AS (SELECT *, l_linenumber <= 6 AND n = min(n) OVER (PARTITION BY draft, l_linenumber) AS good FROM k), a AS (SELECT draft, string_agg('F' || l_linenumber || ':' || CASE WHEN l_suppkey % 3 = 0 THEN 'what of ' || l_partkey || ' in ' || n ELSE 'find ' || l_suppkey END, '|' ORDER BY n) FILTER (good) AS facets, count(*) FILTER (NOT good) + count(*) FILTER (good AND l_suppkey % 3 = 0) * 2 AS bad FROM g GROUP BY draft),
o AS (SELECT DISTINCT draft FROM c)
SELECT o.draft, coalesce(facets, 'F1:the whole question') AS facets, CASE WHEN o.draft % 7 = 0 OR a.draft IS NULL THEN 1 WHEN o.draft % 5 = 0 THEN 1 + bad ELSE bad END + CASE WHEN facets IS NULL THEN 1 ELSE 0 END AS rejects FROM o LEFT JOIN a USING (draft)""")
def parsed_plans(x):
    """Facets with their queries of every plan; one without a usable query asks its own question."""
    n = F.col("n").cast("string")
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    record = F.struct(
        F.concat(F.lit("F"), F.col("l_linenumber").cast("string")).alias("id"), F.concat(F.lit("what of "), F.col("l_partkey").cast("string"), F.lit(" in "), n).alias("question"),
        F.array(F.when(F.col("l_suppkey") % 3 == 0, "").otherwise(F.concat(F.lit("find "), F.col("l_suppkey").cast("string")))).alias("queries"),
    )

    class Numbered:
        lineitem = x.lineitem.withColumn("n", F.row_number().over(w))

    def parse(draft, raw):
        facets, rejects = d.parse_plan(raw, "the whole question")
        yield draft, "|".join(f"{f[0]}:{f[2][0]}" for f in facets), len(rejects)

    return d.parsed(_raw(Numbered, record, "facets", "}"), "draft", ["raw"], parse, "draft long, facets string, rejects long")


@query("K5", f"""WITH {_LINES}, s AS (SELECT draft, n, l_partkey % 7 AS f, l_suppkey % 4 AS q, l_quantity FROM c),
t AS (SELECT draft, f, q, min(n) AS n FROM s WHERE n <= 6 AND f < 6 AND q > 0 GROUP BY ALL), g AS (SELECT draft, string_agg('F' || (f + 1) || ':look ' || q, '|' ORDER BY n) AS searches FROM t GROUP BY draft),
u AS (SELECT draft, count(*) FILTER (n <= 6 AND (f = 6 OR q = 0)) + CASE WHEN max(n) > 6 THEN 1 ELSE 0 END AS bad FROM s GROUP BY draft)
SELECT u.draft, coalesce(searches, '') AS searches, 'C' || (1 + u.draft % 32) AS unsupported, CASE WHEN u.draft % 32 < 6 THEN 'F' || (1 + u.draft % 32) ELSE '' END AS missing, bad + CASE WHEN u.draft % 32 < 6 THEN 0 ELSE 1 END AS rejects FROM u LEFT JOIN g USING (draft)""")
def parsed_audits(x):
    """Unsupported claims, missing facets and searches of every audit."""
    record = F.struct(F.concat(F.lit("F"), (1 + F.col("l_partkey") % 7).cast("string")).alias("facet_id"), F.when(F.col("l_suppkey") % 4 == 0, "see [S2]").otherwise(F.concat(F.lit("look "), (F.col("l_suppkey") % 4).cast("string"))).alias("query"))
    own = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", record.alias("r"))
    rows = x.lineitem.groupBy(F.col("l_orderkey").alias("draft")).agg(F.sort_array(F.collect_list(own)).alias("r"))
    k = (1 + F.col("draft") % 32).cast("string")
    raw = F.to_json(F.struct(F.array(F.concat(F.lit("C"), k)).alias("unsupported_claim_ids"), F.array(F.concat(F.lit("F"), k)).alias("missing_facet_ids"), F.col("r.r").alias("searches"), F.lit("because").alias("reason")))

    def parse(draft, text):
        claims, missing, searches, _, rejects = d.parse_audit(text, _FACETS)
        yield draft, "|".join(f"{f}:{q}" for f, q in searches), ",".join(claims), ",".join(missing), len(rejects)

    return d.parsed(rows.select("draft", raw.alias("raw")), "draft", ["raw"], parse, "draft long, searches string, unsupported string, missing string, rejects long")


@query("K6", "SELECT o_orderkey AS request, 6 AS facets, 1 + o_custkey % 5 AS sources, sha256(to_json(list_transform(generate_series(0, o_custkey % 5), lambda k: 'P' || k))) AS ids_sha FROM orders")
def draft_schemas(x):
    """The schema that each request's draft must follow enumerates its facets and sources."""
    def make(request, n):
        schema = d.answer_schema(_FACETS, [f"P{k}" for k in range(n + 1)])
        item = schema["properties"]["claims"]["items"]["properties"]
        ids = item["source_ids"]["items"]["enum"]
        yield request, len(item["facet_ids"]["items"]["enum"]), len(ids), json.dumps(ids, separators=(",", ":"))

    made = d.parsed(x.orders.select(F.col("o_orderkey").alias("request"), (F.col("o_custkey") % 5).alias("n")), "request", ["n"], make, "request long, facets int, sources long, ids string")
    return made.select("request", "facets", "sources", F.sha2(F.col("ids").cast("binary"), 256).alias("ids_sha"))


@query("C14 C13", """
SELECT event_id, event_type = 'error' AND CAST(json_extract_string(props, '$.k') AS BIGINT) % 3 <> 1 AS overflow FROM events""")
def context_overflows(x):
    """Which errors say that a context is too small: plain, nested as JSON text, or about something else."""
    k = F.get_json_object("props", "$.k").cast("long")
    said = F.lit("the request exceeds the context length")
    nested = F.to_json(F.struct(F.to_json(F.struct(F.struct(said.alias("message")).alias("error"))).alias("error")))
    body = F.when(F.col("event_type") != "error", "").when(k % 3 == 0, said).when(k % 3 == 2, nested).otherwise('{"error": "model not found"}')
    return d.parsed(x.events.select("event_id", body.alias("body")), "event_id", ["body"], lambda e, b: [(e, d.overflows(b))], "event_id long, overflow boolean")
