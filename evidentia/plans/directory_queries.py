"""Queries over people, roles and videos. Customers are people, orders their roles, parts videos, lineitems chapters."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import directory as d
from .registry import query


@query("DV1", "SELECT c_custkey, c_name FROM customer WHERE contains(lower(c_name), '00') OR contains(lower(c_mktsegment), 'auto') ORDER BY c_name, c_custkey")
def people_search(x):
    hit = F.contains(F.lower("c_name"), F.lit("00")) | F.contains(F.lower("c_mktsegment"), F.lit("auto"))
    return x.customer.filter(hit).orderBy("c_name", "c_custkey").select("c_custkey", "c_name")


_ROLES = """roles AS (SELECT o_orderkey AS role_id, o_custkey AS person, o_orderpriority AS title, strftime(o_orderdate, '%Y-%m-%d') AS f, strftime(o_orderdate + INTERVAL 700 DAY, '%Y-%m-%d') AS t, o_orderstatus AS status FROM orders)"""


def _roles(x):
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    at = F.col("o_orderdate").cast("timestamp_ntz")
    return x.orders.select(F.col("o_orderkey").alias("role_id"), F.col("o_custkey").alias("person"), F.col("o_orderpriority").alias("title"), day(at).alias("f"), day(at + F.expr("INTERVAL '700' DAY")).alias("t"), F.col("o_orderstatus").alias("status"))


@query("PF6 J11 J12 DV2 W14 M5", f"""WITH {_ROLES}, live AS (SELECT * FROM roles JOIN customer ON person = c_custkey WHERE status IN ('O', 'F') AND c_acctbal > 0 AND f <= '1996-06-01' AND t > '1996-06-01'),
tok AS (SELECT *, lower(title || ' ' || c_name) AS h FROM live),
s AS (SELECT role_id, c_name, round(CASE WHEN contains(h, 'urgent customer') THEN 2 ELSE 0 END + (CASE WHEN list_contains(regexp_extract_all(h, '[\\p{{L}}\\p{{N}}]+'), 'urgent') THEN 1 ELSE 0 END + CASE WHEN list_contains(regexp_extract_all(h, '[\\p{{L}}\\p{{N}}]+'), 'customer') THEN 1 ELSE 0 END) / 2.0, 6) AS score FROM tok)
SELECT role_id, score FROM s ORDER BY score DESC, lower(c_name), role_id LIMIT 200""")
def role_search_asof(x):
    """Roles in force at a day, by score, name and id; 200 rows at most (the operator's own limit)."""
    at = F.lit("1996-06-01")
    live = _roles(x).filter(F.col("status").isin("O", "F") & d.in_force(at, F.col("f"), F.col("t"))).join(x.customer.filter("c_acctbal > 0"), F.col("person") == F.col("c_custkey"))
    score = d.token_score(F.concat_ws(" ", "title", "c_name"), F.lit("urgent customer"))
    return live.withColumn("score", score).orderBy(F.desc("score"), F.lower("c_name"), "role_id").limit(200).select("role_id", "score")


@query("A26 DV6", f"WITH {_ROLES} SELECT title, c_nationkey AS organization, count(DISTINCT person) AS holders FROM roles JOIN customer ON person = c_custkey GROUP BY ALL HAVING count(DISTINCT person) > 1")
def role_competing(x):
    r = _roles(x).join(x.customer, F.col("person") == F.col("c_custkey"))
    return d.competing(r.withColumnRenamed("c_nationkey", "organization"), "title", "organization", "person")


@query("DV3 D15", f"WITH {_ROLES} SELECT role_id, f, lead(f) OVER w AS valid_until, lead(f) OVER w IS NULL AS current FROM roles WINDOW w AS (PARTITION BY person ORDER BY f, role_id)")
def role_scd2(x):
    return d.successor_chain(_roles(x), ["person"], "f", ["role_id"]).select("role_id", "f", "valid_until", "current")


@query("A8", "SELECT c_nationkey, string_agg(DISTINCT c_mktsegment, ' | ' ORDER BY c_mktsegment) AS aliases, CASE WHEN c_nationkey % 2 = 0 THEN count(*) END AS visible FROM customer GROUP BY c_nationkey")
def alias_lists(x):
    g = x.customer.groupBy("c_nationkey").agg(F.array_join(F.sort_array(F.collect_set("c_mktsegment")), " | ").alias("aliases"), F.count("*").alias("n"))
    return g.select("c_nationkey", "aliases", F.when(F.col("c_nationkey") % 2 == 0, F.col("n")).alias("visible"))


_VIDEOS = """
v AS (SELECT p_partkey AS video, p_name AS title, lower(p_name || ' ' || p_type || ' ' || p_brand) AS about FROM part),
ch AS (SELECT l_partkey AS video, l_linenumber AS ordinal, max(CASE WHEN l_returnflag = 'R' THEN 'cold storage ' ELSE 'notes ' END || CASE WHEN l_linestatus = 'F' THEN 'of the widget' ELSE 'on steel' END) AS about FROM lineitem GROUP BY ALL)"""


@query("DV4 J13 M6 W15 D16 R2", f"""WITH {_VIDEOS},
c AS (SELECT video, ordinal, len(list_filter(['cold', 'widget'], lambda w: list_contains(regexp_extract_all(about, '[\\p{{L}}\\p{{N}}]+'), w))) AS m FROM ch),
b AS (SELECT video, max(m) AS best, min(ordinal) FILTER (m = top) AS chapter FROM (SELECT *, max(m) OVER (PARTITION BY video) AS top FROM c) GROUP BY video),
s AS (SELECT v.video, title, len(list_filter(['cold', 'widget'], lambda w: list_contains(regexp_extract_all(about, '[\\p{{L}}\\p{{N}}]+'), w))) AS base, coalesce(best, 0) AS best, chapter, contains(about, 'cold widget') AS phrase FROM v LEFT JOIN b USING (video))
SELECT video AS video_id, CASE WHEN best > 0 THEN chapter END AS chapter, round(CASE WHEN phrase THEN 2 ELSE 0 END + (base + 1.5 * best) / 2.0, 6) AS score, row_number() OVER (ORDER BY CASE WHEN phrase THEN 2 ELSE 0 END + (base + 1.5 * best) / 2.0 DESC, lower(title), video) AS rank
FROM s WHERE base > 0 OR best > 0 OR phrase QUALIFY rank <= 100""")
def video_best_chapter(x):
    """Videos by tokens of title, kind and chapters with their best chapter; a hundred at most (the search's own limit)."""
    about = F.lower(F.concat_ws(" ", "p_name", "p_type", "p_brand"))
    v = x.part.select(F.col("p_partkey").alias("video_id"), F.col("p_name").alias("title"), about.alias("about"))
    text = F.concat(F.when(F.col("l_returnflag") == "R", "cold storage ").otherwise("notes "), F.when(F.col("l_linestatus") == "F", "of the widget").otherwise("on steel"))
    c = x.lineitem.groupBy(F.col("l_partkey").alias("video_id"), F.col("l_linenumber").alias("ordinal")).agg(F.max(text).alias("about"))
    return d.search_videos(v, c, F.lit("cold widget"), 100)


@query("DV5 C34 PF16", """
WITH v AS (SELECT p_partkey AS video, p_partkey // 3 * 7 % 101 AS ext, p_name || p_size AS fp, 40 + p_size AS duration FROM part WHERE p_size > 10), k AS (SELECT p_partkey // 3 * 7 % 101 AS ext, p_name || p_size AS fp FROM part WHERE p_size <= 3),
c AS (SELECT l_partkey AS video, l_linenumber AS ordinal, min(l_quantity) AS s, min(l_quantity) + min(l_discount) * 100 AS e FROM lineitem GROUP BY ALL), p AS (SELECT c.*, duration, lag(e) OVER (PARTITION BY video ORDER BY ordinal) AS prior FROM c JOIN v USING (video))
SELECT video AS video_id, 'repeated external_id' AS issue FROM v WHERE ext IN (SELECT ext FROM v GROUP BY ext HAVING count(*) > 1) UNION SELECT video, 'known external_id' FROM v WHERE ext IN (SELECT ext FROM k)
UNION SELECT video, 'repeated fingerprint' FROM v WHERE fp IN (SELECT fp FROM v GROUP BY fp HAVING count(*) > 1) UNION SELECT video, 'known fingerprint' FROM v WHERE fp IN (SELECT fp FROM k)
UNION SELECT video, 'empty chapter' FROM p WHERE e <= s UNION SELECT video, 'chapter order' FROM p WHERE prior > s UNION SELECT video, 'chapter bounds' FROM p WHERE e > duration OR s < 0""")
def video_import_issues(x):
    """What keeps videos from an import: identities that are taken, chapters out of order or out of bounds."""
    own = x.part.select(F.col("p_partkey").alias("video_id"), (F.floor(F.col("p_partkey") / 3) * 7 % 101).alias("external_id"), F.concat("p_name", F.col("p_size").cast("string")).alias("fingerprint"), (40 + F.col("p_size")).alias("duration"), "p_size")
    c = x.lineitem.groupBy(F.col("l_partkey").alias("video_id"), F.col("l_linenumber").alias("ordinal")).agg(F.min("l_quantity").alias("start"), (F.min("l_quantity") + F.min("l_discount") * 100).alias("end"))
    return d.import_issues(own.filter("p_size > 10"), c, own.filter("p_size <= 3"))


@query("F34", """
SELECT s_suppkey, CASE WHEN s_acctbal > 0 THEN 'https://media.example/' || CAST(s_suppkey AS VARCHAR) ELSE '' END AS uri, s_name || ' (' || n_name || ')' || CASE WHEN s_acctbal > 0 THEN '' ELSE ' [locked]' END AS line FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def masked_locators(x):
    s = x.supplier.join(x.nation, F.col("s_nationkey") == F.col("n_nationkey"))
    ok = F.col("s_acctbal") > 0
    return s.select("s_suppkey", F.when(ok, F.concat(F.lit("https://media.example/"), F.col("s_suppkey").cast("string"))).otherwise("").alias("uri"), F.concat("s_name", F.lit(" ("), "n_name", F.lit(")"), F.when(ok, "").otherwise(" [locked]")).alias("line"))


@query("DV6 A12 F34", f"""WITH {_ROLES}, c AS (SELECT title, c_nationkey AS org FROM roles JOIN customer ON person = c_custkey GROUP BY ALL HAVING count(DISTINCT person) > 1),
q AS (SELECT person, role_id, title, f, EXISTS (SELECT 1 FROM c WHERE c.title = roles.title AND c.org = c_nationkey) AS competing FROM roles JOIN customer ON person = c_custkey),
r AS (SELECT *, row_number() OVER (PARTITION BY person ORDER BY f DESC, role_id) AS rn, count(*) OVER (PARTITION BY person) AS n FROM q)
SELECT person, string_agg(title || ' since ' || f || CASE WHEN competing THEN ' (held by several)' ELSE '' END, chr(10) ORDER BY rn) AS answer, max(n) > 8 AS truncated FROM r WHERE rn <= 8 GROUP BY person""")
def role_answers(x):
    """The eight latest roles of each person as lines, with a note where others hold the same one (the answer's own limit)."""
    r = _roles(x).join(x.customer.select(F.col("c_custkey").alias("person"), F.col("c_nationkey").alias("organization")), "person")
    many = d.competing(r, "title", "organization", "person").select("title", "organization", F.lit(True).alias("many"))
    r = r.join(many, ["title", "organization"], "left")
    line = F.concat("title", F.lit(" since "), "f", F.when(F.col("many"), " (held by several)").otherwise(""))
    return d.answer_lines(r, "person", [F.desc("f"), "role_id"], line, 8)


@query("DV6 F34", f"""WITH {_VIDEOS}, n AS (SELECT l_suppkey AS speaker, p_partkey AS video, title FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) l JOIN v ON video = l_partkey JOIN part ON p_partkey = video),
r AS (SELECT *, row_number() OVER (PARTITION BY speaker ORDER BY lower(title), video) AS rn, count(*) OVER (PARTITION BY speaker) AS n FROM n)
SELECT speaker, string_agg(title || ' [' || video || ']', chr(10) ORDER BY rn) AS answer, max(n) > 5 AS truncated FROM r WHERE rn <= 5 GROUP BY speaker""")
def video_answers(x):
    """Five videos of each speaker as lines (the answer's own limit)."""
    v = x.lineitem.select(F.col("l_suppkey").alias("speaker"), F.col("l_partkey").alias("p_partkey")).distinct().join(x.part.select("p_partkey", "p_name"), "p_partkey")
    return d.answer_lines(v, "speaker", [F.lower("p_name"), "p_partkey"], F.concat("p_name", F.lit(" ["), F.col("p_partkey").cast("string"), F.lit("]")), 5)
