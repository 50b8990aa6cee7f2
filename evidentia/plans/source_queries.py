"""Queries over JSON sources: the customers of a nation as its registry, orders as manifests of their lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import json_files as j
from .graph_queries import _parts
from .registry import query


@query("SC20", """
SELECT 'nation ' || c_nationkey AS path, CASE WHEN c_nationkey % 2 = 0 THEN 2 ELSE 1 END AS version, CAST(c_custkey AS VARCHAR) AS id, c_name AS name,
  c_mktsegment || ':exact_case' || CASE WHEN c_acctbal > 0 THEN ',' || lower(c_name) || ':casefold' ELSE '' END || ',' || c_name || ':casefold' AS aliases, CASE WHEN c_acctbal > 5000 THEN CAST(c_custkey + 1 AS VARCHAR) ELSE '' END AS distinct_from
FROM customer WHERE c_nationkey < 23 AND c_custkey % 13 <> 5""")
def registry_entities(x):
    """A registry for each nation: aliases as texts and objects, entries without a name, registries that are none."""
    q = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    key = F.col("c_custkey")
    alias = F.concat_ws(", ", q(F.col("c_mktsegment")), F.lit("7"), F.lit('{"text": " "}'), F.when(F.col("c_acctbal") > 0, F.concat(F.lit('{"text": " '), F.lower("c_name"), F.lit(' ", "mode": "casefold"}'))))
    entry = F.concat(
        F.lit('{"id": '), key.cast("string"), F.lit(', "name": '), F.when(key % 13 == 5, F.lit("null")).otherwise(q(F.concat("c_name", F.lit(" ")))), F.lit(', "aliases": ['), alias,
        F.lit('], "distinct_from": ['), F.when(F.col("c_acctbal") > 5000, q((key + 1).cast("string"))).otherwise(""), F.lit("]}"),
    )
    nation = F.col("c_nationkey")
    g = x.customer.groupBy("c_nationkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", entry.alias("e")))), lambda v: v["e"]), ", ").alias("e"))
    text = F.when(nation == 23, F.lit('{"entities": {}}')).when(nation == 24, F.lit("{")).otherwise(F.concat(F.lit("{"), F.when(nation % 2 == 0, '"version": 2, ').otherwise(""), F.lit('"entities": ["no entity", '), "e", F.lit("]}")))
    found, _ = j.registry_entities(g.select(F.concat(F.lit("nation "), nation.cast("string")).alias("path"), text.alias("text")))
    shown = F.array_join(F.transform("aliases", lambda a: F.concat(a["text"], F.lit(":"), a["mode"])), ",")
    return found.select("path", "version", "id", "name", shown.alias("aliases"), F.array_join("distinct_from", ",").alias("distinct_from"))


@query("SC20", """
WITH n AS (SELECT l_orderkey AS o, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS k, l_partkey AS p, CAST(l_quantity AS BIGINT) AS q FROM lineitem),
f AS (SELECT o, 'file' || k AS name, p, q FROM n)
SELECT 'order ' || o AS path, issue FROM (
  SELECT o, CASE WHEN p % 7 = 0 THEN 'missing:' || name WHEN p % 7 = 1 THEN 'changed:' || name WHEN p % 7 = 2 THEN 'unlisted:' || name WHEN p % 7 = 3 THEN 'listed_twice:' || name END AS issue FROM f WHERE o % 10 <> 9
  UNION ALL SELECT o, 'omits:file1' FROM f WHERE name = 'file1' AND p % 7 = 2 AND o % 10 <> 9
  UNION ALL SELECT DISTINCT o, 'omits:file1' FROM f WHERE o % 10 <> 9 AND NOT EXISTS (SELECT 1 FROM f g WHERE g.o = f.o AND name = 'file1')
  UNION ALL SELECT DISTINCT o, 'unrecognized:revision' FROM f WHERE o % 10 = 4
  UNION ALL SELECT DISTINCT o, 'invalid_json' FROM f WHERE o % 10 = 9) WHERE issue IS NOT NULL""")
def manifest_issues(x):
    """A manifest for each order, which names most of its lines as files; some are gone, changed, not listed or listed twice."""
    from pyspark.sql import Window

    # the order's number is read back from its path, by which all steps meet: lines are dealt out once, into parts by their number
    w = Window.partitionBy("path").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    lines = x.lineitem.select(F.concat(F.lit("order "), F.col("l_orderkey").cast("string")).alias("path"), "l_linenumber", "l_partkey", "l_suppkey", "l_quantity").repartition(_parts(x), "path")
    n = lines.select("path", F.concat(F.lit("file"), F.row_number().over(w).cast("string")).alias("name"), F.col("l_partkey").alias("p"), F.col("l_quantity").cast("long").alias("bytes"))
    o = F.substring_index("path", " ", -1).cast("long")
    sha, kind = F.sha2(F.col("p").cast("string").cast("binary"), 256), F.col("p") % 7
    entry = F.format_string('{"path": "%s", "bytes": %d, "sha256": "%s"}', "name", F.when(kind == 1, F.col("bytes") + 1).otherwise(F.col("bytes")), sha)
    named = F.when(kind == 2, None).when(kind == 3, F.concat(entry, F.lit(", "), entry)).otherwise(entry)
    listed = n.groupBy("path").agg(F.array_join(F.collect_list(named), ", ").alias("f"))
    text = F.when(o % 10 == 9, F.lit("{,}")).otherwise(F.concat(F.lit('{"schema": "v1", "revision": "'), F.when(o % 10 == 4, "old").otherwise("new"), F.lit('", "files": ['), "f", F.lit("]}")))
    file = lambda name, size, sha: F.struct(name.alias("name"), size.alias("bytes"), sha.alias("sha256"))
    readme = file(F.lit("README.md"), F.lit(1).cast("long"), F.lit(""))
    found = n.select("path", F.inline(F.array_compact(F.array(F.when(kind != 0, file(F.col("name"), F.col("bytes"), sha)), F.when(F.col("name") == "file1", readme)))))
    return j.manifest_issues(listed.select("path", text.alias("text")), found, {"schema": "v1", "revision": "new"}, ("file1",))
