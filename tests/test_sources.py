"""Sources, sinks and streams on small fixtures."""

from evidentia.operators import access
from evidentia.sources import documents as d
from evidentia.sources import generations as g


def test_decode():
    assert d.decode("é".encode("utf-16")) == ("é", "decoded as utf-16")
    assert d.decode("é".encode("utf-32"))[0] == "é"
    assert d.decode(b"\xef\xbb\xbfa") == ("a", "")
    assert d.decode(b"caf\xe9") == ("café", "decoded as cp1252")
    assert d.decode(b"a\0b") == (None, "has NUL characters")


def test_markdown():
    text = "Top\n===\nintro\n\n- a\n- b\n\n## Sub #\n| h | i |\n|---|---|\n| 1 | 2 |\n|  |  |\nafter\n"
    out = [*d.markdown_blocks(text)]
    assert [(k, p, t) for k, p, _, t in out] == [
        ("section_header", "Top", "Top"), ("prose", "Top", "intro"), ("list_item", "Top", "- a"), ("list_item", "Top", "- b"),
        ("section_header", "Top > Sub", "Sub"), ("table_header", "Top > Sub", "h | i"), ("table_row", "Top > Sub", "1 | 2"), ("prose", "Top > Sub", "after"),
    ]
    assert [*d.markdown_blocks("")] == []


def test_html():
    html = "<title>T</title><script>x</script><h1>A</h1><p>a<br>b</p><dl><dt>k</dt><dd>v</dd></dl><table><tr><td>1</td><td>2</td></tr></table><ul><li><p>deep</p></li></ul>"
    out = [(k, t) for k, _, _, t in d.html_blocks(html)]
    assert out == [("section_header", "A"), ("prose", "a\nb"), ("definition", "k: v"), ("table_row", "1 | 2"), ("list_item", "deep")]


def test_layout_tables():
    assert d.layout_tables(["x", "name  n", "a  1", "b  2", "y"]) == [(1, 4)]
    assert d.layout_tables(["a  b", "c  d"]) == []


def test_collect_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, body in (("a.md", "# A"), ("~$a.md", "x"), ("b.bin", "x"), ("in/c.txt", "one\n\ntwo")):
        (tmp_path / name).write_text(body)
    files = d.decoded(d.collect_files(spark, str(tmp_path)))
    assert sorted((r.suffix, r.text) for r in files.collect()) == [("md", "# A"), ("txt", "one\n\ntwo")]
    blocks = d.parsed(files.filter("suffix = 'txt'"), "path", "text", d.plain_blocks)
    assert [r.block_text for r in blocks.orderBy("ordinal").collect()] == ["one", "two"]


def test_files_are_listed_and_read_by_tasks(spark, tmp_path):
    for name, body in (("a.md", "# A"), ("in/c.txt", "one"), ("in/deep/er/C.TXT", "two"), ("in/_b.txt", "x"), (".h/d.txt", "x"), ("in/e f.html", ""), ("a/b.bin", "x")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(body)
    want = {f"file:{tmp_path}/{n}": b for n, b in (("a.md", b"# A"), ("in/c.txt", b"one"), ("in/deep/er/C.TXT", b"two"), ("in/e f.html", b""))}
    for folder in (f"{tmp_path}/", f"file://{tmp_path}"):
        files = d.collect_files(spark, folder)
        # no list of the files is in the plan, hence none on the driver
        assert not files.inputFiles() and "FileScan" not in files._jdf.queryExecution().toString()
        assert {r.path: bytes(r.content) for r in files.collect()} == want
        assert {r.suffix for r in files.collect()} == {"md", "txt", "html"}
    (tmp_path / "none").mkdir()
    assert d.collect_files(spark, str(tmp_path / "none")).count() == 0


def test_generations(spark, tmp_path):
    one = spark.createDataFrame([(1, "a"), (2, "b")], "id long, sha string")
    g.publish(one, str(tmp_path / "t"), "g1")
    more = g.insert_missing(spark.createDataFrame([(2, "b"), (3, "c"), (3, "c")], "id long, sha string"), g.current(spark, str(tmp_path / "t")), ["id"])
    assert [r.id for r in more.collect()] == [3]
    g.publish(one.unionByName(more), str(tmp_path / "t"), "g2")
    assert g.current(spark, str(tmp_path / "t")).count() == 3
    assert g.conflicts(spark.createDataFrame([(1, "x")], "id long, sha string"), one, ["id"], "sha").count() == 1
    assert g.traced(spark.createDataFrame([("r", "long answer", "secret")], "run string, answer string, evidence string"), "answer", 4).collect()[0].asDict() == {"run": "r", "answer": "long"}


def grants_of(spark, rows):
    none = "CAST(NULL AS TIMESTAMP)"
    body = ", ".join(f"('{pt}', '{p}', '{rt}', '{r}', '{e}', '{a}', {none}, {none}, false)" for pt, p, rt, r, e, a in rows)
    return spark.sql(f"SELECT * FROM VALUES {body} t(principal_type, principal_id, resource_type, resource_id, effect, action, valid_from, valid_until, revoked)")


def access_fixture(spark):
    none = "CAST(NULL AS TIMESTAMP)"
    users = spark.sql("SELECT * FROM VALUES ('u', true), ('v', true), ('w', false) t(user_id, active)")
    members = spark.sql(f"SELECT 'u' AS user_id, 'g' AS group_id, true AS group_active, {none} AS valid_from, TIMESTAMP '2026-01-01' AS valid_until")
    roles = spark.sql(f"SELECT * FROM VALUES ('user', 'u', 'viewer', {none}, {none}), ('user', 'w', 'administrator', {none}, {none}) t(principal_type, principal_id, role_name, valid_from, valid_until)")
    things = spark.sql("SELECT * FROM VALUES ('document', 'r', true, null), ('document', 's', true, null), ('document', 'gone', false, null), ('trace', 't', true, 'u'), ('video', 'x', true, null) t(resource_type, resource_id, active, owner)")
    return users, members, roles, things


def test_access_rules(spark):
    import pyspark.sql.functions as F

    users, members, roles, things = access_fixture(spark)
    allow, read = ("user", "u", "*", "*", "allow", "*"), "document.read"

    def may(grants, user, kind, thing, action, at="2025-06-01"):
        t = F.lit(at).cast("timestamp")
        keys = access.principal_keys(users, members, t)
        asked = spark.createDataFrame([(user, kind, thing)], "user_id string, resource_type string, resource_id string")
        out = access.can(asked, keys, access.permissions(keys, roles, t), things, grants_of(spark, grants), action, t)
        return out.collect()[0].allowed

    denied = ("group", "g", "document", "r", "deny", read)
    assert may([allow], "u", "document", "r", read) and not may([allow], "u", "document", "gone", read) and not may([allow], "u", "document", "none", read)
    # a denial of the group outweighs, until the membership ends
    assert not may([allow, denied], "u", "document", "r", read) and may([allow, denied], "u", "document", "r", read, "2026-01-01")
    # no role holds the action; an inactive user has nothing
    assert not may([("user", "v", "*", "*", "allow", "*")], "v", "document", "r", read) and not may([("user", "w", "*", "*", "allow", "*")], "w", "document", "r", read)
    assert not may([allow], "u", "video", "x", "video.open") and may([allow], "u", "video", "x", "video.metadata.read")
    # an owner reads its own trace without a grant, unless one denies
    assert may([("user", "u", "video", "x", "allow", "*")], "u", "trace", "t", "trace.read_own")
    assert not may([("user", "u", "trace", "*", "deny", "*")], "u", "trace", "t", "trace.read_own")


def test_document_scopes(spark):
    import pyspark.sql.functions as F

    users, members, roles, things = access_fixture(spark)
    t = F.lit("2025-06-01").cast("timestamp")
    keys = access.principal_keys(users, members, t)
    held = access.permissions(keys, roles, t)
    docs = things.filter("active and resource_type = 'document'")

    def seen(grants):
        scope = access.document_scope(keys, held, grants_of(spark, grants), t)
        sizes = {r.user_id: r.n_documents for r in access.scope_sizes(users, scope, docs).collect()}
        listed = access.in_scope(docs.select("resource_id").crossJoin(users.select("user_id")), scope).groupBy("user_id").count().collect()
        assert {k: n for k, n in sizes.items() if n} == {r.user_id: r["count"] for r in listed}
        return sizes["u"]

    own = lambda kind, thing, effect, action: ("user", "u", kind, thing, effect, action)
    assert seen([own("*", "*", "allow", "*")]) == 2 and seen([own("document", "r", "allow", "*"), own("document", "gone", "allow", "*")]) == 1
    assert seen([own("document", "*", "allow", "*"), own("document", "r", "deny", "document.cite")]) == 1
    assert seen([own("document", "*", "allow", "*"), own("*", "*", "deny", "document.search")]) == 0
    assert seen([own("document", "*", "allow", "document.read"), own("document", "*", "allow", "document.search")]) == 0
    assert seen([own("document", "*", "allow", "document.read"), own("document", "*", "allow", "document.search"), own("document", "s", "allow", "document.cite")]) == 1


def most_rows(df):
    """The most rows that an operator of the executed plan put out."""
    conf = df.sparkSession.conf
    before = conf.get("spark.sql.adaptive.enabled")
    conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df.collect()
        nodes, most = [df._jdf.queryExecution().executedPlan()], 0
        while nodes:
            node = nodes.pop()
            rows = node.metrics().get("numOutputRows")
            most = max(most, rows.get().value() if rows.isDefined() else 0)
            nodes += [node.children().apply(k) for k in range(node.children().size())]
        return most
    finally:
        conf.set("spark.sql.adaptive.enabled", before)


def test_grants_of_a_group_are_not_multiplied_by_its_members(spark):
    import pyspark.sql.functions as F

    n, none = 300, "CAST(NULL AS TIMESTAMP)"
    t = F.lit("2025-06-01").cast("timestamp")
    users = spark.range(n).select(F.concat(F.lit("u"), "id").alias("user_id"), F.lit(True).alias("active"))
    members = users.select("user_id", F.lit("g").alias("group_id"), F.lit(True).alias("group_active"), F.expr(none).alias("valid_from"), F.expr(none).alias("valid_until"))
    roles = users.select(F.lit("user").alias("principal_type"), F.col("user_id").alias("principal_id"), F.lit("viewer").alias("role_name"), F.expr(none).alias("valid_from"), F.expr(none).alias("valid_until"))
    things = spark.range(n).select(F.lit("document").alias("resource_type"), F.concat(F.lit("r"), "id").alias("resource_id"), F.lit(True).alias("active"), F.lit(None).cast("string").alias("owner"))
    grants = [("group", "g", "document", f"r{k}", "allow", "*") for k in range(n)] + [("user", "u1", "*", "r1", "deny", "*"), ("group", "g", "document", "r2", "deny", "document.read"), ("user", "u2", "document", "*", "allow", "*")]
    grants = grants_of(spark, grants)
    keys = access.principal_keys(users, members, t)
    held = access.permissions(keys, roles, t)
    sizes = access.scope_sizes(users, access.document_scope(keys, held, grants, t), things)
    assert most_rows(sizes) < n * 20
    assert {r.user_id: r.n_documents for r in sizes.collect()} == {f"u{k}": n - (2 if k == 1 else 1) for k in range(n)}
    asked = spark.range(n).select(F.concat(F.lit("u"), "id").alias("user_id"), F.lit("document").alias("resource_type"), F.concat(F.lit("r"), "id").alias("resource_id"))
    may = access.can(asked, keys, held, things, grants, "document.read", t)
    assert most_rows(may) < n * 20
    assert {r.user_id for r in may.filter("not allowed").collect()} == {"u1", "u2"}
    opened = asked.select(F.lit(1).alias("answer"), "*", F.lit(False).alias("opened"))
    assert most_rows(access.reauthorized(opened, keys, held, things, grants, t)) < n * 20


def test_a_large_registry_is_not_copied_to_each_of_its_entities(spark):
    import json

    from evidentia.sources import json_files

    n = 6000
    text = json.dumps({"version": 3, "entities": [{"id": f"{k}", "name": f"name {k} " + "x" * 100} for k in range(n)]})
    found, _ = json_files.registry_entities(spark.createDataFrame([("p", text)], "path string, text string"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("Generate ")]
    assert "try_parse_json" not in above and "value#" not in above
    assert found.count() == n and {r.version for r in found.collect()} == {3}


def against_sql(spark, folder, name, **tables):
    """The rows of a query over tables of our own, and those of its SQL."""
    import duckdb

    from evidentia.plans import catalog

    con = duckdb.connect()
    for table, df in tables.items():
        df.coalesce(1).write.parquet(f"{folder}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    got = catalog.QUERIES[name](spark, str(folder))
    cur = con.execute(catalog.ORACLES[name])
    names = [d[0] for d in cur.description]
    return sorted((tuple(r[c] for c in names) for r in got.collect()), key=repr), sorted(map(tuple, cur.fetchall()), key=repr)


def test_quotes_prefer_the_closer_form(spark, tmp_path):
    tail = "lorem ipsum. " * 12
    texts = ["Zu und die aus de.\nlorem ipsum. " + tail, "x" * 20 + "  lorem ipsum.  " + "lorem ipsum.  " * 4 + tail, "a  b c d", "short one"]
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    got, want = against_sql(spark, tmp_path, "quote_places", documents=docs)
    assert got == want and got


def test_fractions_round_as_the_binary_values_they_are(spark, tmp_path):
    orders = spark.sql("SELECT id AS o_orderkey, id AS o_custkey, 'F' AS o_orderstatus, (id * 500 + 250) / 100D AS o_totalprice, '1-URGENT' AS o_orderpriority FROM range(2000)")
    lines = spark.sql("SELECT id AS l_orderkey, id AS l_partkey, id AS l_suppkey, 'R' AS l_returnflag, 5D AS l_quantity FROM range(10)")
    got, want = against_sql(spark, tmp_path, "state_features", orders=orders, lineitem=lines)
    assert got == want


def test_aliases_as_whole_words_without_rewriting_the_texts(spark, tmp_path):
    from evidentia.plans import catalog

    docs = spark.createDataFrame([(0, "In Africa."), (1, "africans"), (2, "éafrica"), (3, None), (4, "x_africa"), (5, "ASIA"), (6, "the middle east"), (7, "")], "doc_id long, text string")
    regions = spark.createDataFrame([(0, "AFRICA"), (1, "ASIA"), (2, "MIDDLE EAST")], "r_regionkey int, r_name string")
    got, want = against_sql(spark, tmp_path, "alias_occurrence", documents=docs, region=regions)
    assert [repr(r) for r in got] == [repr(r) for r in want]
    plan = catalog.QUERIES["alias_occurrence"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan


def test_short_documents_are_parsed_many_to_a_batch(spark):
    import pandas as pd

    from evidentia.sources import documents as d

    class Docs:
        schema = spark.range(1).selectExpr("id").schema

        def select(self, *_):
            return self

        def mapInPandas(self, run, _):
            return run

    run = d.parsed(Docs(), "id", "t", lambda text: (("prose", "", "", p) for p in text.split()))
    batches = list(run([pd.DataFrame({"k": [k, k + 500], "t": [f"a b{k}", None]}) for k in range(500)]))
    assert len(batches) == 1 and list(batches[0].itertuples(index=False))[2:4] == [(1, 0, "prose", "", "", "a"), (1, 1, "prose", "", "", "b1")]
    long = list(run([pd.DataFrame({"k": [1], "t": ["x" * 1000 + " "]}) for k in range(5000)]))
    assert sum(map(len, long)) == 5000 and max(map(len, long)) * 1000 <= d.BATCH_CHARS + 2000


def test_references_keep_the_parts_that_their_number_asks_for(spark, monkeypatch):
    from evidentia.plans import graph_queries
    from evidentia.plans.registry import Tables

    x = Tables(spark, "/root/testdata/sf0.001")
    monkeypatch.setattr(graph_queries, "_ROWS", 400)
    parts = graph_queries._parts(x)
    assert parts == -(-x.lineitem.count() // 400) > 4
    blocks, found = graph_queries._resolved(x)
    assert blocks.rdd.getNumPartitions() == parts and found.rdd.getNumPartitions() == parts
    assert graph_queries._closed(x)[1].rdd.getNumPartitions() == parts
