"""Steps that must not carry texts, or all they read, through exchange after exchange."""

import re

from pyspark.sql import functions as F

from evidentia.operators import evidence as e
from evidentia.operators import packets as p
from evidentia.operators import structure as s
from evidentia.sources import json_files as j


def exchanges(df) -> list[str]:
    """The columns that go into each exchange of the plan."""
    df.sparkSession.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        shown = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    finally:
        df.sparkSession.conf.set("spark.sql.adaptive.enabled", "true")
    return re.findall(r"\(\d+\) Exchange\nInput \[\d+\]: \[(.*?)\]\n", shown)


def test_heads_are_found_where_a_document_stands(spark):
    texts = ["no head of its own\nab\nlong enough line\nabcd\nabcde\n\n  x \nlong enough again", "ab", "", None, "a long line alone", "abcd\nab\nab"]
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    out = s.headed_blocks(docs, 5, 2)
    want = set()
    for d, t in enumerate(texts):
        section = top = None
        for k, line in enumerate([x.strip(" ") for x in (t or "").split("\n") if x.strip(" ")]):
            section, top = k if len(line) <= 5 else section, k if len(line) <= 2 else top
            want.add((d, k, line, section, top))
    assert {tuple(r) for r in out.collect()} == want
    assert not exchanges(out)


def test_evidence_moves_a_text_once(spark):
    blocks = spark.createDataFrame([(1, 7, 0, 0, "prose", "block 0", "some text", "x", "")], "block long, doc long, section long, ordinal long, kind string, locator string, text string, sha256 string, flags string")
    docs = spark.createDataFrame([(7, "t", "h", "p")], "doc long, title string, source_sha256 string, path string")
    sections = spark.createDataFrame([(7, 0, "p")], "doc long, section long, path string")
    rows = spark.createDataFrame([(1, 1, 7, 0, 4, "some")], "id long, block long, doc long, start long, end long, text string")
    cited = spark.createDataFrame([(7, "S1", 7, 1, "p", "some", "y", "block 0", "c")], "answer long, source string, doc long, block long, path string, quote string, quote_sha256 string, locator string, card string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for out in (e.validated_evidence(rows, blocks, docs, sections, docs.select("doc")).select("id", "verdict"), e.bound_evidence(cited, blocks, docs, docs.select(F.col("doc").alias("answer"), "doc")).select("block", "verdict")):
            moved = exchanges(out)
            assert moved and sum(bool(re.search(r"\b(b_)?text#", c)) for c in moved) <= 1
            assert sum("quote#" in c for c in moved) <= 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_units_of_answers_are_trimmed_of_white_space_alone(spark):
    text = "\n".join([" one \x85", "", "\t- two", "3. three", "3.. four", "12.", "- ", "-five"])
    rows = p.answer_parts(spark.createDataFrame([(1, text)], "answer long, text string")).orderBy("unit").collect()
    # white space that ends a unit goes; U+0085 is none here, and what stands before it stays
    assert [(r.start, r.text) for r in rows] == [(1, "one \x85"), (9, "- two"), (15, "3. three\n3.. four"), (33, "12."), (37, "- \n-five")]


def test_cases_keep_the_parts_that_their_number_asks_for(spark, monkeypatch):
    from evidentia.plans import case_queries
    from evidentia.plans.registry import Tables

    x = Tables(spark, "/root/testdata/sf0.001")
    monkeypatch.setattr(case_queries, "_CASES", 20)
    parts = case_queries._parts(x)
    assert parts == -(-x.part.count() // 20) > 4
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = case_queries.closure_cases(x)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    # no step sorts or gathers a fixed share of all blocks
    assert {int(n) for n in re.findall(r"hashpartitioning\([^)]*, (\d+)\)", plan)} == {parts}


def test_manifests_and_their_files_meet_where_the_lines_are_dealt(spark, monkeypatch):
    from evidentia.plans import graph_queries, source_queries
    from evidentia.plans.registry import Tables

    x = Tables(spark, "/root/testdata/sf0.001")
    monkeypatch.setattr(graph_queries, "_ROWS", 400)
    out = source_queries.manifest_issues(x)
    # lines move, by their order's path; no digest or text of a manifest does
    moved = exchanges(out)
    assert moved and len(set(map(lambda c: re.sub(r"#\d+L?", "", c), moved))) == 1
    assert all("l_partkey" in c and "sha256" not in c and "text" not in c for c in moved)
    assert out.rdd.getNumPartitions() == graph_queries._parts(x) > 4


def test_manifests_of_any_layout_meet_their_files_by_name(spark):
    files = spark.createDataFrame([("m", '{"files": [{"path": "a", "bytes": 1, "sha256": "s"}, {"path": "b"}]}'), ("n", "{,}"), ("o", "{}")], "path string, text string")
    found = spark.createDataFrame([("m", "a", 1, "s"), ("m", "c", 1, "s"), ("m", None, 1, "s"), ("n", "a", 1, "s"), ("o", "a", 1, "s"), ("q", "a", 1, "s"), (None, "a", 1, "s")], "path string, name string, bytes long, sha256 string")
    out = j.manifest_issues(files.repartition(3), found.repartition(5), {}, ("c", "d"))
    assert len(exchanges(out)) <= 4
    want = [("m", "missing:b"), ("m", "omits:c"), ("m", "omits:d"), ("m", "unlisted:c"), ("n", "invalid_json"), ("o", "omits:c"), ("o", "omits:d"), ("o", "unlisted:a")]
    assert sorted(tuple(r) for r in out.collect()) == want
