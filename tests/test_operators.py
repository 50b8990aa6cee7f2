"""Operators on small fixtures with awkward rows: policies, surfaces, layout, releases, generations, streams' shared folder."""

import pytest
from pyspark.sql import functions as F

from evidentia.functions import spans
from evidentia.functions import text as t
from evidentia.operators import access, answers, learning, structure
from evidentia.session import shared_dir
from evidentia.sources import documents as d
from evidentia.sources import generations as g


def test_ridge_weights_match_a_direct_solution(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 3))
    y = x @ [1.0, -2.0, 0.5] + 0.01 * rng.normal(size=60)
    rows = spark.createDataFrame([("a", r.tolist(), float(v)) for r, v in zip(x, y)], "action string, x array<double>, y double")
    out = learning.solved(learning.moments(rows, "action", "x", "y", 3), "action").collect()[0]
    want = np.linalg.solve(np.eye(3) + x.T @ x, x.T @ y)
    assert np.allclose(out.weights, want) and np.isclose(out.residual, y @ y - (x.T @ y) @ want)


def test_contexts(spark):
    f = learning.encoded(F.col("s"), ["a", "b"], [learning.fraction(F.col("n"), F.col("m"))])
    rows = spark.createDataFrame([("a", 1, 2), ("c", 5, 0), ("b", -1, 4)], "s string, n int, m int").select(f.alias("f"))
    assert [r.f for r in rows.collect()] == [[1.0, 1.0, 0.0, 0.5], [1.0, 0.0, 0.0, 1.0], [1.0, 0.0, 1.0, 0.0]]
    assert [r[0] for r in rows.select(learning.valid_context(F.col("f"), 4)).collect()] == [True] * 3


def test_policy_states_refuse_what_does_not_follow(spark):
    events = [(1, k, s) for k, s in enumerate(["promote", "candidate", "promote", "candidate", "rollback", "rollback"])]
    out = learning.policy_states(spark.createDataFrame(events, "p long, n long, kind string"), "p", "n", "kind").collect()
    assert [(r.state, r.version) for r in out] == [("rolled_back", 3)]


def test_literal_surfaces():
    text = "Mail a.b@c.org on 2024-05-06 or 6.5.2024: 12,5 % of EUR 1 200.50, form AB-12/7, call +358 40 123 4567, says NATO and Anna Maria Virtanen; 42."
    got = {}
    for kind, shown in spans.literal_surfaces(text):
        got.setdefault(kind, []).append(shown)
    assert got["email"] == ["a.b@c.org"] and got["date"] == ["2024-05-06", "6.5.2024"] and got["percent"] == ["12,5 %"] and got["currency"] == ["EUR 1 200.50"]
    assert got["identifier"] == ["AB-12/7"] and "+358 40 123 4567" in got["phone"] and "NATO" in got["acronym"] and got["proper_phrase"] == ["Anna Maria Virtanen"] and "42" in got["number"]
    assert spans.literal_surfaces("") == []


def test_surface_forms():
    assert spans.corpus_surface("  Ｆｕｌｌ‑width  Straße’s ") == "full-width strasse's" and spans.identity_surface("Ｆｕｌｌ  O’Neil") == "Full O'Neil"
    assert spans.question_surfaces('Who wrote "The  Plan" for Anna\'s ABC-12 unit?') == ["The Plan", "Anna", "ABC-12", "Anna's", "unit", "wrote", "The", "Plan"] or spans.question_surfaces('Who wrote "The  Plan"?')[0] == "The Plan"
    assert len(spans.question_surfaces(" ".join(f"word{k}" for k in range(80)))) == 32


def test_layout_tables_need_a_digit_below_the_header(spark):
    pages = {1: ["Name  Qty", "bolt  4", "nut  7"], 2: ["Name  Qty", "bolt  few", "nut  some"], 3: ["a1  b", "c  d", "e  f"], 4: ["x  1", "y  2"], 5: ["a  1", "b  2  3  4", "c  5"], 6: ["h  i", "plain", "j  1", "k  2", "l  3"]}
    rows = [(p, n, line) for p, lines in pages.items() for n, line in enumerate(lines)]
    tables = structure.table_groups(spark.createDataFrame(rows, "doc_id long, ordinal long, block_text string"))
    assert sorted({(r.doc_id, r.table) for r in tables.collect()}) == [(1, 0), (6, 2)]
    shown = {(r.doc_id, r.ordinal): r.block_text for r in structure.table_row_blocks(tables).collect()}
    assert shown[1, 0] == "Name | Qty" and shown[1, 2] == "Name: nut; Qty: 7"


def test_spatial_text(spark):
    boxes = [(1, 50.0, 1.0, 60.0, 11.0, "b"), (1, 0.0, 0.0, 10.0, 10.0, "a"), (1, 0.0, 40.0, 10.0, 50.0, "c"), (2, 0.0, 0.0, 5.0, 5.0, None)]
    out = {r.page: r.text for r in structure.spatial_text(spark.createDataFrame(boxes, "page long, x0 double, y0 double, x1 double, y1 double, text string")).collect()}
    assert out[1] == "a    b\nc"


@pytest.mark.parametrize(("line", "marker"), [("- a", "-"), ("* a", "*"), ("+", "+"), ("12) a", "12)"), ("1234567890. a", None), ("-a", None), ("---", None), ("* * *", None), ("1.5 a", None), ("", None), ("   3. x", "3.")])
def test_list_markers(line, marker):
    assert d.list_marker(line) == marker


def test_delimiter_rows():
    assert d.delimiter_row("|---|:-:|", 2) and d.delimiter_row("- | -", 2) and not d.delimiter_row("|---|", 2) and not d.delimiter_row("| a | - |", 2)


def test_definitions_with_orphans():
    found = [(k, x) for k, _, _, x in d.html_blocks("<dl><dd>alone</dd><dt>a</dt><dt>b</dt><dd>c</dd><dd>d</dd><dt>lost</dt></dl><table><tr><td><pre>x  y\n z</pre></td></tr></table><p>end</p>")]
    assert found == [("orphan_description", "alone"), ("definition", "a; b: c"), ("definition", "a; b: d"), ("orphan_term", "lost"), ("table_row", "x  y\n z"), ("prose", "end")]


def test_generations_are_numbered(spark, tmp_path):
    root = str(tmp_path / "g")
    for n in ("a", "b"):
        g.publish(spark.createDataFrame([(n,)], "name string"), root, n)
    assert g.current(spark, root).first()[0] == "b" and g.rolled_back(spark, root) == "a" and g.current(spark, root).first()[0] == "a"
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        g.publish(spark.createDataFrame([("x",)], "name string"), root, "a")


def test_release_screens(spark):
    rows = spark.createDataFrame([("src/a.py",), ("/abs/a.py",), ("a/../b.py",), ("x/.git/c.py",), ("a.exe",), ("secrets/k.json",), (None,)], "p string")
    assert [bool(r[0]) for r in rows.select(t.releasable(F.col("p"))).collect()] == [True] + [False] * 6


def test_citations_and_merges(spark):
    blocks = spark.createDataFrame([("d", 0, "hello world")], "doc string, ordinal int, block_text string")
    cites = spark.createDataFrame([(1, "d", 0, 0, 5, "hello"), (2, "d", 0, 0, 5, "Hello"), (3, "d", 1, 0, 1, "h"), (4, "d", 0, 6, 99, "world"), (5, "x", 0, 0, 1, "h"), (6, "d", 0, 3, 3, "")], "c int, doc string, ordinal int, start int, end int, quote string")
    assert {r.c: r.verdict for r in answers.bound_citations(cites, blocks).collect()} == {1: "ok", 2: "text differs", 3: "unknown block", 4: "outside", 5: "unknown block", 6: "outside"}
    rows = spark.createDataFrame([("q", k, s, p, c) for k, (s, p, c) in enumerate([("a", True, 90), ("b", False, 50), ("c", False, 5), ("a", False, 1), ("d", False, 6)])], "q string, n int, span string, prior boolean, cost long")
    assert [(r.span, r.alias, r.used) for r in answers.merged_evidence(rows, "q", "n", "span", 100, 9).orderBy("alias").collect()] == [("a", "P1", 90), ("c", "P2", 95)]


def test_revisions_are_numbered_across_blocks(spark):
    rows = spark.createDataFrame([(k * 3, k % 4) for k in range(40)], "w long, s long")
    out = access.revised(rows, "w", ["s"], block=10).orderBy("w").collect()
    assert [r.revision for r in out] == [*range(1, 41)] and sum(r["last"] for r in out) == 4


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, *_):
            return None

    class Spark:
        conf = Conf()
        sparkContext = type("C", (), {"master": "yarn", "getConf": lambda self=None: Conf()})()

    with pytest.raises(ValueError, match="checkpoint"):
        shared_dir(Spark())


def test_dense_lanes_in_blocks_scan_once(spark, monkeypatch, tmp_path):
    import numpy as np

    from evidentia.operators import retrieval

    rng = np.random.default_rng(3)
    path = str(tmp_path / "v")
    rows = [(k, [float(x) for x in rng.integers(-3, 4, 6)]) for k in range(400)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3).write.parquet(path)
    v = spark.read.parquet(path)
    asked = v.filter("vec_id % 9 = 0").select(v["vec_id"].alias("query_id"), "embedding")
    want = set()
    for q, e in rows[::9]:
        scores = sorted(((-round(float(np.dot(e, x)), 9), k) for k, x in rows))[:10]
        want |= {(q, k, -s, n) for n, (s, k) in enumerate(scores, 1)}
    monkeypatch.setattr(retrieval, "SLAB", 64)
    monkeypatch.setattr(retrieval, "SCORES", 500)
    out = retrieval.dense(v, asked, lane=10, block=7)
    assert {(r.query_id, r.vec_id, r.score, r["rank"]) for r in out.collect()} == want
    assert out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("FileScan") == 1
    assert retrieval.dense(v, asked.limit(0)).count() == 0 and retrieval.dense(v.limit(0), asked).count() == 0


@pytest.mark.parametrize("small", [0, 512])
def test_lexical_lanes_with_bounded_candidates(spark, small):
    import math
    import random

    from evidentia.operators import retrieval

    rng = random.Random(9)
    word = lambda: "the" if rng.random() < 0.4 else f"w{int(rng.paretovariate(0.7)) % 900}"
    docs = [(k, " ".join(word() for _ in range(rng.randrange(0, 60)))) for k in range(1800)]
    asked = [(q, "the " + " ".join(word() for _ in range(rng.randrange(1, 9)))) for q in range(25)] + [(99, ""), (100, "the"), (101, "nowhere")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    queries = spark.createDataFrame(asked, "query_id long, text string")
    tokens = {d: t.split() for d, t in docs}
    mean = sum(map(len, tokens.values())) / len(tokens)
    df = {}
    for t in tokens.values():
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    want = set()
    for q, text in asked:
        scores = {}
        for d, t in tokens.items():
            parts = [math.log(1 + (len(docs) - df[w] + 0.5) / (df[w] + 0.5)) * t.count(w) * 2.2 / (t.count(w) + 1.2 * (0.25 + 0.75 * len(t) / mean)) for w in set(text.split()) if w in t]
            if parts:
                scores[d] = round(sum(parts), 9)
        want |= {(q, d, s, n) for n, (s, d) in enumerate(sorted((-s, d) for d, s in scores.items())[:20], 1)}
    got = {(r.query_id, r.doc_id, -r.score, r["rank"]) for r in retrieval.bm25(frame, queries, lane=20, small=small).collect()}
    close = lambda rows: {(q, d, round(s, 7), n) for q, d, s, n in rows}
    assert close(got) == close(want)
    pairs = retrieval.lexical_candidates(*retrieval.scored_terms(frame, queries), 20)
    every = sum(1 for q, text in asked for t in tokens.values() if set(text.split()) & set(t))
    assert pairs.count() < every / 2


def test_words_of_a_passage_are_taken_once(spark):
    """The words of a text are one expression of the plan, outside of every lambda that runs for each window or length."""
    from evidentia.operators import retrieval

    docs = spark.createDataFrame([(1, " ".join(f"w{k}" for k in range(300))), (2, ""), (3, None), (4, "One two")], "doc_id long, text string")
    p = retrieval.passages(docs)
    assert p._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1
    assert sorted((r.doc_id, r.seq, r.word_start, r.word_end) for r in p.collect()) == [(1, 0, 0, 160), (1, 1, 128, 288), (1, 2, 256, 300), (4, 0, 0, 2)]
    e = docs.select("doc_id", retrieval.letter_vector(4)(docs["text"]).alias("e"))
    assert "lambdafunction(regexp_extract_all" not in e._jdf.queryExecution().analyzed().toString().replace("size(", "")
    got = {r.doc_id: r.e for r in e.collect()}
    norm = (3 * 0.2**2 + 2.2**2) ** 0.5
    assert got[4] == [0.2 / norm, 0.2 / norm, 0.2 / norm, 2.2 / norm] and got[2] == got[3] == [0.5] * 4


def test_only_documents_with_a_hit_are_placed(spark, monkeypatch):
    """Neighbours are sought for the documents of hits alone."""
    from evidentia.operators import retrieval
    from evidentia.plans import passage_queries
    from evidentia.plans.registry import Tables

    seen = []
    plain = retrieval.neighbours
    monkeypatch.setattr(retrieval, "neighbours", lambda p, row: seen.append(p) or plain(p, row))
    monkeypatch.setattr(passage_queries.r, "search", lambda p, q, e, limit=32, k=60: p.selectExpr("0L as question", "key", "1.0D as score", "1L as rank").filter("key = (select min(key) from {p})".replace("{p}", "_p")) if p.createOrReplaceTempView("_p") is None else None)
    hits = passage_queries._hits(Tables(spark, "/root/testdata/sf0.001")).collect()
    assert len(hits) == 1 and {r.doc for r in seen[0].select("doc").distinct().collect()} == {hits[0].doc}


def test_lexical_lane_by_matrix_products(spark):
    """Slabs and blocks of queries of any size give the lane of the joins, ties included; documents without a term stay out."""
    from evidentia.operators import retrieval

    words = [f"w{k}" for k in range(12)]
    docs = spark.createDataFrame([(d, " ".join(words[(d * k) % 12] for k in range(1, 2 + d % 5)) if d % 9 else "none") for d in range(120)], "doc_id long, text string")
    asked = spark.createDataFrame([(q, f"w{q} w{(q + 3) % 12} w5") for q in range(12)], "query_id long, text string")
    rows = lambda d: sorted((r.query_id, r.doc_id, round(r.score, 8), r["rank"]) for r in d.collect())
    want = rows(retrieval.bm25(docs, asked, lane=7, small=1000))
    assert rows(retrieval.bm25(docs, asked, lane=7, small=0)) == want
    own, terms = retrieval.scored_terms(docs, asked)
    assert rows(retrieval.ranked(retrieval.lexical_lane(own, terms, 7, block=5, slab=11), "doc_id", 7)) == want
    assert "rest" not in retrieval.bm25(docs, asked, lane=7, small=0)._jdf.queryExecution().optimizedPlan().toString()


def test_folded_words_come_a_few_texts_at_a_time(spark):
    """The words of a text are rows as they are found: no column holds the word lists of a batch."""
    from evidentia.plans import catalog

    class X:
        documents = spark.createDataFrame([(d, t) for d, t in enumerate(["Straße STRASSE", None, "", *["ﬁn fin a"] * 150])], "doc_id long, text string").repartition(1)

    df = catalog.QUERIES["folded_vocabulary"].__closure__[0].cell_contents(X)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert {(r.term, r.df) for r in df.collect()} == {("strasse", 1), ("fin", 150), ("a", 150)}
    assert "ArrowEvalPython" not in plan
