"""The pipeline, stage by stage, against the plain versions; and the registered queries against the SQL there is."""

import os

import duckdb
import pytest

import corpus_pipeline as cp
from evidentia.llm import quality_rules, queries

from . import reference as ref

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    now, columns = docs, docs.columns
    rows = {r.doc_id: r.text for r in now.collect()}
    for name, stage in cp.STAGES[:-1]:
        out = cp.stored(stage(spark, now, SF), "test")
        assert out.columns == columns
        got = {r.doc_id: r.text for r in out.collect()}
        pairs = sorted(rows.items())
        if name == "quality rules":
            kept = {r.doc_id for r in quality_rules.judge(now).filter("kept").collect()}
            want = {d: t for d, t in pairs if d in kept}
            assert all(not ref.quality(t)[-1] for t in want.values())
        elif name == "line dedup":
            want = {d: t for d, t in ref.dedup_lines(pairs, runs=True).items() if t.strip(" \t\n\r\x0b\x0c")}
        elif name == "near duplicates":
            group = ref.similar(pairs)
            want = {d: t for d, t in pairs if group[d] == d}
        else:
            hit = ref.contamination(pairs, bench)
            want = {d: t for d, t in pairs if not hit[d][-1]}
        assert got == want, name
        now, rows = out, got
    lib = Tokenizer.from_file(queries.vocabulary())
    last = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in cp.STAGES[-1][1](spark, now, SF).collect()}
    assert last == {d: ref.tokens(lib, t) for d, t in rows.items()}
    assert {r.doc_id for r in cp.run(spark, SF).collect()} == set(last)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    cur = con.execute(queries.ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(tuple(r[names.index(c)] for c in cols) for r in cur.fetchall()) == sorted(tuple(r[c] for c in cols) for r in df.collect())


def awkward(spark, folder):
    """A folder with awkward documents and a small benchmark; returns the expected ids of what stays before the last stage."""
    word = lambda d: " ".join(f"the {d}w{k} of" for k in range(30))
    rows = [
        (1, word("a"), "x", None), (1, word("a"), "x", None), (2, word("a").upper() + ".", "y", 1), (None, word("a"), "x", 2), (None, word("b"), "x", 3), (None, word("b"), "x", 3), (3, None, "x", 4), (4, "", "x", 5), (5, " \n\t", "x", 6),
        (6, "too short", "x", 7), (7, word("c") + " alpha beta gamma delta epsilon zeta eta theta iota kappa lambda", "x", 8), (8, "\n".join(f"the a{k} b{k} of c{k} d{k} and e{k} f{k}" for k in range(20_000)), "x", 9), (9, word("d"), None, 10),
    ]
    docs = spark.createDataFrame([(d, t, a, b, len(t or ""), "p", None) for d, t, a, b in rows], "doc_id long, text string, lang string, source long, n_chars long, fingerprint string, spans string")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, "beta gamma delta epsilon zeta eta theta iota kappa lambda"), (2, None), (None, "no such words here at all")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_awkward_rows_and_empty_tables(spark, tmp_path):
    folder = str(tmp_path / "in")
    awkward(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = docs
    for _, stage in cp.STAGES[:-1]:
        out = cp.stored(stage(spark, out, folder), "test")
        assert out.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in out.collect()) == [(False, 1), (False, 8), (False, 9), (True, 0)]
    assert sorted(str(r.doc_id) for r in cp.run(spark, folder).collect()) == ["1", "8", "9", "None"]
    none = docs.filter("false")
    for _, stage in cp.STAGES:
        assert stage(spark, none, folder).count() == 0
    bench = str(tmp_path / "none")
    spark.read.parquet(f"{folder}/benchmark.parquet").filter("false").write.parquet(f"{bench}/benchmark.parquet")
    assert cp.STAGES[3][1](spark, docs, bench).count() == docs.count()


def test_entry_works_without_the_subpackage(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[2]
    shutil.copytree(root / "evidentia", tmp_path / "evidentia", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; n = e.queries(); assert 'vocabulary_df' in n and not any(x.startswith('op') or x == 'pipeline' for x in n); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": os.environ["PATH"], "HOME": str(tmp_path)})


def test_columns_of_any_name_pass_the_line_stage(spark):
    same = "\n".join(f"line {k} " + "word " * 30 for k in range(4))
    rows = [(1, same, 777, "x", 9), (2, same + "\nown line of this one", 888, "y", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_lines int, `a.b` string, n_removed_chunks int")
    out = cp.lines(spark, docs, SF)
    assert out.columns == docs.columns
    got = sorted((r.doc_id, r.n_lines, r["a.b"], r.n_removed_chunks, r.text) for r in out.collect())
    assert got == [(1, 777, "x", 9, same), (2, 888, "y", 9, "own line of this one")]
