"""Documents of more than a thousand lines, whose blocks take ids of the document after them: queries against their SQL."""

import duckdb
import pytest

from evidentia.plans import catalog

from .test_oracles import SF, plain


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("long")
    for t in ("orders", "lineitem"):
        duckdb.sql(f"COPY (SELECT * FROM '{SF}/{t}.parquet') TO '{path}/{t}.parquet'")
    # of twelve documents two hold all texts, one after the other
    whole = f"(SELECT string_agg(text, chr(10) ORDER BY doc_id) FROM '{SF}/documents.parquet')"
    duckdb.sql(f"COPY (SELECT doc_id - 40 AS doc_id, CASE WHEN doc_id % 6 = 1 THEN {whole} ELSE text END AS text, lang, source, n_chars FROM '{SF}/documents.parquet' WHERE doc_id BETWEEN 40 AND 51) TO '{path}/documents.parquet'")
    return str(path)


@pytest.mark.parametrize("name", ["bound_evidence", "validated_evidence", "recovered_excerpts", "excerpt_overrides", "qualified_answers"])
def test_blocks_that_share_an_id(spark, folder, name):
    con = duckdb.connect()
    for t in ("orders", "lineitem", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    assert con.execute("SELECT max(len(string_split(text, chr(10)))) FROM documents").fetchone()[0] > 1100
    df = catalog.QUERIES[name](spark, folder)
    cur = con.execute(catalog.ORACLES[name])
    names = [d[0] for d in cur.description]
    want = sorted(repr(tuple(plain(r[names.index(c)]) for c in df.columns)) for r in cur.fetchall())
    assert sorted(repr(tuple(plain(v) for v in r)) for r in df.collect()) == want
