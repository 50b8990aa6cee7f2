"""The registered queries, columns and types included, against brute force over whole tables."""

import os

import pytest

from evidentia.llm import queries

from . import reference as ref

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def docs(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


def rows(df, *columns):
    return {r[0]: tuple(r)[1:] for r in df.select(*columns).collect()}


def typed(df, **kinds):
    have = dict(df.dtypes)
    assert {k: have[k] for k in kinds} == kinds


def test_op3(spark, docs):
    out = queries.op3_simhash(spark, SF)
    typed(out, doc_id="bigint", fingerprint="string", component_id="bigint")
    want = {d: (f"{f:016x}", root) for d, (f, root) in ref.simhash(docs, 3, 3).items()}
    assert rows(out, "doc_id", "fingerprint", "component_id") == want


def test_op4(spark):
    pages = [(r.page_id, (r.html or "").encode()) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    first = {}
    for page, payload in sorted(pages):
        first.setdefault(payload, page)
    want = {p: (len(b), ref.base32_sha1(b), "response" if first[b] == p else "revisit", None if first[b] == p else first[b]) for p, b in pages}
    out = queries.op4_warc(spark, SF)
    typed(out, page_id="bigint", payload_bytes="bigint", payload_digest="string", record_type="string", refers_to="bigint")
    assert rows(out, "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == want


def test_op5_and_op10(spark, docs):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(queries.vocabulary())
    full = {d: ref.tokens(lib, t) for d, t in docs}
    counts = queries.op5_token_counts(spark, SF)
    typed(counts, doc_id="bigint", n_bytes="bigint", n_tokens="bigint", over_limit="boolean")
    assert rows(counts, "doc_id", "n_bytes", "n_tokens", "over_limit") == {d: (len((t or "").encode()), full[d][0], full[d][0] > 2048) for d, t in docs}
    ids = queries.op10_segment_bpe(spark, SF)
    typed(ids, doc_id="bigint", n_tokens="bigint", ids_sha256="string", decoded_sha256="string")
    assert rows(ids, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == full


def test_op6(spark, docs):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    out = queries.op6_decontaminate(spark, SF)
    typed(out, doc_id="bigint", n_words="bigint", n_hit="bigint", n_items="bigint", items_sha256="string", contaminated="boolean")
    assert rows(out, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == ref.contamination(docs, items)


def test_op7(spark, docs):
    out = queries.op7_pii(spark, SF)
    typed(out, doc_id="bigint", n_email="bigint", n_ip="bigint", n_card="bigint", n_phone="bigint", base_sha256="string", spans="string")
    shown = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
    every, want = ref.all_spans(docs), {}
    for d, t in docs:
        base = ref.base_spans(t)
        order = ("email", "ip", "card", "phone")
        want[d] = (*[sum(k == n for k, *_ in base) for n in order], ref.sha(shown(base)), shown(every[d]))
    assert rows(out, "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans") == want


def test_op9(spark, docs):
    out = queries.op9_license_scan(spark, SF)
    got = rows(out, "doc_id", "n_paragraphs", "n_licence_paragraphs", "n_confirmed", "families")
    assert set(got) == {d for d, _ in docs}
    for d, t in docs:
        n, licences, confirmed, families = got[d]
        assert n == sum(1 for x in (t or "").split("\n") if x) and confirmed <= licences <= n and (families == "") == (confirmed == 0)
