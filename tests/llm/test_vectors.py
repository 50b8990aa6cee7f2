"""Whitening and hard negatives against brute force over all rows, chunk tables against the library."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidentia.llm import chunk_table, hard_negatives, queries, whitening

from . import reference as ref

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<double>, label int"


def whole(rows):
    """(id, label, integers) of the rows whose vectors are complete, filled up to one length."""
    part = [r for r in rows if r[1] is not None and all(c is not None and np.isfinite(c) for c in r[1])]
    width = max((len(r[1]) for r in part), default=0)
    return [(r[0], r[2], [int(np.floor(256 * float(c))) for c in r[1]] + [0] * (width - len(r[1]))) for r in part]


def check_whitened(rows, out):
    part = whole(rows)
    fit = sorted({tuple(x) for _, _, x in part})
    n, width = len(fit), len(fit[0])
    sums = [sum(x[k] for x in fit) for k in range(width)]
    v = np.cov(np.array(fit, float).T.reshape(width, -1), bias=True).reshape(width, width)
    values, axes = np.linalg.eigh(v)
    values, axes = values[::-1], axes[:, ::-1]
    own = {}
    for r in out:
        own.setdefault(r.component, []).append(r)
    assert sorted(own) == [*range(1, min(4, width) + 1)]
    for c, got in own.items():
        assert len(got) == len(part) and {r.n for r in got} == {n}
        # both in the order of ids and then of results, as ids may repeat
        z = [float((np.array(x) - np.array(sums) / n) @ axes[:, c - 1] / np.sqrt(values[c - 1])) for _, _, x in part]
        exact = [sum((n * a - s) ** 2 for a, s in zip(x, sums)) for _, _, x in part]
        key = lambda i: -1 if i is None else i
        for sign in (1, -1):
            want = sorted((key(p[0]), d, round(sign * w, 6) + 0.0) for p, d, w in zip(part, exact, z))
            have = sorted((key(r.vec_id), int(r.deviation), round(r.whitened, 6) + 0.0) for r in got)
            if np.allclose(np.array(want, float), np.array(have, float), atol=2e-6):
                break
        else:
            raise AssertionError(c)
        assert abs(got[0].explained - values[c - 1] / values.sum()) < 1e-9
        assert got[0].identity_error < 1e-9


def test_op11_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    out = queries.op11_whitening(spark, SF)
    assert dict(out.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    check_whitened(rows, out.collect())


def test_whitening_of_awkward_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(k if k % 9 else None, [float(c) for c in rng.normal(size=rng.choice([0, 2, 5, 5, 5]))], None) for k in range(200)]
    rows += [*rows[:40], (7, None, 1), (8, [1.0, None], 1), (9, [float("nan")] * 5, 1), (10, [float("-inf")], 1)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"n": F.lit(5), "a.b": F.lit(1)}).repartition(7)
    out = whitening.whiten(df)
    assert "a.b" in out.columns and out.columns.count("n") == 1
    check_whitened(rows, out.collect())


@pytest.mark.parametrize("rows", [[], [(1, [], 1)], [(1, None, 1)]])
def test_whitening_without_components(spark, rows):
    assert whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect() == []


def test_whitening_without_spread(spark):
    rows = [(1, [1.0, 2.0], 1), (2, [1.0, 2.0], 1)]
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained) for r in got) == [(i, c, 1, 0, None, None) for i in (1, 2) for c in (1, 2)]
    one = spark.createDataFrame([(1, [1.0, 2.0], 1), (2, [3.0, 2.0], 1)], SCHEMA)
    got = {(r.vec_id, r.component): r for r in whitening.whiten(one).collect()}
    assert abs(got[1, 1].whitened) == pytest.approx(1) and got[1, 2].whitened is None and got[1, 1].explained == 1


def test_digit_slices_are_exact():
    rng = np.random.default_rng(0)
    for low, high in ((-3, 4), (-(2**40), 2**40), (-(2**63), 2**63 - 1)):
        y = rng.integers(low, high, (40, 5), endpoint=False)
        for m in (y, y.astype(object) * 10**12):
            assert (whitening.gram(m) == m.astype(object).T @ m.astype(object)).all()
            assert (sum(p.astype(object) * (1 << (20 * k)) for k, p in enumerate([q.astype(np.int64) for q in whitening.limbs(m)])) == m).all()
    for v in (0, -1, 1, 2**40, -(2**40), -(2**80) - 3, 10**30):
        assert sum(p << (40 * k) for k, p in enumerate(whitening.parts_of(v))) == v


def negatives(rows, mod):
    part = whole([r for r in rows if r[2] is not None])
    label = [(b + 1) % 10 if i is not None and i % 7 == 0 else b for i, b, _ in part]
    x = np.array([p[2] for p in part], np.int64).reshape(len(part), -1)
    key = [2**63 if i is None else i for i, _, _ in part]
    out = []
    for a, (i, _, _) in enumerate(part):
        if i is None or i % mod:
            continue
        s = x @ x[a]
        order = sorted(range(len(part)), key=lambda k: (-s[k], key[k]))
        for p in [k for k in order if k != a and label[k] == label[a]][:5]:
            found = [k for k in order if label[k] != label[a] and 80 * s[p] <= 100 * s[k] <= 100 * s[p]][:5]
            out += [(i, part[p][0], r, part[k][0], int(s[p]), int(s[k])) for r, k in enumerate(found, 1)]
    return sorted(out, key=str)


def mined(out):
    return sorted(((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in out.collect()), key=str)


def test_op13_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    out = queries.op13_hard_negatives(spark, SF)
    kinds = dict(out.dtypes)
    assert kinds.pop("positive_rank") == kinds.pop("rank") == "int" and set(kinds.values()) == {"bigint"}
    got = mined(out)
    assert got == negatives(rows, 100) and got


@pytest.mark.parametrize("slab", [8192, 64])
def test_hard_negatives_of_awkward_rows(spark, monkeypatch, slab):
    rng = np.random.default_rng(slab)
    part = lambda: None if rng.random() < 0.004 else float("nan") if rng.random() < 0.004 else float(rng.integers(-3, 4)) / 256
    rows = []
    for _ in range(500):
        vector = None if rng.random() < 0.03 else [part() for _ in range(int(rng.choice([0, 2, 3, 3, 3])))]
        rows.append((None if rng.random() < 0.03 else int(rng.integers(0, 300)), vector, None if rng.random() < 0.05 else int(rng.integers(0, 3))))
    rows += rows[:50]
    monkeypatch.setattr(hard_negatives, "SLAB", slab)
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"row": F.lit("x"), "_id": F.lit(None), "score": F.lit(1)}).repartition(5)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    assert mined(hard_negatives.mine(df, F.col("vec_id") % 10 == 0, label=label)) == negatives(rows, 10)


@pytest.mark.parametrize("rows", [[], [(0, None, 1)], [(0, [1.0], 1)], [(0, [1.0], 1), (5, [1.0], 2)]])
def test_hard_negatives_of_few_rows(spark, rows):
    assert hard_negatives.mine(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") == 0).collect() == []


def test_bounds_hold():
    rng = np.random.default_rng(2)
    x = rng.integers(-300, 300, (500, 8))
    import pyarrow as pa

    edges = []
    for j in range(8):
        starts = np.unique(np.quantile(x[:, j], [0, 0.2, 0.4, 0.6, 0.8]).astype(int))
        starts[0] = x[:, j].min()
        edges.append((starts, np.append(starts[1:] - 1, x[:, j].max())))
    cells = [np.array([np.searchsorted(s, v, "right") - 1 for v, (s, _) in zip(row, edges)], np.uint8).tobytes() for row in x]
    n = pa.array(range(500), pa.int64())
    slab = hard_negatives.Slab([pa.RecordBatch.from_arrays([n, n, n, pa.array(x.tolist(), pa.list_(pa.int64())), pa.array(cells, pa.binary())], names=["row", "id", "label", "x", "cells"])], edges)
    q = rng.integers(-300, 300, (20, 8))
    low, high = slab.bounds(q)
    exact = x @ q.T
    assert (low <= exact).all() and (exact <= high).all() and (high - low).max() < exact.max() - exact.min()


def pieces():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=queries.vocabulary(queries.PIECES))


def test_op12_query(spark):
    lib = pieces()
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    want = {}
    for d, t in docs.items():
        ids = lib.encode(t, add_bos=True, add_eos=True)
        want[d] = (len(ids), ref.sha(np.array(ids, "<u4").tobytes()), ref.sha(lib.decode(ids)))
    out = queries.op12_sentencepiece(spark, SF)
    assert out.dtypes == [("doc_id", "bigint"), ("n_tokens", "bigint"), ("ids_sha256", "string"), ("decoded_sha256", "string")]
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in out.collect()} == want


def test_chunks_of_random_texts(spark):
    lib, rng = pieces(), random.Random(5)
    alphabet = [*" \n\t▁éÉ漢🤖\x00", "  ", "▁▁", "ab", " the", "<s>", "</s>", "\r\n", "é", "　", " "]
    texts = ["", " ", "\n", "▁", None, "x" * 70_000, " " * 70_000, "the end " * 20_000, *["".join(rng.choices(alphabet, k=rng.randrange(30))) for _ in range(1500)]]
    df = spark.createDataFrame([(k, t, "y") for k, t in enumerate(texts)] * 2, "id long, text string, ids string").repartition(3)
    for limit in (1 << 24, 400, 0):
        table = chunk_table.chunk_table(df, queries.vocabulary(queries.PIECES), limit=limit)
        assert table.count() == table.select("chunk").distinct().count() and (table.count() > 0) == (limit > 0)
        got = chunk_table.encode(df, queries.vocabulary(queries.PIECES), table=table).collect()
        assert len(got) == 2 * len(texts)
        for r in got:
            ids = lib.encode(texts[r.id] or "")
            assert np.frombuffer(r.ids, "<u4").tolist() == ids and r.n_tokens == len(ids) and r.decoded == lib.decode(ids)


def test_chunks_of_an_empty_table(spark):
    out = chunk_table.encode(spark.createDataFrame([], "id long, text string"), queries.vocabulary(queries.PIECES))
    assert out.columns == ["id", "ids", "n_tokens", "decoded"] and out.collect() == []
