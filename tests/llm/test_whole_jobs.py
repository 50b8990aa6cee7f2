"""Cases in which an operator once did less than its whole job."""

import pytest
from pyspark.sql import functions as F

from evidentia.llm import line_dedup, queries, simhash, token_counts

from . import reference as ref

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("n", [2, 3, 5, 8])
def test_repeated_runs_go_whole(spark, n):
    run = [f"run {n} line {i} " + " ".join(f"w{i}x{k}" for k in range(96 // n)) for i in range(n)]
    rows = []
    for d in range(12):
        # foreign lines before, after and between the copies move the chunks' ends
        lead = [f"lead {d} {k} of this document only" for k in range(d % 5)]
        rows.append((d, "\n".join([*lead, *run, f"tail {d} a", f"tail {d} b"])))
    out = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), runs=True)
    got = {r.doc_id: r.text.split("\n") for r in out.collect()}
    assert set(run) <= set(got[0])
    assert not any(set(run) & set(got[d]) for d in range(1, 12))
    assert all(x in got[d] for d, t in rows for x in t.split("\n") if x not in run)


def test_op1_query_removes_whole_runs(spark):
    rows = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = {d: len(t) for d, t in ref.dedup_lines(rows, runs=True).items()}
    got = {r.doc_id: r.kept_chars for r in queries.op1_line_dedup(spark, SF).collect()}
    assert got == want


def test_overlapping_runs_keep_the_first(spark):
    line = "twenty words " * 10
    rows = spark.createDataFrame([(1, "\n".join([line] * 3)), (2, "\n".join(["other", *[line] * 3]))], "doc_id long, text string")
    got = {r.doc_id: (r.text.count(line), r.n_removed_lines) for r in line_dedup.dedup_lines(rows, runs=True).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "n_removed_lines").collect()}
    assert got[2] == (0, 3) and got[1][0] >= 2


@pytest.mark.parametrize("text", ["ALİ.", "ALİ,", "ALİ:", "ALİ!", "İ?", "ali. ALİ; Straße. ÉTÉ, ǰ."])
def test_marks_after_a_capital_with_a_dot(text):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(queries.vocabulary())
    assert token_counts.PieceCounter(queries.vocabulary()).counts([text.encode()]) == [len(lib.encode(text, add_special_tokens=False).ids)]


def test_one_row_of_each_group_stays(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(60)) for x in "abc")
    rows = [(1, a, "x"), (1, a, "x"), (1, a, "y"), (2, a, "x"), (None, a, "x"), (None, b, "x"), (None, b, "x"), (None, b, "y"), (1, c, "x"), (3, c, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = simhash.keep_one(docs, shingle=3)
    assert out.columns == docs.columns
    kept = sorted((r.text[0], r.doc_id) for r in out.collect())
    assert kept == [("a", 1), ("b", None), ("c", 1)]


def copies(rng, words, n, changes):
    """`n` copies of a text, each with some words of its own."""
    out = []
    for k in range(n):
        own = list(words)
        for at in rng.sample(range(len(own)), changes):
            own[at] = f"new{k}x{at}"
        out.append(" ".join(own))
    return out


def test_similar_documents_by_brute_force(spark):
    """Groups of near copies around the threshold, beside unrelated texts: every group that all pairs give, and no other."""
    import random

    rng = random.Random(5)
    rows = []
    for g in range(40):
        rows += copies(rng, [f"g{g}w{k}" for k in range(rng.choice([30, 120, 400]))], rng.choice([1, 2, 5]), rng.choice([0, 1, 2, 4]))
    docs = [(i, t) for i, t in enumerate(rows)]
    kept = {r.doc_id for r in simhash.keep_similar(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    group = ref.similar(docs)
    assert kept == {d for d in group if group[d] == d} and len(kept) < len(docs)


def test_a_large_group_of_near_copies(spark):
    """Beyond a tree's bound a shard is dealt out; the group still falls to one document, or nearly."""
    import random

    rng = random.Random(6)
    docs = [(i, t) for i, t in enumerate(copies(rng, [f"w{k}" for k in range(300)], 300, 2))]
    prints = simhash.map_texts(spark.createDataFrame(docs, "doc_id long, text string"), "text", {"fingerprint": "binary", "bands": "array<long>"}, lambda: lambda ts: [*zip(*[simhash.wide_print(simhash.shingle_hashes(simhash.split_words(t), 5, {})) for t in ts])], ["doc_id"])
    dealt = {frozenset((bytes(r.a), bytes(r.b))) for r in simhash.similar_links(simhash.shards(prints), shard=40, pivots=10).collect()}
    parent = {bytes(r.fingerprint): bytes(r.fingerprint) for r in prints.collect()}
    for a, b in map(sorted, dealt):
        x, y = ref.find(parent, a), ref.find(parent, b)
        parent[max(x, y)] = min(x, y)
    assert len({ref.find(parent, x) for x in parent}) == 1


@pytest.mark.parametrize("shard", [simhash.SHARD, 16])
def test_links_that_fail_hide_no_others(spark, shard):
    """Families on both sides of the threshold, whose closest links often fail; with small shards they meet in blocks."""
    import random

    rng = random.Random(11)
    rows = []
    for g in range(25):
        words = [f"g{g}w{k}" for k in range(rng.choice([40, 120]))]
        rows += [t for changes in (1, 2, 3, 4, 5) for t in copies(rng, words, 4, changes)]
    docs = [(i, " ".join(f"{w}" for w in t.split())) for i, t in enumerate(rows)]
    kept = {r.doc_id for r in simhash.keep_similar(spark.createDataFrame(docs, "doc_id long, text string"), shard=shard).collect()}
    group = ref.similar(docs)
    assert kept == {d for d in group if group[d] == d} and 25 < len(kept) < len(docs)


def test_components_grow_link_by_link(spark):
    import random

    rng = random.Random(2)
    links = [(rng.randrange(40), rng.randrange(40)) for _ in range(30)]
    frame = lambda part: spark.createDataFrame(part, "a long, b long")
    found = simhash.components(frame(links[:8]))
    for k in range(8, 30, 6):
        found = simhash._joined(found, frame(links[k : k + 6]).filter("a <> b"))
        root = {n: n for n in range(40)} | {r.node: r.root for r in found.collect()}
        parent = {n: n for n in range(40)}
        for a, b in links[: k + 6]:
            x, y = sorted((ref.find(parent, a), ref.find(parent, b)))
            parent[y] = x
        assert root == {n: ref.find(parent, n) for n in range(40)}
        assert found.count() == found.select("node").distinct().count()
    assert simhash._joined(found, frame([])).collect() == found.collect()


def test_offers_are_the_closest_and_all_in_the_end():
    import numpy as np

    rng = np.random.default_rng(4)
    values = rng.integers(0, 1 << 8, (60, 1)).astype(np.uint64)
    labels = rng.integers(0, 3, 60)
    apart = lambda a, b: int(values[a, 0] ^ values[b, 0]).bit_count()
    want = {a: sorted(apart(a, b) for b in range(60) if labels[a] != labels[b] and apart(a, b) <= 3) for a in range(60)}
    for most in (1, 2, 64):
        got = {a: [] for a in range(60)}
        for a, b, more in simhash.offered(values, labels, 3, most):
            got[a].append(apart(a, b))
            assert labels[a] != labels[b] and more == (len(want[a]) > most)
        assert {a: sorted(x) for a, x in got.items()} == {a: x[:most] for a, x in want.items()}


def test_blank_lines_cost_no_more_than_others():
    import tracemalloc

    text = b"\n" * 200_000 + b"w " * 60
    tracemalloc.start()
    found = line_dedup._cut(text, 50, True)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found[1][0]) == 200_001 and peak < 150 << 20


def test_runs_of_blank_lines_by_brute_force(spark):
    import random

    rng = random.Random(8)
    line = lambda: "" if rng.random() < 0.5 else f"w{rng.randrange(4)} " * rng.choice([10, 30])
    docs = [(d, "\n".join(line() for _ in range(rng.randrange(12)))) for d in range(120)]
    out = line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"), runs=True)
    assert {r.doc_id: r.text for r in out.collect()} == ref.dedup_lines(docs, runs=True)


def test_similar_documents_of_awkward_rows(spark):
    a, b = (" ".join(f"{x}{k}" for k in range(60)) for x in "ab")
    rows = [(1, a, 1), (1, a, 1), (2, a.upper() + "!", 2), (None, a, 3), (None, b, 4), (None, b, 4), (5, None, 5), (6, "", 6), (7, " .. ", 7), (8, "one", 8), (9, "One.", 9), (10, "x " * 300_000, 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fingerprint long")
    out = simhash.keep_similar(docs)
    assert out.columns == docs.columns
    assert sorted((r.fingerprint, r.doc_id) for r in out.collect()) == [(1, 1), (4, None), (5, 5), (8, 8), (10, 10)]
    assert simhash.keep_similar(docs.filter("false")).count() == 0


@pytest.mark.parametrize("name", ["byte_bpe_50k.json"])
def test_other_vocabularies_are_refused(name):
    from evidentia.llm import segment_bpe

    with pytest.raises(ValueError, match="vocabulary file"):
        segment_bpe.Vocabulary(queries.vocabulary(name))


@pytest.mark.parametrize("size", [3_000, 20_000])
def test_caches_are_bounded(size):
    from evidentia.llm.common import Memo

    memo = Memo(size)
    for a in range(0, 3000, 50):
        keys = [b"k%d" % k for k in range(a, a + 50)] + [b"long" * 100 + b"%d" % a]
        new = memo.missing(keys)
        memo.young.update(dict.fromkeys(new, 1))
        assert all(k in memo.young for k in keys)
    assert len(memo.young) + len(memo.old) < 2 * size / 150 + 120


def test_links_are_confirmed_inside_tasks(spark):
    """Of a group whose pairs lie on both sides of the similarity a task emits a forest, and the same components as all pairs give."""
    import random

    import numpy as np

    rng = random.Random(5)
    n, texts = 90, []
    base = [f"w{k}" for k in range(60)]
    for k in range(n):
        words = list(base)
        for at in rng.sample(range(60), 3 + k % 3):
            words[at] = f"x{k}y{at}"
        texts.append(" ".join(words))
    sets = [simhash.shingle_hashes(t.encode().split(), 3, {}) for t in texts]
    values = np.zeros((n, 4), "<u8")
    values[:, 0] = np.arange(n)
    names = [v.tobytes() for v in values]
    alike = {(i, j) for i in range(n) for j in range(i) if len({*sets[i].tolist()} & {*sets[j].tolist()}) >= 0.6 * len({*sets[i].tolist()} | {*sets[j].tolist()})}
    assert 0 < len(alike) < n * (n - 1) / 2
    root = list(range(n))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, j in alike:
        root[top(i)] = top(j)
    want = {frozenset(k for k in range(n) if top(k) == r) for r in map(top, range(n))}
    rows = spark.createDataFrame([(1, bytearray(names[k]), k) for k in range(n)], "band long, fingerprint binary, label long")
    grams = spark.createDataFrame([(bytearray(names[k]), bytearray(sets[k].tobytes()), len(sets[k])) for k in range(n)], "fingerprint binary, grams binary, size long")
    for shard in (1000, 16):
        got = [(names.index(bytes(r.a)), names.index(bytes(r.b))) for r in simhash.open_links(rows, grams, 0.6, radius=256, shard=shard).collect()]
        assert all((max(p), min(p)) in alike for p in got)
        root[:] = range(n)
        for i, j in got:
            root[top(i)] = top(j)
        assert {frozenset(k for k in range(n) if top(k) == r) for r in map(top, range(n))} == want
        assert shard == 16 or len(got) <= n - 1
