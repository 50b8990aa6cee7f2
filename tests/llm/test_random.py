"""Random texts over alphabets that provoke each operator, many to a Spark job, against the plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from evidentia.llm import chat_format, decontaminate, line_dedup, pii, quality_rules, queries, segment_bpe, token_counts

from . import reference as ref


def texts(pieces, n, length, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(pieces) for _ in range(rng.randrange(length))) for _ in range(n)]


def table(spark, rows):
    return spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id long, text string")


def test_spans(spark):
    pieces = ["a", "b1", "@", ".", "_", "-", "+", "1", "22", "255", "256", " ", "  ", "(", ")", "4111111111111111", "é", "🙂", "\n", "a@b.c", "1.2.3.4"]
    rows = texts(pieces, 600, 30, 1)
    out = {r.doc_id: [(s.kind, s.start, s.end) for s in r.base] for r in pii.extract(table(spark, rows)).collect()}
    assert out == {i: ref.base_spans(t) for i, t in enumerate(rows)}


def test_found_spans(spark):
    """Patterns, their rounds and what they find, against the plain version on texts that share contexts."""
    rng = random.Random(11)
    words = ["badge no: ", "id=", "key = \"", "see page ", "my code ", "a ", "b, ", "\n", "user("]
    values = ["deadbeef00c0ffee%02x", "ZK-7745%02d", "a.b%d@c.de", "10.0.0.%d", "x%d", "plain", "AB%06d"]
    rows = ["".join(rng.choice(words) + ((v % rng.randrange(30)) if "%" in (v := rng.choice(values)) else v) + rng.choice([" ", "\" ", ", ", ") "]) for _ in range(rng.randrange(8))) for _ in range(250)]
    out = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in pii.extract(table(spark, rows)).collect()}
    want = ref.all_spans(list(enumerate(rows)))
    assert out == want and sum(map(len, want.values())) > sum(len(ref.base_spans(t)) for t in rows) + 100


def test_recall_of_planted_identifiers(spark):
    """Identifiers that no base recogniser knows, behind contexts that seeds share: recall and precision."""
    rng = random.Random(12)
    rows, planted, clean = [], 0, 0
    for k in range(400):
        lead = " ".join(rng.choice(["rain", "falls", "on", "the", "hills"]) for _ in range(20))
        c = rng.choice(["api key = ", "serial no: ", "login=", "card# "])
        if k % 4 == 0:
            rows.append(f"{lead} {c}{rng.randrange(16**20):020x}a1 {lead}")
        elif k % 4 == 1:
            planted += 1
            rows.append(f"{lead} {c}ID-{rng.randrange(10**6):06d} {lead}")
        else:
            clean += 1
            rows.append(f"{lead} in 1987 {lead} room B{rng.randrange(100):05d} {lead}")
    out = {r.doc_id: len(r.spans) for r in pii.extract(table(spark, rows)).collect()}
    caught = sum(out[k] > 0 for k in range(400) if k % 4 == 1)
    assert caught >= 0.9 * planted and sum(out[k] > 0 for k in range(400) if k % 4 > 1) <= 0.02 * clean


def test_quality(spark):
    rows = texts(["a", "b", "of", " ", " ", "\t", "\n", "\x0b", "#", "é", "\xa0", "a b a b a b ", "line\n"], 400, 60, 2)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    out = quality_rules.measures(table(spark, rows)).withColumn("base_failed", ~quality_rules.verdict(quality_rules.BASE_RULES))
    assert {r.doc_id: tuple(r[n] for n in names) for r in out.collect()} == {i: ref.quality(t) for i, t in enumerate(rows)}


def test_chat_escapes(spark):
    rows = texts(["#", "##", "###", "\\", "</turn>", "</turn", ">", "\n", "a", " ", ": ", "### user: "], 500, 14, 3)
    df = spark.createDataFrame([(i % 50, i, "user" if i % 2 else "assistant", t) for i, t in enumerate(rows)], "conv_id long, turn long, role string, text string")
    back = chat_format.read_back(chat_format.format_chats(df)).collect()
    for r in back:
        assert [t.text for t in r.turns] == [t for i, t in enumerate(rows) if i % 50 == r.conv_id] and r.round_trip


def test_tokens():
    from tokenizers import Tokenizer

    path = queries.vocabulary()
    lib, codec, counter = Tokenizer.from_file(path), segment_bpe.Codec(path, cache=50), token_counts.PieceCounter(path, cache=50)
    pieces = ["the", "Re", "'s", "'LL", "’", "<|endoftext|>", "<|", " ", "\n", " ", "\u0085", "\x1c", "é", "é", "Σ", "İ", "ß", "日本", "½", "٣", "9", "!", "...", "🙂", "‍", "tion", "A", ","]
    rows = texts(pieces, 1500, 25, 4)
    for a in range(0, len(rows), 100):  # small caches turn over on the way
        part = [t.encode() for t in rows[a : a + 100]]
        ids = codec.encode(part)
        counts = counter.counts(part)
        for t, x, n in zip(rows[a:], ids, counts):
            assert (len(x) // 4, ref.sha(x), ref.sha(codec.decode(x))) == ref.tokens(lib, t) and n == len(x) // 4


@pytest.mark.parametrize("width", [1, 3, 10])
def test_windows(width):
    rows = texts(["a ", "b ", "c ", "d-", "E ", "zz "], 200, 60, width)
    items = [(str(i), t) for i, t in enumerate(texts(["a ", "b ", "c ", "e "], 12, 25, 9))]
    test = decontaminate.TestSet([(i, t.encode(), 0) for i, t in items], width)
    cut, found = [decontaminate.split_words(t.encode()) for t in rows], [([], set(), 0) for _ in rows]
    decontaminate.judge(cut, test, found)
    want = ref.contamination(list(enumerate(rows)), items, width)
    for i in range(len(rows)):
        assert (len(cut[i]), sum(b - a for a, b in found[i][0]), len(found[i][1])) == want[i][:3]


@pytest.mark.parametrize("runs", [False, True])
def test_line_dedup(spark, runs):
    rows = texts(["one\n", "two\n", "three\n", "\n", "long " * 60 + "\n", "twenty " * 20 + "\n", "end"], 150, 12, 5)
    out = {r.doc_id: r.text for r in line_dedup.dedup_lines(table(spark, rows), runs=runs).select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect()}
    assert out == ref.dedup_lines(list(enumerate(rows)), runs)
