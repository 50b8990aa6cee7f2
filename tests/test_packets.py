"""Packing under budgets, held against plain versions and hand-made cases."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from evidentia.operators import packets as p


def plain_packets(blocks, chosen, room):
    """{block: packet} of one document: blocks [(block, section, cost, follows)], chosen sections; packets as lists that grow."""
    if sum(c for _, _, c, _ in blocks) <= room:
        return {b: 1 for b, *_ in blocks}
    sections = {s for _, s, *_ in blocks if s is not None}
    inside = [x for x in blocks if (x[1] in chosen if x[1] is not None else sections <= chosen)] or blocks
    kept = {b for b, *_ in inside}
    runs, before = [], None
    for x in blocks:
        if x[0] not in kept:
            before = None
            continue
        if before is None or before[1] != x[1]:
            runs.append([])
        runs[-1].append(x)
        before = x
    done, held = [], []
    weigh = lambda xs: sum(x[2] for x in xs)
    for run in runs:
        if held and weigh(held + run) > room:
            done.append(held)
            held = []
        if weigh(run) <= room:
            held = held + run
            continue
        for x in run:
            if held and weigh([*held, x]) > room:
                tail = [held.pop()] if x[3] and len(held) > 1 else []
                done.append(held)
                held = tail
            held.append(x)
    done += [held] if held else []
    return {x[0]: k for k, packet in enumerate(done, 1) for x in packet}


def test_packets_own_every_chosen_block_once(spark):
    rng = random.Random(4)
    rows, picks, want = [], [], {}
    for doc in range(150):
        section, own, chosen = None, [], set()
        for b in range(rng.randrange(1, 40)):
            if rng.random() < 0.3:
                section = rng.choice([None, b, b])
            own.append((b, section, rng.choice([5, 20, 60, 150, 400]) + 48, rng.random() < 0.4))
        for s in {s for _, s, *_ in own if s is not None}:
            if rng.random() < 0.7:
                chosen.add(s)
        picks += [(doc, s, s in chosen) for s in {s for _, s, *_ in own if s is not None}]
        rows += [(doc, b, s, c - 48, f) for b, s, c, f in own]
        want |= {(doc, b): k for b, k in plain_packets(own, chosen, 300).items()}
    blocks = spark.createDataFrame(rows, "doc long, block long, section long, tokens long, follows boolean")
    out = p.document_packets(blocks, spark.createDataFrame(picks, "doc long, section long, chosen boolean"), 1500)
    got = out.collect()
    assert len(got) == len(want) and {(r.doc, r.block): r.packet for r in got} == want
    sums = p.packet_summary(out).collect()
    assert all(s.cost <= 1500 or s.n_blocks == 1 or s.split for s in sums) and sum(s.n_blocks for s in sums) == len(got)


def test_selection_of_sections(spark):
    sections = spark.createDataFrame([(1, 10, [10]), (1, 11, [10, 11]), (1, 20, [20]), (2, 1, [1]), (2, 2, [2]), (3, 1, [1])], "doc long, section long, path array<long>")
    picked, hits = spark.createDataFrame([(1, 10)], "doc long, section long"), spark.createDataFrame([(3, 1)], "doc long, section long")
    got = {(r.doc, r.section): r.chosen for r in p.selected_sections(sections, picked, hits).collect()}
    assert got == {(1, 10): True, (1, 11): True, (1, 20): False, (2, 1): True, (2, 2): True, (3, 1): True}


@pytest.mark.parametrize(("text", "yes"), [("Owner: x", True), ("  owned\tby : y", True), ("TASK LEADER:", True), ("ownership: z", False), ("the owner: x", False), ("lead", False), (None, False)])
def test_labels_that_continue(spark, text, yes):
    assert spark.createDataFrame([(text,)], "t string").select(p.continues(F.col("t"))).first()[0] is yes


def test_batches_are_halved_twice(spark):
    items = [(1, k, 100, 90) for k in range(8)] + [(2, 0, 9999, 1), (2, 1, 10, 500), (2, 2, 10, 1)] + [(3, k, 10, 1) for k in range(3)]
    out = p.prompt_batches(spark.createDataFrame(items, "key long, position long, cost long, tokens long"), limit=428 + 500, window=128 + 200)
    got = {}
    for r in out.collect():
        got.setdefault(r.key, {})[r.position] = (r.batch, r.decision)
    assert got[1] == {0: (1, "sent"), 1: (1, "sent"), 2: (2, "sent"), 3: (2, "sent"), **{k: (3, "failed") for k in range(4, 8)}}
    assert got[2] == {0: (None, "oversize"), 1: (1, "failed"), 2: (2, "sent")}
    assert set(got[3].values()) == {(1, "sent")}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


SOURCE = "block string, doc long, ordinal long, kind string, flags array<string>, text string, sha256 string"


def sources(spark, *rows):
    return spark.createDataFrame([(b, d, n, k, f, t, h or sha(t)) for n, (b, d, k, f, t, h) in enumerate(rows)], SOURCE)


def test_recovery_takes_whole_blocks_or_none(spark):
    blocks = sources(
        spark, ("a", 1, "prose", [], "first words", None), ("b", 1, "table_row", [], "cell", None), ("c", 1, "prose", ["ocr_text_unverified"], "read", None),
        ("long", 1, "prose", [], "x" * 4001, None), ("blank", 1, "prose", [], " \n", None), ("changed", 1, "prose", [], "new", sha("old")), ("far", 2, "prose", [], "other", None),
    )
    cases = {
        1: (["c", "b", "a", "a"], [], "direct", 6, 8000, [("a", "direct"), ("b", "context"), ("c", "context")], []), 2: (["a", "far"], [], "direct", 6, 8000, [], ["source_excerpt_unverified_selection"]),
        3: (["a", "b"], ["a"], "counter", 6, 8000, [("b", "context")], []), 4: (["a", "b"], [], "direct", 6, 5, [("b", "context")], ["source_excerpt_recovery_budget_exhausted"]),
        5: (["long", "a"], [], "direct", 1, 8000, [("a", "direct")], ["source_excerpt_whole_block_too_large"]), 6: ([], [], "direct", 1, 9, [], ["source_excerpt_selection_limit"]),
        7: (["a"], [], "other", 1, 99, [], ["source_excerpt_invalid_role"]), 8: (["blank"], [], "direct", 1, 9, [], ["source_excerpt_unverified_selection"]), 9: (["changed"], [], "direct", 1, 9, [], ["source_excerpt_unverified_selection"]),
        10: (["none"], [], "direct", 1, 9, [], ["source_excerpt_unverified_selection"]), 11: (["a", "b", "c", "long", "far"], [], "direct", 1, 9, [], ["source_excerpt_selection_limit"]),
    }
    rows = [(k, 1, role, ids, known, cards, chars) for k, (ids, known, role, cards, chars, _, _) in cases.items()]
    out = p.recovered_excerpts(spark.createDataFrame(rows, "request long, doc long, role string, selected array<string>, known array<string>, cards int, chars int"), blocks)
    got = {r.request: ([tuple(e) for e in r.excerpts], r.warnings) for r in out.collect()}
    assert got == {k: (c[5], c[6]) for k, c in cases.items()}


def test_quotations_cite_nothing(spark):
    text = "a\n b [E:x] <i> `m` *s* ~t~ \\ & 【S1】"
    shown = spark.createDataFrame([(text,)], "t string").select(p.quotation(F.col("t"), F.lit(True)), p.quotation(F.col("t"), F.lit(False))).first()
    assert shown[0] == "The source states: “a b &#91;E:x&#93; &lt;i&gt; \\`m\\` \\*s\\* \\~t\\~ \\\\ &amp; &#12304;S1&#12305;”"
    assert "\n" not in shown[1] and shown[1].startswith("The source states: “a\\n b ")


def test_units_of_an_answer(spark):
    text = "  One.\nstill one\n\n\n- item a\n- item b\n  more b\n12. third\nx\n \n*no item\n3.no"
    out = p.answer_parts(spark.createDataFrame([(1, text), (2, ""), (3, None)], "answer long, text string")).orderBy("unit").collect()
    assert [r.text for r in out] == ["One.\nstill one", "- item a", "- item b\n  more b", "12. third\nx", "*no item\n3.no"]
    assert all(text[r.start : r.start + len(r.text)] == r.text for r in out)


def test_overrides_and_qualification(spark):
    blocks = sources(spark, ("a", 1, "prose", [], "alpha  words", None), ("b", 1, "table", [], "beta\nrow", None), ("c", 1, "prose", [], "gamma", "other"))
    cards = spark.createDataFrame([(1, "k1", 1, ["a"], False), (1, "k2", 1, ["b", "a"], True), (1, "k3", 1, ["c"], True), (1, "dup", 1, ["a"], True), (1, "dup", 1, ["b"], True), (2, "k1", 1, ["a"], False)], "answer long, card string, doc long, blocks array<string>, open boolean")
    quote = "The source states: “alpha words” [E:k1]"
    text = f"{quote}\n\nThe source states: “beta\\nrow” [E:k2] {p.OPEN_NOTE}\n\nPlain words [E:k2][E:k1].\n\nRefused [E:k3].\n\nAgain [E:k3]."
    answers = spark.createDataFrame([(1, text), (2, f"Said [E:k1].\n\n{quote}")], "answer long, text string")
    got = {(r.answer, r.position): r.block for r in p.excerpt_overrides(answers, cards, blocks).collect()}
    second = answers.filter("answer = 2").first().text
    assert got == {(1, text.index("[E:k1]")): "a", (1, text.index("[E:k2]")): "b", (2, second.rindex("[E:k1]")): "a"}
    out = {r.answer: (r.text, r.warnings) for r in p.qualified_answers(answers, cards, blocks).collect()}
    assert out[2] == (second, [])
    open_ = f" [E:k2] {p.OPEN_NOTE}"
    # the second unit quotes both blocks of k2; the third has only k1's left, whose quotation is not an open one
    assert out[1][0].split("\n\n") == [quote, "The source states: “beta\\nrow”" + open_, "The source states: “alpha words”" + open_, quote, f"{p.REFUSAL} [E:k3]"]
    assert out[1][1] == ["reference_unresolved_card:answer_unit_qualified", "reference_unresolved_card:complete_source_excerpt_retained", "reference_unresolved_card:source_excerpt_unavailable"]


def test_scopes_admit_cards_whole(spark):
    rows = [(1, "x", 1, None, 20), (1, "x", 1, 1, 500), (1, "x", 1, 2, 30), (1, "y", 2, None, 900), (1, "y", 2, 1, 1), (1, "x", 3, None, 10), (1, "x", 3, 1, 5)]
    out = p.scoped_evidence(spark.createDataFrame(rows, "key long, scope string, report long, card long, size long"), 100)
    got = {(r.report, r.card): r.admitted for r in out.collect()}
    assert got == {(1, None): True, (1, 1): False, (1, 2): True, (3, None): True, (3, 1): True, (2, None): False, (2, 1): False}
