"""Units of answers, slices of blocks, passages by a tokenizer and closures, held against plain versions."""

import random
import re

import pytest
from pyspark.sql import functions as F

from evidentia.functions import spans
from evidentia.operators import references as r
from evidentia.operators import sequential as q
from evidentia.plans import catalog

SF = "/root/testdata/sf0.001"


def plain_units(text):
    """By flags for every character."""
    n = len(text)
    fenced, opened, at = [False] * n, None, 0
    for line in text.split("\n"):
        m = re.match(r"\s*(```+|~~~+)", line)
        closes = m and opened and m[1][0] == opened[0] and len(m[1]) >= len(opened)
        if m and not opened:
            opened = m[1]
            closes = False
        if opened:
            for k in range(at, min(n, at + len(line) + 1)):
                fenced[k] = True
        if closes:
            opened = None
        at += len(line) + 1
    out = []
    for m in re.finditer(r"(?:[^\n]*[^ \t\n][^\n]*(?:\n|$))+", text):
        part = m[0]
        a, b = m.start() + len(part) - len(part.lstrip()), m.start() + len(part.rstrip())
        if a >= b:
            continue
        body = text[a:b]
        lines = part.split("\n")
        odd = any(fenced[a:b]) or any(re.match(r"    |\t", x) or re.match(r"\s*\|", x) or re.match(r"\s*[-:]+\s*\|", x) for x in lines) or body[0] == "#"
        if odd or re.fullmatch(r"[A-Za-z_]\w*\s*=\s*\S+(?:\s+[A-Za-z_]\w*\s*=\s*\S+)*", body):
            out.append((a, b, "unsupported_representation"))
            continue
        quoted, k, clear = [False] * (b - a), 0, True
        while k < len(body):
            m2 = re.compile(r"`+").match(body, k)
            close = m2[0] if m2 else {'"': '"', "“": "”", "‘": "’"}.get(body[k])
            if not close:
                k += 1
                continue
            end = body.find(close, k + len(m2[0] if m2 else "x"))
            if end < 0:
                clear = False
                break
            for j in range(k, end + len(close)):
                quoted[j] = True
            k = end + len(close)
        if not clear:
            out.append((a, b, "ambiguous_span_or_attribution"))
            continue
        cuts, k = [0], 0
        while k < len(body):
            if body[k] not in ".!?" or quoted[k]:
                k += 1
                continue
            word = re.search(r"\S*$", body[:k])[0]
            if body[k] == "." and (re.match(r"[^\W_]\.[^\W_]", body[max(0, k - 1) : k + 2]) if k else False):
                k += 1
                continue
            if body[k] == "." and (len(word) == 1 or "." in word):
                k += 1
                continue
            j = k + 1 + len(re.match(r"[ \t]*", body[k + 1 :])[0])
            while (c := re.compile(r"\[S[0-9]+\][ \t]*").match(body, j)) and not quoted[j]:
                j = c.end()
            rest = body[j:]
            if (rest and not rest[0].isspace() and not rest[0].isupper()) or rest.lstrip()[:1].islower():
                k += 1
                continue
            cuts.append(j)
            k = max(k + 1, j)
        for x, y in zip(cuts, [*cuts[1:], len(body)]):
            if s := body[x:y].strip():
                x += body[x:y].index(s)
                out.append((a + x, a + x + len(s), None))
    return out


PIECES = ["One", "two", "Three", " ", " ", "\n", "\n\n", ". ", "! ", "?", ".", "e.g.", "A.", "3.5", "[S1]", " [S12] ", "`", "``", '"', "“", "”", "‘x’", "```\n", "~~~\n", "| a | b\n", "--- | ---\n", "    code\n", "\tcode", "# Head\n", "x = 1", "y=2 z=3\n", "é", "İ", "\r\n"]


def test_units_of_random_answers():
    rng = random.Random(12)
    for _ in range(30_000):
        text = "".join(rng.choices(PIECES, k=rng.randrange(1, 14)))
        assert spans.answer_units(text) == plain_units(text), text
    assert spans.answer_units("") == []


def test_units_query(spark):
    want = sorted((d.doc_id, k, a, b, why) for d in spark.read.parquet(f"{SF}/documents.parquet").collect() for k, (a, b, why) in enumerate(plain_units(d.text or "")))
    key = lambda x: tuple(map(str, x))
    assert sorted((tuple(x) for x in catalog.QUERIES["answer_units"](spark, SF).collect()), key=key) == sorted(want, key=key)


@pytest.mark.parametrize("most", [1, 3, 10])
def test_slices_keep_every_character(most):
    rng = random.Random(most)
    for _ in range(3000):
        text = "".join(rng.choices(["word ", "x", "\n", ".", "   ", "longerword", "é_1"], k=rng.randrange(25)))
        got = [*q.preformatted_slices(text, most)]
        assert "".join(text[a:b] for a, b in got) == text
        at = 0
        for a, b in got:
            assert a == at and q.estimate(text[a:b]) <= most
            longest = max(k for k in range(1, len(text) - a + 1) if q.estimate(text[a : a + k]) <= most and k <= 4 * most)
            line = text.rfind("\n", a, a + longest)
            assert b == (len(text) if a + longest == len(text) else line + 1 if line >= 0 else a + longest)
            at = b


def test_token_passages_by_the_library(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = {}
    for x in catalog.QUERIES["token_passages"](spark, SF).collect():
        got.setdefault(x.doc_id, []).append(x)
    for d in spark.read.parquet(f"{SF}/documents.parquet").collect():
        text = d.text or ""
        rows = sorted(got.get(d.doc_id, ()), key=lambda x: x.ordinal)
        if not text.strip():
            assert rows == []
            continue
        at = [a for a, b in lib.encode(text, add_special_tokens=False).offsets if b > a]
        assert rows[0].start == 0 and rows[-1].end == len(text) and [x.ordinal for x in rows] == [*range(len(rows))]
        for k, x in enumerate(rows):
            own = at[320 * k : 320 * k + 384]
            assert x.tokens == len(own) and (k == 0 or x.start == own[0]) and (x is rows[-1] or (x.tokens == 384 and x.end == at[320 * k + 384]))
            assert x.sha == __import__("hashlib").sha256(text[x.start : x.end].encode()).hexdigest()


def test_neighbours_cross_the_edges_of_a_block(spark):
    from evidentia.operators import retrieval

    rows = [("a", 1, 1, "s", "prose", 0), ("b", 1, 1, "s", "prose", 1), ("c", 1, 2, "s", "prose", 0), ("d", 1, 3, "t", "table_header", 0), ("e", 1, 4, "u", "prose", 0), ("f", 1, 5, None, "prose", 0), ("g", 1, 6, None, "prose", 0), ("h", 2, 7, None, "prose", 0)]
    p = spark.createDataFrame(rows, "key string, doc long, block long, section string, kind string, seq long")
    got = {x.key: [n.key for n in x.near] for x in retrieval.neighbours(p, F.struct("key")).collect()}
    assert got == {"a": ["b", "c"], "b": ["a", "c"], "c": ["b", "d"], "d": [], "e": ["d"], "f": ["g"], "g": ["f"], "h": []}


def plain_closure(seed, texts, target, most_nodes, most_references, most_chars):
    """Block by block, first come first served; texts by place, target(label) -> places or an issue."""
    needed, line, issues, visited, scanned, count = [seed], [seed], [], 0, 0, 0
    for b in line:
        if visited >= most_nodes:
            issues.append("nodes")
            break
        visited += 1
        room = most_chars - scanned
        if len(texts[b]) > room:
            issues.append("scan_chars")
        scanned += min(room, len(texts[b]))
        stop = False
        for label, key, end in r.located_references(texts[b]):
            if end > room:
                continue
            count += 1
            if count > most_references:
                issues.append("references")
                stop = True
                break
            found = target(key)
            if len(found) > most_nodes:
                issues.append("target_nodes")
            for x in found[:most_nodes]:
                if x in needed:
                    continue
                if len(needed) >= most_nodes:
                    issues.append("nodes")
                    break
                needed.append(x)
                line.append(x)
        if stop or scanned >= most_chars:
            if not stop and line[-1] != b:
                issues.append("scan_chars")
            break
    return needed, sorted(set(issues))


def test_closures_block_by_block(spark):
    rng = random.Random(17)
    rows, sections, want = [], [], {}
    for doc in range(60):
        n = rng.randrange(2, 30)
        texts = ["".join(f"See Section {rng.randrange(1, 9)} now. " if rng.random() < 0.5 else "Words. " for _ in range(rng.randrange(3))) or "-" for _ in range(n)]
        spans_ = {k: tuple(sorted((rng.randrange(n), rng.randrange(n)))) for k in range(1, 9)}
        rows += [(doc, b, t) for b, t in enumerate(texts)]
        sections += [(doc, f"Section {k}", a, b) for k, (a, b) in spans_.items()]
        target = lambda key, s=spans_: [*range(s[int(key[8:])][0], s[int(key[8:])][1] + 1)]
        for limits in ((8192, 2048, 2_000_000), (5, 2048, 2_000_000), (8192, 4, 2_000_000), (8192, 2048, 90)):
            for seed in range(n):
                want[limits, doc, seed] = plain_closure(seed, texts, target, *limits)
    blocks = spark.createDataFrame(rows, "doc long, block long, text string")
    found = r.resolved(r.references(blocks), r.targets(blocks, spark.createDataFrame(sections, "doc long, heading string, first long, last long")))
    for limits in {k[0] for k in want}:
        for x in r.closed(blocks.select("doc", F.col("block").alias("seed")), blocks, found, None, *limits).collect():
            needed, issues = want[limits, x.doc, x.seed]
            assert sorted(b for i in x.intervals for b in range(i["first"], i["last"] + 1)) == sorted(needed), (limits, x)
            assert sorted({i.split(":")[1] for i in x.issues}) == issues, (limits, x)


def test_a_long_section_with_many_references_is_expanded_once():
    import time

    before = [*range(0, 100_001 * 10, 10)]
    refs = {p: [{"issue": None, "key": "k", "label": "x", "end": 1, "first": 0, "last": 99_999}] for p in range(0, 100_000, 100)}
    began = time.time()
    for seed in range(0, 100_000, 2000):
        found, issues = r.close(seed, before, refs, None, 200_000, 200_000, 10**9)
        assert sum(b - a + 1 for a, b, _ in found) == 100_000 and issues == [] and len(found) <= 3
    assert time.time() - began < 10


def test_limits_of_the_index(spark):
    blocks = spark.createDataFrame([(1, k, f"[^n{k}]: note") for k in range(5)], "doc long, block long, text string")
    sections = spark.createDataFrame([(1, f"{k} T", k, k) for k in range(5)], "doc long, heading string, first long, last long")
    for limits, n, codes in (((99, 99, 999), 5, set()), ((3, 99, 999), 3, {"section_index", "footnote_index_nodes", "inferred_heading_index"}), ((99, 2, 999), 2, {"footnote_index_references"}), ((99, 99, 25), 2, {"footnote_index_chars", "inferred_heading_index"})):
        found = r.targets(blocks, sections, None, *limits).filter("key like 'footnote%'").count()
        assert found == n, limits
        assert {x.issue.split(":")[1] for x in r.index_issues(blocks, sections, *limits).collect()} == codes, limits


def test_inferred_headings_are_targets(spark):
    rows = [(1, None, 0, "1 Scope"), (1, None, 1, "body"), (1, None, 2, "1.1 Terms"), (1, None, 3, "more"), (1, None, 4, "2 Rules"), (1, None, 5, "See Section 1.1")]
    blocks = spark.createDataFrame(rows, "doc long, section string, block long, text string")
    heads = r.heading_targets(r.inferred_headings(blocks), blocks)
    assert sorted((h.heading, h.first, h.last) for h in heads.collect()) == [("1 Scope", 0, 3), ("1.1 Terms", 2, 3), ("2 Rules", 4, 5)]
    none = spark.createDataFrame([], "doc long, heading string, first long, last long")
    found = r.resolved(r.references(blocks), r.targets(blocks, none, heads))
    assert [(x.first, x.last) for x in found.collect()] == [(2, 3)]
    assert [i.asDict() for i in r.closed(spark.createDataFrame([(1, 5)], "doc long, seed long"), blocks, found).first().intervals] == [{"first": 5, "last": 5, "hop": 0}, {"first": 2, "last": 3, "hop": 1}]


@pytest.mark.parametrize(
    ("text", "names"),
    [
        ("What does Anna Berg do?", ["Anna Berg"]), ("what is the atlas about", ["the atlas"]), ("How about moss pit, then?", ["moss pit"]), ("What is Anna\u2019s role in ABC-2?", ["Anna", "ABC-2"]),
        ("What is it about?", []), ("what does\nit do", []), ("What is the project role?", []), ("Compare Haltian and MAISA.", ["MAISA", "Haltian", "MAISA."]), ("The North Sea Plan budget of R&D.Lab's team", ["R&D.Lab", "North Sea"]),
        ("what about ?", []), ("", []), ("A B C", []), ("AB-c, ABCDEFGHIJKLMNOPQRS", ["AB", "AB-c", "ABCDEFGHIJKLMNOPQRS"]), ("What is the lead of x y z w v u responsibility", []), ("WHAT DOES Q1 DO WHAT DOES Q2 DO", ["Q1", "Q2", "WHAT", "DOES", "DO"]),
    ],
)
def test_names_of_questions(text, names):
    assert spans.question_names(text)[: len(names) or None] == names or (text.startswith("WHAT") and spans.question_names(text)[:2] == ["Q1", "Q2"])
    assert len(spans.question_names(" ".join(f"Name{k}, x" for k in range(30)))) == 8


def plain_audit(text, open_, premises, quotes, most):
    """(start, end, claim, sources, status, reason) of each unit, one after the other."""
    out, planned = [], 0
    for a, b, why in plain_units(text):
        body = text[a:b]
        quoted, k = [False] * len(body), 0
        while k < len(body):
            ticks = re.compile("`+").match(body, k)
            close = ticks[0] if ticks else {'"': '"', "“": "”", "‘": "’"}.get(body[k])
            end = body.find(close, k + (len(ticks[0]) if ticks else 1)) if close else -1
            if close and end < 0 and ticks:
                quoted[k:] = [True] * (len(body) - k)
                break
            if not close or end < 0:
                k += 1
                continue
            quoted[k : end + len(close)] = [True] * (end + len(close) - k)
            k = end + len(close)
        marks = [m for m in re.finditer(r"\[S[0-9]+\]", body) if not quoted[m.start()]]
        claim = "".join("\0" * len(m[0]) if m in marks else m[0] for m in re.finditer(r"\[S[0-9]+\]|[^\[]+|\[", body) for m in [next((x for x in marks if x.span() == m.span()), m)]).replace("\0", "").strip()
        ids = [*dict.fromkeys(m[0][1:-1] for m in marks)]
        known = [i for i in ids if i in quotes]
        status = "unchecked"
        if why is None:
            if known != ids:
                why = "invalid_citation"
            elif not ids:
                why = "no_citation"
            elif any(x < b and y > a for x, y in premises):
                why = "mixed_question_premise"
            elif {*ids} & {*open_}:
                why = "unresolved_required_context"
            else:
                plain = claim[1:].strip() if claim.startswith(">") else claim
                if len(plain) > 1 and plain[0] + plain[-1] in ("“”", '""', "‘’") and __import__("html").unescape(plain[1:-1]) in [quotes[i] for i in ids]:
                    status = "literal_quote_verified"
                elif not claim or len(claim) + sum(len(quotes[i]) for i in ids) > 300:
                    why = "input_too_long"
                elif planned >= most:
                    why = "claim_limit"
                else:
                    status, planned = "planned", planned + 1
        out.append((a, b, claim, known, status, why))
    return out


def test_audits_of_random_answers(spark):
    from evidentia.operators import evidence

    rng = random.Random(21)
    quotes = {"S1": "One two", "S2": "a < b & c", "S3": "x" * 290}
    pieces = [*PIECES, " [S1]", " [S2]. ", "[S3]", "“One two” [S1]\n\n", "“a &lt; b &amp; c”[S2]\n\n", "> \"One two\" [S1].\n\n", "Said so [S1]. ", "A claim [S9]. ", "More of it [S1][S2]. "]
    rows, want = [], {}
    for k in range(400):
        text = "".join(rng.choices(pieces, k=rng.randrange(1, 16)))
        open_, premises = rng.choice([[], [], ["S2"]]), rng.choice([[], [], [(3, 9)]])
        rows.append((k, text, open_, [{"start": a, "end": b} for a, b in premises]))
        want[k] = plain_audit(text, open_, premises, quotes, 2)
    answers = spark.createDataFrame(rows, "answer long, text string, open array<string>, premises array<struct<start:long,end:long>>")
    bound = spark.createDataFrame([(k, i, q_) for k in range(400) for i, q_ in quotes.items()], "answer long, source string, quote string")
    got = {k: [] for k in range(400)}
    for x in evidence.planned_audits(answers, bound, 2, 300).orderBy("answer", "unit").collect():
        got[x.answer].append((x.start, x.end, x.claim, x.sources, x.status, x.reason))
    for k in want:
        assert got[k] == want[k], rows[k]
    assert {s for w in want.values() for *_, s, _ in w} == {"planned", "unchecked", "literal_quote_verified"}
