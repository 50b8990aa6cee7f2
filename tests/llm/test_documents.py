"""Operators over documents against the plain versions: the smallest tables, and a fixture of awkward rows."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidentia.llm import chat_format, decontaminate, license_scan, line_dedup, pii, quality_rules, queries, segment_bpe, simhash, token_counts, warc

from . import reference as ref

SF = "/root/testdata/sf0.001"
PASSAGE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
TEXTS = [
    None, "", " \n\t ", "word", "two words", "İSTANBUL ΣΑΣ ½² é 日本語 <|endoftext|>x don't I'LL", "a" * 3000, "🙂 " * 50 + "mail a.b@c.de now",
    f"Intro. {PASSAGE} and more text that follows it here", f"Other. {PASSAGE} and more text that follows it here", "same same same same same same same same same same same same",
    "x\ty\x0bz\x0cw\r\nq " * 20, "card 4111 1111 1111 1111, ip 1.2.3.4.5 and 300.1.1.1, +1 (555) 123-4567; a@b.c_d@e.f", "##### \\### </turn> \\\\### x",
    "line one here\nline two here\nline three\n" * 3, "Long line " + "of many words " * 30 + "\nshort", "Long line " + "of many words " * 30 + "\nother", "Ünï çødé " * 3000,
    "Released under the MIT License.\nbody text", "word", "password=b7db7aa4a5fcc78305 token = \"0cab398dc11d1a2a11dc6572c8df8bd228c864f3\"",
]


@pytest.fixture(scope="module")
def odd(spark):
    """Awkward texts, with extra columns whose names the operators use themselves."""
    rows = [(i, t, "x", i, None) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_words string, hash long, ids string")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def by_id(df, *cols):
    return {r[0]: tuple(r[c] for c in cols) for r in df.collect()}


@pytest.fixture(params=["odd", "docs"])
def table(request):
    return request.getfixturevalue(request.param)


def test_quality(table):
    got = by_id(quality_rules.judge(table).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert got == {d: ref.quality(t) for d, t in pairs(table)}
    kept = quality_rules.keep_good(table)
    assert kept.columns == table.columns and {r.doc_id for r in kept.collect()} <= {d for d, t in pairs(table) if not ref.quality(t)[-1]}


def test_quality_keeps_clean_documents(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 1")
    judged = quality_rules.judge(docs).join(labels, "doc_id").filter("not base_failed")
    assert judged.filter("not kept").count() == 0


@pytest.mark.parametrize("runs", [False, True])
def test_line_dedup(table, runs):
    got = line_dedup.dedup_lines(table, runs=runs)
    assert {r.doc_id: r.text or "" for r in got.collect()} == ref.dedup_lines(pairs(table), runs)
    assert got.columns[: len(table.columns)] == table.columns


def test_chunks_resist_shifts():
    body = [f"line number {i} of a long shared passage" for i in range(40)]
    a = {x[3] for x in line_dedup.passages("\n".join(["lead in", *body, "tail"]).encode())}
    b = {x[3] for x in line_dedup.passages("\n".join(["quite another", "beginning here", *body, "end"]).encode())}
    assert sum(len(x) for x in a & b) > 0.8 * len("\n".join(body))
    for text in (b"", b"\n\n\n"):
        assert line_dedup.passages(text, runs=True) == []


def test_line_dedup_of_awkward_columns(spark):
    two = "first line of two\nsecond line of two"
    rows = spark.createDataFrame([(1, two, 5, "x"), (2, two, 6, None), (3, None, 7, "")], "`a.id` long, `a.b` string, n_lines long, `_l_x` string")
    out = line_dedup.dedup_lines(rows, "a.id", "a.b")
    assert out.columns == ["a.id", "a.b", "_l_x", "n_lines", "n_removed_lines", "n_removed_chunks"]
    assert sorted((r["a.id"], r["a.b"], r.n_lines) for r in out.collect()) == [(1, two, 2), (2, "", 2), (3, "", 0)]


def test_equal_ids_with_different_texts(spark):
    two = "first line of two\nsecond line of two"
    rows = spark.createDataFrame([(1, f"{two}\nown end"), (1, two), (1, f"other start\n{two}")], "doc_id long, text string")
    out = [r.text for r in line_dedup.dedup_lines(rows).collect()]
    assert any("other start" in t for t in out) and any("own end" in t for t in out) and sum("first line" in t for t in out) >= 1


def test_repeated_ids_count_as_one_document(spark):
    two = "first line of two\nsecond line of two\n" * 3
    rows = spark.createDataFrame([(1, two), (1, two), (None, two), (2, two)], "doc_id long, text string")
    out = {(r.doc_id, r.n_removed_lines > 0) for r in line_dedup.dedup_lines(rows).collect()}
    assert (2, True) in out and {d for d, _ in out} == {1, 2, None}


def test_simhash(table):
    got = simhash.near_groups(table, shingle=3, radius=3)
    want = ref.simhash(pairs(table), 3, 3)
    assert {r.doc_id: (r.fingerprint % (1 << 64), r.component_id) for r in got.collect()} == want
    kept = {r.doc_id for r in simhash.keep_one(table, shingle=3).collect()}
    assert kept == {c for _, c in want.values()}


def test_bk_tree_and_shards(spark):
    rng = np.random.default_rng(1)
    centre = rng.integers(0, 1 << 63, 3)
    values = sorted({int(c) ^ sum(1 << int(b) for b in rng.choice(63, rng.integers(0, 5), replace=False)) for c in centre for _ in range(150)})
    tree = simhash.BKTree(np.array(values, np.int64))
    for q in values[:20]:
        found = {values[n] for n, near, _ in tree.search(np.array([q], np.int64), 3) if len(near)}
        assert found == {v for v in values if (v ^ q).bit_count() <= 3}
    prints = spark.createDataFrame([(v,) for v in values], "fingerprint long")
    # shards far smaller than the groups are cut again and again
    roots = {r.node: r.root for r in simhash.components(simhash.links(prints, 3, shard=16)).collect()}
    want = ref.components({v: v for v in values}, 3)
    assert {v: roots.get(v, v) for v in values} == want


def test_decontamination(spark, table):
    items = [(1, PASSAGE), (2, "x " + PASSAGE), (3, None), (4, ""), (5, "two words"), (1, "other text, the same id"), (None, "word")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = ref.contamination(pairs(table), items)
    for block in (1 << 20, 40):  # one block, and several
        out = decontaminate.contamination(table, bench, block_bytes=block)
        digest = F.sha2(F.array_join("items", ",").cast("binary"), 256)
        assert by_id(out.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("s"), "contaminated"), "n_words", "n_hit", "n_items", "s", "contaminated") == want
    kept = decontaminate.clean(table, bench)
    assert kept.columns == table.columns and {r.doc_id for r in kept.collect()} == {d for d, w in want.items() if not w[-1]}
    assert decontaminate.clean(table, bench.filter("false")).count() == table.count()


def test_a_long_item_in_pieces(spark):
    words = [f"w{k}" for k in range(400)]
    docs = [(k, " ".join(["lead", *words[k : k + 25], "tail"])) for k in range(0, 370, 7)]
    items = [(1, " ".join(words)), (2, "w3 w4 w5 w6 w7 w8 w9 w10 w11 w12 w13")]
    out = decontaminate.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), block_bytes=300)
    got = by_id(out.select("doc_id", "n_words", "n_hit", F.size("items").alias("n")), "n_words", "n_hit", "n")
    assert got == {d: w[:3] for d, w in ref.contamination(docs, items).items()}


def judged(texts, test):
    found = [([], set(), 0) for _ in texts]
    decontaminate.judge([decontaminate.split_words(t) for t in texts], test, found)
    return found


def test_longest_match():
    import pickle

    test = pickle.loads(pickle.dumps(decontaminate.TestSet([("1", PASSAGE.encode(), 0)], 10)))
    out = judged([f"a {PASSAGE} b".encode(), b"nothing", b""], test)
    assert [f[2] for f in out] == [12, 0, 0] and out[0][0] == [[1, 13]]


def test_suffix_array_is_sorted():
    test = decontaminate.TestSet([("1", b"b a b a b a", 0)], 3)
    ids = np.array([test.number.get(w, 0) for w in b"a b a b a b x b a b".split()], np.int64)
    starts, _ = decontaminate.suffix_array(ids, test)
    keys = [tuple(ids[s : s + 3]) for s in starts]
    assert keys == sorted(keys) and len(starts) > 3


def test_token_counts_and_bpe(table):
    from tokenizers import Tokenizer

    path = queries.vocabulary()
    lib = Tokenizer.from_file(path)
    want = {d: ref.tokens(lib, t) for d, t in pairs(table)}
    out = segment_bpe.encode(table, path)
    assert by_id(out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("a"), F.sha2(F.col("decoded").cast("binary"), 256).alias("b")), "n_tokens", "a", "b") == want
    count = token_counts.token_counts(table, path)
    assert by_id(count.select("doc_id", "n_bytes", "n_tokens"), "n_bytes", "n_tokens") == {d: (len((t or "").encode()), want[d][0]) for d, t in pairs(table)}


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_counts_with_other_vocabularies(name):
    counter = token_counts.PieceCounter(queries.vocabulary(name))
    texts = [t for t in TEXTS if t and len(t) < 5000]
    assert counter.counts([t.encode() for t in texts]) == counter.encode(texts)


def test_merge_forms_agree():
    v = segment_bpe.Vocabulary(queries.vocabulary())
    rng = np.random.default_rng(2)
    for n in (2, 3, 8, 17, 32):
        words = ["".join(rng.choice(list("abcdeinrst"), n)) for _ in range(40)]
        rows = [[*map(v.inner.__getitem__, w.encode()[:-1]), v.last[w.encode()[-1]]] for w in words]
        assert segment_bpe.merge_rows(v, np.array(rows)) == [segment_bpe.merge_word(v, r) for r in rows]


def test_pii(table):
    out = pii.extract(table)
    rows = {r.doc_id: r for r in out.collect()}
    for d, t in pairs(table):
        base = [(s.kind, s.start, s.end) for s in rows[d].base]
        assert base == ref.base_spans(t)
        assert set(base) <= {(s.kind, s.start, s.end) for s in rows[d].spans}


def test_pii_discovers_by_context(spark):
    seeds = [(i, f"call me, badge no: {i:02x}deadbeef{i:02x}c0ffee1a today") for i in range(6)]
    rows = spark.createDataFrame([*seeds, (9, "his badge no: ZK-774512 is lost"), (10, "room 774512x is free")], "doc_id long, text string")
    out = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in pii.extract(rows).collect()}
    assert out[9] == [("secret", 14, 23)] and out[10] == []


def test_many_matches_keep_their_places(spark):
    text = "é a@b.cd " * 500
    row = pii.extract(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()[0]
    assert [(s.start, s.end) for s in row.base] == [(m.start(), m.end()) for m in re.finditer("a@b.cd", text)]


@pytest.fixture(scope="module")
def model():
    return license_scan.train([])


def test_licences(table, model):
    assert model.held_out["accuracy"] > 0.95
    out = {r.doc_id: [(x.paragraph, x.family) for x in r.licences if x.family != "unknown"] for r in license_scan.scan(table, model).collect()}
    fixed = {
        "Licensed under CC BY-NC 4.0.": "CC", "Released under the MIT License.": "MIT", "Licensed under the Apache License, Version 2.0.": "Apache",
        "This work is licensed under the GNU General Public License, version 3.": "GPL", "All rights reserved.": "proprietary",
    }
    assert out == {d: [(i, fixed[x]) for i, x in enumerate((t or "").split("\n")) if x in fixed] for d, t in pairs(table)}


#: Paragraphs as they stand in public files, none of them a training row.
HELD_OUT = {
    "MIT": (
        "This project is open source and available under the terms of the MIT license, see the file COPYING for the full text.", "The library is MIT licensed; contributions are accepted under the MIT License as well.",
        "in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense,", "jQuery is provided under the MIT license. Copyright jQuery Foundation and other contributors.", "* SPDX-License-Identifier: MIT */",
    ),
    "ISC": ("node-semver is distributed under the ISC License, copyright Isaac Z. Schlueter.", "# SPDX-License-Identifier: ISC", "Copyright notice and this permission notice appear in all copies; permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted."),
    "BSD": (
        "Go source is governed by a BSD-style license that can be found in the LICENSE file.", "NumPy is licensed under the BSD license, enabling reuse with few restrictions; see the BSD 3-Clause License.",
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the", "// SPDX-License-Identifier: BSD-3-Clause",
        "Neither the name of Google Inc. nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    "Apache": (
        "Spark is released under the Apache License 2.0 by its contributors.", "limitations under the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "All examples are licensed under the Apache License, Version 2.0, unless a file says otherwise.",
        "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.", "SPDX-License-Identifier: Apache-2.0",
    ),
    "GPL": (
        "git is free software; it is covered by the GNU General Public License version 2.", "GNU Emacs is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "You should have received a copy of the GNU General Public License along with GNU Emacs. If not, see <https://www.gnu.org/licenses/>.", "The kernel is licensed under the GNU GPL version 2, with the syscall note.", "// SPDX-License-Identifier: GPL-2.0-only",
    ),
    "LGPL": ("glib is licensed under the GNU Lesser General Public License; linking is allowed.", "FFmpeg may be used under the terms of the GNU Lesser General Public License v2.1 or later.", "/* SPDX-License-Identifier: LGPL-2.1-or-later */"),
    "AGPL": ("The server is licensed under the GNU Affero General Public License, unlike the client.", "Our hosted edition is distributed under the terms of AGPLv3.", "SPDX-License-Identifier: AGPL-3.0-or-later"),
    "MPL": (
        "Firefox is made available to you under the terms of the Mozilla Public License 2.0.", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "SPDX-License-Identifier: MPL-2.0", "- License, v. 2.0. This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    ),
    "CC": (
        "Text is available under the Creative Commons Attribution-ShareAlike 4.0 International License; additional terms may apply.", "Photo by J. Doe, licensed under CC BY-SA 4.0 via Wikimedia.",
        "The documentation is published under CC BY 4.0, the code is not.", "Except where otherwise noted, content is licensed under a Creative Commons Attribution-NonCommercial license.", "Data released under CC0 1.0, no rights reserved.",
    ),
    "Unlicense": ("youtube-dl is released into the public domain under the Unlicense by the copyright holders.", "Everything in this directory is free and unencumbered software released into the public domain."),
    "proprietary": ("Copyright (c) 1999-2021 Example Corp. All rights reserved.", "This file is proprietary and confidential; unauthorized copying of this file, via any medium, is strictly prohibited."),
}
NO_FAMILY = (
    "Eclipse is provided under the Eclipse Public License 2.0.", "Use of the font is subject to the SIL Open Font License.", "Please read the end user license agreement before you install the program.",
    "Released under the Quux Sharing License, version 7.", "The zlib License covers the compression code.",
)
PLAIN = (
    "He lost his licence after the accident.", "The general spoke in public about the war.", "Permission to land was granted at noon.", "The apache tribe lived in the south-west.", "All her rights were denied by the court.",
    "The recipe comes with a warranty of good taste.", "We met on the village commons.", "Software eats the world, said the investor.", "The dog license costs ten dollars a year.", "They reserved a table for two.",
)


def test_held_out_licence_paragraphs(spark, model):
    known = [(t, k) for k, ts in HELD_OUT.items() for t in ts]
    rows = [*known, *[(t, "unknown") for t in NO_FAMILY], *[(t, None) for t in PLAIN]]
    table = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: [x.family for x in r.licences] for r in license_scan.scan(table, model).collect()}
    wrong = [(t, k, got[i]) for i, (t, k) in enumerate(rows) if got[i] != ([k] if k else [])]
    assert sum(got[i] == [k] for i, (_, k) in enumerate(known)) >= 0.9 * len(known), wrong
    # what has no family never gets one, and ordinary sentences are rarely taken for licences
    assert all(got[i] in ([], ["unknown"]) for i in range(len(known), len(rows))), wrong
    assert sum(bool(got[i]) for i, (_, k) in enumerate(rows) if k is None) <= 0.2 * len(PLAIN), wrong


def plain_licences(text, model, confirm=0.7):
    """n_paragraphs and (paragraph, family, probability, confirmed), from the definitions."""
    ls = license_scan
    out = []
    lines = (text or "").split("\n")
    for i, line in enumerate(lines):
        ws = ls.words(line)
        if not ls.ANCHORS.intersection(ws):
            continue
        p = model.probabilities(line)
        at = max(range(len(p)), key=lambda k: (p[k], -k))
        family, pairs = ls.FAMILIES[at], {f"{a} {b}" for a, b in zip(ws, ws[1:])}
        share = 0.0
        for whole, t in ls.COMPARED.get(family, ()):
            n = len({*t} & (pairs if " " in t[0] else {*ws}))
            share = max(share, n / len(t), n / len(pairs) if whole and len(pairs) >= 5 else 0.0)
        met = family not in ("none", "unknown") and p[at] >= model.threshold and share >= confirm
        if family != "none":
            out.append((i, family if met else "unknown", round(p[at], 3), met))
    return sum(x != "" for x in lines), out


def test_licence_scan_matches_the_plain_version(spark, model, table):
    rng = np.random.default_rng(3)
    ts = [t for ts in (*HELD_OUT.values(), NO_FAMILY, PLAIN) for t in ts] + [t for ts in license_scan.texts.TEMPLATES.values() for t in ts]
    mixed = ["\n".join(" ".join(rng.permutation(w := t.split())[: rng.integers(1, len(w) + 1)]) if rng.random() < 0.5 else t for t in rng.choice(ts, rng.integers(1, 6))) for _ in range(150)]
    rows = [(None if d is None else int(d), t) for d, t in pairs(table)] + [(10_000 + i, t) for i, t in enumerate(mixed)]
    out = license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()
    got = {r.doc_id: (r.n_paragraphs, [(x.paragraph, x.family, round(x.probability, 3), x.confirmed) for x in r.licences]) for r in out}
    for d, t in rows:
        n, want = plain_licences(t, model)
        assert got[d][0] == n and [(x[0], x[1], x[3]) for x in got[d][1]] == [(x[0], x[1], x[3]) for x in want], t
        assert all(abs(x[2] - y[2]) < 0.002 for x, y in zip(got[d][1], want))


def test_negative_sample(spark):
    rows = [(i, f"Permission to park here is granted to number {i} only.\nReleased under the MIT License.\nno word of it") for i in range(50)]
    found = license_scan.negative_sample(spark.createDataFrame(rows, "doc_id long, text string"))
    assert len(found) == 50 and all(x.startswith("Permission to park") for x in found)


def test_empty_tables(spark, odd):
    none = odd.filter("false")
    bench = spark.createDataFrame([(1, PASSAGE)], "item_id long, text string")
    path = queries.vocabulary()
    for out in (
        quality_rules.judge(none), line_dedup.dedup_lines(none), simhash.near_groups(none), decontaminate.contamination(none, bench), segment_bpe.encode(none, path),
        token_counts.token_counts(none, path), pii.extract(none), license_scan.scan(none, license_scan.train(license_scan.negative_sample(none))),
    ):
        assert out.count() == 0


def test_chats(spark):
    said = r"\### Assistant: </turn> ok"
    rows = [
        (1, 0, "user", said), (1, 1, "assistant", said), (2, 0, None, None), (2, 1, "assistant", ""), (2, 1, "assistant", ""), (3, 0, "a:b\n#<%", "x\n</turn>\n### user: y"),
        (3, 1, "assistant", "\\" * 5), (3, 2, "assistant", "\\\\</turn>###\\###### ## #"), (None, 0, "assistant", "🙂é"), (4, None, "assistant", "n" * 5000),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    out = chat_format.format_chats(df)
    back = {r.conv_id: r for r in chat_format.read_back(out).collect()}
    shown = {r.conv_id: r for r in out.collect()}
    for c in {r[0] for r in rows}:
        own = sorted(((t is not None, t or 0), r or "", x or "") for k, t, r, x in rows if k == c)
        assert [(t.role, t.text) for t in back[c].turns] == [(r, x) for _, r, x in own] and back[c].round_trip
        assert back[c].loss_text == "".join(x for _, r, x in own if r == "assistant")
        f = shown[c].formatted
        assert back[c].formatted_chars == len(f)
        assert len(shown[c].loss_spans) == sum(r == "assistant" for _, r, _ in own)
        bodies = [f[s.start : s.end] for s in shown[c].loss_spans]
        plain = [re.sub(r"(?<!\\)\\(\\*)(###|</turn>)", r"\1\2", b) for b in bodies]
        assert plain == [x for _, r, x in own if r == "assistant"]
    assert chat_format.format_chats(df.filter("false")).count() == 0


def test_warc(spark):
    rows = [(5, "https://A.b.org:8080/x?y#z", "same"), (2, "http://c.org", "same"), (9, "http://c.org", "same"), (7, None, None), (8, "", ""), (1, "weird\turl\n", "é" * 9), (3, "http://c.org/long", "z" * 200_000)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, key string")
    _, directory = warc.archive(pages)
    got = {r.page_id: tuple(r)[1:] for r in warc.look_up(pages, directory).collect()}
    first = {}
    for p, _, h in rows:
        first[h or ""] = min(first.get(h or "", p), p)
    want = {}
    for p, _, h in rows:
        body = (h or "").encode()
        f = first[h or ""]
        want[p] = (len(body), ref.base32_sha1(body), "response" if f == p else "revisit", None if f == p else f)
    assert got == want
    _, directory = warc.archive(pages, dedup_from=5)
    kinds = {r.page_id: r.record_type for r in warc.look_up(pages, directory).collect()}
    assert set(kinds.values()) == {"response"}
    _, directory = warc.archive(pages.filter("false"))
    assert warc.look_up(pages.filter("false"), directory).count() == 0


def test_surt():
    assert warc.surt("https://u@M.Site.org:80/a?b#c") == "org,site,m:80)/a?b" and warc.surt("http://x.y") == "y,x)/"


def test_small_blocks_and_repeated_captures(spark):
    pages = spark.createDataFrame([(i % 40, "http://h.org/same", f"text {i % 40}") for i in range(80)], "page_id long, url string, html string")
    folder = warc.shared_path(spark, "warc")
    captures = warc.write(pages, folder)
    directory = warc.build_index(captures, folder, block_rows=3)
    out = warc.look_up(pages, directory).collect()
    assert len(out) == 80 and all(r.record_type == "response" for r in out)


def test_one_url_with_many_captures(spark, monkeypatch):
    """Pages without a URL share one key: a lookup still reads few blocks, and revisits of one payload find its response."""
    pages = spark.range(6000).selectExpr("id AS page_id", "CAST(NULL AS STRING) AS url", "IF(id % 3 = 0, NULL, concat('text ', id)) AS html")
    folder = warc.shared_path(spark, "warc")
    captures = warc.write(pages, folder)
    directory = warc.build_index(captures, folder, block_rows=100)
    out = {r.page_id: (r.payload_bytes, r.record_type, r.refers_to) for r in warc.look_up(pages, directory).collect()}
    assert out == {i: (0 if i % 3 == 0 else len(f"text {i}"), "response" if i % 3 or i == 0 else "revisit", None if i % 3 or i == 0 else 0) for i in range(6000)}
    reader, read = warc.Reader(directory), []
    monkeypatch.setattr(reader, "bytes_at", lambda *a, own=reader.bytes_at: (read.append(a), own(*a))[1])
    entries = reader.span(("", "=3001"), ("", "=3002"))
    assert len(entries) <= 2 and len([*reader.captures(entries, (b"", b"=3001"))]) == 1 and len(read) == 1


def test_pages_of_any_type(spark):
    rows = [("a b%c\n", None, "x"), ("", None, "x"), (None, None, "x"), ("z", "http://q/é%41?x=1\t2", "y"), ("zz", "http://q", "y"), ("1", "http://q", None)]
    pages = spark.createDataFrame(rows, "page_id string, url string, html string")
    _, directory = warc.archive(pages)
    out = sorted(((r.page_id is not None, r.page_id, r.record_type, r.refers_to) for r in warc.look_up(pages, directory).collect()), key=str)
    assert out == sorted([(True, "a b%c\n", "revisit", ""), (True, "", "response", None), (False, None, "revisit", ""), (True, "z", "response", None), (True, "zz", "revisit", "z"), (True, "1", "response", None)], key=str)


def test_a_revisit_is_read_through_its_response(spark):
    """Size and digest of a revisit come from the payload that it refers to: without that response there is no result."""
    pages = spark.createDataFrame([(1, "http://a.b", "same"), (2, "http://c.d", "same")], "page_id long, url string, html string")
    folder = warc.shared_path(spark, "warc")
    captures = warc.write(pages, folder)
    alone = warc.build_index(captures.filter("page = '=2'"), folder)
    with pytest.raises(Exception, match="no capture of page 1"):
        warc.look_up(pages.filter("page_id = 2"), alone).collect()
