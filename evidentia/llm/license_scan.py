"""Licence scans: a trained paragraph classifier over word n-grams, confirmed by comparison with templates.

Training (driver, a few thousand short rows): paragraphs of public licence texts, variants of them with words left out
or changed, fragments as hard-wrapped files have them, and usage lines built by rule (`license_texts`); licence-like
sentences and names of licences of no family are the class `unknown`; ordinary sentences and up to `negative_rows`
paragraphs of the corpus that share words with templates but match none are the class `none`. Multinomial logistic
regression over the presence of word 1- and 2-grams that hold a content word is fitted by full-batch gradient steps with
momentum. Usage lines in frames that no training row has set the temperature (calibration) and the least probability at
which predicted families are right in 98 of 100 cases; below it a licence-like paragraph is `unknown`.

Scoring is one projection of built-in expressions: lines are the paragraphs; a paragraph without any of `ANCHORS` is
ordinary; the others are scored by looking their n-grams up by hash in a literal table. A predicted family is confirmed
if enough of the word pairs of one of its templates, names or identifiers occur in the paragraph, or enough of the
paragraph's in one of its templates; an unconfirmed prediction becomes `unknown`. Nothing shuffles.

Defined results: null and empty texts have no paragraphs; a paragraph of any length is scored whole; repeated rows are
judged alike; an empty table gives an empty result (and a model fitted without corpus rows); input columns pass
through, except the added ones.
"""

from __future__ import annotations

import json
import math
import random
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import license_texts as texts
from .common import let

#: Words that say nothing about a licence.
FUNCTION_WORDS = set("a an and are as at by for from in is it its may not of on or that the this to under with without you be no any use part file copy work project own".split())
#: A paragraph about a licence has one of these.
ANCHORS = set(
    "license licence licensed licenses licences licensing licensee licensees licensor sublicense copyright copyrights copyleft redistribution redistributions redistribute permission granted "
    "warranty warranties rights reserved proprietary confidential unencumbered domain gnu gpl lgpl agpl gplv2 gplv3 lgplv3 agplv3 mozilla mpl apache bsd spdx cc0 creativecommons commons unlicense expat".split()
)
FAMILIES = texts.FAMILIES
BUCKETS = 8192
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: str) -> list[str]:
    return re.findall(_WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text))


def grams(ws: list[str]) -> list[str]:
    """Distinct 1- and 2-grams that hold a content word."""
    out = [w for w in ws if w not in FUNCTION_WORDS]
    out += [f"{a} {b}" for a, b in zip(ws, ws[1:]) if a not in FUNCTION_WORDS or b not in FUNCTION_WORDS]
    return [*dict.fromkeys(out)]


def compared(ws: list[str]) -> list[str]:
    """What a template is compared by: its distinct word pairs, or its word."""
    return [*dict.fromkeys([f"{a} {b}" for a, b in zip(ws, ws[1:])] or ws)]


#: family -> (whether a licence's own text, its compared pairs)
COMPARED = {
    k: [(True, compared(words(t))) for t in texts.TEMPLATES.get(k, ())] + [(False, compared(words(t))) for t in texts.NAMES.get(k, ())]
    + [(False, compared(words(f"SPDX-License-Identifier: {t}"))) for t in texts.SPDX.get(k, ())]
    for k in FAMILIES[1:-1]
}


@dataclass(frozen=True)
class Model:
    """weights: n-gram -> one weight a family, already divided by the temperature."""

    weights: dict
    bias: list
    threshold: float
    held_out: dict = field(default_factory=dict)

    def probabilities(self, text: str) -> list[float]:
        z = list(self.bias)
        for g in grams(words(text)):
            for k, w in enumerate(self.weights.get(g, ())):
                z[k] += w
        e = [math.exp(x - max(z)) for x in z]
        return [x / sum(e) for x in e]


def _variants(ws: list[str], n: int, rng: random.Random) -> list[list[str]]:
    out = [ws]
    for _ in range(n):
        out.append([w if rng.random() > 0.08 else f"x{rng.randrange(1000)}" for w in ws if rng.random() > 0.1])
    return out


def _fragments(ws: list[str], rng: random.Random) -> list[list[str]]:
    """Lines of a hard-wrapped paragraph, wrapped twice, that a scan would look at."""
    out = []
    for width in (rng.randrange(8, 12), rng.randrange(12, 16)) if len(ws) > 16 else ():
        out += [ws[a : a + width] for a in range(0, len(ws), width)]
    return [x for x in out if ANCHORS.intersection(x)]


def training_rows(negatives: list[str], variants: int = 6, seed: int = 7) -> list[tuple[list[str], int]]:
    rng = random.Random(seed)
    rows = []
    for k, ts in texts.TEMPLATES.items():
        for t in ts:
            rows += [(v, FAMILIES.index(k)) for v in (*_variants(words(t), variants, rng), *_fragments(words(t), rng))]
    for t, k in (*texts.usages(texts.FRAMES), *texts.spdx_lines(), *texts.spdx_lines("license = \"{}\"")):
        rows.append((words(t), FAMILIES.index(k)))
    rows += [(v, len(FAMILIES) - 1) for t in texts.OTHER for v in _variants(words(t), 2 * variants, rng)]
    rows += [(v, 0) for t in texts.ORDINARY for v in _variants(words(t), 2 * variants, rng)]
    return rows + [(words(t), 0) for t in negatives]


def train(negatives: list[str], steps: int = 150, rate: float = 6.0, decay: float = 2e-4) -> Model:
    import numpy as np

    rows = training_rows(negatives)
    count: dict[str, int] = {}
    for ws, _ in rows:
        for g in grams(ws):
            count[g] = count.get(g, 0) + 1
    known = sorted(g for g, n in count.items() if n > 1)
    place = {g: i for i, g in enumerate(known)}

    def matrix(part):
        x = np.zeros((len(part), len(known)), np.float32)
        for r, (ws, _) in enumerate(part):
            for g in grams(ws):
                if g in place:
                    x[r, place[g]] = 1.0
        return x, np.array([y for _, y in part])

    def soft(z):
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    x, y = matrix(rows)
    target = np.eye(len(FAMILIES), dtype=np.float32)[y]
    # classes weigh alike, however many rows they have
    weight = (1.0 / np.bincount(y, minlength=len(FAMILIES)))[y].astype(np.float32)[:, None] / len(FAMILIES)
    w, b = np.zeros((len(known), len(FAMILIES)), np.float32), np.zeros(len(FAMILIES), np.float32)
    vw, vb = np.zeros_like(w), np.zeros_like(b)
    for _ in range(steps):
        g = (soft(x @ w + b) - target) * weight
        vw = 0.9 * vw + x.T @ g + decay * w
        vb = 0.9 * vb + g.sum(axis=0)
        w -= rate * vw
        b -= rate * vb
    held = [(words(t), FAMILIES.index(k)) for t, k in (*texts.usages(texts.CALIBRATION_FRAMES), *texts.spdx_lines("SPDX: {}"))]
    hx, hy = matrix(held)
    z = hx @ w + b
    loss = lambda t: -np.log(soft(z / t)[np.arange(len(hy)), hy] + 1e-12).mean()
    heat = min((0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 3.0), key=loss)
    p = soft(z / heat)
    top, best = p.argmax(axis=1), p.max(axis=1)
    family = (top > 0) & (top < len(FAMILIES) - 1)
    right = top == hy
    fits = [t for t in sorted({0.0, *np.round(best[family], 4).tolist()}) if right[family & (best >= t)].mean() >= 0.98]
    weights = {g: [round(float(v), 4) for v in w[i] / heat] for g, i in place.items()}
    measured = {"rows": len(held), "accuracy": float(right.mean()), "temperature": heat}
    return Model(weights, [round(float(v), 4) for v in b / heat], float(fits[0]) if fits else 1.0, measured)


def negative_sample(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", rows: int = 300, sample_docs: int = 1000) -> list[str]:
    """Up to `rows` paragraphs with a word of `ANCHORS` that match no template, out of about `sample_docs` documents.

    Documents are taken by the hash of their id, at a rate that keeps their number the same for a corpus of any size; of
    their distinct paragraphs those of least hash count, whatever the order of rows. A paragraph matches if it has a
    third of the word pairs of a template or name; it is then no negative.
    """
    every = max(1, docs.count() // sample_docs)
    taken = docs.filter(F.pmod(F.xxhash64(F.col(f"`{doc_id}`")), F.lit(every)) == 0)
    paragraphs = taken.select(F.explode(F.split(F.col(f"`{text}`"), "\n")).alias("p")).filter("length(p) between 20 and 2000")
    paragraphs = paragraphs.filter(_near(F.col("p"))).distinct().orderBy(F.xxhash64("p"), "p").limit(4 * rows)
    out = []
    for r in paragraphs.collect():
        own = {*compared(words(r.p)), *words(r.p)}
        if not any(3 * len(own.intersection(t)) >= len(t) for ts in COMPARED.values() for _, t in ts):
            out.append(r.p)
    return out[:rows]


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(_WORD), F.lit(0))


def _near(text: Column) -> Column:
    """Whether a text has a word of `ANCHORS`."""
    return F.arrays_overlap(F.split(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), _constant(sorted(ANCHORS)))


def _constant(values: list[str]) -> Column:
    """A literal array of words or word pairs."""
    return F.split(F.lit("\n".join(values)), "\n")


def scan(docs: DataFrame, model: Model, text: str = "text", confirm: float = 0.7) -> DataFrame:
    """`docs` with n_paragraphs and licences: array<struct<paragraph, family, probability, confirmed>> of paragraphs that are not ordinary."""
    from xxhash import xxh64_intdigest

    function = _constant(sorted(FUNCTION_WORDS))
    table: list[list] = [[] for _ in range(BUCKETS)]
    for g, w in model.weights.items():
        h = xxh64_intdigest(g.encode(), 42)
        h -= (h >> 63) << 64
        table[h % BUCKETS].append({"h": h, "w": w})
    weights = F.from_json(F.lit(json.dumps(table)), "array<array<struct<h:bigint,w:array<double>>>>")
    bias, families = F.array(*map(F.lit, model.bias)), F.array(*map(F.lit, FAMILIES))

    def two(ws: Column) -> Column:
        n = F.size(ws) - 1
        return F.when(n > 0, F.zip_with(F.slice(ws, F.lit(1), n), F.slice(ws, F.lit(2), n), lambda a, b: F.concat(a, F.lit(" "), b))).otherwise(F.array().cast("array<string>"))

    def features(ws: Column) -> Column:
        """Hashes of the words that are no function words and of all pairs; pairs of function words are not in the table."""
        return F.transform(F.array_distinct(F.concat(F.array_except(ws, function), two(ws))), lambda g: F.xxhash64(g))

    def add(z: Column, h: Column) -> Column:
        found = F.filter(F.get(weights, F.pmod(h, F.lit(BUCKETS)).cast("int")), lambda x: x["h"] == h)
        return F.when(F.size(found) > 0, F.zip_with(z, F.get(found, F.lit(0))["w"], lambda a, b: a + b)).otherwise(z)

    def classed(z: Column) -> Column:
        def with_top(top: Column) -> Column:
            p = 1.0 / F.aggregate(z, F.lit(0.0), lambda t, x: t + F.exp(x - top))
            return F.struct((F.array_position(z, top).cast("int") - 1).alias("at"), p.alias("p"))

        return let(F.array_max(z), with_top)

    def shared(ws: Column, family: Column) -> Column:
        """The largest part that the paragraph has of a template, name or identifier, or a text's template of the paragraph."""

        def with_pairs(pairs: Column) -> Column:
            out = F.lit(0.0)
            for k, ts in COMPARED.items():
                own = []
                for whole, t in ts:
                    n = F.size(F.array_intersect(pairs if " " in t[0] else ws, _constant(t)))
                    own.append(n / len(t))
                    if whole:
                        own.append(F.when(F.size(pairs) >= 5, n / F.size(pairs)).otherwise(0.0))
                out = F.when(family == k, F.greatest(*own, F.lit(0.0))).otherwise(out)
            return out

        return let(F.array_distinct(two(ws)), with_pairs)

    def judged(p: Column) -> Column:
        def with_words(ws: Column) -> Column:
            def with_class(c: Column) -> Column:
                family = F.get(families, c["at"])

                def with_met(met: Column) -> Column:
                    return F.struct(F.when(family.isin("none", "unknown") | met, family).otherwise("unknown").alias("family"), F.round(c["p"], 4).alias("probability"), met.alias("confirmed"))

                known = ~family.isin("none", "unknown") & (c["p"] >= model.threshold)
                return let(known & (F.when(known, shared(ws, family)).otherwise(0.0) >= confirm), with_met)

            return let(let(F.aggregate(features(ws), bias, add), classed), with_class)

        return F.struct(p["i"].alias("paragraph"), let(_words(p["t"]), with_words).alias("c"))

    lines = F.split(F.coalesce(F.col(f"`{text}`"), F.lit("")), "\n")
    numbered = F.filter(F.transform(lines, lambda t, i: F.struct(i.alias("i"), t.alias("t"))), lambda x: _near(x["t"]))
    scored = F.filter(F.transform(numbered, judged), lambda x: x["c"]["family"] != "none")
    flat = F.transform(scored, lambda x: F.struct(x["paragraph"].alias("paragraph"), x["c"]["family"].alias("family"), x["c"]["probability"].alias("probability"), x["c"]["confirmed"].alias("confirmed")))
    # a text without any anchor has no paragraph to score
    flat = F.when(_near(F.col(f"`{text}`")), flat).otherwise(F.array().cast("array<struct<paragraph:int,family:string,probability:double,confirmed:boolean>>"))
    return docs.withColumns({"n_paragraphs": F.size(F.filter(lines, lambda x: x != "")).cast("long"), "licences": flat})
