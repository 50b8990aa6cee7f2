"""Operators whose next step depends on the steps before, over groups of bounded size: questions (at most 16 facets of
32 hits), answers, documents. The corpus itself never enters one.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Groups that `by_group` works on at once.
GROUPS = 256


def select_evidence(hits: list[dict], budget: int, overlap: float = 0.65, share: float = 0.8, weight: float = 0.12) -> list[dict]:
    """Chooses hits (facet, rank, score, passage, doc, block, start, end, cost, near) within the budget.

    The first fitting hit of every facet; then by score, less `weight` for each one already taken from its document, up
    to `share` of the budget; then, for each hit chosen so far, the passages `near` it (dicts like hits, nearest first);
    then the hits passed over, in their order. A passage that was chosen, or that overlaps a chosen one of its block by
    `overlap` of the shorter, is passed over.
    """
    chosen: list[dict] = []
    taken: dict = {}
    used, seen = 0, set()

    def fits(h: dict, ceiling: float) -> bool:
        if h["passage"] in seen or used + h["cost"] > ceiling:
            return False
        for c in chosen:
            if c["block"] == h["block"]:
                shared = max(0, min(c["end"], h["end"]) - max(c["start"], h["start"]))
                if shared >= overlap * min(c["end"] - c["start"], h["end"] - h["start"]):
                    return False
        return True

    def take(h: dict, facet, reason: str) -> None:
        nonlocal used
        chosen.append(h | {"facet": facet, "position": len(chosen) + 1, "reason": reason})
        used += h["cost"]
        seen.add(h["passage"])
        taken[h["doc"]] = taken.get(h["doc"], 0) + 1

    by_facet: dict = {}
    for h in sorted(hits, key=lambda h: (h["facet"], h["rank"])):
        by_facet.setdefault(h["facet"], []).append(h)
    for facet, own in by_facet.items():
        if first := next((h for h in own if fits(h, budget)), None):
            take(first, facet, "facet")
    rest, passed = [h for own in by_facet.values() for h in own], []
    while rest:
        best = min(rest, key=lambda h: (-h["score"] / (1 + weight * taken.get(h["doc"], 0)), h["rank"], h["facet"]))
        rest.remove(best)
        if fits(best, max(used, int(budget * share))):
            take(best, best["facet"], "diversity")
        else:
            passed.append(best)
    for h in [*chosen]:
        for near in h.get("near") or ():
            if fits(near, budget):
                take(near | {"score": 0.0, "rank": None}, h["facet"], "adjacent")
    for h in passed:
        if fits(h, budget):
            take(h, h["facet"], "remaining")
    return chosen


def values(column) -> list:
    """The values of an Arrow array, as its to_pylist gives them: lists and structs field by field, which takes a fraction of the time."""
    import pyarrow as pa

    kind = column.type
    if pa.types.is_struct(kind) and kind.num_fields:
        names = [f.name for f in kind]
        out = [dict(zip(names, v, strict=True)) for v in zip(*map(values, column.flatten()), strict=True)]
    elif pa.types.is_list(kind):
        own, at, out = values(column.flatten()), 0, []
        for n in column.value_lengths().to_pylist():
            out.append(own[at : at + (n or 0)])
            at += n or 0
    else:
        return column.to_pylist()
    if column.null_count:
        out = [v if there else None for v, there in zip(out, column.is_valid().to_pylist(), strict=True)]
    return out


def by_group(rows: DataFrame, key: str, step, schema: str) -> DataFrame:
    """step(key, list of row dicts) -> tuples, for each group: groups travel as arrays, many to an Arrow batch, which
    spares the cost of one pandas frame per group. For groups of bounded size."""
    value = F.struct(*[c for c in rows.columns if c != key])
    packed_ = rows.groupBy(key).agg(F.collect_list(value).alias("rows"))
    out_type = T._parse_datatype_string(schema)

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(out_type)
        for batch in batches:
            # a batch holds many groups, of which a few at a time become Python's objects
            for a in range(0, batch.num_rows, GROUPS):
                part = batch.slice(a, GROUPS)
                out = [t for k, own in zip(values(part.column(0)), values(part.column(1)), strict=True) for t in step(k, own)]
                columns = [*zip(*out, strict=True)] or [()] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kinds, strict=True)], schema=kinds)

    return packed_.mapInArrow(run, schema)


def in_order(rows: DataFrame, key: str, order: str, start, schema: str) -> DataFrame:
    """start(key) -> a step(row dict) -> tuple, applied to each group's rows in their order. For groups of any size: Spark
    sorts the rows, and a task holds one batch of them and the state of the group that it is in."""
    names = rows.columns
    sorted_ = rows.repartition(key).sortWithinPartitions(key, order)
    out_type = T._parse_datatype_string(schema)

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(out_type)
        group, step = None, None
        for batch in batches:
            out = []
            for values in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                row = dict(zip(names, values, strict=True))
                if step is None or row[key] != group:
                    group, step = row[key], start(row[key])
                out.append(step(row))
            columns = [*zip(*out, strict=True)] or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kinds, strict=True)], schema=kinds)

    return sorted_.mapInArrow(run, schema)


def greedy_select(hits: DataFrame, question: str, budget: int) -> DataFrame:
    """select_evidence for each question: question, facet, passage, doc, position, reason, cost."""
    names = ["facet", "passage", "doc", "position", "reason", "cost"]

    def step(key, rows):
        return [(key, *[h[n] for n in names]) for h in select_evidence(rows, budget)]

    kinds = dict(hits.dtypes)
    return by_group(hits, question, step, f"{question} {kinds[question]}, facet {kinds['facet']}, passage {kinds['passage']}, doc {kinds['doc']}, position long, reason string, cost long")


def pack(bundles: list[tuple[int, list[tuple[int, int]]]], costs: list[int], budget: int, overhead: int = 0) -> Iterator[tuple[int, list[int], list[int], list[str]]]:
    """Packets (number, places, seeds, issues) of at most `budget` from bundles (seed, intervals of places that it needs), in the order of the seeds.

    If everything fits it is one packet. A bundle beyond the budget is its seed alone, with an issue that says so; a seed
    beyond it is a packet of its own, with an issue too.
    """
    places = lambda own: {p for a, b in own for p in range(a, b + 1)}
    sums = [0]
    for c in costs:
        sums.append(sums[-1] + c)
    weigh = lambda own: overhead + sum(sums[b + 1] - sums[a] for a, b in own)
    every = sorted({i for _, own in bundles for i in own})
    whole: list[tuple[int, int]] = []
    for a, b in every:
        if whole and a <= whole[-1][1] + 1:
            whole[-1] = (whole[-1][0], max(b, whole[-1][1]))
        else:
            whole.append((a, b))
    if whole and weigh(whole) <= budget:
        yield 1, sorted(places(whole)), [s for s, _ in sorted(bundles)], []
        return
    number, held, cost, seeds, issues = 1, set(), overhead, [], []
    for seed, own in sorted(bundles):
        note = []
        if weigh([(seed, seed)]) > budget:
            own, note = [(seed, seed)], [f"seed_exceeds_budget:{seed}"]
        elif weigh(own) > budget:
            own, note = [(seed, seed)], [f"budget_exceeded:{seed}"]
        new = places(own) - held
        if held and cost + sum(costs[p] for p in new) > budget:
            yield number, sorted(held), seeds, issues
            number, held, cost, seeds, issues = number + 1, set(), overhead, [], []
            new = places(own)
        held |= new
        cost += sum(costs[p] for p in new)
        seeds.append(seed)
        issues += note
    if held:
        yield number, sorted(held), seeds, issues


class Ledger:
    """Admission of calls (kind, requested, measured or None, failed) one after the other.

    Reserves of kinds not yet called are kept back from the others. A call is charged what it measured, or its ceiling
    if it failed or did not measure; one that cannot be admitted is denied and costs nothing.
    """

    def __init__(self, most_calls: int, most_tokens: int, reserves: dict[str, int]):
        self.most_calls, self.most_tokens, self.reserves = most_calls, most_tokens, dict(reserves)
        self.made = self.charged = 0

    def call(self, c: dict) -> dict:
        kept = {k: v for k, v in self.reserves.items() if k != c["kind"]}
        room = self.most_tokens - self.charged - sum(kept.values())
        if self.most_calls - self.made - len(kept) < 1 or room < 1:
            return c | {"admitted": False, "charged": 0, "total": self.charged}
        self.reserves.pop(c["kind"], None)
        ceiling = min(c["requested"], room)
        cost = ceiling if c["failed"] or c["measured"] is None else c["measured"]
        self.made, self.charged = self.made + 1, self.charged + cost
        return c | {"admitted": True, "charged": cost, "total": self.charged}


def budget_ledger(calls: Iterable[dict], most_calls: int, most_tokens: int, reserves: dict[str, int]) -> Iterator[dict]:
    """The calls in order, as a `Ledger` admits them."""
    yield from map(Ledger(most_calls, most_tokens, reserves).call, calls)


def estimate(text: str) -> int:
    return max(len(re.findall(r"\w+|[^\w\s]", text)), -(-len(text) // 4))


def packed(parts: list[str], most: int, finer=None) -> Iterator[str]:
    """Joins parts by blanks while the estimate allows; parts beyond it go through `finer`."""
    held = ""
    for p in parts:
        if estimate(p) > most:
            if held:
                yield held
            held = ""
            yield from finer(p) if finer else (p[a : a + most] for a in range(0, len(p), most))
        elif held and estimate(f"{held} {p}") > most:
            yield held
            held = p
        else:
            held = f"{held} {p}".strip()
    if held:
        yield held


def split_block(text: str, most: int) -> list[str]:
    """A block in pieces of at most `most` estimated tokens: by sentences, by words, by characters."""
    if estimate(text) <= most:
        return [text]
    sentences = [s for s in re.split(r"(?<=[.!?])\s+", text.strip()) if s]
    return [*packed(sentences, most, lambda s: packed(s.split(), most))]


def preformatted_slices(text: str, most: int) -> Iterator[tuple[int, int]]:
    """[start, end) of slices of at most `most` estimated tokens that together are the text, cut after a line end where there is one."""
    at = 0
    while at < len(text):
        # the next token that would be one too many, or the characters that are worth `most`
        words = re.compile(r"\w+|[^\w\s]").finditer(text, at)
        over = next((m.start() for k, m in enumerate(words) if k == most), len(text))
        end = min(over, at + 4 * most)
        if end < len(text):
            line = text.rfind("\n", at, end)
            end = line + 1 if line >= 0 else end
        yield at, end
        at = end


def strict_json(text: str):
    """A JSON value; duplicate keys and non-finite numbers are errors."""

    def once(pairs):
        keys = [k for k, _ in pairs]
        if len({*keys}) < len(keys):
            raise ValueError("duplicate key")
        return dict(pairs)

    def finite(x):
        raise ValueError(f"not finite: {x}")

    return json.loads(text, object_pairs_hook=once, parse_constant=finite)


def salvage(text: str, array: str) -> list:
    """The complete leading records of the first field `array` of a cut-off object."""
    try:
        return strict_json(text)[array]
    except (ValueError, KeyError, TypeError):
        pass
    head = re.match(rf'\s*\{{\s*"{re.escape(array)}"\s*:\s*\[', text)
    out, at = [], head.end() if head else len(text)
    scan = json.JSONDecoder()
    while gap := re.compile(r"\s*,?\s*").match(text, at):
        try:
            value, at = scan.raw_decode(text, gap.end())
        except ValueError:
            break
        out.append(value)
    return out


def windows(starts: list[int], length: int, size: int, overlap: int) -> list[tuple[int, int, int]]:
    """(start, end, tokens) of windows of `size` tokens that begin at `starts` in a text: a window ends where the next token begins."""
    out = []
    for a in range(0, len(starts), size - overlap):
        b = min(len(starts), a + size)
        out.append((starts[a] if a else 0, starts[b] if b < len(starts) else length, b - a))
        if b == len(starts):
            break
    return out


def token_windows(text: str, size: int = 160, overlap: int = 32) -> list[tuple[int, int]]:
    """[start, end) of windows over white-space tokens, contiguous slices of the text."""
    return [(a, b) for a, b, _ in windows([m.start() for m in re.finditer(r"\S+", text)], len(text), size, overlap)]
