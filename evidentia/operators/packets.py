"""Packing under budgets: a document's blocks into packets by section, manifests into prompt batches, evidence into scopes,
literal excerpts and qualified answers.

Costs, selections and flags are columns; only the step whose outcome depends on the steps before it runs in Arrow batches,
over the whole numbers of one group (a document's blocks, an answer's citations), never over texts.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import spans
from . import sequential

#: What a packet costs beside its blocks, and a block beside its text.
PACKET_COST, BLOCK_COST = 1200, 48
#: Labels that continue what the block before them names.
OWNER_LABELS = ("responsible", "owner", "owned by", "task leader", "lead")


def continues(text: Column) -> Column:
    """Whether a block only says who answers for what the block before it names: one of the labels and a colon."""
    plain = F.regexp_replace(F.lower(F.regexp_replace(text, r"^\s+", "")), r"\s+", " ")
    label, colon = F.substring_index(plain, ":", 1), F.contains(plain, F.lit(":"))
    return F.coalesce(colon & F.rtrim(label).isin(*OWNER_LABELS), F.lit(False))


def selected_sections(sections: DataFrame, picked: DataFrame, hits: DataFrame) -> DataFrame:
    """doc, section, chosen: those picked with all below them, those with hits, and all of a document where that is none.

    sections: doc, section, path (section ids from the root on, its own included); picked and hits: doc, section.
    """
    mark = lambda d, name: d.select("doc", "section").distinct().withColumn(name, F.lit(True))
    above = sections.select("doc", "section", F.explode("path").alias("at")).join(mark(picked, "under").withColumnRenamed("section", "at"), ["doc", "at"])
    own = sections.select("doc", "section").distinct().join(above.select("doc", "section", "under").distinct(), ["doc", "section"], "left").join(mark(hits, "hit"), ["doc", "section"], "left")
    own = own.withColumn("own", F.coalesce("under", "hit", F.lit(False)))
    return own.select("doc", "section", (F.col("own") | ~F.bool_or("own").over(Window.partitionBy("doc"))).alias("chosen"))


def assign(rows: list[dict], room: int) -> list[int]:
    """The packet, from 1, of each block (run, cost, follows), in order.

    A run (neighbours of one section) that does not fit beside what is held opens a packet; one that fits none is split
    between its blocks, and a block that `follows` takes the block before it along, unless that is all that is held.
    """
    totals: dict[int, int] = {}
    for r in rows:
        totals[r["run"]] = totals.get(r["run"], 0) + r["cost"]
    out: list[int] = []
    packet, held, count, run = 1, 0, 0, None
    for r in rows:
        total = totals[r["run"]]
        if r["run"] != run and count and held + total > room:
            packet, held, count = packet + 1, 0, 0
        elif r["run"] == run and total > room and count and held + r["cost"] > room:
            packet += 1
            if r["follows"] and count > 1:
                out[-1], held, count = packet, last, 1
            else:
                held, count = 0, 0
        run, last = r["run"], r["cost"]
        held, count = held + last, count + 1
        out.append(packet)
    return out


def document_packets(blocks: DataFrame, chosen: DataFrame, budget: int, packet_cost: int = PACKET_COST, block_cost: int = BLOCK_COST) -> DataFrame:
    """doc, packet, block, section, cost, whole, split: every chosen block in exactly one packet of its document.

    blocks: doc, block (an ordinal), section (null: none), tokens, follows; chosen: as by `selected_sections`. A document
    that fits is one packet, whole, with all its blocks. Else blocks without a section go along where all sections do, and
    all blocks where no block is chosen. A packet costs `packet_cost` and its blocks; a block beyond the budget is a packet
    of its own. `split` tells the blocks of sections that fit no packet.
    """
    room = budget - packet_cost
    all_ = chosen.groupBy("doc").agg(F.bool_and("chosen").alias("every"))
    b = blocks.select("doc", "block", "section", "follows", (F.col("tokens") + block_cost).alias("cost")).join(chosen, ["doc", "section"], "left").join(all_, "doc", "left")
    of = Window.partitionBy("doc")
    b = b.withColumn("own", F.when(F.col("section").isNull(), F.coalesce("every", F.lit(True))).otherwise(F.coalesce("chosen", F.lit(False)))).withColumn("whole", F.sum("cost").over(of) <= room)
    b = b.withColumn("own", F.col("own") | F.col("whole") | ~F.bool_or("own").over(of))
    w = of.orderBy("block")
    fresh = ~F.col("section").eqNullSafe(F.lag("section").over(w)) | ~F.coalesce(F.lag("own").over(w), F.lit(False))
    b = b.withColumn("run", F.sum(F.when(fresh, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))).filter("own")
    split = ~F.col("whole") & (F.sum("cost").over(Window.partitionBy("doc", "run")) > room)
    b = b.withColumn("split", split).select("doc", "block", "section", "cost", "run", "follows", "whole", "split")
    kinds = dict(b.dtypes)

    def step(doc, rows):
        rows.sort(key=lambda r: r["block"])
        packets = [1] * len(rows) if rows[0]["whole"] else assign(rows, room)
        return [(doc, p, r["block"], r["section"], r["cost"], r["whole"], r["split"]) for p, r in zip(packets, rows, strict=True)]

    return sequential.by_group(b, "doc", step, f"doc {kinds['doc']}, packet int, block {kinds['block']}, section {kinds['section']}, cost long, whole boolean, split boolean")


def packet_summary(packets: DataFrame, packet_cost: int = PACKET_COST) -> DataFrame:
    """doc, packet, first, last, n_blocks, n_sections (one at least), cost, whole, split of each packet."""
    g = packets.groupBy("doc", "packet").agg(
        F.min("block").alias("first"), F.max("block").alias("last"), F.count("*").alias("n_blocks"), F.greatest(F.lit(1), F.countDistinct("section")).cast("long").alias("n_sections"),
        (F.sum("cost") + packet_cost).alias("cost"), F.bool_or("whole").alias("whole"), F.bool_or("split").alias("split"),
    )
    return g


def prompt_batches(items: DataFrame, limit: int, window: int, base: int = 128, splits: int = 2) -> DataFrame:
    """`items` (key, position, cost, tokens) with batch (a number in the order of the calls; null: sent in none) and decision.

    In order, a batch takes items while `base` and their costs stay within `limit`; an item beyond it is sent in none. A
    batch whose tokens exceed the `window` fails; the first `splits` of these that hold several items are halved instead
    (the first half the smaller), and the halves are called next. decision: sent, failed or oversize.
    """
    kinds = dict(items.dtypes)

    def step(key, rows):
        batch, held = 0, 0
        for r in sorted(rows, key=lambda r: r["position"]):
            if base + r["cost"] > limit:
                held = 0
                yield key, r["position"], None
                continue
            if not held or base + held + r["cost"] > limit:
                batch, held = batch + 1, 0
            held += r["cost"]
            yield key, r["position"], batch

    found = sequential.by_group(items.select("key", "position", "cost"), "key", step, f"key {kinds['key']}, position {kinds['position']}, batch int")
    rows = items.join(found, ["key", "position"]).withColumn("batch", F.when(F.col("batch").isNotNull(), F.array("batch")))
    for _ in range(splits):
        own = Window.partitionBy("key", "batch")
        rows = rows.withColumns({"n": F.count("*").over(own), "over": F.col("batch").isNotNull() & (F.sum("tokens").over(own) + base > window), "k": F.row_number().over(own.orderBy("position"))})
        first = F.min(F.when(F.col("over") & (F.col("n") > 1), F.col("batch"))).over(Window.partitionBy("key"))
        half = F.when(F.col("k") <= F.floor(F.col("n") / 2), 1).otherwise(2)
        # the place of a half is its batch's place and its own, and comes before that of the next batch
        rows = rows.withColumn("batch", F.when(F.col("batch") == first, F.concat("batch", F.array(half))).otherwise(F.col("batch"))).drop("n", "over", "k")
    own = Window.partitionBy("key", "batch")
    over = F.sum("tokens").over(own) + base > window
    decision = F.when(F.col("batch").isNull(), "oversize").when(over, "failed").otherwise("sent")
    number = F.when(F.col("batch").isNotNull(), F.dense_rank().over(Window.partitionBy("key").orderBy(F.asc_nulls_last("batch"))))
    return rows.withColumn("decision", decision).withColumn("batch", number.cast("int"))


#: The most excerpts that are recovered, their characters, those of one, and the blocks of one selection.
MOST_CARDS, MOST_CHARS, MOST_BLOCK_CHARS, MOST_SELECTED = 6, 8000, 4000, 4
#: What a selection may be asked as; kinds and flags of blocks that decide whether it may speak for itself.
ROLES, PROSE_KINDS, DOUBTFUL_FLAGS = ("direct", "context", "counter", "operand"), ("prose", "paragraph", "list_item"), ("html_preformatted", "ocr_text_unverified")


def recovered_excerpts(requests: DataFrame, blocks: DataFrame) -> DataFrame:
    """request, excerpts (block, role, in the order of the document) and warnings of selections of whole blocks.

    requests: request, doc, role, selected (block ids), known (block ids recovered before), cards, chars (what is left of
    the budgets); blocks: block, doc, ordinal, kind, flags, text, sha256. One selected block that is unknown, of another
    document, blank or changed rejects the whole selection. An id selects all blocks that bear it. A block that is too
    long, or does not fit what is left, is passed over; those after it may still fit.
    """
    limit = "source_excerpt_selection_limit"
    r = requests.withColumn("ids", F.array_distinct("selected"))
    r = r.withColumn("reject", F.when((F.size("ids") == 0) | (F.size("ids") > MOST_SELECTED), limit))
    b = blocks.select("block", F.col("doc").alias("b_doc"), "ordinal", F.char_length("text").alias("n"), F.col("kind").isin(*PROSE_KINDS).alias("prose"), F.arrays_overlap("flags", F.array(*map(F.lit, DOUBTFUL_FLAGS))).alias("doubt"), (F.trim(F.regexp_replace("text", r"\s", "")) != "").alias("filled"), (F.sha2(F.col("text").cast("binary"), 256) == F.col("sha256")).alias("same"))
    rows = r.filter("reject is null").select("request", "doc", "role", "known", "cards", "chars", F.explode("ids").alias("block")).join(b, "block", "left")
    good = F.coalesce((F.col("b_doc") == F.col("doc")) & F.col("filled") & F.col("same"), F.lit(False))
    item = F.struct("ordinal", "block", "n", (F.coalesce(F.col("prose"), F.lit(False)) & ~F.coalesce(F.col("doubt"), F.lit(False))).alias("speaks"), F.array_contains("known", F.col("block")).alias("old"))
    one = rows.groupBy("request").agg(F.first("role").alias("role"), F.first("cards").alias("cards"), F.first("chars").alias("chars"), F.bool_and(good).alias("good"), F.array_sort(F.collect_list(item)).alias("items"))
    known_role = F.coalesce(F.col("role").isin(*ROLES), F.lit(False))
    failed = F.when(F.size("items") > MOST_SELECTED, limit).when(~known_role, "source_excerpt_invalid_role").when(~F.col("good"), "source_excerpt_unverified_selection")
    kind = f"struct<block:{dict(blocks.dtypes)['block']},role:string>"
    start = F.struct(F.array().cast(f"array<{kind}>").alias("out"), F.lit(0).alias("used"), F.array().cast("array<string>").alias("notes"))

    def step(acc: Column, x: Column) -> Column:
        full = (F.size(acc["out"]) >= F.least(F.lit(MOST_CARDS), F.col("cards"))) | (acc["used"] + x["n"] > F.least(F.lit(MOST_CHARS), F.col("chars")))
        shown = F.struct(x["block"].alias("block"), F.when((F.col("role") == "direct") & x["speaks"], "direct").otherwise("context").alias("role"))
        noted = lambda note: F.struct(acc["out"].alias("out"), acc["used"].alias("used"), F.concat(acc["notes"], F.array(F.lit(note))).alias("notes"))
        taken = F.struct(F.concat(acc["out"], F.array(shown)).alias("out"), (acc["used"] + x["n"]).alias("used"), acc["notes"].alias("notes"))
        return F.when(x["old"], acc).when(x["n"] > MOST_BLOCK_CHARS, noted("source_excerpt_whole_block_too_large")).when(full, noted("source_excerpt_recovery_budget_exhausted")).otherwise(taken)

    done = F.aggregate("items", start, step)
    none = F.array().cast(f"array<{kind}>")
    kept = one.withColumn("failed", failed).select("request", F.when(F.col("failed").isNull(), done).otherwise(F.struct(none.alias("out"), F.lit(0).alias("used"), F.array("failed").alias("notes"))).alias("d"))
    kept = kept.select("request", F.col("d.out").alias("excerpts"), F.array_distinct("d.notes").alias("warnings"))
    return kept.unionByName(r.filter("reject is not null").select("request", none.alias("excerpts"), F.array("reject").alias("warnings")))


#: How a quotation is introduced, what is escaped in it, and the notes of what stays open.
QUOTE_LEAD, QUOTE_TAIL = "The source states: “", "”"
OPEN_NOTE = "Referenced details remain unverified; conclusions depending on them remain open."
REFUSAL = "A referenced condition needed for this point is unresolved; I cannot give a definite conclusion."
BRACKETS, MARKS = "[]【】［］", "`*_~"


#: White space of `\\s`; a set of characters to trim costs one look at each end, a regular expression one at every character.
BLANKS = " \t\n\x0b\f\r"


def _trimmed(text: Column) -> Column:
    return F.trim(text, F.lit(BLANKS))


def _blank(text: Column) -> Column:
    return F.ltrim(text, F.lit(BLANKS)) == ""


def quotation(text: Column, prose: Column) -> Column:
    """A block as a quotation whose marks can neither cite nor format; prose is reflowed, other line ends are shown."""
    plain = F.when(prose, F.regexp_replace(_trimmed(text), r"\s+", " ")).otherwise(text)
    pairs = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), *((c, f"&#{ord(c)};") for c in BRACKETS), ("\\", "\\\\"), ("\r", "\\r"), ("\n", "\\n"), *((c, "\\" + c) for c in MARKS)]
    for a, b in pairs:
        plain = F.replace(plain, F.lit(a), F.lit(b))
    return F.concat(F.lit(QUOTE_LEAD), plain, F.lit(QUOTE_TAIL))


#: What begins a list item of an answer: a dash, a star, or a number and a full stop, with white space after it.
ITEM = re.compile(r"[ \t\n\x0b\f\r]*(?:[-*]|[0-9]+\.)(?:[ \t\n\x0b\f\r]|\Z)")


def _units(text: str) -> list[dict]:
    """Start and text of the parts between blank lines of a text, and of its list items."""
    out: list[tuple[int, list[str]]] = []
    at, apart = 0, True
    for line in text.split("\n"):
        blank = not line.strip(BLANKS)
        if not blank and (apart or ITEM.match(line)):
            out.append((at, [line]))
        elif not blank:
            out[-1][1].append(line)
        at, apart = at + len(line) + 1, blank
    raw = ((start, "\n".join(own)) for start, own in out)
    return [{"start": start + len(r) - len(r.lstrip(BLANKS)), "text": r.strip(BLANKS)} for start, r in raw]


def _parts(text: str) -> Column:
    return spans.applied(_units, "array<struct<start:long,text:string>>", F.col(text))


def answer_parts(answers: DataFrame) -> DataFrame:
    """answer, unit, start (characters) and text of the units of each text: parts between empty lines, and list items. A text is cut where it stands."""
    rows = answers.select("answer", F.posexplode(_parts("text")).alias("unit", "u"))
    return rows.select("answer", (F.col("unit") + 1).cast("long").alias("unit"), "u.start", "u.text")


def _cited(units: DataFrame) -> DataFrame:
    """`units` with the ids of the evidence cards that each cites, repeats included."""
    return units.withColumn("ids", F.regexp_extract_all("text", F.lit(r"\[E:([A-Za-z0-9_.:-]+)\]"), F.lit(1)))


def _quoted() -> Column:
    return quotation(F.col("text"), F.col("kind").isin("prose", "paragraph"))


def _sources(cards: DataFrame, blocks: DataFrame, **more: Column) -> DataFrame:
    """answer, card, open, valid, and sources (nth, block, n, and `more` of a block) of the cards whose id is unique in their answer.

    valid: all blocks are known, of the card's document, unchanged, neither blank nor too long. No text leaves its block.
    """
    once = cards.withColumn("n_same", F.count("*").over(Window.partitionBy("answer", "card"))).filter("n_same = 1")
    rows = once.select("answer", "card", "doc", "open", F.posexplode_outer("blocks").alias("nth", "block"))
    fit = ~_blank(F.col("text")) & (F.char_length(_trimmed(F.col("text"))) <= MOST_BLOCK_CHARS) & (F.sha2(F.col("text").cast("binary"), 256) == F.col("sha256"))
    b = blocks.select("block", F.col("doc").alias("b_doc"), F.char_length("text").alias("n"), fit.alias("fit"), *[c.alias(k) for k, c in more.items()])
    j = rows.join(b, "block", "left")
    good = F.coalesce((F.col("b_doc") == F.col("doc")) & F.col("fit"), F.lit(False))
    return j.groupBy("answer", "card").agg(F.first("doc").alias("doc"), F.bool_or("open").alias("open"), F.bool_and(good).alias("valid"), F.array_sort(F.collect_list(F.struct("nth", "block", "n", *more))).alias("sources"))


def _digest(text: Column) -> Column:
    """The first half of SHA-256, in 16 bytes."""
    return F.unhex(F.substring(F.sha2(text.cast("binary"), 256), 1, 32))


def excerpt_overrides(answers: DataFrame, cards: DataFrame, blocks: DataFrame) -> DataFrame:
    """answer, position (characters), block: the citations that stand for one block, since their unit is nothing but its quotation.

    answers: answer, text; cards: answer, card, doc, blocks (ids), open (whether references are unresolved). Distinct
    quotations count in their order against the limits of recovered excerpts; one that does not fit is passed over.
    """
    units = _cited(answer_parts(answers)).filter("size(ids) = 1").withColumn("card", F.col("ids")[0])
    # what a unit says before its mark meets the quotations by its digest, and no text goes further
    mark = F.concat(F.lit(" [E:"), F.col("card"), F.lit("]"))
    noted = F.concat(mark, F.lit(" " + OPEN_NOTE))
    end = F.when(F.endswith("text", noted), noted).when(F.endswith("text", mark), mark)
    said = F.substr("text", F.lit(1), F.char_length("text") - F.char_length(end))
    units = units.filter(end.isNotNull()).select("answer", "unit", "start", "card", F.endswith("text", noted).alias("open"), _digest(said).alias("said"))
    known = _sources(cards, blocks, digest=_digest(_quoted()), chars=F.char_length(_quoted())).filter("valid")
    j = units.join(known, ["answer", "card", "open"])
    hit = F.filter("sources", lambda s: s["digest"] == F.col("said"))
    found = j.withColumn("s", F.get(hit, 0)).filter("s is not null").select("answer", "unit", "doc", "open", (F.col("start") + F.col("s.chars") + 1).alias("position"), F.col("s.block").alias("block"), F.col("s.n").alias("n"))
    keys = found.groupBy("answer", "doc", "block", "open").agg(F.min("unit").alias("unit"), F.first("n").alias("n"))
    kinds = dict(found.dtypes)

    def step(answer, rows):
        used = count = 0
        for r in sorted(rows, key=lambda r: r["unit"]):
            if count < MOST_CARDS and used + r["n"] <= MOST_CHARS:
                used, count = used + r["n"], count + 1
                yield answer, r["doc"], r["block"], r["open"]

    kept = sequential.by_group(keys, "answer", step, f"answer {kinds['answer']}, doc {kinds['doc']}, block {kinds['block']}, open boolean")
    return found.join(kept, ["answer", "doc", "block", "open"]).select("answer", F.col("position").cast("long").alias("position"), "block")


def qualified_answers(answers: DataFrame, cards: DataFrame, blocks: DataFrame) -> DataFrame:
    """answer, text, warnings: units that cite a card with unresolved references give way to quotations of all cards they cite.

    A card's blocks that are not quoted yet go together or, if they do not fit the limits, not at all; an unresolved card
    without a quotation is refused once. Answers without unresolved cards stay as they are. What is quoted is settled by
    lengths; then a block meets those who quote it, and an answer what has changed in it, so that a text moves once.
    """
    kinds = dict(answers.dtypes)
    units = _cited(answer_parts(answers))
    open_ = cards.filter("open").select("answer").distinct()
    cited = units.select("answer", "unit", F.posexplode(F.array_distinct("ids")).alias("nth", "card")).join(open_, "answer", "left_semi")
    rows = cited.join(_sources(cards, blocks), ["answer", "card"]).select("answer", "unit", "nth", "card", "doc", "open", "valid", F.transform("sources", lambda s: F.struct(s["block"].alias("block"), s["n"].alias("n"))).alias("own"))

    def step(answer, found):
        used, emitted, refused = 0, set(), set()
        by: dict = {}
        for r in found:
            by.setdefault(r["unit"], []).append(r)
        for unit in sorted(by):
            own = sorted(by[unit], key=lambda r: r["nth"])
            if not any(r["open"] for r in own):
                continue
            for r in own:
                fresh = {s["block"]: s["n"] for s in r["own"] if (r["doc"], s["block"], r["open"]) not in emitted} if r["own"] else {}
                if r["valid"] and used + sum(fresh.values()) <= MOST_CHARS and len(emitted) + len(fresh) <= MOST_CARDS:
                    emitted |= {(r["doc"], b, r["open"]) for b in fresh}
                    used += sum(fresh.values())
                    yield answer, unit, r["nth"], r["card"], r["open"], [*fresh], False
                elif r["open"] and r["card"] not in refused:
                    refused.add(r["card"])
                    yield answer, unit, r["nth"], r["card"], r["open"], [], True
                else:
                    yield answer, unit, r["nth"], r["card"], r["open"], [], False

    block = dict(blocks.dtypes)["block"]
    acts = sequential.by_group(rows, "answer", step, f"answer {kinds['answer']}, unit long, nth int, card string, open boolean, fresh array<{block}>, refused boolean")
    mark = F.concat(F.lit(" [E:"), F.col("card"), F.lit("]"))
    quote = F.concat("quote", mark, F.when(F.col("open"), F.lit(" " + OPEN_NOTE)).otherwise(""))
    said = acts.select("answer", "unit", "nth", "card", "open", "refused", F.posexplode_outer("fresh").alias("k", "block")).join(blocks.select("block", _quoted().alias("quote"), F.char_length("text").alias("n")), "block", "left")
    said = said.select("answer", "unit", "nth", "refused", "k", "n", F.when(F.col("refused"), F.concat(F.lit(REFUSAL), mark)).otherwise(quote).alias("part"))
    part = F.when(F.col("part").isNotNull(), F.struct("k", "n", "part"))
    note = F.when(F.col("refused"), "reference_unresolved_card:source_excerpt_unavailable").when(F.col("part").isNotNull(), "reference_unresolved_card:complete_source_excerpt_retained")
    own = said.repartition("answer").groupBy("answer", "unit", "nth").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["part"])).alias("parts"), F.max(note).alias("note"))
    per = own.groupBy("answer", "unit").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("nth", "parts"))), lambda x: x["parts"])).alias("parts"), F.collect_set("note").alias("notes"))
    instead = per.groupBy("answer").agg(F.map_from_entries(F.collect_list(F.struct("unit", "parts"))).alias("by"), F.array_distinct(F.flatten(F.collect_list("notes"))).alias("notes"))
    j = answers.join(open_.withColumn("has_open", F.lit(True)), "answer", "left").join(instead, "answer", "left")
    j = j.withColumn("by", F.coalesce("by", F.create_map().cast("map<bigint,array<string>>"))).withColumn("units", F.when(F.col("has_open"), _parts("text")))
    new = F.array_join(F.flatten(F.transform("units", lambda u, i: F.coalesce(F.try_element_at("by", (i + 1).cast("long")), F.array(u["text"])))), "\n\n")
    none = F.array().cast("array<string>")
    warnings = F.array_sort(F.concat(F.array(F.lit("reference_unresolved_card:answer_unit_qualified")), F.col("notes")))
    return j.select("answer", F.when(F.col("has_open"), F.coalesce(new, F.lit(""))).otherwise(F.col("text")).alias("text"), F.coalesce(warnings, none).alias("warnings"))


def scoped_evidence(items: DataFrame, budget: int) -> DataFrame:
    """`items` with admitted: reports and their cards under a character budget, scope by scope.

    items: key (a question), scope, report (an ordinal), card (null: the report's head) and size. Scopes come in the order
    of their first report, reports and cards in theirs. A scope's head, of `len("ENTITY_SCOPE ")` and its name, is always
    there; a report whose head does not fit falls with its cards; a card goes whole or not at all, and those after it may fit.
    """
    kinds = dict(items.dtypes)
    head = F.char_length(F.concat(F.lit("ENTITY_SCOPE "), F.col("scope"))).alias("head")
    first = F.min("report").over(Window.partitionBy("key", "scope")).alias("first")
    slim = items.select("key", first, head, "report", "card", "size", F.xxhash64("scope").alias("tie"))

    def step(key, rows):
        used, scope, open_ = 0, None, False
        for r in sorted(rows, key=lambda r: (r["first"], r["tie"], r["report"], r["card"] is not None, r["card"] or 0)):
            if (r["first"], r["tie"]) != scope:
                scope, used = (r["first"], r["tie"]), used + r["head"]
            fits = used + r["size"] <= budget and (r["card"] is None or open_)
            if r["card"] is None:
                open_ = fits
            used += r["size"] if fits else 0
            yield key, r["report"], r["card"], fits

    found = sequential.by_group(slim, "key", step, f"key {kinds['key']}, report {kinds['report']}, card {kinds['card']}, admitted boolean")
    same = (items["key"] == found["key"]) & (items["report"] == found["report"]) & items["card"].eqNullSafe(found["card"])
    return items.join(found, same).select(*[items[c] for c in items.columns], "admitted")
