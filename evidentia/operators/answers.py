"""Answer side: claims and their sources, citations, coverage, evaluation of released answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def claim_verdicts(claims: DataFrame, evidence: DataFrame, facets: DataFrame) -> DataFrame:
    """claims (draft, claim_id, facet, sources: array) with a verdict: all copies of an id that occurs twice are rejected,
    then claims with 0 or over 6 sources, then unknown facets, then unknown sources; a claim falls as a whole."""
    n = F.count("*").over(Window.partitionBy("draft", "claim_id"))
    c = claims.withColumn("copies", n)
    known = facets.select("facet").distinct().withColumn("facet_ok", F.lit(True))
    c = c.join(known, "facet", "left")
    bad = c.select("draft", "claim_id", F.explode("sources").alias("source")).join(evidence.select("draft", "source"), ["draft", "source"], "left_anti")
    bad = bad.select("draft", "claim_id").distinct().withColumn("unbound", F.lit(True))
    c = c.join(bad, ["draft", "claim_id"], "left")
    verdict = (
        F.when(F.col("copies") > 1, "duplicate").when(~F.size("sources").between(1, 6), "source count")
        .when(F.col("facet_ok").isNull(), "unknown facet").when(F.col("unbound").isNotNull(), "unknown source").otherwise("ok")
    )
    return c.withColumn("verdict", verdict).drop("copies", "facet_ok", "unbound")


def citation_labels(uses: DataFrame, answer: str, source: str, position: str) -> DataFrame:
    """Labels S1, S2... by the first use of each source in an answer."""
    first = uses.groupBy(answer, source).agg(F.min(position).alias("first_use"))
    n = F.row_number().over(Window.partitionBy(answer).orderBy("first_use", source))
    return first.withColumn("label", F.concat(F.lit("S"), n.cast("string")))


def answer_status(citations: Column, gaps: Column, clear: Column, errors: Column, exhaustive: Column) -> Column:
    """answer, partial, error or not_found; an exhaustive question with gaps is partial at best."""
    full = (citations > 0) & (gaps == 0) & clear
    return F.when(full & ~(exhaustive & (errors > 0)), "answer").when(citations > 0, "partial").when(errors > 0, "error").otherwise("not_found")


def rates(checks: DataFrame, passed: Column) -> DataFrame:
    """Numerator, denominator and rate by method, by method and category, and by method and regime, in one pass."""
    g = checks.groupingSets([["method"], ["method", "category"], ["method", "regime"]], "method", "category", "regime")
    return g.agg(F.count_if(passed).alias("numerator"), F.count("*").alias("denominator"), F.round(F.avg(passed.cast("double")), 6).alias("rate"))


def merged_evidence(rows: DataFrame, group: str, order: str, span: str, budget: int = 10_000, most: int = 128) -> DataFrame:
    """Evidence of each group after a merge: the prior rows, then those whose span is new while they fit.

    rows: group, order, span, prior (boolean) and cost. A row that does not fit is left out and the next one is tried. Adds
    alias (P1, P2, ... in order) and used, the cost so far. The rows of a group, an answer's evidence, are one array.
    """
    first = rows.groupBy(group, span).agg(F.min(F.struct(order, "prior", "cost")).alias("r")).select(group, span, "r.*")
    packed = first.groupBy(group).agg(F.sort_array(F.collect_list(F.struct((~F.col("prior")).alias("new"), F.col(order), F.col(span).alias("span"), "prior", F.col("cost").cast("long").alias("cost")))).alias("rows"))
    kept = "array<struct<span:{0},prior:boolean,used:bigint>>".format(rows.schema[span].dataType.simpleString())
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast(kept).alias("kept"))

    def step(acc: Column, x: Column) -> Column:
        total = acc["used"] + x["cost"]
        fits = x["prior"] | ((F.size(acc["kept"]) < most) & (total <= budget))
        taken = F.struct(total.alias("used"), F.concat(acc["kept"], F.array(F.struct(x["span"].alias("span"), x["prior"].alias("prior"), total.alias("used")))).alias("kept"))
        return F.when(fits, taken).otherwise(acc)

    out = packed.select(group, F.posexplode(F.aggregate("rows", start, step, lambda acc: acc["kept"])).alias("n", "x"))
    return out.select(group, F.col("x.span").alias(span), F.concat(F.lit("P"), (F.col("n") + 1).cast("string")).alias("alias"), F.col("x.prior").alias("prior"), F.col("x.used").alias("used"))


def case_scores(cases: DataFrame, answers: DataFrame, required, forbidden) -> DataFrame:
    """Checks of each case: cases have case_id, expected, required and forbidden phrases, secrets and most (citations).

    answers: case_id, status, text and sources (array). `required` and `forbidden` say of a source and a case whether it
    must, or must not, be cited. A case without an answer is missing and fails what needs one.
    """
    j = cases.join(answers.withColumn("_has", F.lit(True)), "case_id", "left")
    low, own = F.lower(F.coalesce("text", F.lit(""))), F.coalesce("sources", F.array().cast("array<bigint>"))
    has = F.coalesce("_has", F.lit(False))
    none_of = lambda phrases, t: ~F.exists(phrases, lambda p: F.contains(t, p))
    return j.select(
        "case_id", (~has).alias("missing"), (has & F.coalesce(F.col("status") == F.col("expected"), F.lit(False))).alias("status_ok"),
        (has & F.forall("required", lambda p: F.contains(low, F.lower(p)))).alias("phrases_ok"), (has & none_of("forbidden", low)).alias("forbidden_ok"),
        F.exists(own, lambda v: required(v, F.col("case_id"))).alias("required_ok"), (~F.exists(own, lambda v: forbidden(v, F.col("case_id")))).alias("sources_ok"),
        (F.size(own) <= F.col("most")).alias("cap_ok"), (has & none_of("secrets", F.coalesce("text", F.lit("")))).alias("leak_ok"),
    )


def bound_citations(citations: DataFrame, blocks: DataFrame) -> DataFrame:
    """`citations` (doc, ordinal, start, end, quote and others) with a verdict against blocks (doc, ordinal, block_text)."""
    j = citations.join(blocks.select("doc", "ordinal", "block_text"), ["doc", "ordinal"], "left")
    n = F.col("end") - F.col("start")
    cut = F.substring("block_text", F.col("start") + 1, n)
    verdict = F.when(F.col("block_text").isNull(), "unknown block").when((F.col("end") > F.char_length("block_text")) | (n <= 0), "outside").when(cut != F.col("quote"), "text differs").otherwise("ok")
    return j.withColumn("verdict", verdict).drop("block_text")


def omitted(old: DataFrame, new: DataFrame, draft: str, signature: list[str]) -> DataFrame:
    """Signatures of the old draft's unflagged claims that the new one lacks."""
    return old.filter("not flagged").select(draft, *signature).distinct().join(new.select(draft, *signature), [draft, *signature], "left_anti")


def screening_cutoff(now: Column, deadline: Column, need: Column, share: float = 0.2, ceiling: float = 15.0) -> Column:
    """Until when screening may run: a fifth of what remains, one and a half calls at least, within the ceiling and the deadline."""
    remaining = F.greatest(F.lit(0.0), deadline - now)
    return F.least(deadline, now + F.least(remaining, F.greatest(1.5 * need, F.lit(ceiling)), F.greatest(1.5 * need, remaining * share)))


def reader_window(now: Column, hard: Column, soft: Column, need: Column, packets: Column) -> Column:
    """Seconds for the next read: none if the hard cutoff leaves too few, or the soft one after a first packet."""
    left, ahead = hard - now, soft - now
    return F.when((left < need) | ((packets > 0) & (ahead < need)), 0.0).otherwise(F.least(left, F.greatest(need, ahead)))


def research_ends(documents: DataFrame, run: str, window_over: Column, catalogue_left: Column, errors: Column) -> DataFrame:
    """all_unlikely, complete and public notes of each run from its documents (unlikely, done, warned); the columns are of the run."""
    g = documents.groupBy(run).agg(F.bool_and("unlikely").alias("all_unlikely"), F.bool_and("done").alias("_done"), F.count_if(~F.col("done")).alias("_left"), F.bool_or(F.col("warned") & F.col("done")).alias("_gaps"))
    ended = F.when((F.col("_left") > 0) & window_over, F.concat(F.lit("window:"), F.col("_left").cast("string"))).when(catalogue_left, "catalogue")
    notes = F.concat_ws(" ", F.when(F.col("_gaps"), "extraction"), ended, F.when(errors, "errors"))
    return g.select(run, "all_unlikely", (F.col("_done") & ~catalogue_left).alias("complete"), notes.alias("notes"))


def source_rows(rows: DataFrame) -> DataFrame:
    """Rows (answer, source, quote, seconds) with ids S1, S2, ... and aliases D and T of their sources and quotes, opaque values dropped."""
    w = lambda *o: Window.partitionBy("answer").orderBy(*o)
    alias = lambda lead, n: F.concat(F.lit(lead), n.cast("string"))
    n = F.row_number().over(w("source", "quote", F.coalesce("seconds", F.lit(-1))))
    return rows.select("answer", alias("S", n).alias("id"), alias("D", F.dense_rank().over(w("source"))).alias("document"), alias("T", F.dense_rank().over(w("quote"))).alias("topic"), "seconds")
