r"""Personal data: base recognisers, and contextual extraction that bootstraps from what they find; built-ins alone.

Seeds are the base matches (e-mail, IP address, card, phone) and long hexadecimal or AKIA keys (kind `secret`). The
text before a seed, its last word with the delimiters up to the seed, is a lexical pattern. Patterns and the instances
behind them (seeds, and identifiers, words of six or more characters with a digit) form a bipartite graph. Spark
scores it in rounds: a pattern's confidence is the mean score of the occurrences behind it and its support the number
of its different instances that score `confidence` or more; an instance's score is 1 for a seed, else
1 - product(1 - confidence) over its patterns of `support`. So identifiers that one round discovers support the
patterns of the next. Patterns with the support and confidence name the identifiers behind them as further spans, of
the kind that most of their supporting instances have (a discovered instance has the kind of its best pattern).
Patterns that end in a delimiter (= : # quotes or brackets) hold one word; those that end in white space hold two, as a
single word before a blank says little.

Positions come from cutting the text at the matches: a match starts after the gaps and matches before it, prefix
sums over blocks of 64. Patterns and instances are joined by key, against tables of their own, so that the rows of a
hot pattern or instance can be split; nothing is collected or broadcast by hand.

Defined results: null and empty texts have no spans; texts of any length are searched whole, and a pattern looks at
most 72 characters back; repeated rows each carry their spans, and each occurrence counts for confidence but not for
support; of equally supported kinds the first of KINDS counts; an empty table gives an empty result; of the input only
the text and the columns named in `keep` are used. Calling `extract` runs jobs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, stored

KINDS = ("email", "ip", "card", "phone", "secret")
#: The contract's patterns. A match begins where its first run begins, or where the match before it ended: any later
#: start within the run fails or succeeds alike. Runs are possessive, which keeps long ones linear.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|(?=[a-f]*[0-9])(?=[0-9]*[a-f])[0-9a-f]{16,}+)(?![A-Za-z0-9])",
}
IDENTIFIER = r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*[0-9])[A-Za-z0-9_-]{6,}+"
CONTEXT = r"""([^\x00-\x20=:#"'(<\[]{1,32}[\x20\t]?[=:#"'(<\[]{1,2}[\x20\t]?["']?|[^\x00-\x20]{1,32}\x20[^\x00-\x20]{1,32}\x20)\z"""
BLOCK = 64


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        d = F.substring(F.reverse(digits), i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


CHECKS = {
    "ip": lambda v: v.rlike(r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])){3}$"),
    "card": lambda v: F.when(F.length(_digits(v)).between(13, 19), _luhn(_digits(v))).otherwise(False),
    "phone": lambda v: F.length(_digits(v)).between(9, 15),
}
#: A cheap condition without which no match can pass.
NEEDS = {
    "email": lambda t: t.contains("@"),
    "phone": lambda t: t.contains("+"),
    "card": lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){12}"),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]++\.[0-9]"),
    "secret": lambda t: t.rlike(r"[0-9a-f]{16}|AKIA"),
}


def find(text: Column, pattern: str) -> Column:
    """array<struct<start, end, value, before>> of the matches: code points, end exclusive, and the gap before each."""

    def placed(values: Column) -> Column:
        def with_gaps(gaps: Column) -> Column:
            steps = F.zip_with(F.slice(gaps, F.lit(1), F.size(values)), values, lambda g, v: F.char_length(g) + F.char_length(v))

            def with_steps(s: Column) -> Column:
                total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
                blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(s) - 1) / BLOCK).cast("int")), lambda b: total(F.slice(s, b * BLOCK + 1, F.lit(BLOCK))))

                def with_blocks(sums: Column) -> Column:
                    def with_starts(starts: Column) -> Column:
                        def one(v: Column, i: Column) -> Column:
                            b = F.floor(i / BLOCK).cast("int")
                            end = F.get(starts, b) + total(F.slice(s, b * BLOCK + 1, i - b * BLOCK + 1))
                            return F.struct((end - F.char_length(v)).alias("start"), end.alias("end"), v.alias("value"), F.get(gaps, i).alias("before"))

                        return F.transform(values, one)

                    return let(F.transform(sums, lambda _, k: total(F.slice(sums, F.lit(1), k))), with_starts)

                return let(blocks, with_blocks)

            return let(steps, with_steps)

        return F.when(F.size(values) > 0, let(F.split(text, pattern, -1), with_gaps))

    return F.coalesce(let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed), F.array().cast("array<struct<start:int,end:int,value:string,before:string>>"))


def _with_context(found: Column) -> Column:
    """The gap before each match, cut down to its pattern ('' for none)."""
    near = lambda x: F.lower(F.regexp_extract(F.substring(x["before"], -72, 72), CONTEXT, 1))
    return F.transform(found, lambda x: F.struct(x["start"], x["end"], x["value"], near(x).alias("context")))


def _checked(check):
    return lambda x: check(x["value"])


def base_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds one array column for each of KINDS, and `identifiers`: struct<start, end, value, context>."""
    t = F.coalesce(F.col(text), F.lit(""))
    kind = "array<struct<start:int,end:int,value:string,context:string>>"
    out = {}
    for k in KINDS:
        passed = find(t, PATTERNS[k])
        if k in CHECKS:
            passed = F.filter(passed, _checked(CHECKS[k]))
        out[k] = F.when(NEEDS[k](t), _with_context(passed)).otherwise(F.array()).cast(kind)
    out["identifiers"] = F.when(t.rlike("[0-9]"), _with_context(find(t, IDENTIFIER))).otherwise(F.array()).cast(kind)
    return docs.withColumns(out)


def bootstrap(edges: DataFrame, rounds: int = 3, support: int = 3, confidence: float = 0.8) -> DataFrame:
    """(context, kind, confidence, support) of the patterns to trust, from edges (context, value, kind: null unless a seed)."""
    e = stored(edges.filter("context <> ''").groupBy("context", "value").agg(F.count("*").alias("n"), F.min("kind").alias("kind")), "edges")
    seeds = e.groupBy("value").agg(F.min("kind").alias("kind"))
    score = stored(seeds.select("value", "kind", F.col("kind").isNotNull().alias("seed"), F.when(F.col("kind").isNotNull(), 1.0).otherwise(0.0).alias("score")), "scores")
    for r in range(rounds):
        scored = e.drop("kind").join(score, "value")
        # by kind first: the kind that most of the supporting instances have is the pattern's own
        each = scored.groupBy("context", "kind").agg(F.sum(F.col("score") * F.col("n")).alias("s"), F.sum("n").alias("n"), F.count_if(F.col("score") >= confidence).alias("m"))
        trust = each.groupBy("context").agg((F.sum("s") / F.sum("n")).alias("confidence"), F.sum("m").alias("support"), F.min_by("kind", F.struct(-F.col("m"), F.col("kind"))).alias("kind"))
        trust = stored(trust.filter(F.col("support") >= support), "patterns")
        if r + 1 < rounds:
            doubt = F.sum(F.log1p(-F.least(F.col("confidence"), F.lit(0.999999))))
            gained = e.join(trust.select("context", "confidence", F.col("kind").alias("of")), "context").groupBy("value").agg((1 - F.exp(doubt)).alias("gain"), F.min_by("of", F.struct(-F.col("confidence"), F.col("of"))).alias("of"))
            own = score.join(stored(gained, "gained"), "value", "left")
            kind, gain = F.when(F.col("seed"), F.col("kind")).otherwise(F.col("of")), F.when(F.col("seed"), 1.0).otherwise(F.coalesce("gain", F.lit(0.0)))
            score = stored(own.select("value", kind.alias("kind"), "seed", gain.alias("score")), "scores")
    return trust.filter(F.col("confidence") >= confidence)


def extract(docs: DataFrame, text: str = "text", keep: tuple = ("doc_id",), **how) -> DataFrame:
    """`keep` columns with base (array<struct<kind, start, end>> of the four contract kinds) and spans (all, also found ones)."""
    held = docs.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)], F.col(text).alias("_t"))
    found = base_spans(held, "_t").drop("_t").withColumn("row", F.monotonically_increasing_id())
    named = lambda k: F.transform(k, lambda x: F.struct(F.lit(KINDS.index(k)).alias("at"), x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value"), x["context"].alias("context")))
    found = found.withColumn("seeds", F.concat(*[named(k) for k in KINDS]))
    free = F.filter("identifiers", lambda x: ~F.exists("seeds", lambda s: (s["start"] < x["end"]) & (x["start"] < s["end"])))
    found = stored(found.select(*[c for c in found.columns if c.startswith("_k")], "row", "seeds", free.alias("identifiers")), "spans")
    seeds = found.select(F.explode("seeds").alias("s")).select("s.context", "s.value", F.col("s.at").alias("kind"))
    others = found.select("row", F.explode("identifiers").alias("s")).select("row", "s.*")
    trusted = bootstrap(seeds.unionByName(others.select("context", "value", F.lit(None).cast("int").alias("kind"))), **how)
    more = others.filter("context <> ''").join(stored(trusted.select("context", "kind"), "trusted"), "context")
    more = more.groupBy("row").agg(F.collect_list(F.struct(F.col("kind").alias("at"), "start", "end")).alias("more"))
    short = lambda a: F.transform(a, lambda x: F.struct(x["at"].alias("at"), x["start"].alias("start"), x["end"].alias("end")))
    named_kind = F.array(*map(F.lit, KINDS))
    shown = lambda a: F.transform(F.sort_array(a), lambda x: F.struct(F.get(named_kind, x["at"]).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    out = found.join(more, "row", "left")
    every = F.concat(short(F.col("seeds")), F.coalesce("more", F.array().cast("array<struct<at:int,start:int,end:int>>")))
    return out.select(
        *[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)],
        shown(short(F.filter("seeds", lambda x: x["at"] < 4))).alias("base"), shown(every).alias("spans"),
    )


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
