"""Quality rules: one threshold table, compiled into one projection of built-in expressions.

A word is a maximal run of characters other than space and U+0009 to U+000D. `measures` adds the counts; `RULES`
names ratios of them with their bounds; `verdict` compiles the table into one boolean. Nothing shuffles and no
user function runs.

Defined results: null and empty texts have no words and fail `n_words`; texts of any length are measured whole; repeated rows are judged alike; an empty
table gives an empty result; other columns pass through, and working columns start with `_q_`, so that names such
as `n_words` in the input do not clash (the measures replace them in the output).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

WORD_GAP = r"[\x20\x09-\x0D]+"
WINDOW = 5
#: Frequent function words of the four languages.
STOP_WORDS = (
    "the of and to in is that it for was on with as by at be this are or from an have not "
    "de la le et les des en un une du que qui dans pour par est sur au "
    "el los las una y se por con para su como del "
    "der die und den von zu das mit sich auf für ist im dem nicht ein eine"
).split()


@dataclass(frozen=True)
class Rule:
    """`value` (SQL over the measures, understood by Spark and DuckDB alike) must lie within [low, high]."""

    name: str
    value: str
    low: float | None = None
    high: float | None = None

    def sql(self) -> str:
        parts = [f"({self.value}) >= {self.low}"] * (self.low is not None) + [f"({self.value}) <= {self.high}"] * (self.high is not None)
        return "(" + " AND ".join(parts) + ")"


#: The contract's base rules; a text that breaks one has base_failed.
BASE_RULES = (
    Rule("n_words", "n_words", low=10),
    Rule("repeated_windows", "100 * n_repeat_words - 20 * n_words", high=0),
)
#: The method's own rules, in integers so that every engine rounds alike.
RULES = (
    Rule("word_length_low", "word_chars - 2 * n_words", low=0),
    Rule("word_length_high", "word_chars - 15 * n_words", high=0),
    Rule("symbols", "100 * n_symbols - 20 * n_words", high=0),
    Rule("exclamations", "100 * n_exclaim - 30 * n_words", high=0),
    Rule("stop_words", "100 * n_stop - 2 * n_words", low=-60),
    Rule("duplicate_lines", "100 * n_dup_lines - 50 * n_lines", high=0),
)


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_GAP), "")


def _repeat_words(h: Column) -> Column:
    """Words inside windows whose hash occurs twice, from the hash of each window by position."""
    pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

    def twice(s: Column) -> Column:
        return F.filter(s, lambda x, k: F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)))

    at = F.sort_array(F.transform(let(pairs, twice), lambda x: x["i"]))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last"))
    step = lambda a, p: F.struct((a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n"), p.alias("last"))
    covered = F.aggregate(at, start, step, lambda a: a["n"])
    return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered)


def _joined(left: str, right: str, shift: int) -> Column:
    """Hash of left[i] and right[i + shift] for every i that has both; empty where there is none."""
    n = F.greatest(F.least(F.size(left), F.size(right) - shift), F.lit(0))
    return F.zip_with(F.slice(left, F.lit(1), n), F.slice(right, F.lit(1 + shift), n), lambda a, b: F.xxhash64(a, b))


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_stop, n_exclaim and n_lines (long)."""
    body = F.coalesce(F.col(text), F.lit(""))
    d = docs.withColumn("_q_w", words(F.col(text))).withColumn("_q_l", F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    # the hash of five words from those of one, two and four: three passes over longs in place of five lookups a word
    d = d.withColumn("_q_1", F.transform("_q_w", lambda w: F.xxhash64(w)))
    d = d.withColumn("_q_2", _joined("_q_1", "_q_1", 1))
    d = d.withColumn("_q_4", _joined("_q_2", "_q_2", 2))
    d = d.withColumn("_q_h", _joined("_q_4", "_q_1", WINDOW - 1))
    n = lambda c: c.cast("long")
    made = {
        "n_words": n(F.size("_q_w")),
        "word_chars": n(F.char_length(F.array_join("_q_w", ""))),
        "n_symbols": n(F.regexp_count(body, F.lit(r"[#*$%&|<>]"))),
        "n_dup_lines": n(F.size("_q_l") - F.size(F.array_distinct("_q_l"))),
        "n_repeat_words": _repeat_words(F.col("_q_h")),
        "n_stop": n(F.size("_q_w") - F.size(F.filter("_q_w", lambda w: ~w.isin(*dict.fromkeys(STOP_WORDS))))),
        "n_exclaim": n(F.regexp_count(body, F.lit("!"))),
        "n_lines": n(F.size("_q_l")),
    }
    # a later filter would be pushed below a projection and would repeat these expressions; it stays above a generator
    row = F.array(F.struct(*[v.alias(k) for k, v in made.items()]))
    return d.select(*[f"`{c}`" for c in docs.columns if c not in made], F.inline(row))


def verdict(rules) -> Column:
    return F.expr(" AND ".join(r.sql() for r in rules))


def judge(docs: DataFrame, text: str = "text", rules=RULES, base=BASE_RULES) -> DataFrame:
    """`docs` with its measures, base_failed and kept."""
    d = measures(docs, text).withColumn("base_failed", ~verdict(base))
    return d.withColumn("kept", ~F.col("base_failed") & verdict(rules))


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of `docs`, as they are, that the rules keep."""
    held = docs.select(F.struct("*").alias("_q_row"), F.col(text).alias("_q_text"))
    return judge(held, "_q_text").filter("kept").select("_q_row.*")
