r"""Chat formatting with a grammar round trip, in built-in expressions alone.

Grammar: a conversation is a sequence of turns, each

    ### role: body\n</turn>\n

where the control strings `###` and `</turn>` occur in a body only behind a backslash. `escaped` puts one backslash
before every control string (and the backslashes already before it), `unescaped` takes one away, so the two are
inverse. A turn's body is first tried as it is: the turn is rendered, parsed again by `parse` and compared with its
source; where the two differ, which is where the text has control strings of its own, the body is escaped. The whole
conversation is parsed once more (`round_trip`).

The rows of a conversation meet in one row, its text; all work on single turns happens before that.

Defined results: null texts and roles are empty; a text of any length is one body, a conversation one row; turns go by (turn, role, text), so ties and repeated rows have an
order; a null conv_id is a conversation of its own; an empty table gives an empty result; other columns are not used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let

CONTROL = r"(?:###|</turn>)"
OPEN, MID, CLOSE = "### ", ": ", "\n</turn>\n"
#: Characters that a role may not hold, and what stands for them; `%` first.
ROLE_CODES = (("%", "%25"), (":", "%3A"), ("\n", "%0A"), ("#", "%23"), ("<", "%3C"))


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?<!\\)(\\*+)(" + CONTROL + ")", r"\\$1$2")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?<!\\)\\(\\*+)(" + CONTROL + ")", "$1$2")


def _role_out(role: Column) -> Column:
    for a, b in ROLE_CODES:
        role = F.replace(role, F.lit(a), F.lit(b))
    return role


def _role_in(role: Column) -> Column:
    for a, b in reversed(ROLE_CODES):
        role = F.replace(role, F.lit(b), F.lit(a))
    return role


def render_turn(role: Column, body: Column) -> Column:
    return F.concat(F.lit(OPEN), _role_out(role), F.lit(MID), body, F.lit(CLOSE))


def parse(rendered: Column) -> Column:
    """array<struct<role, text>>; a turn that breaks the grammar has a null text."""
    parts = F.split(rendered, CLOSE)

    def turn(p: Column) -> Column:
        at = F.locate(MID, p, len(OPEN) + 1)
        body = F.substring(p, at + len(MID), F.length(p))
        # escaped control strings are taken out from the left, as they were put in, before looking for bare ones
        bare = F.regexp_replace(body, r"\\++" + CONTROL, " ").rlike(CONTROL)
        broken = ~p.startswith(OPEN) | (at == 0) | bare
        role = F.substring(p, F.lit(len(OPEN) + 1), at - len(OPEN) - 1)
        return F.struct(_role_in(role).alias("role"), F.when(~broken, unescaped(body)).alias("text"))

    def turns(p: Column) -> Column:
        # what follows the last close is empty, or else a turn that never ended
        n = F.size(p)
        return F.transform(F.when(F.element_at(p, -1) == "", F.slice(p, F.lit(1), n - 1)).otherwise(p), turn)

    return let(parts, turns)


def format_chats(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", trained: tuple = ("assistant",)) -> DataFrame:
    """One row per conversation: conv_id, formatted, n_turns, loss_mask (one boolean a turn), loss_spans and round_trip.

    loss_spans: [start, end) code points of the bodies of the `trained` roles in `formatted`, as escaped there.
    """
    src = rows.select(
        F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    plain = parse(render_turn(F.col("role"), F.col("text")))
    same = F.coalesce((F.size(plain) == 1) & (F.get(plain, F.lit(0))["text"] == F.col("text")) & (F.get(plain, F.lit(0))["role"] == F.col("role")), F.lit(False))
    src = src.withColumn("body", F.when(same, F.col("text")).otherwise(escaped(F.col("text"))))
    src = src.withColumn("shown", render_turn(F.col("role"), F.col("body")))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    src = src.withColumn("end", F.sum(F.char_length("shown").cast("long")).over(order) - len(CLOSE))
    own = F.struct("turn", "role", "text", "shown", F.struct((F.col("end") - F.char_length("body")).alias("start"), "end").alias("span"))
    whole = src.groupBy("conv_id").agg(F.sort_array(F.collect_list(own)).alias("t"))
    whole = whole.withColumn("formatted", F.array_join(F.col("t.shown"), ""))
    mask = F.transform("t", lambda x: x["role"].isin(*trained))
    source = F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
    return whole.select(
        "conv_id", "formatted", F.size("t").cast("long").alias("n_turns"), mask.alias("loss_mask"),
        F.transform(F.filter("t", lambda x: x["role"].isin(*trained)), lambda x: x["span"]).alias("loss_spans"),
        F.coalesce(parse(F.col("formatted")) == source, F.lit(False)).alias("round_trip"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, turns (parsed), loss_text (what is under the loss mask, unescaped) and formatted_chars."""
    seen = formatted.withColumn("turns", parse(F.col("formatted")))
    taken = F.zip_with("turns", "loss_mask", lambda t, m: F.when(m, t["text"]))
    return seen.select("conv_id", "turns", F.array_join(taken, "").alias("loss_text"), F.char_length("formatted").cast("long").alias("formatted_chars"), "round_trip")
