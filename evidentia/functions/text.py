"""Text expressions: tokens, normal forms, estimates, recognisers. Columns in, columns out; all built-in."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]+"
PART = r"[\p{L}\p{N}]+"
#: Words that a registry search ignores; the last eight say what is searched.
SEARCH_STOP_WORDS = (
    "a", "about", "and", "are", "at", "by", "does", "for", "from", "in", "is", "it", "job", "of", "on", "or", "please", "role", "the", "this", "to", "what", "when", "where", "which", "who", "whose",
    "chapter", "discuss", "discusses", "recording", "speaker", "timestamp", "video", "watch", "webinar",
)


def plain(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def words(text: Column) -> Column:
    """Lower-cased runs of letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(plain(text)), F.lit(WORD), F.lit(0))


def search_tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits of two characters or more, without stop words; repeats stay."""
    return F.filter(F.regexp_extract_all(F.lower(plain(text)), F.lit(PART), F.lit(0)), lambda w: (F.length(w) > 1) & ~w.isin(*SEARCH_STOP_WORDS))


def match_tokens(text: Column, most: int = 64) -> Column:
    """Distinct tokens of a match expression in order, `most` at the most."""
    return F.slice(F.array_distinct(F.regexp_extract_all(F.lower(plain(text)), F.lit(PART), F.lit(0))), 1, most)


def surface(text: Column, fold: bool = True) -> Column:
    """Curly quotes and dashes made plain, white space collapsed, trimmed; lower-cased if `fold`."""
    out = F.translate(plain(text), "‘’“”‐‑‒–—−", "''\"\"------")
    out = F.trim(F.regexp_replace(out, r"[ \t\n\r\f\x0B]+", " "))
    return F.lower(out) if fold else out


def source_text(text: Column) -> Column:
    """Extracted prose: LF line ends, plain blanks, no blanks around line ends, at most one empty line."""
    out = F.regexp_replace(plain(text), r"\r\n?", "\n")
    out = F.regexp_replace(F.translate(out, " ", " "), r"[ \t]+", " ")
    out = F.regexp_replace(out, r" *\n *", "\n")
    out = F.regexp_replace(out, r"\n{3,}", "\n\n")
    return F.regexp_replace(out, r"^[ \n]+|[ \n]+$", "")


def preformatted(text: Column) -> Column:
    return F.regexp_replace(plain(text), r"\r\n?", "\n")


def token_estimate(text: Column) -> Column:
    """The larger of the number of words and marks, and a quarter of the characters, rounded up."""
    marks = F.size(F.regexp_extract_all(plain(text), F.lit(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_ \t\n\r\f\x0B]"), F.lit(0)))
    return F.greatest(marks.cast("long"), F.ceil(F.char_length(plain(text)) / 4).cast("long"))


def conservative_tokens(text: Column) -> Column:
    """Sum over pieces: runs with a digit by characters, letter runs by quarters, blanks by quarters of bytes, else bytes."""
    pieces = F.regexp_extract_all(plain(text), F.lit(r"[A-Za-z0-9]+|[ \t\n\r\f\x0B]+|[^A-Za-z0-9 \t\n\r\f\x0B]+"), F.lit(0))

    def cost(p: Column) -> Column:
        quarter = lambda n: F.ceil(n / 4).cast("long")
        return (
            F.when(p.rlike("^[A-Za-z]"), F.when(p.rlike("[0-9]"), F.char_length(p).cast("long")).otherwise(quarter(F.char_length(p))))
            .when(p.rlike("^[0-9]"), F.char_length(p).cast("long"))
            .when(p.rlike(r"^[ \t\n\r\f\x0B]"), F.greatest(F.lit(1).cast("long"), quarter(F.octet_length(p))))
            .otherwise(F.octet_length(p).cast("long"))
        )

    return F.aggregate(F.transform(pieces, cost), F.lit(0).cast("long"), lambda a, x: a + x)


def passage_cost(text: Column, title: Column, locator: Column, headers: Column) -> Column:
    """Tokens of a passage in a request: its text, its title, place and headers as a JSON list, and 32 for the frame."""
    quoted = lambda c: F.to_json(F.array(F.coalesce(c, F.lit(""))))
    inside = lambda c: F.substring(quoted(c), F.lit(2), F.char_length(quoted(c)) - 2)
    own = F.concat(F.lit("["), inside(title), F.lit(", "), inside(locator), F.lit(", "), F.replace(F.to_json(headers), F.lit('","'), F.lit('", "')), F.lit("]"))
    return 32 + conservative_tokens(text) + conservative_tokens(own)


def digest(*parts: Column) -> Column:
    """SHA-256 of the parts, each followed by a NUL."""
    return F.sha2(F.concat(*[x for p in parts for x in (p.cast("string"), F.lit("\0"))]).cast("binary"), 256)


def json_text(c: Column) -> Column:
    """A text as a JSON string."""
    return F.regexp_extract(F.to_json(F.array(c)), r"(?s)^\[(.*)\]$", 1)


def json_list(c: Column) -> Column:
    """An array of texts as a JSON list with a blank after each comma."""
    return F.concat(F.lit("["), F.array_join(F.transform(c, json_text), ", "), F.lit("]"))


def canonical_json(fields: dict[str, Column]) -> Column:
    """A JSON object with sorted keys and a blank after each separator; values are JSON already."""
    parts = [F.concat(F.lit(f'"{k}": '), fields[k].cast("string")) for k in sorted(fields)]
    return F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))


def canonical_digest(fields: dict[str, Column]) -> Column:
    """SHA-256 of the canonical JSON."""
    return F.sha2(canonical_json(fields).cast("binary"), 256)


def escaped(text: Column) -> Column:
    """Text safe inside markup and quotes."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


#: Recognisers of exact surfaces, written without look-around so that every engine reads them alike.
SURFACES = {
    "date": r"[0-9]{4}-[0-9]{2}-[0-9]{2}",
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "money": r"[$€£][0-9]+(?:[.,][0-9]+)*",
    "number": r"[0-9]+(?:[.,][0-9]+)*",
    "percent": r"[0-9]+(?:\.[0-9]+)?%",
}


def surfaces(text: Column) -> Column:
    """array<struct<kind, surface>> of all recognisers, repeats included."""
    found = {k: F.regexp_extract_all(plain(text), F.lit(p), F.lit(0)) for k, p in SURFACES.items()}
    found["acronym"] = F.filter(F.regexp_extract_all(plain(text), F.lit(PART), F.lit(0)), lambda w: w.rlike("^[A-Z][A-Z0-9]{1,9}$"))
    return F.concat(*[F.transform(f, _named(k)) for k, f in found.items()])


def _named(kind: str):
    return lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("surface"))


#: What a release must not hold: keys by their form, and paths of a machine or its secrets.
CREDENTIALS = {
    "aws_key": r"AKIA[0-9A-Z]{16}",
    "private_key": r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
    "bearer": r"[Bb]earer [A-Za-z0-9._-]{20,}",
    "assigned": r"(?i:password|token|secret|api_key)[ ]*[=:][ ]*[\"']?[A-Za-z0-9]{8,}",
    "home_path": r"(?:/home/|/Users/|C:\\Users\\)[A-Za-z0-9_.-]+",
    "url_login": r"[a-z]+://[^/ :@]+:[^/ @]+@",
}
#: Suffixes that a release may have, and parts of a path that keep a file out of it.
RELEASED, KEPT_BACK = ("py", "md", "json", "txt", "toml"), (".git", "__pycache__", ".env", "secrets", "node_modules")


def credential_kinds(text: Column) -> Column:
    """The kinds of CREDENTIALS that a text holds, comma-joined."""
    return F.concat_ws(",", *[F.when(plain(text).rlike(p), F.lit(k)) for k, p in CREDENTIALS.items()])


def releasable(path: Column) -> Column:
    """Whether a relative path may go into a release: a known suffix, no hidden or private part, no way upwards."""
    parts = F.split(path, "/")
    clean = ~F.exists(parts, lambda p: p.isin("", "..", *KEPT_BACK))
    return ~path.startswith("/") & clean & F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1).isin(*RELEASED)


CREDENTIAL = r"(?:AKIA[0-9A-Z]{16}|-----BEGIN [A-Z ]*PRIVATE KEY-----|(?:password|token|secret|api_key)[ ]*=[ ]*[\"']?[A-Za-z0-9]{8,})"


def has_credential(text: Column) -> Column:
    return plain(text).rlike(CREDENTIAL)


def question_mode(text: Column) -> Column:
    t = F.lower(plain(text))
    return F.when(t.rlike(r"\b(?:all|every|each|list)\b"), "exhaustive").when(t.rlike(r"\b(?:overview|summary|summarize|about)\b"), "overview").otherwise("targeted")


def question_shape(text: Column) -> Column:
    """Comma-joined features of a question."""
    t = F.lower(plain(text))
    tests = (("comparison", r"\b(?:than|versus|compare|difference)\b"), ("temporal", r"\b(?:when|before|after|date|year)\b"), ("procedure", r"\b(?:how|step|process)\b"), ("exact", r"[0-9]"))
    hit = F.filter(F.array(*[F.when(t.rlike(p), F.lit(n)) for n, p in tests]), lambda x: x.isNotNull())
    return F.when(F.size(hit) > 0, F.array_join(hit, ",")).otherwise("general")


def seconds_of(clock: Column) -> Column:
    """SS, MM:SS or HH:MM:SS as seconds; null if a part after the first exceeds 59 or the form is another."""
    parts = F.split(clock, ":")
    n = lambda i: F.get(parts, F.lit(i)).cast("long")
    ok = clock.rlike(r"^[0-9]{1,5}$|^[0-9]{1,3}:[0-5][0-9]$|^[0-9]{1,3}:[0-5][0-9]:[0-5][0-9]$")
    return F.when(ok, F.when(F.size(parts) == 1, n(0)).when(F.size(parts) == 2, n(0) * 60 + n(1)).otherwise(n(0) * 3600 + n(1) * 60 + n(2)))


def clock_of(seconds: Column) -> Column:
    """M:SS or H:MM:SS."""
    h, m, s = F.floor(seconds / 3600), F.floor(seconds / 60) % 60, seconds % 60
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    return F.when(h > 0, F.concat(h.cast("string"), F.lit(":"), two(m), F.lit(":"), two(s))).otherwise(F.concat(m.cast("string"), F.lit(":"), two(s)))
