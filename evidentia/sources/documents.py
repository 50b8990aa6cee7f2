"""Documents as rows: files found and read by Spark, bytes decoded, text parsed into blocks by Arrow-batched functions.

A block is (doc_id, ordinal, kind, section_path, locator, text). Parsers are pure functions of one text, so a lost task
is simply run again.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from itertools import groupby

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import file_system

SUFFIXES = ("docx", "pdf", "txt", "md", "html", "htm")
#: What one batch of parsed blocks holds at most, but for one block more.
BATCH_BLOCKS, BATCH_CHARS = 8192, 1 << 20
#: What one batch of files holds at most, but for one file more.
BATCH_BYTES = 4 << 20
BLOCK = "ordinal long, kind string, section_path string, locator string, block_text string"


def _listed(system, path: str) -> Iterator[tuple[str, bool]]:
    """(path, whether a folder) of what lies in a folder, without hidden names."""
    from pyarrow import fs

    for e in system.get_file_info(fs.FileSelector(path)):
        if not e.base_name.startswith((".", "_")):
            yield e.path, e.type == fs.FileType.Directory


def _readable(path: str) -> bool:
    name = path.rsplit("/", 1)[-1]
    return name.rpartition(".")[2].lower() in SUFFIXES and not name.startswith("~$")


def collect_files(spark: SparkSession, folder: str) -> DataFrame:
    """path, content, suffix and sha256 of the readable documents below `folder`; hidden files and lock files are left out.

    Tasks list the folders and read the files, each a share of them: the driver holds no list. One task lists what lies
    directly in `folder`.
    """
    root = re.sub(r"^file:/+", "/", folder).rstrip("/")
    scheme = root[: len(root) - len(file_system(root)[1])] if "://" in root else "file:"
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def top(batches):
        import pyarrow as pa

        system, base = file_system(root)
        for batch in batches:
            for _ in range(batch.num_rows):
                found = [*_listed(system, base)]
                yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in found], pa.string()), pa.array([f for _, f in found], pa.bool_())], names=["path", "folder"])

    def below(batches):
        import pyarrow as pa

        system, _ = file_system(root)
        for batch in batches:
            for path, folder in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                waiting, files = [path] if folder else [], [] if folder else [path]
                while waiting or files:
                    yield pa.RecordBatch.from_arrays([pa.array(filter(_readable, files), pa.string())], names=["path"])
                    files = []
                    if waiting:
                        for p, inner in _listed(system, waiting.pop()):
                            (waiting if inner else files).append(p)

    def contents(batches):
        import pyarrow as pa

        def batch_of(paths, bodies):
            return pa.RecordBatch.from_arrays([pa.array([scheme + p for p in paths], pa.string()), pa.array(bodies, pa.binary())], names=["path", "content"])

        system, _ = file_system(root)
        for batch in batches:
            paths, bodies, size = [], [], 0
            for path in batch.column(0).to_pylist():
                with system.open_input_file(path) as f:
                    bodies.append(f.read())
                paths.append(path)
                size += len(bodies[-1])
                if size >= BATCH_BYTES:
                    yield batch_of(paths, bodies)
                    paths, bodies, size = [], [], 0
            if paths:
                yield batch_of(paths, bodies)

    found = spark.range(0, 1, 1, 1).mapInArrow(top, "path string, folder boolean").repartition(tasks, "path").mapInArrow(below, "path string")
    files = found.repartition(tasks, "path").mapInArrow(contents, "path string, content binary")
    return files.select("path", "content", F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)).alias("suffix"), F.sha2("content", 256).alias("sha256"))


def decode(raw: bytes) -> tuple[str | None, str]:
    """Text and a note: byte-order marks first (the longer ones before the shorter), then UTF-8, then Windows-1252."""
    marks = ((b"\xff\xfe\x00\x00", "utf-32"), (b"\x00\x00\xfe\xff", "utf-32"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16"))
    codec = next((c for m, c in marks if raw.startswith(m)), None)
    tries = [(codec, f"decoded as {codec}")] if codec else [("utf-8-sig", ""), ("cp1252", "decoded as cp1252")]
    for name, note in tries:
        try:
            text = raw.decode(name)
        except UnicodeDecodeError:
            continue
        return (None, "has NUL characters") if "\0" in text else (text, note)
    return None, "cannot be decoded"


def decoded(files: DataFrame) -> DataFrame:
    """`files` with text and note in place of content."""
    kept = [c for c in files.columns if c != "content"]

    def run(batches):
        for rows in batches:
            pairs = [decode(bytes(x)) for x in rows.pop("content")]
            yield rows.assign(text=[t for t, _ in pairs], note=[n for _, n in pairs])

    kinds = ", ".join(f"`{c}` {t}" for c, t in files.select(*kept).dtypes)
    return files.select(*kept, "content").mapInPandas(run, f"{kinds}, text string, note string")


_BLANKS = str.maketrans("\t\u00a0", "  ")


def _tidy(text: str) -> str:
    """Lines without blanks around and repeated blanks inside, at most one empty line between two."""
    kept: list[str] = []
    for line in text.replace("\r\n", "\n").replace("\r", "\n").translate(_BLANKS).split("\n"):
        line = " ".join(filter(None, line.split(" ")))
        if line or kept[-1:] != [""]:
            kept.append(line)
    return "\n".join(kept).strip()


class Outline:
    """The headings above the current place."""

    def __init__(self):
        self.stack: list[tuple[int, str]] = []

    def enter(self, level: int, title: str) -> None:
        self.stack = [x for x in self.stack if x[0] < level] + [(level, title)]

    @property
    def path(self) -> str:
        return " > ".join(t for _, t in self.stack)


def cells(line: str) -> list[str]:
    """Cells of a pipe row; a backslash keeps a pipe in its cell."""
    return [c.replace(r"\|", "|").strip() for c in re.split(r"(?<!\\)\|", line.strip().removeprefix("|").removesuffix("|"))]


def delimiter_row(line: str, width: int) -> bool:
    """Whether a line parts a table's header of `width` cells from its rows: dashes, with a colon at either end, in every cell."""
    own = cells(line)
    return "-" in line and len(own) == width and all(re.fullmatch(":?-+:?", c) for c in own)


def list_marker(line: str) -> str | None:
    """The marker of a list item: a bullet, or at most nine digits and a full stop or bracket, then a blank or the line's end."""
    head, _, rest = line.expandtabs(4).strip(" ").partition(" ")
    if len({*head, *rest} - {" "}) == 1 and head[0] in "-*_" and len(head) + len(rest.replace(" ", "")) > 2:
        return None  # a thematic break
    bullet = head in ("-", "*", "+")
    number = len(head) > 1 and head[-1] in ".)" and head[:-1].isascii() and head[:-1].isdecimal() and len(head) <= 10
    return head if bullet or number else None


def table_rows(headers: list[str], rows: list[list[str]]) -> Iterator[tuple[str, str]]:
    """(kind, text) of a table: the header, then rows without the empty ones."""
    yield "table_header", " | ".join(headers)
    for row in rows:
        if any(row):
            yield "table_row", " | ".join(row)


def markdown_blocks(text: str) -> Iterator[tuple[str, str, str, str]]:
    """(kind, section_path, locator, text): headings of both styles, pipe tables, lists by item, prose by paragraph."""
    lines = [*text.splitlines(), ""]
    outline, i = Outline(), 0

    def role(n: int) -> str:
        line, below = lines[n], lines[n + 1] if n + 1 < len(lines) else ""
        if not line.strip():
            return "blank"
        if re.fullmatch(r"\s*(?:={3,}|-{3,})\s*", below):
            return "underlined"
        if re.match(r"^#{1,6}\s+\S", line):
            return "heading"
        if "|" in line and delimiter_row(below, len(cells(line))):
            return "table"
        return "text"

    while i < len(lines):
        kind = role(i)
        if kind == "underlined":
            outline.enter(1 if lines[i + 1].lstrip().startswith("=") else 2, _tidy(lines[i]))
            yield "section_header", outline.path, f"lines {i + 1}-{i + 2}", _tidy(lines[i])
            i += 2
        elif kind == "heading":
            marks, title = re.match(r"^(#+)\s+(.*?)\s*#*\s*$", lines[i]).groups()
            outline.enter(len(marks), _tidy(title))
            yield "section_header", outline.path, f"line {i + 1}", _tidy(title)
            i += 1
        elif kind == "table":
            end = i + 2
            while lines[end].strip() and "|" in lines[end]:
                end += 1
            for n, (what, row) in enumerate(table_rows(cells(lines[i]), [cells(x) for x in lines[i + 2 : end]])):
                yield what, outline.path, f"line {i + 1 + n + (n > 0)}", row
            i = end
        elif kind == "text":
            end = i + 1
            while role(end) == "text":
                end += 1
            own = lines[i:end]
            if all(map(list_marker, own)):
                for n, x in enumerate(own):
                    yield "list_item", outline.path, f"line {i + n + 1}", _tidy(x)
            else:
                yield "prose", outline.path, f"lines {i + 1}-{end}", _tidy("\n".join(own))
            i = end
        else:
            i += 1


def plain_blocks(text: str) -> Iterator[tuple[str, str, str, str]]:
    for n, p in enumerate(x for x in map(_tidy, re.split(r"\n\s*\n", text.replace("\r\n", "\n"))) if x):
        yield "prose", "", f"paragraph {n + 1}", p


#: Stand-ins for white space inside <pre>, which stays as it is wherever the element stands.
_KEPT = {" ": "\ue000", "\n": "\ue001", "\t": "\ue002"}


def _kept(text: str, back: bool = False) -> str:
    for a, b in _KEPT.items():
        text = text.replace(b, a) if back else text.replace(a, b)
    return text


class _Page(HTMLParser):
    """Events of the visible part of a page: (kind, text), cells joined for a row, terms with their descriptions."""

    HIDDEN = {"script", "style", "noscript", "template"}
    OWN = {"p", "li", "pre", "dt", "dd", "h1", "h2", "h3", "h4", "h5", "h6", "title"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.hidden, self.open, self.found, self.row, self.title, self.terms, self.described, self.kept = 0, [], [], None, "", [], False, 0

    def orphans(self) -> None:
        """Terms that no description followed."""
        if self.terms and not self.described:
            self.found.append(("orphan_term", "; ".join(self.terms)))
        self.terms, self.described = [], False

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in self.HIDDEN
        self.kept += tag == "pre"
        if tag == "br" and self.open:
            self.open[-1][1].append("\n")
        elif tag == "dl":
            self.orphans()
        elif tag == "tr":
            self.row, self.heads = [], 0
        elif tag in ("td", "th") or tag in self.OWN and not (self.open and self.open[-1][0] in ("td", "th", "li", "dd", "pre")):
            self.open.append((tag, []))

    def handle_data(self, data):
        if not self.hidden and self.open:
            self.open[-1][1].append(_kept(data.replace("\r\n", "\n")) if self.kept else data)

    def handle_endtag(self, tag):
        self.hidden -= tag in self.HIDDEN and self.hidden > 0
        self.kept -= tag == "pre" and self.kept > 0
        if tag == "dl":
            self.orphans()
        if tag == "tr" and self.row is not None:
            if any(self.row):
                self.found.append(("table_header" if self.heads == len(self.row) else "table_row", " | ".join(self.row)))
            self.row = None
        if not self.open or self.open[-1][0] != tag:
            return
        kind, parts = self.open.pop()
        text = _kept(_tidy("".join(parts)), back=True)
        if kind in ("td", "th"):
            if self.row is not None:
                self.row.append(text)
                self.heads += kind == "th"
        elif kind == "title":
            self.title = text
        elif kind == "dt":
            if self.described:
                self.orphans()
            self.terms.append(text)
        elif kind == "dd":
            self.found.append(("definition", f"{'; '.join(self.terms)}: {text}") if self.terms else ("orphan_description", text))
            self.described = bool(self.terms)
        elif text:
            self.found.append((kind, text))


def html_blocks(html: str) -> Iterator[tuple[str, str, str, str]]:
    """(kind, section_path, locator, text) of the visible blocks of a page."""
    page, outline = _Page(), Outline()
    page.feed(html)
    page.close()
    page.orphans()
    if page.title:
        outline.enter(0, page.title)
    for n, (kind, text) in enumerate(page.found):
        if kind[0] == "h" and kind[1:].isdigit():
            outline.enter(int(kind[1]), text)
            yield "section_header", outline.path, f"element {n + 1}", text
        else:
            yield {"p": "prose", "li": "list_item", "pre": "preformatted"}.get(kind, kind), outline.path, f"element {n + 1}", text


def extracted(files: DataFrame) -> DataFrame:
    """Blocks of decoded files (path, suffix, sha256, text) by the parser of their suffix: doc_id is the path, sha256 goes along.

    A file whose content changed between two readings has two digests and gives no blocks.
    """
    changed = files.groupBy("path").agg(F.countDistinct("sha256").alias("n")).filter("n > 1").select("path")
    own = files.join(changed, "path", "left_anti")
    out = None
    for suffix, parser in PARSERS.items():
        found = parsed(own.filter(F.col("suffix") == suffix), "path", "text", parser)
        out = found if out is None else out.unionByName(found)
    return out.join(own.select(F.col("path").alias("doc_id"), "suffix", "sha256"), "doc_id")


PARSERS: dict[str, Callable] = {"md": markdown_blocks, "html": html_blocks, "htm": html_blocks, "txt": plain_blocks}


def parsed(docs: DataFrame, doc_id: str, text: str, parser: Callable) -> DataFrame:
    """Blocks of every document, by an Arrow-batched function that yields as it goes: the blocks of many short documents at once."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches):
        import pandas as pd

        names = ["doc_id", "ordinal", "kind", "section_path", "locator", "block_text"]
        found, chars = [], 0
        for rows in batches:
            for key, body in zip(rows["k"], rows["t"], strict=True):
                for n, b in enumerate(parser(body or "")):
                    found.append((key, n, *b))
                    chars += sum(map(len, b))
                    if len(found) >= BATCH_BLOCKS or chars >= BATCH_CHARS:
                        yield pd.DataFrame(found, columns=names)
                        found, chars = [], 0
        if found:
            yield pd.DataFrame(found, columns=names)

    return docs.select(F.col(doc_id).alias("k"), F.col(text).alias("t")).mapInPandas(run, f"doc_id {kind}, {BLOCK}")


def layout_tables(lines: list[str]) -> list[tuple[int, int]]:
    """[first, end) of runs of lines that look like a table: three rows of cells apart by two blanks, widths within one."""
    widths = [len([c for c in re.split(r" {2,}|\t", x.strip()) if c]) for x in lines]
    out, at = [], 0
    for many, run in groupby(widths, key=lambda n: n >= 2):
        own = list(run)
        if many and len(own) >= 3 and max(own) - min(own) <= 1 and any(re.search(r"\d", x) for x in lines[at + 1 : at + len(own)]):
            out.append((at, at + len(own)))
        at += len(own)
    return out
