"""Word documents as blocks, from their zipped XML alone: headings by style, lists, tables, footnotes."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

from .documents import Outline, table_rows

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def _text(node) -> str:
    parts = {f"{_W}t": lambda n: n.text or "", f"{_W}tab": lambda n: "\t", f"{_W}br": lambda n: "\n"}
    return re.sub(r"[ \t]+", " ", "".join(parts[n.tag](n) for n in node.iter() if n.tag in parts)).strip()


def header_row(rows: list[list[str]]) -> int:
    """The first of the first five rows with more than one distinct label, else the first."""
    return next((i for i, r in enumerate(rows[:5]) if len({c for c in r if c}) > 1), 0)


def _table(node) -> Iterator[tuple[str, str]]:
    rows = []
    for tr in node.iter(f"{_W}tr"):
        row = []
        for tc in tr.findall(f"{_W}tc"):
            merged = tc.find(f"{_W}tcPr/{_W}vMerge")
            row.append("" if merged is not None and merged.get(f"{_W}val") != "restart" else _text(tc))
        rows.append(row)
    if rows:
        at = header_row(rows)
        yield from table_rows(rows[at], rows[:at] + rows[at + 1 :])


def docx_blocks(content: bytes) -> Iterator[tuple[str, str, str, str]]:
    """(kind, section_path, locator, text) of a .docx file."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
        notes = ElementTree.fromstring(z.read("word/footnotes.xml")) if "word/footnotes.xml" in z.namelist() else None
    outline = Outline()
    for n, node in enumerate(body if body is not None else ()):
        where = f"element {n + 1}"
        if node.tag == f"{_W}tbl":
            for kind, text in _table(node):
                yield kind, outline.path, where, text
        elif node.tag == f"{_W}p" and (text := _text(node)):
            style = node.find(f"{_W}pPr/{_W}pStyle")
            level = re.fullmatch(r"(?i)heading\s*([1-9])|title", style.get(f"{_W}val", "") if style is not None else "")
            if level:
                outline.enter(int(level[1] or 1), text)
                yield "section_header", outline.path, where, text
            else:
                yield "list_item" if node.find(f"{_W}pPr/{_W}numPr") is not None else "prose", outline.path, where, text
    for note in () if notes is None else notes:
        if int(note.get(f"{_W}id", "0")) > 0 and (text := _text(note)):
            yield "footnote", "", f"footnote {note.get(f'{_W}id')}", text
