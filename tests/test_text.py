"""Text functions and the Word parser against hand-made results."""

import io
import zipfile

from pyspark.sql import functions as F

from evidentia.functions import spans
from evidentia.functions import text as t
from evidentia.sources import office


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "v string").select(expr(F.col("v"))).first()[0]


def test_tokens(spark):
    assert one(spark, t.words, "The Ünï_c0de, x") == ["the", "ünï_c0de", "x"]
    assert one(spark, t.search_tokens, "The head of a Team team") == ["head", "team", "team"]
    assert one(spark, t.words, None) == []
    assert one(spark, t.token_estimate, "one, two") == 3 and one(spark, t.token_estimate, "abcdefgh") == 2
    assert one(spark, t.conservative_tokens, "ab12 word\n.é") == 4 + 1 + 1 + 1 + 3
    assert one(spark, t.conservative_tokens, "") == 0


def test_forms(spark):
    assert one(spark, t.surface, "  “A”–b \t c ") == '"a"-b c'
    assert one(spark, t.source_text, " a \r\n\r\n\r\n\r\n b  c ") == "a\n\nb c"
    assert one(spark, t.escaped, '<a href="x">&</a>') == "&lt;a href=&quot;x&quot;&gt;&amp;&lt;/a&gt;"


def test_clock(spark):
    for clock, n in (("7", 7), ("1:05", 65), ("2:00:09", 7209), ("1:75", None), ("x", None)):
        assert one(spark, t.seconds_of, clock) == n
    assert spark.range(3725, 3726).select(t.clock_of(F.col("id"))).first()[0] == "1:02:05"


def test_spans():
    text = "He said:  a\n quote. Dr. Who left! Then?"
    assert text[slice(*spans.locate_quote(text, "a quote."))] == "a\n quote." and spans.locate_quote(text, " ") is None
    assert [text[a:b] for a, b, _ in spans.answer_units(text)] == ["He said:  a\n quote.", "Dr.", "Who left!", "Then?"]
    assert spans.complete_part("One. Two. Thr") == "One. Two." and spans.complete_part("none") == ""
    assert spans.expand_markers("x [E:a, C2] y [C9].", {"a": ["P1", "P2"], "C2": ["P2", "P3"]}) == "x [P1][P2][P3] y ."
    assert spans.folded_words("ﬁne STRASSE Straße") == ["fine", "strasse", "strasse"]


def test_docx():
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda text, props="": f"<w:p><w:pPr>{props}</w:pPr><w:r><w:t>{text}</w:t></w:r></w:p>"
    cell = lambda text, props="": f"<w:tc><w:tcPr>{props}</w:tcPr>{p(text)}</w:tc>"
    table = f"<w:tbl><w:tr>{cell('T')}{cell('T')}</w:tr><w:tr>{cell('a')}{cell('b')}</w:tr><w:tr>{cell('1')}{cell('2', '<w:vMerge/>')}</w:tr></w:tbl>"
    body = p("Head", '<w:pStyle w:val="Heading1"/>') + p("text") + p("item", "<w:numPr/>") + table
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
        z.writestr("word/footnotes.xml", f'<w:footnotes {w}><w:footnote w:id="1">{p("note")}</w:footnote></w:footnotes>')
    assert [(k, s, x) for k, s, _, x in office.docx_blocks(raw.getvalue())] == [
        ("section_header", "Head", "Head"), ("prose", "Head", "text"), ("list_item", "Head", "item"),
        ("table_header", "Head", "a | b"), ("table_row", "Head", "T | T"), ("table_row", "Head", "1"[:1] + " | "), ("footnote", "", "note"),
    ]
