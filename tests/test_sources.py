import io
import zipfile

from foliary.sources import parsers, readers


def test_xml_reading_order_and_exclusion():
    data = b"<r xmlns='u'>a<x>b<y>c</y>d</x>e<skip>no</skip>f</r>"
    assert "no" not in parsers.xml_text(data, frozenset({"skip"}))
    assert parsers.xml_text(data).split("\n") == ["a", "b", "c", "d", "e", "no", "f"]
    assert parsers.xml_text(b"<broken>text") == "<broken>text"


def test_html():
    t = parsers.html_text("<html><script>x()</script><h2>Title</h2><p>one<br>two</p><ul><li>a</li></ul><table><tr><td>1</td><td>2</td></tr></table></html>")
    assert "x()" not in t and "## Title" in t and "• a" in t and "1 | 2" in t


def docx() -> bytes:
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = (
        "<w:p><w:pPr><w:pStyle w:val='Heading1'/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><w:t>one  two</w:t></w:r></w:p>"
        "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"
    )
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document xmlns:w='{w}'><w:body>{body}</w:body></w:document>")
    return out.getvalue()


def test_docx():
    assert parsers.docx_rows(docx()) == [("Heading1", "Head"), ("", "one two"), ("table", "a | b")]
    assert parsers.docx_sections(docx()) == [("Head", "one two\na | b")]


def test_pptx():
    ns = "xmlns:p='http://schemas.openxmlformats.org/presentationml/2006/main' xmlns:a='http://schemas.openxmlformats.org/drawingml/2006/main'"
    slide = f"<p:sld {ns}><p:sp><p:nvSpPr><p:nvPr><p:ph type='title'/></p:nvPr></p:nvSpPr><a:p><a:r><a:t>T</a:t></a:r></a:p></p:sp><p:sp><a:p><a:r><a:t>body</a:t></a:r></a:p></p:sp></p:sld>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("ppt/slides/slide1.xml", slide)
        z.writestr("ppt/embeddings/a.xlsx", b"x")
    assert parsers.pptx_slides(out.getvalue()) == [(1, "T", "body")]
    assert parsers.pptx_embedded(out.getvalue()) == [("a.xlsx", "excel")]


def test_extract_and_list(spark, tmp_path):
    (tmp_path / "a.txt").write_text("hello")
    (tmp_path / "b.csv").write_text("x; y\n;z\n")
    (tmp_path / "c.docx").write_bytes(docx())
    (tmp_path / "d.docx").write_bytes(b"broken")
    (tmp_path / "e.pdf").write_bytes(b"%PDF")
    got = {r.filename: r for r in readers.extract_texts(spark, str(tmp_path)).collect()}
    assert got["a.txt"].text == "hello" and got["b.csv"].text == "x y\nz" and "Head" in got["c.docx"].text
    assert got["d.docx"].text is None and got["d.docx"].error and got["e.pdf"].error
    assert readers.list_files(spark, str(tmp_path)).count() == 5
    asked = {r.filename: r.text for r in readers.extract_texts(spark, str(tmp_path), "*.pdf", other=lambda p, d: "from outside").collect()}
    assert asked == {"e.pdf": "from outside"}


def test_manifest(spark, tmp_path):
    p = tmp_path / "m.csv"
    p.write_text("﻿group;path\nA;/x/1\n;/x/2\nB;\n/x/3\n", encoding="utf-8")
    assert sorted(map(tuple, readers.read_manifest(spark, str(p)).collect())) == [("A", "/x/1"), ("ALL", "/x/2"), ("ALL", "/x/3")]


def test_accompanying_and_choice(spark):
    f = spark.createDataFrame([("/d/deck.pptx", "deck.pptx", ".pptx"), ("/d/deck_notes.pdf", "deck_notes.pdf", ".pdf"), ("/d/deck/x.docx", "x.docx", ".docx"), ("/d/o.pdf", "o.pdf", ".pdf")], "path string, filename string, extension string")
    assert {r.other for r in readers.accompanying(f).collect()} == {"/d/deck_notes.pdf", "/d/deck/x.docx"}
    c = spark.createDataFrame([("a", "b" * 600, None), ("c" * 600, "d" * 900, None), ("", "x", "y" * 50)], "text_1 string, text_2 string, text_3 string")
    assert sorted(r.extractor for r in readers.choose_extraction(c).collect()) == [1, 2, 3]
