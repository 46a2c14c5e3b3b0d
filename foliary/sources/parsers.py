"""Bytes of one file to text or rows, with the standard library only."""

from __future__ import annotations

import io
import re
import zipfile
from html.parser import HTMLParser
from xml.etree import ElementTree

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
#: Kinds of embedded files by extension.
EMBEDDED = {"xlsx": "excel", "xls": "excel", "docx": "word", "doc": "word", "pptx": "powerpoint", "ppt": "powerpoint", "pdf": "pdf", "bin": "ole"}


def decoded(data: bytes) -> str:
    """UTF-8 (a byte order mark is dropped), else Latin-1, which never fails."""
    try:
        return data.decode("utf-8-sig")
    except UnicodeDecodeError:
        return data.decode("latin-1")


def xml_text(data: bytes, excluded: frozenset[str] = frozenset()) -> str:
    """Text and tails in reading order, one a line, without excluded elements; broken XML comes out as it is."""
    try:
        root = ElementTree.fromstring(data)
    except ElementTree.ParseError:
        return data.decode("utf-8", "ignore")
    out: list[str] = []
    stack: list[tuple[str, object]] = [("open", root)]
    while stack:
        what, e = stack.pop()
        if what == "tail":
            out.append(e)
            continue
        tag = e.tag.rsplit("}", 1)[-1].lower() if isinstance(e.tag, str) else ""
        if tag in excluded or not tag:
            continue
        out.append(e.text or "")
        if e is not root:
            stack.append(("tail", e.tail or ""))
        stack += [("open", c) for c in reversed(list(e))]
    return "\n".join(s for s in map(str.strip, out) if s)


class _Page(HTMLParser):
    SKIP = {"script", "style", "nav", "footer", "header", "noscript"}
    BLOCK = {"p", "div", "tr", "ul", "ol", "table", "section", "article"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.skipped = 0

    def handle_starttag(self, tag, attrs):
        if tag in self.SKIP:
            self.skipped += 1
        elif not self.skipped:
            self.out.append("\n" if tag in self.BLOCK or tag == "br" else "\n• " if tag == "li" else "\n" + "#" * int(tag[1]) + " " if re.fullmatch("h[1-6]", tag) else " | " if tag in ("td", "th") else "")

    def handle_endtag(self, tag):
        if tag in self.SKIP:
            self.skipped = max(0, self.skipped - 1)
        elif tag in self.BLOCK or re.fullmatch("h[1-6]", tag):
            self.out.append("\n")

    def handle_data(self, data):
        if not self.skipped:
            self.out.append(data)


def html_text(data: bytes | str) -> str:
    page = _Page()
    page.feed(data if isinstance(data, str) else decoded(data))
    lines = [re.sub(r"[ \t\xa0]+", " ", x).strip() for x in "".join(page.out).replace("\n | ", "\n").split("\n")]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()


def _parts(data: bytes, pattern: str) -> list[tuple[str, bytes]]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = [n for n in z.namelist() if re.fullmatch(pattern, n)]
        names.sort(key=lambda n: [int(x) if x.isdigit() else x for x in re.split(r"(\d+)", n)])
        return [(n, z.read(n)) for n in names]


def docx_rows(data: bytes) -> list[tuple[str, str]]:
    """(style, text) of paragraphs and ('table', 'a | b') of table rows, in reading order."""
    parts = _parts(data, r"word/document\.xml")
    if not parts:
        return []
    body = ElementTree.fromstring(parts[0][1]).find(f"{W}body")
    rows = []

    def text(e):
        return re.sub(r"\s+", " ", "".join((t.text or "") if t.tag == f"{W}t" else "\t" if t.tag == f"{W}tab" else " " if t.tag == f"{W}br" else "" for t in e.iter())).strip()

    for e in body if body is not None else []:
        if e.tag == f"{W}p":
            style = e.find(f"{W}pPr/{W}pStyle")
            if s := text(e):
                rows.append((style.get(f"{W}val", "") if style is not None else "", s))
        elif e.tag == f"{W}tbl":
            for tr in e.iter(f"{W}tr"):
                cells = [c for c in (text(tc) for tc in tr.findall(f"{W}tc")) if c]
                if cells:
                    rows.append(("table", " | ".join(cells)))
    return rows


def docx_sections(data: bytes) -> list[tuple[str, str]]:
    """(title, text) by heading styles; what precedes the first heading has the title ''."""
    out: list[tuple[str, list[str]]] = []
    for style, s in docx_rows(data):
        if re.match(r"(?i)heading|titre|title", style):
            out.append((s, []))
        else:
            if not out:
                out.append(("", []))
            out[-1][1].append(s)
    return [(t, "\n".join(x)) for t, x in out]


def pptx_slides(data: bytes) -> list[tuple[int, str, str]]:
    """(number, title, text) of slides: the text of shapes by paragraph, table rows with bars."""
    out = []
    for n, (_, raw) in enumerate(_parts(data, r"ppt/slides/slide\d+\.xml"), 1):
        root = ElementTree.fromstring(raw)
        title, lines = "", []
        for shape in root.iter(f"{P}sp"):
            ph = shape.find(f"{P}nvSpPr/{P}nvPr/{P}ph")
            ps = [t for t in ("".join(x.text or "" for x in p.iter(f"{A}t")).strip() for p in shape.iter(f"{A}p")) if t]
            if ph is not None and ph.get("type") in ("title", "ctrTitle") and not title:
                title = " ".join(ps)
            else:
                lines += ps
        for tr in root.iter(f"{A}tr"):
            lines.append(" | ".join("".join(x.text or "" for x in tc.iter(f"{A}t")).strip() for tc in tr.findall(f"{A}tc")))
        out.append((n, title, "\n".join(lines)))
    return out


def pptx_embedded(data: bytes) -> list[tuple[str, str]]:
    """(name, kind) of embedded files."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = [n for n in z.namelist() if n.startswith("ppt/embeddings/") and not n.endswith("/")]
    return [(n.rsplit("/", 1)[-1], EMBEDDED.get(n.rsplit(".", 1)[-1].lower(), "unknown")) for n in sorted(names)]


def text_of(path: str, data: bytes, excluded: frozenset[str] = frozenset()) -> str | None:
    """Text of a file by its extension; None for kinds that need an outside extractor (such as PDF)."""
    ext = path.rsplit(".", 1)[-1].lower()
    if ext in ("txt", "md", "log"):
        return data.decode("utf-8", "ignore")
    if ext == "csv":
        return "\n".join(" ".join(c for c in (x.strip() for x in line.split(";")) if c) for line in decoded(data).splitlines())
    if ext == "xml":
        return xml_text(data, excluded)
    if ext in ("html", "htm"):
        return html_text(data)
    if ext == "docx":
        return "\n".join(t for _, t in docx_rows(data))
    if ext == "pptx":
        return "\n\n".join("\n".join(x for x in (f"--- Slide {n} ---", t, b) if x) for n, t, b in pptx_slides(data))
    return None
