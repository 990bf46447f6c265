"""EPUB, DOCX and PDF files as nodes of a tree, in reading order. Files are read whole, one a row, by `binaryFile`; members of an archive
that are larger than `MOST_BYTES` when unpacked are an error, not cut.

A node has an id, its parent's (the heading that it stands under, by level), a kind (heading, paragraph, item, row, page, contents, error), a
label (a heading's level, a contents entry's target) and where it comes from: the resource and the id of its element or its place there.
"""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from .pdf import MOST_BYTES, pdf_pages

SCHEMA = "document_id string, node_id string, parent_id string, ordinal long, kind string, label string, text string, resource string, anchor string"
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
# Elements of XHTML by what they do with text.
_BLOCKS = frozenset("address article aside blockquote body dd div dl dt figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul caption".split())
_SILENT = frozenset("script style head title svg math".split())
#: (kind, label, text, anchor)
Found = tuple[str, str | None, str, str | None]


def _member(archive: zipfile.ZipFile, name: str) -> bytes:
    if archive.getinfo(name).file_size > MOST_BYTES:
        raise ValueError(f"{name} is larger than {MOST_BYTES} bytes")
    return archive.read(name)


def _xml(data: bytes) -> ElementTree.Element:
    if b"<!DOCTYPE" in data[:2000] and b"<!ENTITY" in data:
        raise ValueError("entity declarations aren't read")
    return ElementTree.fromstring(data)


class Page(HTMLParser):
    """Blocks of one XHTML file; text that stands in no paragraph is one, too."""

    def __init__(self, contents: bool = False) -> None:
        super().__init__(convert_charrefs=True)
        self.contents, self.found, self.parts = contents, [], []
        self.open: list[tuple[str, str | None]] = []
        self.silent, self.target = 0, None

    def flush(self) -> None:
        text, self.parts = " ".join("".join(self.parts).split()), []
        if not text:
            return
        names = [n for n, _ in self.open]
        anchor = next((i for _, i in reversed(self.open) if i), None)
        heading = next((n for n in reversed(names) if len(n) == 2 and n[0] == "h" and n[1].isdigit()), None)
        if self.contents:
            if self.target is not None:
                self.found.append(("contents", self.target, text, anchor))
        elif heading:
            self.found.append(("heading", heading[1], text, anchor))
        else:
            kind = "item" if "li" in names else "row" if "tr" in names else "paragraph"
            self.found.append((kind, None, text, anchor))
        self.target = None

    def handle_starttag(self, tag: str, attributes: list) -> None:
        held = dict(attributes)
        if tag in _SILENT:
            self.silent += 1
        elif tag == "br":
            self.parts.append(" ")
        elif tag in ("td", "th"):
            self.parts.append(" \ue000 " if self.parts else "")
        elif tag in _BLOCKS and not ("tr" in (n for n, _ in self.open) and tag in ("p", "div")):
            self.flush()
            if tag != "hr":
                self.open.append((tag, held.get("id")))
        elif tag == "a" and self.contents:
            self.flush()
            self.target = held.get("href") or ""

    def handle_endtag(self, tag: str) -> None:
        if tag in _SILENT:
            self.silent = max(0, self.silent - 1)
        elif tag == "a" and self.contents:
            self.flush()
        elif any(n == tag for n, _ in self.open):
            self.flush()
            while self.open and self.open.pop()[0] != tag:
                pass

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.parts.append(data)


def xhtml_blocks(text: str, contents: bool = False) -> list[Found]:
    page = Page(contents)
    page.feed(text)
    page.close()
    page.flush()
    return [(k, lab, t.replace(" \ue000 ", "\t"), a) for k, lab, t, a in page.found]


def epub_nodes(data: bytes) -> Iterator[tuple[str, Found]]:
    """(resource, node): the contents first, then the files of the spine in order."""
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        container = _xml(_member(archive, "META-INF/container.xml"))
        package = next(e.attrib["full-path"] for e in container.iter() if e.tag.endswith("rootfile"))
        root = _xml(_member(archive, package))
        items = {e.attrib["id"]: e.attrib for e in root.iter() if e.tag.endswith("}item")}
        name = lambda href: posixpath.normpath(posixpath.join(posixpath.dirname(package), href.split("#")[0]))
        for a in items.values():
            if "nav" in a.get("properties", "").split():
                for f in xhtml_blocks(_member(archive, name(a["href"])).decode("utf-8", "replace"), True):
                    yield name(a["href"]), f
        for ref in (e.attrib["idref"] for e in root.iter() if e.tag.endswith("}itemref")):
            if "nav" in items[ref].get("properties", "").split():
                continue
            resource = name(items[ref]["href"])
            for f in xhtml_blocks(_member(archive, resource).decode("utf-8", "replace")):
                yield resource, f


def docx_nodes(data: bytes) -> Iterator[tuple[str, Found]]:
    """Paragraphs, headings, list items and table rows in order, then foot- and endnotes."""

    def text(e: ElementTree.Element) -> str:
        parts = []
        for x in e.iter():
            if x.tag == f"{_W}t":
                parts.append(x.text or "")
            elif x.tag in (f"{_W}tab", f"{_W}br", f"{_W}cr"):
                parts.append(" ")
        return " ".join("".join(parts).split())

    def walk(body: ElementTree.Element) -> Iterator[Found]:
        for k, e in enumerate(body):
            if e.tag == f"{_W}p":
                style = next((s.attrib.get(f"{_W}val", "") for s in e.iter(f"{_W}pStyle")), "").lower()
                anchor = next((b.attrib.get(f"{_W}name") for b in e.iter(f"{_W}bookmarkStart")), None) or str(k)
                if t := text(e):
                    if style.startswith(("heading", "title")):
                        level = "".join(c for c in style if c.isdigit()) or "1"
                        yield "heading", level, t, anchor
                    else:
                        yield ("item" if next(e.iter(f"{_W}numPr"), None) is not None else "paragraph"), None, t, anchor
            elif e.tag == f"{_W}tbl":
                for n, row in enumerate(e.iter(f"{_W}tr")):
                    cells = [text(c) for c in row.iter(f"{_W}tc")]
                    if any(cells):
                        yield "row", None, "\t".join(cells), f"{k}.{n}"
            elif e.tag in (f"{_W}sdt", f"{_W}sdtContent"):
                yield from walk(e)

    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        name = "word/document.xml"
        body = _xml(_member(archive, name)).find(f"{_W}body")
        for f in walk(body if body is not None else _xml(_member(archive, name))):
            yield name, f
        for name in ("word/footnotes.xml", "word/endnotes.xml"):
            if name in archive.namelist():
                for note in _xml(_member(archive, name)):
                    if t := text(note):
                        yield name, ("paragraph", "note", t, note.attrib.get(f"{_W}id"))


def pdf_nodes(data: bytes) -> Iterator[tuple[str, Found]]:
    for k, text in enumerate(pdf_pages(data)):
        if text:
            yield "", ("page", str(k + 1), text, str(k + 1))


READERS = {".epub": epub_nodes, ".docx": docx_nodes, ".pdf": pdf_nodes}


def tree(document_id: str, found: Iterator[tuple[str, Found]]) -> list[tuple]:
    """Numbered nodes with the heading that they stand under."""
    out, above = [], []
    for n, (resource, (kind, label, text, anchor)) in enumerate(found):
        level = int(label) if kind == "heading" else 7
        while above and (above[-1][0] >= level or kind in ("contents", "page")):
            above.pop()
        out.append((document_id, f"n{n}", above[-1][1] if above else None, n, kind, label, text, resource, anchor))
        if kind == "heading":
            above.append((level, f"n{n}"))
    return out


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Nodes of all .epub, .docx and .pdf files below a path. A file that can't be read gives one node of kind `error`."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{epub,docx,pdf}").load(path).select("path", "content")
    columns = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    nodes = tree(name, READERS[name[name.rindex(".") :].lower()](bytes(content)))
                except (ValueError, KeyError, IndexError, StopIteration, RuntimeError, zipfile.BadZipFile, ElementTree.ParseError) as e:
                    nodes = [(name, "n0", None, 0, "error", None, f"{type(e).__name__}: {e}", "", None)]
                yield pd.DataFrame(nodes, columns=columns)

    return files.mapInPandas(run, SCHEMA)
