"""Word files (Office Open XML) as text, with nothing but zip and XML.

A paragraph becomes one text unit, a heading style a Markdown heading line, so that titles and
headings are found as in Markdown; a table's row is its cells between bars.  Deleted text, field
codes and everything outside the body (headers, notes, comments) are left out.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The namespace and the file that hold a document's body.
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_BODY = "word/document.xml"
#: Largest body, unpacked; a file that unpacks to more is damaged or hostile.
MOST = 256 * 1024 * 1024
_HEADING = re.compile(r"heading\s*([1-6])$", re.IGNORECASE)


def _inline(node) -> str:
    """The text of a paragraph's runs."""
    out = []
    for e in node:
        tag = e.tag.removeprefix(_W)
        if tag == "t":
            out.append(e.text or "")
        elif tag == "tab":
            out.append("\t")
        elif tag in ("br", "cr"):
            out.append("\n")
        elif tag not in ("del", "pPr", "rPr", "instrText", "delText", "p", "tbl"):
            out.append(_inline(e))
    return "".join(out)


def _units(node) -> Iterator[str]:
    for e in node:
        tag = e.tag.removeprefix(_W)
        if tag == "p":
            style = e.find(f"{_W}pPr/{_W}pStyle")
            level = _HEADING.match(style.get(f"{_W}val", "")) if style is not None else None
            text = _inline(e).strip()
            if text:
                yield "#" * int(level[1]) + " " + text if level else text
        elif tag == "tbl":
            for row in e.iter(f"{_W}tr"):
                cells = [" ".join(_units(c)) for c in row.findall(f"{_W}tc")]
                if any(cells):
                    yield " | ".join(cells)
        elif tag in ("sdt", "sdtContent", "body", "ins", "customXml"):
            yield from _units(e)


def text_of(content: bytes | None) -> str | None:
    """The text of a Word file, its units separated by empty lines; null if it can't be read."""
    if content is None:
        return None
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            if z.getinfo(_BODY).file_size > MOST:
                return None
            data = z.read(_BODY)
        if b"<!DOCTYPE" in data[:4096]:  # no entities are expanded
            return None
        return "\n\n".join(_units(ElementTree.fromstring(data)))
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, EOFError, ValueError, RuntimeError, NotImplementedError, OSError, zipfile.zlib.error):
        return None


def _texts(contents: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for some in contents:
        yield some.map(lambda b: text_of(None if b is None else bytes(b)))


def parsed(content: Column) -> Column:
    """``text_of`` of a column of files' contents."""
    return F.pandas_udf(_texts, "string")(content)


def packed(text: str | None) -> bytes:
    """The smallest Word file of a text: a paragraph for each line, ``#`` lines as headings."""
    paragraphs = []
    for line in (text or "").split("\n"):
        line = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]", "", line)
        level = re.match(r"(#{1,6}) (.*)", line)
        style = f'<w:pPr><w:pStyle w:val="Heading{len(level[1])}"/></w:pPr>' if level else ""
        paragraphs.append(f'<w:p>{style}<w:r><w:t xml:space="preserve">{escape(level[2] if level else line)}</w:t></w:r></w:p>')
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(_BODY, f'<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="{_W[1:-1]}"><w:body>{"".join(paragraphs)}</w:body></w:document>')
    return out.getvalue()


def _files(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for some in texts:
        yield some.map(packed)


def written(text: Column) -> Column:
    """``packed`` of a column of texts."""
    return F.pandas_udf(_files, "binary")(text)
