"""Column functions on document text: counting, splitting, identifiers, HTML."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extensions that are parsed, and by what.
PARSERS = {".pdf": "pdf", ".docx": "docx", ".doc": "docx", ".md": "markdown", ".markdown": "markdown", ".mdown": "markdown", ".html": "html", ".htm": "html"}
#: Upper bounds of the chunk size categories, in tokens.
SIZE_CATEGORIES = ((150, "tiny"), (350, "small"), (600, "medium"))
#: Namespace of DNS names for version 5 identifiers (RFC 9562).
NAMESPACE_DNS = "6ba7b8109dad11d180b400c04fd430c8"


def token_count(text: Column) -> Column:
    """Estimated tokens: half of the CJK characters plus a quarter of the others."""
    cjk = F.coalesce(F.regexp_count(text, F.lit(r"[一-鿿]")), F.lit(0))
    other = F.coalesce(F.length(text), F.lit(0)) - cjk
    return F.floor(cjk * 0.5 + other * 0.25).cast("long")


def title(text: Column, stem: Column) -> Column:
    """The heading in the first line, else the file's stem."""
    first = F.split(text, "\n")[0]
    found = F.regexp_extract(first, r"^#+\s+(.+)$", 1)
    return F.when(found != "", found).otherwise(stem)


def headings(text: Column) -> Column:
    """array<struct<level, text>> of all Markdown heading lines."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"^#{1,6}\s+.+$"))
    return F.transform(lines, lambda x: F.struct(F.length(F.regexp_extract(x, r"^(#{1,6})\s", 1)).alias("level"), F.regexp_extract(x, r"^#{1,6}\s+(.+)$", 1).alias("text")))


def text_units(text: Column) -> Column:
    """Trimmed paragraphs (separated by an empty line) that are not empty."""
    return F.filter(F.transform(F.split(text, "\n\n"), lambda x: F.trim(x)), lambda x: x != "")


def html_to_text(html: Column) -> Column:
    """Text of a page: scripts, styles, comments and images go, links become `[text](url)`."""
    out = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    out = F.regexp_replace(out, r"(?s)<!--.*?-->", " ")
    out = F.regexp_replace(out, r'(?is)<a\s[^>]*?href="([^"]*)"[^>]*>(.*?)</a>', "[$2]($1)")
    out = F.regexp_replace(out, r"(?s)<[^>]*>", " ")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def extension(path: Column) -> Column:
    """The lower-cased extension with its dot; empty if there is none."""
    return F.lower(F.regexp_extract(path, r"(\.[A-Za-z0-9]+)$", 1))


def parser_of(path: Column) -> Column:
    """The parser's name for a path's extension; null for unknown ones."""
    known = F.create_map(*[F.lit(x) for kv in PARSERS.items() for x in kv])
    return F.try_element_at(known, extension(path))


def _from_gbk(contents: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for some in contents:
        yield some.map(lambda b: None if b is None else bytes(b).decode("gbk", "replace"))


def decoded(content: Column) -> Column:
    """Bytes as text: UTF-8, or else GBK, which Spark's own decoder does not know; only such
    content goes through Python."""
    utf8 = F.is_valid_utf8(content.cast("string"))
    return F.when(utf8, content.cast("string")).otherwise(F.pandas_udf(_from_gbk, "string")(F.when(~utf8, content)))


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` names it in
    functions of array elements."""
    return F.transform(F.array(value), use)[0]


def char_ngrams(text: Column, n: int = 3) -> Column:
    """All n-grams of characters of a text without white space; none if it is shorter."""

    def grams(c: Column) -> Column:
        many = F.transform(F.sequence(F.lit(1), F.size(c) - (n - 1)), lambda i: F.concat(*[F.element_at(c, (i + k).cast("int")) for k in range(n)]))
        return F.when(F.size(c) >= n, many).otherwise(F.array().cast("array<string>"))

    chars = F.filter(F.split(F.regexp_replace(text, r"\s+", ""), ""), lambda x: x != "")
    return bound(chars, grams)


def document_key(parent: Column, stem: Column) -> Column:
    """`doc_` and eight hex digits of the path."""
    return F.concat(F.lit("doc_"), F.substring(F.md5(F.concat_ws(":", parent, stem).cast("binary")), 1, 8))


def content_hash(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def uuid5(name: Column, namespace: str = NAMESPACE_DNS) -> Column:
    """The version 5 UUID of a name."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), name.cast("binary")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    parts = [F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12)]
    return F.concat_ws("-", *parts)


def size_category(tokens: Column) -> Column:
    out = F.when(tokens < SIZE_CATEGORIES[0][0], SIZE_CATEGORIES[0][1])
    for bound, name in SIZE_CATEGORIES[1:]:
        out = out.when(tokens < bound, name)
    return out.otherwise("large")


def tenant_norm(tenant: Column) -> Column:
    """A blank or missing tenant is `default`; others stay as they are."""
    return F.when(F.coalesce(F.trim(tenant), F.lit("")) == "", "default").otherwise(tenant)


def tenant_sanitized(tenant: Column) -> Column:
    """Suffix of a tenant's index: letters, digits, `-` and `_` only."""
    bare = F.regexp_replace(F.coalesce(tenant, F.lit("")), r"[^\p{L}\p{N}_-]", "")
    return F.concat(F.lit("_t"), F.when(bare == "", "default").otherwise(bare))


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def word_count(text: Column) -> Column:
    """The number of ``words``, without making them."""
    return F.regexp_count(text, F.lit(r"[\p{L}\p{N}]+"))


def lead(text: Column, sentences: int = 2, chars: int = 8000) -> Column:
    """The first sentences of the first ``chars`` characters; a summary without a model."""
    return F.trim(F.array_join(F.slice(F.split(F.substring(text, 1, chars), r"\. "), 1, sentences), ". "))


def status_or_null(value: Column) -> Column:
    """Zero as null."""
    return F.nullif(value, F.lit(0))
