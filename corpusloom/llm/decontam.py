"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The patterns are windows of ten consecutive benchmark words.  The search slides a
window over a document's words from left to right and looks only at the block of
two words at the window's end: a shift table says how far the window may move
without passing an occurrence.  Blocks that end no pattern move it by up to nine
words.  Blocks that do end one select a bucket of test strings by the hash of that
suffix block, narrowed by the hash of the prefix block, and a direct comparison of
all words confirms the occurrence.

Scale: documents are scanned once where they lie, without a shuffle.  The
benchmark is taken in blocks of at most about ``block_bytes`` of text, one for each pass
over the documents: a pass brings its block to the driver, broadcasts it, and what it finds
travels along with the document to the next pass, which is written in between.  So a
benchmark of any size works with one bounded broadcast (a task's tables take about 180 times
the block's text).

Edge cases: a null or wordless text has no words and no hits.  An item of fewer
than ``window`` words is one window of its own length, an item without words is
none.  Items that share an id count once; an item whose id is null is listed as
"null".  Repeated documents and null doc_ids are scanned row by row.  Empty tables
give empty results, or documents without hits.  Only the named columns are read,
so other columns can't clash.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.shared import column, filtered, materialize, sliced, text_bytes

WINDOW = 10
BLOCK_BYTES = 1 << 20

#: Word bytes are 0-9, a-z (A-Z lower-cased) and all of non-ASCII characters.
_WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)


def words_of(text: bytes) -> list[bytes]:
    """The lower-cased words of a UTF-8 text, in order."""
    return text.translate(_WORD_BYTES).split()


class WuManber:
    """Finds all occurrences of word sequences that have one common length."""

    def __init__(self, patterns: dict[tuple, set], length: int):
        self.length = m = length
        self.block = b = min(2, m)
        self.far = m - b + 1
        self.shift: dict = {}
        self.buckets: dict = {}
        for words, items in patterns.items():
            for end in range(b, m + 1):
                key = words[end - b : end]
                self.shift[key] = min(self.shift.get(key, self.far), m - end)
            tests = self.buckets.setdefault(words[m - b :], {}).setdefault(words[:b], [])
            tests.append((list(words), items))

    def scan(self, words: list[bytes]) -> Iterator[tuple[int, set]]:
        """(start, items) of each occurrence, by start."""
        m, b, far = self.length, self.block, self.far
        shift, buckets = self.shift.get, self.buckets
        end, n = m, len(words)
        while end <= n:
            key = tuple(words[end - b : end])
            step = shift(key, far)
            if step:
                end += step
                continue
            start = end - m
            for test, items in buckets[key].get(tuple(words[start : start + b]), ()):
                if words[start:end] == test:
                    yield start, items
            end += 1


def searchers(items: list[tuple[str, bytes]], window: int) -> list[WuManber]:
    """One searcher for each pattern length that occurs in ``items``."""
    by_length: dict[int, dict[tuple, set]] = {}
    for item, text in items:
        words = words_of(text)
        m = min(window, len(words))
        for i in range(len(words) - m + 1) if m else ():
            by_length.setdefault(m, {}).setdefault(tuple(words[i : i + m]), set()).add(item)
    return [WuManber(patterns, m) for m, patterns in sorted(by_length.items())]


def merged(spans: list) -> list[tuple[int, int]]:
    """Sorted disjoint [start, end) spans that cover the same words."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


class _Blocks:
    """A benchmark in blocks of at most about ``block_bytes`` of text."""

    def __init__(self, benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int):
        self.items = benchmark.select(F.coalesce(column(item_col).cast("string"), F.lit("null")).alias("item"), F.coalesce(column(text_col), F.lit("")).alias("text"))
        size = self.items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        self.count = max(1, math.ceil(size / block_bytes))

    def broadcast(self, k: int):
        """Block ``k``, sent to all tasks."""
        rows = self.items.where(F.pmod(F.xxhash64("item", "text"), F.lit(self.count)) == k).collect()
        return self.items.sparkSession.sparkContext.broadcast([(r["item"], r["text"].encode()) for r in rows])


def _scanner(block, window: int):
    """A function from a text to (number of words, spans, items), built in the task."""
    found = searchers(block.value, window)

    def scan(text: bytes | None) -> tuple[int, list, set]:
        words = words_of(text or b"")
        spans, items = [], set()
        for searcher in found:
            for start, hit in searcher.scan(words):
                end = start + searcher.length
                if spans and spans[-1][0] <= start <= spans[-1][1]:
                    spans[-1] = (spans[-1][0], max(end, spans[-1][1]))
                else:
                    spans.append((start, end))
                items |= hit
        return len(words), merged(spans), items

    return scan


def find_hits(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row per document: its id, n_words, hit_spans (word offsets, end
    exclusive) and item_ids (sorted as strings)."""
    span = "array<struct<start:int,end:int>>"
    out = docs.select(
        column(id_col).alias("doc_id"),
        column(text_col).alias("text"),
        F.lit(0).cast("long").alias("n_words"),
        F.array().cast(span).alias("hit_spans"),
        F.array().cast("array<string>").alias("item_ids"),
    )
    blocks = _Blocks(benchmark, item_col, item_text_col, block_bytes)
    names = ["doc_id", "text", "n_words", "hit_spans", "item_ids"]
    for k in range(blocks.count):
        block, last = blocks.broadcast(k), k == blocks.count - 1

        def search(batches, block=block, last=last):
            scan = _scanner(block, window)
            for batch in sliced(batches, of="text"):
                n, spans, items = [], [], []
                for text, had, were in zip(text_bytes(batch.column("text")), batch.column("hit_spans").to_pylist(), batch.column("item_ids").to_pylist(), strict=True):
                    count, new, hit = scan(text)
                    n.append(count)
                    spans.append([{"start": a, "end": b} for a, b in merged(new + [(x["start"], x["end"]) for x in had])])
                    items.append(sorted(hit | set(were)))
                arrays = [batch.column("doc_id"), batch.column("text"), pa.array(n, pa.int64()), pa.array(spans, batch.schema.field("hit_spans").type), pa.array(items, batch.schema.field("item_ids").type)]
                found = pa.RecordBatch.from_arrays(arrays, names)
                yield found.select([c for c in names if c != "text"]) if last else found

        if last:  # the text goes no further
            return out.mapInArrow(search, out.drop("text").schema)
        out = materialize(out.mapInArrow(search, out.schema), "decontam")
    raise AssertionError("there is always a block")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents without any hit, with all their columns."""
    blocks = _Blocks(benchmark, item_col, item_text_col, block_bytes)
    for k in range(blocks.count):
        block = blocks.broadcast(k)

        def keep(batches, block=block):
            scan = _scanner(block, window)
            for batch in sliced(batches, of="text"):
                yield batch.filter(pa.array([not scan(t)[1] for t in text_bytes(batch.column("text"))], pa.bool_()))

        docs = filtered(docs, text_col, keep)
        if k < blocks.count - 1:
            docs = materialize(docs, "decontam")
    return docs


def digest(hits: DataFrame) -> DataFrame:
    """The contract's columns from those of ``find_hits``."""
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda acc, x: acc + x["end"] - x["start"])
    return hits.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("hit_spans") > 0).alias("contaminated"),
    )


def brute_force(text: str | None, items: list[tuple[str, str]], window: int = WINDOW) -> tuple[int, int, list[str]]:
    """(n_words, n_hit, item ids) by comparing at every position; for tests."""
    words = words_of((text or "").encode())
    hit, found = set(), set()
    for item, other in items:
        theirs = words_of(other.encode())
        m = min(window, len(theirs))
        for i in range(len(theirs) - m + 1) if m else ():
            for j in range(len(words) - m + 1):
                if words[j : j + m] == theirs[i : i + m]:
                    hit.update(range(j, j + m))
                    found.add(item)
    return len(words), len(hit), sorted(found)


def items_digest(items: list[str]) -> str:
    """The hash of a list of item ids, for tests."""
    return hashlib.sha256(",".join(items).encode()).hexdigest()
