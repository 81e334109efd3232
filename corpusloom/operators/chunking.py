"""Splitting documents into chunks."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from corpusloom.functions import text

#: Separators from coarse to fine, target and least tokens of a chunk.
SEPARATORS = ("\n\n", "\n", ". ", " ")
SIZE, LEAST = 512, 150
_MARKS = [re.compile(re.escape(x)) for x in SEPARATORS]


def quarters(s: str) -> int:
    """Four times the token estimate of ``functions.text.token_count``: a character counts
    one, a CJK one two."""
    return len(s) + sum("一" <= c <= "鿿" for c in s)


def estimated_tokens(s: str) -> int:
    return quarters(s) // 4


class Splitter:
    """Cuts one text into pieces of up to ``size`` tokens, as offsets into it.

    The text's running weight is laid out once, so the tokens of any stretch are a difference,
    and how many parts fit into a piece is found by bisection.  A stretch that fits is a piece.
    Else it is cut at the coarsest separator that gives two pieces or more; a part that is too
    large by itself is cut again by all separators, and its last piece takes in what follows
    while that fits.  A stretch that nothing cuts keeps its first 2 * size words; ``lost``
    counts the words that go.
    """

    def __init__(self, s: str, size: int):
        self.text, self.size, self.lost = s, size, 0
        self.weight = [0, *accumulate(2 if "一" <= c <= "鿿" else 1 for c in s)]

    def pieces(self, a: int = 0, b: int | None = None) -> list[str]:
        b = len(self.text) if b is None else b
        if (self.weight[b] - self.weight[a]) // 4 <= self.size:
            return [self.text[a:b]]
        for mark, separator in zip(_MARKS, SEPARATORS, strict=True):
            at = [m.start() for m in mark.finditer(self.text, a, b)]
            lost = self.lost
            if at and len(out := self._packed([a, *[x + len(separator) for x in at]], [*at, b], len(separator))) > 1:
                return [p for p in out if p]
            self.lost = lost
        words = self.text[a:b].split()
        self.lost += max(0, len(words) - 2 * self.size)
        return [" ".join(words[: 2 * self.size])]

    def _packed(self, begins: list[int], ends: list[int], gap: int) -> list[str]:
        """Pieces of the parts [begin, end), which stand ``gap`` characters apart."""
        weight, most = self.weight, 4 * self.size + 3
        reach = [weight[e] for e in ends]
        out, k, n = [], 0, len(begins)
        while True:
            while k < n and begins[k] == ends[k]:  # a piece does not begin with an empty part
                k += 1
            if k == n:
                return out
            fits = bisect_right(reach, weight[begins[k]] + most, k)
            if fits > k:
                piece, k = self.text[begins[k] : ends[fits - 1]], fits
            else:
                *whole, piece = self.pieces(begins[k], ends[k]) or [""]
                out += whole
                k += 1
                if piece and k < n:
                    fits = bisect_right(reach, weight[begins[k] - gap] + most - quarters(piece), k)
                    if fits > k:
                        piece, k = piece + self.text[begins[k] - gap : ends[fits - 1]], fits
            if piece:
                out.append(piece.strip())


def chunks_of(s: str, size: int = SIZE, least: int = LEAST) -> tuple[list[tuple[int, str]], int, int]:
    """((index, text) of the chunks, pieces dropped, words cut off).

    Pieces under ``least`` tokens join the chunk before if both stay under 1.5 * size, else they
    are dropped; indexes are those of the pieces.
    """
    splitter, out, dropped = Splitter(s, size), [], 0
    for i, piece in enumerate(splitter.pieces()):
        n = estimated_tokens(piece)
        if n >= least:
            out.append((i, piece))
        elif out and 2 * (n + estimated_tokens(out[-1][1])) < 3 * size:
            out[-1] = (out[-1][0], f"{out[-1][1]}\n\n{piece}")
        else:
            dropped += 1
    return out, dropped, splitter.lost


@udtf(returnType="chunk_index int, chunk_text string, token_count int", useArrow=True)
class ChunkText:
    """Table function for SQL: ``LATERAL chunk_text(text, size, least)``."""

    def eval(self, text: str, size: int, least: int) -> Iterator[tuple[int, str, int]]:
        for i, piece in chunks_of(text or "", size, least)[0]:
            yield i, piece, estimated_tokens(piece)


def recursive_chunks(docs: DataFrame, size: int = SIZE, least: int = LEAST) -> DataFrame:
    """(chunk_id, doc_id, chunk_index, text, token_count) of all documents, in Arrow batches."""

    def run(batches):
        for batch in batches:
            at, index, texts, tokens = [], [], [], []
            for row, s in enumerate(batch.column("text").to_pylist()):
                for i, piece in chunks_of(s or "", size, least)[0]:
                    at.append(row)
                    index.append(i)
                    texts.append(piece)
                    tokens.append(estimated_tokens(piece))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(at, pa.int64())), pa.array(index, pa.int32()), pa.array(texts, pa.string()), pa.array(tokens, pa.int32())], ["doc_id", "chunk_index", "text", "token_count"])

    rows = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, chunk_index int, text string, token_count int")
    return rows.select(F.concat_ws("_chunk_", "doc_id", "chunk_index").alias("chunk_id"), "doc_id", "chunk_index", "text", "token_count")


def losses(docs: DataFrame, size: int = SIZE, least: int = LEAST) -> DataFrame:
    """(doc_id, chunks, pieces_dropped, words_cut): what the fixed rules of ``recursive_chunks``
    leave out of each document."""

    def run(batches):
        for batch in batches:
            got = [chunks_of(s or "", size, least) for s in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(x, pa.int64()) for x in ([len(c) for c, *_ in got], [d for _, d, _ in got], [w for *_, w in got])]], ["doc_id", "chunks", "pieces_dropped", "words_cut"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, chunks long, pieces_dropped long, words_cut long")


def paragraph_chunks(docs: DataFrame, *keep: str) -> DataFrame:
    """(chunk_id, doc_id, …, chunk_index, text, token_count): a chunk for each line."""
    rows = docs.select("doc_id", *keep, F.posexplode(F.split("text", "\n")).alias("chunk_index", "chunk"))
    key = F.concat_ws("_chunk_", "doc_id", "chunk_index")
    return rows.select(key.alias("chunk_id"), "doc_id", *keep, "chunk_index", F.col("chunk").alias("text"), text.token_count(F.col("chunk")).alias("token_count"))


def stats(chunks: DataFrame, least: int) -> DataFrame:
    """(doc_id, num_kept, num_dropped, avg_tokens): kept chunks have ``least`` tokens."""
    kept = F.col("token_count") >= least
    mean = F.coalesce(F.avg(F.when(kept, F.col("token_count"))), F.lit(0.0))
    return chunks.groupBy("doc_id").agg(F.count_if(kept).alias("num_kept"), F.count_if(~kept).alias("num_dropped"), F.round(mean, 4).alias("avg_tokens"))


def contextual(chunks: DataFrame, summaries: DataFrame) -> DataFrame:
    """(chunk_id, content): each chunk behind its document's summary, empty if it has none."""
    rows = chunks.join(summaries, "doc_id", "left")
    content = F.concat(F.lit("[Document Context]\n"), F.coalesce("summary", F.lit("")), F.lit("\n\n[Content]\n"), F.col("text"))
    return rows.select("chunk_id", content.alias("content"))
