"""Packing of documents into training windows by lexical retrieval.

Documents become token ids.  Each ends with ``END_ID``.  The terms of the lexical index are the token
ids themselves: document frequencies and the mean length are counted over all documents.  The
documents are dealt into shards by their rarest term, so that what is alike tends to lie
together; a shard holds about ``SHARD_TOKENS`` tokens and has an inverted index with BM25
weights.  A window starts with a seed: the rest of the document that the window before cut, or else the first
unused document of the shard.  If the seed leaves room, its BM25 neighbours that are unused fill it, the
nearest first (ties: the earlier in the shard), and when none shares a term the first unused one does.
What doesn't fit is cut and its rest is the next seed.

Padding: all windows of a shard are full but the last, which is cut into sequences whose lengths are
powers of two; those need no padding, so there is none at all.

Ids: those of the ``tokenizers`` library (``add_special_tokens=False``, special strings being
ordinary text).  They are computed by ``tiktoken`` from the vocabulary in the same file, which takes about a quarter
of the time; in every slice of a task both encode the first text, and a difference is an error.

Scale: texts are encoded once, into a table in the shared folder (two bytes an id where the vocabulary
allows).  Frequencies have one row for each id of the vocabulary, a bounded number, and go to
the tasks.  Ids are shuffled once.  A key that many documents share is split by
its document frequency, so copies of one document spread over as many shards as they fill.  A task holds one shard
and the document that it reads.

Edge cases: a null text is empty; an empty text is the one id ``END_ID``.  Repeated rows and null or
repeated ids are documents of their own.  A document of any length is cut into as many windows
as it needs.  An empty table gives an empty result.  Only the two named columns are read.
"""

from __future__ import annotations

from array import array
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.shared import column, materialize, sliced

WINDOW = 2048
END_ID = 1
SHARD_TOKENS = 1 << 20
#: Tokens of a partition, which packs its shards one after the other.
PART_TOKENS = 4 * SHARD_TOKENS
K1, B = 1.2, 0.75
#: From so many characters a text's ids are never a list of Python's numbers, which takes half the time but nine times the memory.
LONG_TEXT = 1 << 20
#: Scores are compared after rounding to so many digits.
DIGITS = 6


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=2)
def _encoders(path: str):
    """(tokenizers' tokenizer, tiktoken's encoding of the same vocabulary, the vocabulary's size)."""
    import tiktoken
    from public_tokenizers import PATTERN
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(path)
    slow.encode_special_tokens = True
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(shown))}
    added = {t.content for t in slow.get_added_tokens_decoder().values()}
    ranks = {bytes(byte_of[c] for c in token): k for token, k in slow.get_vocab().items() if token not in added}
    return slow, tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), slow.get_vocab_size()


def encode(docs: DataFrame, *, id_col: str, text_col: str, tokenizer: str, end_id: int) -> DataFrame:
    """(doc, row, ids binary, terms binary, n): the ids, and the different ones, as little-endian numbers
    of two bytes, four for large vocabularies."""

    def encoded(batches):
        slow, fast, size = _encoders(tokenizer)
        kind, mark = np.dtype("<u2" if size <= 1 << 16 else "<u4"), np.zeros(size, np.int64)
        code = "H" if kind.itemsize == 2 else "I"

        def of(text: str) -> np.ndarray:
            if len(text) >= LONG_TEXT:
                return np.append(fast.encode_to_numpy(text, disallowed_special=()), end_id).astype(kind)
            own = array(code, fast.encode_ordinary(text))
            own.append(end_id)
            return np.frombuffer(own, kind.newbyteorder("=")).astype(kind, copy=False)

        for batch in sliced(batches, of="text"):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            ids = [of(t) for t in texts]
            if slow.encode(texts[0], add_special_tokens=False).ids != ids[0][:-1].tolist():
                raise ValueError("tokenizers and tiktoken give different ids for one text")
            columns = [pa.array([a.tobytes() for a in ids], pa.binary()), pa.array([distinct(a, mark).tobytes() for a in ids], pa.binary()), pa.array([len(a) for a in ids], pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("row"), *columns], ["doc", "row", "ids", "terms", "n"])

    rows = docs.select(column(id_col).alias("doc"), F.monotonically_increasing_id().alias("row"), column(text_col).cast("string").alias("text"))
    kind = rows.schema["doc"].dataType.simpleString()
    return rows.mapInArrow(encoded, f"doc {kind}, row long, ids binary, terms binary, n long")


def distinct(ids: np.ndarray, mark: np.ndarray) -> np.ndarray:
    """The different ids; ``mark``: a number for each id of the vocabulary, to be overwritten."""
    at = np.arange(len(ids), dtype=mark.dtype)
    mark[ids] = at
    return ids[mark[ids] == at]


def frequencies(tokens: DataFrame, size: int, kind: str) -> np.ndarray:
    """In how many documents each id occurs, over all documents."""

    def counted(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(np.frombuffer(b"".join(batch.column("terms").to_pylist()), kind), minlength=size)
        term = total.nonzero()[0]
        yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(total[term])], ["term", "df"])

    out = np.zeros(size, np.int64)
    for r in tokens.select("terms").mapInArrow(counted, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        out[r["term"]] = r["df"]
    return out


class Shard:
    """An inverted index with BM25 weights over the documents of a shard."""

    def __init__(self, ids: list[np.ndarray], idf: np.ndarray, mean: float):
        size, every = len(idf), np.concatenate(ids)
        local = np.zeros(size, np.int64)
        known = np.zeros(size, bool)
        known[every] = True
        here = known.nonzero()[0]
        local[here] = np.arange(len(here))
        self.count, self.terms, tf = len(ids), [], []
        for one in ids:
            c = np.bincount(local[one], minlength=len(here))
            self.terms.append(c.nonzero()[0])
            tf.append(c[self.terms[-1]])
        terms, tf = np.concatenate(self.terms), np.concatenate(tf).astype(float)
        sizes = np.array([len(t) for t in self.terms])
        docs = np.repeat(np.arange(self.count), sizes)
        norm = np.repeat(K1 * (1 - B + B * np.array([len(one) for one in ids]) / mean), sizes)
        order = np.argsort(terms, kind="stable")
        starts = np.searchsorted(terms[order], np.arange(1, len(here)))
        self.docs = np.split(docs[order], starts)
        self.weights = np.split((idf[here][terms] * tf * (K1 + 1) / (tf + norm))[order], starts)

    def scores(self, doc: int) -> np.ndarray:
        """BM25 of every document for the terms of ``doc``."""
        terms = self.terms[doc].tolist()
        docs, weights = np.concatenate([self.docs[t] for t in terms]), np.concatenate([self.weights[t] for t in terms])
        return np.bincount(docs, weights, minlength=self.count).round(DIGITS)


def pack_shard(ids: list[np.ndarray], idf: np.ndarray, mean: float, window: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of all pieces of a shard's documents."""
    index, lengths, free = Shard(ids, idf, mean), [len(x) for x in ids], np.ones(len(ids), bool)
    first, doc, at, pieces, sequence, room = 0, None, 0, [], 0, window
    seed, near = None, None
    while True:
        if doc is None:
            if seed is not None:
                near = index.scores(seed) if near is None else near
                best = int(np.where(free, near, -1).argmax())
                doc = best if free[best] and near[best] > 0 else None
            if doc is None:
                while first < len(ids) and not free[first]:
                    first += 1
                if first == len(ids):
                    break
                doc = first
            free[doc], at = False, 0
        seed = doc if seed is None else seed
        take = min(room, lengths[doc] - at)
        pieces.append((doc, at, take, sequence, window - room))
        at, room = at + take, room - take
        if at == lengths[doc]:
            doc = None
        if not room:
            sequence, room, seed, near = sequence + 1, window, None, None
    return _halved(pieces, sequence, window - room)


def _halved(pieces: list, sequence: int, length: int) -> list:
    """``pieces`` with the last sequence, of ``length``, cut into sequences of powers of two."""
    done = [p for p in pieces if p[3] != sequence]
    rest = [p[:3] for p in pieces if p[3] == sequence][::-1]
    while length:
        size, filled = 1 << (length.bit_length() - 1), 0
        while filled < size:
            doc, start, n = rest.pop()
            take = min(n, size - filled)
            done.append((doc, start, take, sequence, filled))
            filled += take
            if take < n:
                rest.append((doc, start + take, n - take))
        sequence, length = sequence + 1, length - size
    return done


def inverse_frequencies(df: np.ndarray, docs: int) -> np.ndarray:
    return np.log1p((docs - df + 0.5) / (df + 0.5))


def pack(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str | None = None,
    end_id: int = END_ID,
    window: int = WINDOW,
    shard_tokens: int = SHARD_TOKENS,
    part_tokens: int = PART_TOKENS,
) -> DataFrame:
    """(doc, start, length, ids, doc_tokens, sequence_id, offset): a row for each piece.

    ``ids``: the piece's ids as little-endian numbers of four bytes.  ``tokenizer``: the file of a
    byte-level BPE tokenizer, at that path on every machine.
    """
    tokenizer = tokenizer or default_tokenizer()
    size = _encoders(tokenizer)[2]
    kind = "<u2" if size <= 1 << 16 else "<u4"
    tokens = materialize(encode(docs, id_col=id_col, text_col=text_col, tokenizer=tokenizer, end_id=end_id), "tokens", keep=True)
    total, count = tokens.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    df, mean = frequencies(tokens, size, kind), total / max(count, 1)
    idf = inverse_frequencies(df, count)
    splits = np.maximum(1, np.ceil(df * mean / shard_tokens)).astype(np.int64)
    rank = df * size + np.arange(size)

    def keyed(terms: pd.Series, row: pd.Series) -> pd.DataFrame:
        each = (np.frombuffer(t, kind) for t in terms)
        key = np.array([t[rank[t].argmin()] for t in each], np.int64)
        salt = ((row.to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % splits[key]
        return pd.DataFrame({"key": key, "salt": salt})

    doc = tokens.schema["doc"].dataType.simpleString()
    place = F.pandas_udf(keyed, "key long, salt long")("terms", "row")
    dealt = tokens.select("doc", "row", "ids", place.alias("place")).select("doc", "row", "ids", "place.key", "place.salt")
    dealt = dealt.repartition(max(1, -(-total // part_tokens)), "key", "salt").sortWithinPartitions("key", "salt", "row")

    def packed(batches):
        sequence = TaskContext.get().partitionId() << 33
        names, ids, held = [], [], 0

        def shard():
            nonlocal sequence
            pieces = pack_shard(ids, idf, mean, window)
            own = pa.array([p[0] for p in pieces])
            columns = [pa.concat_arrays(names).take(own)]
            columns += [pa.array([p[1] for p in pieces], pa.int64()), pa.array([p[2] for p in pieces], pa.int64())]
            columns += [pa.array([ids[d][s : s + n].astype("<u4").tobytes() for d, s, n, _, _ in pieces], pa.binary()), pa.array([len(ids[p[0]]) for p in pieces], pa.int64())]
            columns += [pa.array([p[3] + sequence for p in pieces], pa.int64()), pa.array([p[4] for p in pieces], pa.int64())]
            sequence += pieces[-1][3] + 1
            return pa.RecordBatch.from_arrays(columns, ["doc", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        for batch in batches:
            for k, x in enumerate(batch.column("ids")):
                names.append(batch.column("doc").slice(k, 1))
                ids.append(np.frombuffer(x.as_py(), kind))
                held += len(ids[-1])
                if held >= shard_tokens:
                    yield shard()
                    names, ids, held = [], [], 0
        if ids:
            yield shard()

    return dealt.select("doc", "ids").mapInArrow(packed, f"doc {doc}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select(F.col("doc").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
