"""Reversible line dedup: exact reference counts behind sharded cuckoo filters.

``LineIndex`` holds two tables.  ``counts`` has, for each line key, the exact number
of documents that hold it.  ``filters`` has one cuckoo filter for each shard of the
key space with the keys whose count has reached the threshold.  Cuckoo filters
support deletion, so documents can be inserted and deleted in any order: a batch
changes the counts by +1 or -1 for each (document, key), keys that cross the
threshold upwards are inserted into their shard's filter, those that cross it
downwards are deleted from it.

Dropping lines probes the filters first, which nearly all lines leave at once, and
confirms what passes against the exact counts.  The filters and the frequent keys
are broadcast only while their counted number stays within ``broadcast_keys``;
beyond it, the (document, key) pairs are sent to their shard's filter, in ``SALTS``
parts, those that pass are joined with the counts and the confirmed keys return to
their documents.  Both ways give the same rows.  Shards are split when their keys
have doubled since they were made.

A key is the line without `[\\x20\\x09-\\x0D]` at both ends, A-Z lower-cased; it is held
as its 128-bit XXH3 digest.

Edge cases: a null or empty text is one empty line; empty keys never drop.  Every
row counts as one document, whatever its doc_id, so repeated rows count several
times and null ids do no harm.  Empty tables give empty results.  Only the named
columns are read in ``drop_lines``; ``clean`` keeps all columns of its input.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.shared import broadcast_if_small, column, materialize, sliced, text_bytes

MIN_CHARS = 1
MIN_DOCS = 10
#: Keys in a shard's filter when it is built; it has room for twice as many.
SHARD_KEYS = 1 << 15
#: Frequent keys that are broadcast at most: 16 bytes each and about 4 in the filters.
BROADCAST_KEYS = 1 << 21
#: Parts of a shard's pairs, so that one key that most documents hold is not one task's.
SALTS = 16

_SPACE = b" \t\n\x0b\x0c\r"
_FLUSH = 200_000


def line_key(line: bytes) -> bytes:
    """The key of a line of UTF-8."""
    return line.strip(_SPACE).lower()  # bytes.lower() changes ASCII letters only


def long_enough(key: bytes, min_chars: int) -> bool:
    """Whether a key has ``min_chars`` code points."""
    return len(key) >= min_chars and (min_chars <= 1 or len(key.decode("utf-8", "replace")) >= min_chars)


class CuckooFilter:
    """A cuckoo filter: buckets of four 16-bit fingerprints, two places for each.

    A key comes as 64 bits that are already a hash.  ``rows`` is a power of two.
    """

    SLOTS = 4
    KICKS = 500

    def __init__(self, rows: int, table: np.ndarray | None = None):
        self.rows = rows
        self.table = np.zeros((rows, self.SLOTS), np.uint16) if table is None else table

    @classmethod
    def for_keys(cls, n: int) -> CuckooFilter:
        """With room for twice ``n`` keys at a load that insertion can reach."""
        return cls(1 << max(2, math.ceil(math.log2(max(1, 2 * n) / (cls.SLOTS * 0.9)))))

    def places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprints, never 0, and both buckets of an array of keys."""
        prints = ((keys & np.uint64(0xFFFF)) % np.uint64(0xFFFF) + np.uint64(1)).astype(np.uint16)
        first = ((keys >> np.uint64(16)) & np.uint64(self.rows - 1)).astype(np.int64)
        return prints, first, first ^ self._other(prints)

    def _other(self, prints):
        return ((prints.astype(np.uint64) * np.uint64(0x5BD1E995)) & np.uint64(self.rows - 1)).astype(np.int64)

    def has(self, keys: np.ndarray) -> np.ndarray:
        prints, first, second = self.places(keys)
        p = prints[:, None]
        return (self.table[first] == p).any(1) | (self.table[second] == p).any(1)

    def insert(self, key: int) -> bool:
        """False if there is no room; the filter then has to be rebuilt larger."""
        prints, first, second = self.places(np.array([key], np.uint64))
        p, i = prints[0], int(first[0])
        for row in (i, int(second[0])):
            free = np.flatnonzero(self.table[row] == 0)
            if len(free):
                self.table[row, free[0]] = p
                return True
        for kick in range(self.KICKS):
            slot = (int(p) + kick) % self.SLOTS
            p, self.table[i, slot] = self.table[i, slot], p
            i ^= int(self._other(np.array([p], np.uint16))[0])
            free = np.flatnonzero(self.table[i] == 0)
            if len(free):
                self.table[i, free[0]] = p
                return True
        return False

    def delete(self, key: int) -> bool:
        """Remove one copy of a key that was inserted; False if there is none."""
        prints, first, second = self.places(np.array([key], np.uint64))
        for row in (int(first[0]), int(second[0])):
            at = np.flatnonzero(self.table[row] == prints[0])
            if len(at):
                self.table[row, at[0]] = 0
                return True
        return False

    @classmethod
    def of(cls, keys: np.ndarray) -> CuckooFilter:
        """A filter with all of ``keys``."""
        out = cls.for_keys(len(keys))
        while not all(out.insert(int(k)) for k in keys):
            out = cls(out.rows * 2)
        return out


def _keys_of(texts: list, min_chars: int) -> list[list[tuple[int, int]]]:
    """The distinct keys of each document as two signed 64-bit halves."""
    out = []
    for text in texts:
        keys = {k for line in (text or b"").split(b"\n") if long_enough(k := line_key(line), min_chars)}
        halves = np.frombuffer(b"".join(xxhash.xxh3_128_digest(k) for k in keys), ">i8").reshape(-1, 2)
        out.append([*map(tuple, halves.tolist())])
    return out


def line_counts(docs: DataFrame, text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """(hi, lo, n): how many documents hold each key.  Tasks add up before the shuffle."""

    def count(batches):
        n: Counter = Counter()

        def rows():
            halves = np.array([*n.keys()], np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array([*n.values()], pa.int64())], ["hi", "lo", "n"])

        for batch in sliced(batches):
            for keys in _keys_of(text_bytes(batch.column(0)), min_chars):
                n.update(keys)
                if len(n) > _FLUSH:
                    yield rows()
                    n.clear()
        yield rows()

    return docs.select(column(text_col).alias("text")).mapInArrow(count, "hi long, lo long, n long").groupBy("hi", "lo").agg(F.sum("n").alias("n"))


def _dropper(value: tuple, shards: int, min_chars: int):
    """A function, built in the task, from texts to the lines of each and whether
    they drop."""
    filters, exact = value
    tables = {k: np.frombuffer(v, np.uint16).reshape(-1, CuckooFilter.SLOTS) for k, v in filters.items()}
    tables = {k: CuckooFilter(len(t), t) for k, t in tables.items()}

    def confirmed(hi: int, lo: int) -> bool:
        if isinstance(exact, set):
            return (hi, lo) in exact
        key = np.array([(hi, lo)], exact.dtype)
        at = np.searchsorted(exact, key)[0]
        return at < len(exact) and exact[at] == key[0]

    def drops(texts: list) -> list:
        lines = [(t or b"").split(b"\n") for t in texts]
        keys = [line_key(x) for some in lines for x in some]
        halves = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys)), ">i8").reshape(-1, 2)
        hi, lo = halves[:, 0].astype(np.int64), halves[:, 1].astype(np.int64)
        hit = np.zeros(len(hi), bool)
        shard = hi % shards
        for k, table in tables.items():
            own = np.flatnonzero(shard == k)
            hit[own] = table.has(lo[own].view(np.uint64))
        for i in np.flatnonzero(hit):
            hit[i] = long_enough(keys[i], min_chars) and confirmed(int(hi[i]), int(lo[i]))
        ends = np.cumsum([len(some) for some in lines])
        return [*zip(lines, np.split(hit, ends[:-1]), strict=True)]

    return drops


class LineIndex:
    """Reference counts and filters of a set of documents; see the module."""

    def __init__(self, counts: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, shard_keys: int = SHARD_KEYS, broadcast_keys: int = BROADCAST_KEYS, filters: DataFrame | None = None, shards: int = 1):
        self.counts, self.filters, self.shards, self.shard_keys = counts, filters, shards, shard_keys
        self.min_chars, self.min_docs, self.broadcast_keys = min_chars, min_docs, broadcast_keys

    def _frequent(self) -> DataFrame:
        return self.counts.where(F.col("n") >= self.min_docs).select("hi", "lo")

    def _from_counts(self) -> LineIndex:
        """The same index with new filters, for as many shards as its keys need now."""
        frequent = self._frequent()
        self.shards = max(1, math.ceil(frequent.count() / self.shard_keys))
        self.filters = frequent.limit(0).select(F.lit(0).alias("shard"), F.lit(b"").alias("filter"))
        self.filters = materialize(self._changed(frequent.withColumn("step", F.lit(1))), "line-filters")
        return self

    @classmethod
    def build(cls, docs: DataFrame, *, text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, shard_keys: int = SHARD_KEYS, broadcast_keys: int = BROADCAST_KEYS) -> LineIndex:
        """Index all of ``docs``."""
        counts = materialize(line_counts(docs, text_col, min_chars), "line-counts")
        return cls(counts, min_chars, min_docs, shard_keys, broadcast_keys)._from_counts()

    def insert(self, docs: DataFrame, text_col: str = "text") -> LineIndex:
        """The index with ``docs`` added."""
        return self._updated(line_counts(docs, text_col, self.min_chars), 1)

    def delete(self, docs: DataFrame, text_col: str = "text") -> LineIndex:
        """The index without ``docs``, which must have been inserted before."""
        return self._updated(line_counts(docs, text_col, self.min_chars), -1)

    def _updated(self, change: DataFrame, sign: int) -> LineIndex:
        old = self.counts.select("hi", "lo", F.col("n").alias("was"), F.lit(0).cast("long").alias("d"))
        new = change.select("hi", "lo", F.lit(0).cast("long").alias("was"), (F.col("n") * sign).alias("d"))
        both = materialize(old.unionByName(new).groupBy("hi", "lo").agg(F.sum("was").alias("was"), (F.sum("was") + F.sum("d")).alias("n")), "line-counts")
        step = F.when((F.col("was") < self.min_docs) & (F.col("n") >= self.min_docs), 1).when((F.col("was") >= self.min_docs) & (F.col("n") < self.min_docs), -1)
        crossed = both.select("hi", "lo", step.alias("step")).where("step is not null")
        counts = both.where("n > 0").select("hi", "lo", "n")
        out = LineIndex(counts, self.min_chars, self.min_docs, self.shard_keys, self.broadcast_keys, self.filters, self.shards)
        if out._frequent().count() > 2 * self.shards * self.shard_keys:
            return out._from_counts()
        out.filters = materialize(out._changed(crossed), "line-filters")
        return out

    def _changed(self, crossed: DataFrame) -> DataFrame:
        """The filters after the insertions (step 1) and deletions (step -1) of keys.

        A shard's keys are the share of a hash, so no shard is large.  A filter that
        has no room left is rebuilt from its shard of the exact counts.
        """
        shards, min_docs = self.shards, self.min_docs
        shard = F.pmod(F.col("hi"), F.lit(shards)).cast("int").alias("shard")
        rows = crossed.select(shard, "lo", "step", F.lit(None).cast("binary").alias("filter"))
        rows = rows.unionByName(self.filters.select("shard", F.lit(0).cast("long").alias("lo"), F.lit(0).alias("step"), "filter"))

        def change(group: pa.Table) -> pa.Table:
            lo, step = group.column("lo").to_numpy(), group.column("step").to_numpy()
            had = [x for x in group.column("filter").to_pylist() if x is not None]
            keys = lo[step != 0].astype(np.int64).view(np.uint64)
            step = step[step != 0]
            if had:
                table = np.frombuffer(had[0], np.uint16).reshape(-1, CuckooFilter.SLOTS).copy()
                out = CuckooFilter(len(table), table)
                for k in keys[step < 0]:
                    out.delete(int(k))
                full = not all([out.insert(int(k)) for k in keys[step > 0]])
            else:
                out, full = CuckooFilter.of(keys[step > 0]), False
            return pa.table({"shard": pa.array([group.column("shard")[0].as_py()], pa.int32()), "filter": pa.array([out.table.tobytes()], pa.binary()), "full": pa.array([full])})

        new = materialize(rows.groupBy("shard").applyInArrow(change, "shard int, filter binary, full boolean"), "line-filters")
        if not new.where("full").limit(1).count():
            return new.drop("full")
        again = self.counts.where(F.col("n") >= min_docs).select(shard, "lo", F.lit(1).alias("step"), F.lit(None).cast("binary").alias("filter"))
        again = again.join(broadcast_if_small(new.where("full").select("shard"), shards), "shard", "left_semi")
        rebuilt = again.groupBy("shard").applyInArrow(change, "shard int, filter binary, full boolean")
        return new.where("not full").unionByName(rebuilt).drop("full")

    def _probe(self):
        """Broadcasts of the filters and, in order, of the frequent keys; None if they
        are more than the bound."""
        frequent = self._frequent()
        if frequent.count() > self.broadcast_keys:
            return None
        got = frequent.toArrow()
        keys = np.empty(got.num_rows, [("hi", np.int64), ("lo", np.int64)])
        keys["hi"], keys["lo"] = got.column("hi").to_numpy(), got.column("lo").to_numpy()
        filters = {r["shard"]: bytes(r["filter"]) for r in self.filters.toLocalIterator()}
        return self.counts.sparkSession.sparkContext.broadcast((filters, {*map(tuple, keys.tolist())} if len(keys) <= 4096 else np.sort(keys)))

    def _marked(self, docs: DataFrame, text_col: str) -> DataFrame:
        """The documents with ``__drop``, the keys that drop, by shuffles; for more
        frequent keys than are broadcast."""
        rows = docs.withColumns({"__text": F.coalesce(F.col(text_col), F.lit("")), "__t": F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))})
        min_chars = self.min_chars

        def pairs(batches):
            for batch in sliced(batches):
                keys = _keys_of(text_bytes(batch.column("__text")), min_chars)
                at = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
                halves = np.array([x for k in keys for x in k], np.int64).reshape(-1, 2)
                own = [batch.column(c).take(pa.array(at)) for c in ("__t", "__n")]
                yield pa.RecordBatch.from_arrays([*own, pa.array(halves[:, 0]), pa.array(halves[:, 1])], ["__t", "__n", "hi", "lo"])

        rows = rows.withColumn("__n", F.octet_length("__text"))
        # every document with the same text has the same keys
        held = rows.select("__t", "__n", "__text").mapInArrow(pairs, "__t long, __n int, hi long, lo long").distinct()
        maybe = self._passing(materialize(held, "line-pairs"))
        sure = materialize(materialize(maybe, "line-maybe").join(self._frequent(), ["hi", "lo"]), "line-sure")
        per_text = sure.groupBy("__t", "__n").agg(F.collect_list(F.struct("hi", "lo")).alias("__drop"))
        return rows.join(per_text, ["__t", "__n"], "left").drop("__t", "__n")

    def _passing(self, pairs: DataFrame) -> DataFrame:
        """The pairs (__t, __n, hi, lo) whose key passes its shard's filter.

        Each part of a shard gets the filter first and then its pairs, one after another, so
        a task holds one filter and one batch.
        """
        shard = F.pmod(F.col("hi"), F.lit(self.shards)).cast("int").alias("shard")
        filters = self.filters.select("shard", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), F.lit(None).cast("long").alias("__t"), F.lit(None).cast("int").alias("__n"), F.lit(None).cast("long").alias("hi"), F.lit(None).cast("long").alias("lo"), "filter")
        salted = pairs.select(shard, F.pmod(F.col("__t"), F.lit(SALTS)).cast("int").alias("salt"), "__t", "__n", "hi", "lo", F.lit(None).cast("binary").alias("filter"))
        rows = filters.unionByName(salted).repartition("shard", "salt").sortWithinPartitions("shard", "salt", F.col("filter").isNull())

        def probe(batches):
            at, table = None, None
            for batch in sliced(batches, rows=5000):
                part = batch.column("shard").to_numpy().astype(np.int64) * SALTS + batch.column("salt").to_numpy()
                given = batch.column("filter")
                cuts = sorted({0, len(part), *(np.flatnonzero(np.diff(part)) + 1).tolist()})
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    if part[a] != at:
                        at, table = part[a], None
                    if given[a].is_valid:
                        data = np.frombuffer(given[a].as_py(), np.uint16).reshape(-1, CuckooFilter.SLOTS)
                        table, a = CuckooFilter(len(data), data), a + 1
                    if table is not None and a < b:
                        some = batch.slice(a, b - a).select(["__t", "__n", "hi", "lo"])
                        yield some.filter(pa.array(table.has(some.column("lo").to_numpy().view(np.uint64))))

        return rows.mapInArrow(probe, "__t long, __n int, hi long, lo long")

    def drop_lines(self, docs: DataFrame, *, text_col: str = "text", keep_columns: list[str] | None = None) -> DataFrame:
        """Each document's ``keep_columns`` with n_lines, n_dropped and kept (the
        lines that stay, joined by newlines)."""
        keep = keep_columns or []
        out = self._dropped(docs, text_col, keep)
        return out.toDF(*keep, "n_lines", "n_dropped", "kept")

    def _dropped(self, docs: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
        """The columns of ``drop_lines``, by place: the names may clash."""
        rows = docs.select(*[column(c).alias(f"__k{i}") for i, c in enumerate(keep)], column(text_col).alias("__text"))
        probe, shards, min_chars = self._probe(), self.shards, self.min_chars
        if probe is None:
            rows = self._marked(rows, "__text")

        def split(batches):
            drops = None if probe is None else _dropper(probe.value, shards, min_chars)
            for batch in sliced(batches, of="__text"):
                texts = text_bytes(batch.column("__text"))
                if drops is not None:
                    found = drops(texts)
                else:
                    found = []
                    for text, keys in zip(texts, batch.column("__drop").to_pylist(), strict=True):
                        sure = {(x["hi"], x["lo"]) for x in keys or ()}
                        lines = (text or b"").split(b"\n")
                        found.append((lines, np.array([long_enough(k := line_key(x), min_chars) and tuple(np.frombuffer(xxhash.xxh3_128_digest(k), ">i8").tolist()) in sure for x in lines], bool)))
                kept = [b"\n".join(x for x, gone in zip(lines, hit, strict=True) if not gone) if hit.any() else text or b"" for text, (lines, hit) in zip(texts, found, strict=True)]
                own = [batch.column(f"__k{i}") for i in range(len(keep))]
                n = [pa.array([len(lines) for lines, _ in found], pa.int64()), pa.array([int(hit.sum()) for _, hit in found], pa.int64())]
                yield pa.RecordBatch.from_arrays([*own, *n, pa.array(kept, pa.binary()).cast(pa.string())], [*[f"__k{i}" for i in range(len(keep))], "n_lines", "n_dropped", "kept"])

        kinds = ", ".join([*[f"__k{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)], "n_lines long, n_dropped long, kept string"])
        return rows.mapInArrow(split, kinds)


def digest(dropped: DataFrame) -> DataFrame:
    """The contract's columns from those of ``drop_lines``."""
    return dropped.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def clean(docs: DataFrame, *, text_col: str = "text", n_chars_col: str | None = "n_chars", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """All documents and columns, without the repeated lines in their texts."""
    index = LineIndex.build(docs, text_col=text_col, min_chars=min_chars, min_docs=min_docs)
    others = [c for c in docs.columns if c != text_col]
    out = index._dropped(docs, text_col, others)
    at = {c: F.col(f"__k{i}") for i, c in enumerate(others)} | {text_col: F.col("kept")}
    if n_chars_col in others:
        at[n_chars_col] = F.length("kept").cast(docs.schema[n_chars_col].dataType)
    return out.select(*[at[c].alias(c) for c in docs.columns])


def brute_force(texts: list, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> list[tuple[int, int, str]]:
    """(n_lines, n_dropped, hash of what stays) of each text; for tests."""
    lines = [(t or "").encode().split(b"\n") for t in texts]
    n = Counter(k for some in lines for k in {line_key(x) for x in some})
    out = []
    for some in lines:
        kept = [x for x in some if n[k := line_key(x)] < min_docs or len(k.decode()) < min_chars]
        out.append((len(some), len(some) - len(kept), hashlib.sha256(b"\n".join(kept)).hexdigest()))
    return out
