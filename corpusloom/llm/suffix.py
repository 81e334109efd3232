"""Repeated byte strings by a depth-limited radix sort of suffixes.

All suffixes that have at least ``threshold`` bytes are ordered through their first
``threshold`` bytes only; what is equal there is a repeated window, and every byte that a
repeated window covers goes.  Passes go from the most significant digit on, and only groups
of two or more stay between them:

1. The first digit of a suffix is the gram at its anchor: of the ``GRAM``-byte grams in its
   window, the one with the smallest hash (the first of equals), with its distance.
   Neighbouring suffixes mostly share their anchor, so a run of about 170 suffixes is one
   thin row: the gram's hash, a digest of the run's bytes, the document, the place.  A gram
   that occurs once ends there.
2. Runs with the same gram and the same digest are equal as a whole (128 bits of hash): all
   their suffixes repeat, which settles copies and the inside of shared passages.
3. Where one gram has different runs, and not all of them are settled, one run of each digest
   goes on with its bytes.  Groups of up to ``GROUP`` runs meet in a task, where their
   suffixes are sorted by successive blocks of ``BLOCK`` bytes from their first byte on; after
   each pass the suffixes that are alone in their group leave.  What is left at the depth of
   the threshold is confirmed byte by byte.
4. Larger groups are first cut over tasks: the run is divided into ``FANOUT`` parts by the
   distance of the anchor, and the next digit is the hash of the bytes that all windows of a
   part have in common.  Each pass makes the common part longer, up to the whole window.

Scale: equal runs that a task sees together are combined before the shuffle, so a passage that
a third of the documents share arrives as few rows; rows are thin, grams with more than
``GROUP`` rows are spread over tasks by gram and digest, and no step collects a larger group.
Texts are shuffled twice, by document: once to their open runs, once to put the result
together; copies of one text do not meet.

Edge cases: a null or empty text, or one under ``threshold`` bytes, keeps all bytes.
A document is known by 128 bits of hash of its id and text, so repeated rows and null ids are
fine: rows that are equal in both have the same bytes, and they repeat each other whole.
Empty tables give empty results.  Only the named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.shared import broadcast_if_small, column, materialize, sliced, temporary, text_bytes

THRESHOLD = 400
GRAM = 64
#: Bytes of a digit of the passes within a task.
BLOCK = 64
#: Runs of one digit that one task compares at once.
GROUP = 1000
FANOUT = 8
#: Bytes of text that are hashed at once; places within it fit ``_PLACE`` bits.
CHUNK = 1 << 17
_PLACE = 18
_PIECE = (1 << _PLACE) - (1 << 16)
#: Runs that a task holds to combine equal ones.
_HELD = 200_000

#: Odd multipliers of the hashes, any would do.
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
_BASE = 0x9E3779B97F4A7C15


def gram_of(threshold: int) -> int:
    """Bytes of a gram: 64, less for small thresholds; a multiple of 8."""
    return GRAM if threshold >= 4 * GRAM else max(8, threshold // 32 * 8)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX[1]
    x = (x ^ (x >> np.uint64(29))) * _MIX[2]
    return x ^ (x >> np.uint64(32))


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of the ``gram`` bytes at every place of ``data`` (uint8)."""
    words = np.ndarray((len(data) - 7,), "<u8", data.tobytes(), strides=(1,)).copy()
    n = len(data) - gram + 1
    out = np.zeros(n, np.uint64)
    for k in range(gram // 8):
        out += words[8 * k : 8 * k + n] * (_mixed(_MIX[:1] * np.uint64(k + 1))[0] | np.uint64(1))
    return _mixed(out)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each ``width`` neighbours."""
    n = len(x) - width + 1
    rows = np.full(-(-len(x) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    rows[: len(x)] = x
    blocks = rows.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.ascontiguousarray(np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1]).ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def runs(pieces: list[bytes], threshold: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of neighbouring windows with a common minimizer in each of ``pieces``.

    Returns arrays: piece, place of the minimizer in it, lowest and highest offset of the
    minimizer in the run's windows, and the minimizer's hash.
    """
    data = np.frombuffer(b"".join(pieces), np.uint8)
    sizes = np.array([len(p) for p in pieces], np.int64)
    begins = np.cumsum(sizes) - sizes
    hashes = gram_hashes(data, gram)
    low = np.uint64((1 << _PLACE) - 1)
    tagged = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
    least = _sliding_min(tagged, threshold - gram + 1)
    inside = np.zeros(len(least) + 1, np.int8)
    long = sizes >= threshold
    np.add.at(inside, begins[long], 1)
    np.add.at(inside, begins[long] + sizes[long] - threshold + 1, -1)
    at = np.flatnonzero(np.cumsum(inside[:-1]))
    first = np.ones(len(at), bool)
    first[1:] = (np.diff(at) != 1) | (least[at[1:]] != least[at[:-1]])
    starts = np.flatnonzero(first)
    ends = np.append(starts[1:], len(at)) - 1
    s, e = at[starts], at[ends]
    place = (least[s] & low).astype(np.int64)
    piece = np.searchsorted(begins, s, "right") - 1
    return piece, place - begins[piece], place - e, place - s, hashes[place]


def _pack(place: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    return (place.astype(np.int64) << 32) | (lo.astype(np.int64) << 16) | hi.astype(np.int64)


def _first_rows(threshold: int, gram: int):
    """The function that makes the rows of the first digit from (text, rid, alt)."""

    def chunks(texts):
        """Lists of (row, offset, piece) of about ``CHUNK`` bytes."""
        some, total = [], 0
        for row, text in enumerate(texts):
            for at in range(0, len(text) - threshold + 1, _PIECE):
                piece = text[at : at + _PIECE + threshold - 1]
                if some and total + len(piece) > CHUNK:
                    yield some
                    some, total = [], 0
                some.append((row, at, piece))
                total += len(piece)
        if some:
            yield some

    digest = xxhash.xxh3_64_intdigest

    def of_chunk(some, rids, alts):
        own = [p for *_, p in some]
        piece, place, lo, hi, key = runs(own, threshold, gram)
        left, right = (place - hi).tolist(), (place - lo + threshold).tolist()
        seeds = (lo * 65536 + hi).tolist()
        span = np.array([digest(own[k][a:b], seed) for k, a, b, seed in zip(piece.tolist(), left, right, seeds, strict=True)], np.uint64)
        row = np.array([r for r, *_ in some], np.int64)[piece]
        offset = np.array([o for _, o, _ in some], np.int64)[piece]
        return key, span, rids[row], alts[row], _pack(place + offset, lo, hi)

    def combined(parts):
        """Equal runs are settled at once, and one of them stands for them."""
        key, span, rid, alt, pos = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((span, key))
        k, s = key[order], span[order]
        same = (k[1:] == k[:-1]) & (s[1:] == s[:-1])
        again, twice = np.zeros(len(k), bool), np.zeros(len(k), bool)
        again[1:] = same
        twice[1:] |= same
        twice[:-1] |= same
        k = np.where(again, _mixed(k ^ _mixed(np.arange(len(k), dtype=np.uint64) + np.uint64(1)) ^ rid[order].view(np.uint64)), k)
        return pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(s.view(np.int64)), pa.array(rid[order]), pa.array(alt[order]), pa.array(pos[order]), pa.array(twice)], ["key", "span", "rid", "alt", "pos", "done"])

    def make(batches):
        parts, held = [], 0
        for batch in sliced(batches, of="text"):
            rids, alts = batch.column("rid").to_numpy(), batch.column("alt").to_numpy()
            for some in chunks(text_bytes(batch.column("text"))):
                parts.append(of_chunk(some, rids, alts))
                held += len(parts[-1][0])
                if held > _HELD:
                    yield combined(parts)
                    parts, held = [], 0
        if parts:
            yield combined(parts)

    return make


_ROW = "key long, span long, rid long, alt long, pos long, done boolean"


def _sorted_out(rows: DataFrame, more: list[str], hot: int = GROUP) -> DataFrame:
    """What is settled or goes on after a digit.

    Adds ``settled`` (the run's windows repeat), ``onward`` (it goes to the next digit) and
    ``members``, the number of different runs with its digit.  A digit of which all runs are
    settled does not go on.  Digits with more than ``hot``
    rows are not brought together in one task: their runs are grouped by digit and digest, and
    only the numbers of those groups meet.
    """
    rows = materialize(rows, "suffix-rows")
    often = materialize(rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("key"), "suffix-hot")
    n = often.count()
    keep = ["key", "span", "rid", "alt", "pos", "settled", "onward", "members", *more]
    by_span = Window.partitionBy("key", "span").orderBy("rid", "pos")
    every = by_span.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_key = Window.partitionBy("key")
    few = rows.join(broadcast_if_small(often, n), "key", "left_anti") if n else rows
    few = few.repartition("key").withColumns({"n": F.count("*").over(every), "at": F.row_number().over(by_span)})
    few = few.withColumn("settled", F.col("done") | (F.col("n") > 1))
    few = few.withColumns({"members": F.sum(F.when(F.col("at") == 1, 1).otherwise(0)).over(by_key), "undone": F.max(~F.col("settled")).over(by_key)})
    few = few.withColumn("onward", F.col("undone") & (F.col("members") > 1) & (F.col("at") == 1)).where("settled or onward").select(*keep)
    if not n:
        return few
    many = rows.join(broadcast_if_small(often, n), "key", "left_semi")
    spans = many.groupBy(F.col("key").alias("k"), F.col("span").alias("s")).agg(F.count("*").alias("n"), F.max("done").alias("any"), F.min(F.struct("rid", "pos")).alias("first"))
    digits = spans.groupBy(F.col("k").alias("d")).agg(F.count("*").alias("members"), F.max((F.col("n") == 1) & ~F.col("any")).alias("undone"))
    spans = materialize(spans.join(broadcast_if_small(digits, n), F.col("k") == F.col("d")).drop("d"), "suffix-spans")
    both = many.join(spans, (F.col("key") == F.col("k")) & (F.col("span") == F.col("s")))
    first = (F.col("rid") == F.col("first.rid")) & (F.col("pos") == F.col("first.pos"))
    both = both.withColumns({"settled": F.col("done") | (F.col("n") > 1), "onward": F.col("undone") & (F.col("members") > 1) & first})
    return few.unionByName(both.where("settled or onward").select(*keep))


def _cut(text: bytes, pos: int, threshold: int) -> bytes:
    place, lo, hi = pos >> 32, (pos >> 16) & 0xFFFF, pos & 0xFFFF
    return text[place - hi : place - lo + threshold]


def _with_bytes(open_runs: DataFrame, texts: DataFrame, threshold: int) -> DataFrame:
    """Adds ``seg``, the run's bytes, from the texts of the documents that have open runs.

    Of rows that are equal in id and text one stands for all: they have the same runs, and that
    they repeat each other is settled before."""
    kind = _ROW + ", members long, seg binary"
    names = ["key", "span", "rid", "alt", "pos", "done", "members", "seg"]
    types = {"done": pa.bool_(), "seg": pa.binary()}

    def cut(batches):
        for batch in sliced(batches, rows=64, of="text"):
            out = {c: [] for c in names}
            for text, rid, alt, some in zip(text_bytes(batch.column("text")), batch.column("rid").to_pylist(), batch.column("alt").to_pylist(), batch.column("runs").to_pylist(), strict=True):
                for x in some:
                    own = {**x, "rid": rid, "alt": alt, "seg": _cut(text, x["pos"], threshold)}
                    for c in names:
                        out[c].append(own[c])
            yield pa.RecordBatch.from_arrays([pa.array(v, types.get(c, pa.int64())) for c, v in out.items()], names)

    per = open_runs.groupBy(F.col("rid").alias("r"), F.col("alt").alias("a")).agg(F.collect_list(F.struct("key", "span", "pos", F.col("settled").alias("done"), "members")).alias("runs"))
    rows = texts.join(per, (F.col("rid") == F.col("r")) & (F.col("alt") == F.col("a")))
    return rows.select("text", "rid", "alt", "runs").dropDuplicates(["rid", "alt"]).mapInArrow(cut, kind)


def _children(threshold: int, gram: int, width: int):
    """The function that cuts open runs into parts of ``width`` offsets."""
    last = threshold - gram
    h = xxhash.xxh3_64_intdigest

    def make(batches):
        for batch in sliced(batches):
            out = {c: [] for c in ("key", "span", "rid", "alt", "pos", "done", "seg")}
            for rid, alt, pos, done, seg in zip(*[batch.column(c).to_pylist() for c in ("rid", "alt", "pos", "done", "seg")], strict=True):
                place, lo, hi = pos >> 32, (pos >> 16) & 0xFFFF, pos & 0xFFFF
                for k in range(lo // width, hi // width + 1):
                    a, b = k * width, min((k + 1) * width - 1, last)  # the part's offsets
                    x, y = max(a, lo), min(b, hi)  # those the run has
                    own = seg[hi - y : hi - x + threshold]
                    common = seg[hi - a if hi >= a else 0 : hi - b + threshold]
                    out["key"].append(h(common, (k << 16) + width) - (1 << 63))
                    out["span"].append(h(own, x * 65536 + y) - (1 << 63))
                    out["rid"].append(rid)
                    out["alt"].append(alt)
                    out["pos"].append((place << 32) | (x << 16) | y)
                    out["done"].append(done)
                    out["seg"].append(own)
            types = {"done": pa.bool_(), "seg": pa.binary()}
            yield pa.RecordBatch.from_arrays([pa.array(v, types.get(c, pa.int64())) for c, v in out.items()], [*out])

    return make


_POWERS: dict = {}


def _powers(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of an odd base and of its inverse, modulo 2 ** 64."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        have = _POWERS[base] = tuple(both)
    return have[0][:n], have[1][:n]


def block_hashes(data: np.ndarray) -> Callable[[np.ndarray, int], np.ndarray]:
    """A function of places and a length: 64-bit hashes of so many bytes at each place."""
    up, down = _powers(len(data) + 1, _BASE)
    table = _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(table[data] * up[: len(data)], out=sums[1:])
    return lambda at, length: _mixed((sums[at + length] - sums[at]) * down[at])


def sorted_groups(data: np.ndarray, place: np.ndarray, group: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes of ``data`` at ``place`` that are equal to another one of their group
    through ``depth`` bytes: their rows and a number for each class of equal ones, in order.

    Passes over successive blocks of bytes, most significant first.  After each the suffixes
    that are alone leave.  The digits are hashes of the blocks; at the end each suffix is
    compared with the first of its class byte by byte, eight at a time.
    """
    block = block_hashes(data)
    rows = np.arange(len(place))
    for at in range(0, depth, BLOCK):
        digit = block(place[rows] + at, min(BLOCK, depth - at))
        key = _mixed(digit + _mixed(group.astype(np.uint64) + np.uint64(1)))
        order = np.argsort(key, kind="stable")
        k = key[order]
        new = np.ones(len(k) + 1, bool)
        new[1:-1] = k[1:] != k[:-1]
        many = ~(new[:-1] & new[1:])
        rows, group = rows[order[many]], np.cumsum(new[:-1])[many]
        if not len(rows):
            return rows, group
    words = np.ndarray((len(data) - 7,), "<u8", data.tobytes(), strides=(1,)) if depth >= 8 else data
    first = np.ones(len(group), bool)
    first[1:] = group[1:] != group[:-1]
    mine, others = place[rows], place[rows[np.flatnonzero(first)[np.cumsum(first) - 1]]]
    step = 8 if depth >= 8 else 1
    same = np.ones(len(rows), bool)
    for at in [*range(0, depth - step, step), depth - step]:
        same &= words[mine + at] == words[others + at]
    if not same.all():  # two classes with equal hashes: take those apart by their bytes
        for g in np.unique(group[~same]):
            own, seen = np.flatnonzero(group == g), {}
            for i in own:
                group[i] = -1 - seen.setdefault(data[mine[i] : mine[i] + depth].tobytes(), rows[i])
        order = np.argsort(group, kind="stable")
        rows, group = rows[order], group[order]
        new = np.ones(len(group) + 1, bool)
        new[1:-1] = group[1:] != group[:-1]
        many = ~(new[:-1] & new[1:])
        rows, group = rows[many], group[many]
    return rows, group


def _compared(group: np.ndarray, pos: np.ndarray, segs: list[bytes], threshold: int) -> tuple[np.ndarray, ...]:
    """Runs of windows that repeat within their group: (row, lowest, highest offset)."""
    data = np.frombuffer(b"".join(segs), np.uint8)
    sizes = np.array([len(s) for s in segs], np.int64)
    begins = np.cumsum(sizes) - sizes
    counts = sizes - threshold + 1
    row = np.repeat(np.arange(len(segs), dtype=np.int32), counts)
    step = (np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)).astype(np.int32)
    offset = ((pos & 0xFFFF).astype(np.int32))[row] - step
    # suffixes with one gram at one distance start in one group
    at, _ = sorted_groups(data, begins[row] + step, group.astype(np.int64)[row] * 65536 + offset, threshold)
    if not len(at):
        none = np.empty(0, np.int64)
        return none, none, none
    at.sort()
    first = np.ones(len(at), bool)
    first[1:] = (np.diff(at) != 1) | (row[at[1:]] != row[at[:-1]])
    s = np.flatnonzero(first)
    e = np.append(s[1:], len(at)) - 1
    return row[at[s]], offset[at[e]], offset[at[s]]


def _compare(threshold: int):
    """The function that settles whole groups; its rows come sorted by key."""
    names = ("key", "rid", "alt", "pos", "done", "seg")

    def settle(keys, rids, alts, pos, done, segs):
        pos = np.array(pos, np.int64)
        _, group = np.unique(np.array(keys, np.int64), return_inverse=True)
        row, lo, hi = _compared(group, pos, segs, threshold)
        use = ~np.array(done, bool)[row]
        row, lo, hi = row[use], lo[use], hi[use]
        return pa.RecordBatch.from_arrays([pa.array(np.array(rids, np.int64)[row]), pa.array(np.array(alts, np.int64)[row]), pa.array(_pack(pos[row] >> 32, lo, hi))], ["rid", "alt", "pos"])

    def make(batches):
        held, total = [[] for _ in names], 0
        for batch in sliced(batches):
            for x in zip(*[batch.column(c).to_pylist() for c in names], strict=True):
                if total > CHUNK and x[0] != held[0][-1]:
                    yield settle(*held)
                    held, total = [[] for _ in names], 0
                for own, v in zip(held, x, strict=True):
                    own.append(v)
                total += len(x[-1])
        if total:
            yield settle(*held)

    return make


def repeated_runs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD, group: int = GROUP) -> DataFrame:
    """(rid, alt, pos) of runs of repeated windows; several may overlap.

    ``rid`` and ``alt`` name the document (``_named``); ``pos`` packs a place and the offsets
    before it at which the windows start.
    """
    gram = gram_of(threshold)
    texts = _named(docs, id_col, text_col).where(F.octet_length("text") >= threshold)
    first = texts.mapInArrow(_first_rows(threshold, gram), _ROW)
    level = materialize(_sorted_out(first, [], group), "suffix-1")
    settled = [level.where("settled").select("rid", "alt", "pos")]
    opened = level.where("onward").select("key", "span", "rid", "alt", "pos", "settled", "members")
    runs_ = materialize(_with_bytes(opened, texts, threshold), "suffix-open")
    width = threshold - gram + 1
    while True:
        small = runs_.where(F.col("members") <= group).repartition("key").sortWithinPartitions("key")
        settled.append(materialize(small.mapInArrow(_compare(threshold), "rid long, alt long, pos long"), "suffix-small"))
        large = runs_.where(F.col("members") > group)
        if width == 1 or not large.limit(1).count():
            break
        width = -(-width // FANOUT)
        rows = large.drop("members").mapInArrow(_children(threshold, gram, width), _ROW + ", seg binary")
        level = materialize(_sorted_out(rows, ["seg"], group), "suffix-next")
        settled.append(level.where("settled").select("rid", "alt", "pos"))
        runs_ = level.where("onward").select("key", "span", "rid", "alt", "pos", F.col("settled").alias("done"), "members", "seg")
    out = settled[0]
    for more in settled[1:]:
        out = out.unionByName(more)
    return out


def _named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text, rid, alt): the text, empty for null, and two hashes of id and text."""
    text = F.coalesce(column(text_col), F.lit(""))
    named = docs.select(column(id_col).alias("doc_id"), text.alias("text"))
    return named.withColumns({"rid": F.xxhash64("doc_id", "text"), "alt": F.xxhash64(F.lit(1), "text", "doc_id")})


def spans_of(packed: list[int], threshold: int) -> list[tuple[int, int]]:
    """Disjoint [start, end) byte spans, maximal, that the runs' windows cover."""
    out: list[list[int]] = []
    for a, b in sorted(((p >> 32) - (p & 0xFFFF), (p >> 32) - ((p >> 16) & 0xFFFF) + threshold) for p in packed):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD, group: int = GROUP) -> DataFrame:
    """doc_id, n_bytes, spans (removed [start, end) bytes) and kept (the bytes left)."""
    with temporary(docs.sparkSession):
        found = repeated_runs(docs, id_col=id_col, text_col=text_col, threshold=threshold, group=group)
        per = found.groupBy(F.col("rid").alias("r"), F.col("alt").alias("a")).agg(F.collect_set("pos").alias("runs"))
        per = materialize(per, "suffix-runs", keep=True)
    rows = _named(docs, id_col, text_col)
    rows = rows.join(per, (F.col("rid") == F.col("r")) & (F.col("alt") == F.col("a")), "left").select("doc_id", "text", "runs")
    kind = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, spans array<struct<start:long,end:long>>, kept binary"

    def remove(batches):
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in sliced(batches, of="text"):
            n, spans, kept = [], [], []
            for data, packed in zip(text_bytes(batch.column("text")), batch.column("runs").to_pylist(), strict=True):
                gone = spans_of(packed or [], threshold)
                n.append(len(data))
                spans.append([{"start": a, "end": b} for a, b in gone])
                edges = [0, *[x for ab in gone for x in ab], len(data)]
                kept.append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])

    return rows.mapInArrow(remove, kind)


def digest(removed: DataFrame) -> DataFrame:
    """The contract's columns from those of ``remove_repeats``."""
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + x["end"] - x["start"])
    return removed.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(texts: list, threshold: int = THRESHOLD) -> list[tuple[int, int, int, str]]:
    """(n_bytes, n_removed, n_spans, hash of what stays) from all windows; for tests."""
    data = [(t or "").encode() for t in texts]
    seen: dict[bytes, int] = {}
    for d in data:
        for i in range(len(d) - threshold + 1):
            w = d[i : i + threshold]
            seen[w] = seen.get(w, 0) + 1
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - threshold + 1):
            if seen[d[i : i + threshold]] > 1:
                gone[i : i + threshold] = b"\x01" * threshold
        kept = bytes(b for b, g in zip(d, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out
