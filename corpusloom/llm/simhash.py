"""SimHash near-dedup by meet-in-the-middle ball hashing.

Two fingerprints within 4 bits of each other have a common variant within 2 bits of both.
So every distinct fingerprint emits all its variants within 2 bits (1 + 64 + 2016), equal
variants meet, and the fingerprints that meet are linked.  Two fingerprints that share a
variant differ in at most 2 + 2 bits, so each meeting is a link; the task that finds them
still verifies it bit by bit.

The shuffle on variants is by the variant's first bits (the prefix).  A fingerprint has
variants under 1 + p + p(p-1)/2 prefixes of p bits; it is sent once to each of them and its
variants under that prefix are made there, so 2081 variants cost a few dozen thin rows and
not 2081.  The prefix is lengthened until no prefix has more than ``PREFIX_ROWS`` rows to
expect, using the bits that split the fingerprints best.  Inside a task the variants of a
prefix are made in slices of at most about ``SLICE``, by halving at the next bits, so that each
variant is made once however many fingerprints a prefix has, and sorted; equal neighbours are
deduplicated to one link from each fingerprint to the smallest it meets.

Components of the links and the smallest document of each are found by joins of thin tables
(distributed stars, see ``components``).  Fingerprints are deduplicated first, so thousands
of exact copies are one fingerprint.

Edge cases: a null, empty or wordless text has fingerprint zero and is linked like any
other; a text of fewer words than the shingle is one shingle of all of them.  Null doc_ids
belong to their fingerprint's component but are never its id (a component of null ids only
has a null id).  Repeated rows stay rows.  Empty tables give empty results.  Only the named
columns are read in ``near_duplicates``; ``keep_one`` keeps all columns.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.components import connected_components
from corpusloom.llm.shared import broadcast_if_small, column, materialize, sliced, temporary, text_bytes

SHINGLE = 4
RADIUS = 4
SEED = 42
#: Bits of the shortest prefix.
PREFIX_BITS = 8
#: Fingerprints under one prefix that are expected at most, which more bits, up to
#: ``MOST_BITS``, see to.
PREFIX_ROWS, MOST_BITS = 60_000, 40
#: Variants that a task sorts at once, about.
SLICE = 1 << 22
#: Rows that a task of the meeting gets, about.
_ROWS = 50_000
#: Shingles whose bits are added up at once.
_CHUNK = 1 << 14

_ONE = np.uint64(1)


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of a text; a bit is set if it is in over half the hashes."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(shingle, len(words))
    h = xxhash.xxh64_digest
    n = len(words) - k + 1
    votes = np.zeros(64, np.int64)
    starts, ends = starts[:n].tolist(), ends[k - 1 :].tolist()
    for at in range(0, n, _CHUNK):
        data = b"".join([h(joined[a:b], SEED) for a, b in zip(starts[at : at + _CHUNK], ends[at : at + _CHUNK], strict=True)])
        bits = np.unpackbits(np.frombuffer(data, np.uint8)).reshape(-1, 64)
        # sums of at most 255 rows fit a byte, which adds fastest
        full = len(bits) // 255 * 255
        if full:
            votes += np.add.reduce(bits[:full].reshape(-1, 255, 64), axis=1, dtype=np.uint8).sum(0, dtype=np.int64)
        votes += bits[full:].sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp: the fingerprint's bits as a signed long) of every document."""

    def run(batches):
        for batch in sliced(batches):
            fps = np.array([fingerprint(t, shingle) for t in text_bytes(batch.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    rows = docs.select(column(id_col).alias("doc_id"), column(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, fp long")


def _order(fps: DataFrame) -> tuple[list[int], int]:
    """Bit positions from the one that splits the fingerprints best, and their number.
    Aggregates only: 64 sums come to the driver."""
    sums = fps.agg(F.count("*").alias("n"), *[F.sum(F.shiftright("fp", b).bitwiseAND(1)).alias(f"b{b}") for b in range(64)]).first()
    n = sums["n"]
    return sorted(range(64), key=lambda b: (abs(2 * (sums[f"b{b}"] or 0) - n), b)), n


def _permuted(fps: np.ndarray, order: list[int]) -> np.ndarray:
    """The fingerprints with bit order[0] as the highest bit, and so on; distances stay."""
    out = np.zeros_like(fps)
    for i, b in enumerate(order):
        out |= ((fps >> np.uint64(b)) & _ONE) << np.uint64(63 - i)
    return out


def _masks(low: int, high: int, radius: int) -> list[np.ndarray]:
    """For each number of flips up to ``radius``, the masks over bits low..high-1."""
    bits = [np.uint64(1) << np.uint64(b) for b in range(low, high)]
    out = [np.zeros(1, np.uint64)]
    for r in range(1, radius + 1):
        if r == 1:
            out.append(np.array(bits, np.uint64))
        else:
            out.append(np.array([a | b for i, a in enumerate(bits) for b in bits[i + 1 :]], np.uint64))
    return out


def ball(fps: np.ndarray, radius: int = RADIUS // 2) -> np.ndarray:
    """All variants of each fingerprint within ``radius`` (at most 2) bits, one row each."""
    masks = np.concatenate(_masks(0, 64, radius))
    return fps[:, None] ^ masks[None, :]


def _slices(tails: np.ndarray, flips: np.ndarray, free: int):
    """(positions, flips, width) of the fingerprints that have variants in one slice of a
    prefix; all variants of the slice have equal bits above the lowest ``width``.

    A slice with too many variants is halved by its next bit: a fingerprint goes on with its
    own half as it is, and with the other half one flip further, while it has flips left.
    """
    radius = RADIUS // 2
    todo = [(np.arange(len(tails), dtype=np.int64), flips.astype(np.int8), free)]
    while todo:
        at, f, width = todo.pop()
        sizes = [1, 1 + width, 1 + width + width * (width - 1) // 2]
        total = sum(int((f == x).sum()) * sizes[radius - x] for x in range(radius + 1))
        if total <= SLICE or not width:
            if len(at) > 1:
                yield at, f, width
            continue
        bit = (tails[at] >> np.uint64(width - 1)).astype(np.int8) & 1
        for side in (0, 1):
            then = f + (bit != side)
            stay = then <= radius
            todo.append((at[stay], then[stay], width - 1))


def _meet(fps: np.ndarray, flips: np.ndarray, prefix_bits: int) -> np.ndarray:
    """Links among the (permuted, distinct) fingerprints of one prefix, from their
    variants under it.

    ``flips``: how many of the prefix's bits each had to change to come here.  Returns
    rows (larger, smaller) so that fingerprints with a common variant are connected.
    """
    free = 64 - prefix_bits
    tails = fps & np.uint64((1 << free) - 1)
    pairs = []
    for at, f, width in _slices(tails, flips, free):
        masks = _masks(0, width, RADIUS // 2)
        low = tails[at] & np.uint64((1 << width) - 1)
        variants, owners = [], []
        for k in range(RADIUS // 2 + 1):
            own, which = np.concatenate(masks[: RADIUS // 2 - k + 1]), np.flatnonzero(f == k)
            variants.append((low[which][:, None] ^ own[None, :]).ravel())
            owners.append(np.repeat(at[which].astype(np.int32), len(own)))
        variants, owners = np.concatenate(variants), np.concatenate(owners)
        turn = np.argsort(variants)
        variants, owners = variants[turn], owners[turn]
        new = np.ones(len(variants), bool)
        new[1:] = variants[1:] != variants[:-1]
        group = np.cumsum(new) - 1
        met = np.flatnonzero(~new)
        one, other = owners[met].astype(np.int64), owners[np.flatnonzero(new)[group[met]]].astype(np.int64)
        pairs.append(np.unique(one * len(fps) + other))
    keys = np.unique(np.concatenate(pairs)) if pairs else np.empty(0, np.int64)
    one, other = keys // len(fps), keys % len(fps)
    near = np.bitwise_count(fps[one] ^ fps[other]) <= RADIUS
    return _forest(fps, one[near], other[near])


def _forest(fps: np.ndarray, one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Fewer links with the same components: each fingerprint to its component's
    smallest one, rows (larger, smaller)."""
    if not len(one):
        return np.empty((0, 2), np.uint64)
    order = np.argsort(fps)
    rank = np.empty(len(fps), np.int64)
    rank[order] = np.arange(len(fps))
    a, b = rank[one], rank[other]
    low = np.arange(len(fps))
    while True:
        was = low.copy()
        np.minimum.at(low, a, was[b])
        np.minimum.at(low, b, was[a])
        low = low[low]
        if (low == was).all():
            break
    far = np.flatnonzero(low != np.arange(len(fps)))
    return np.stack([fps[order[far]], fps[order[low[far]]]], 1)


def links(distinct: DataFrame, *, prefix_rows: int = PREFIX_ROWS) -> DataFrame:
    """(a, b) links whose components are those of all pairs within ``RADIUS`` bits.

    ``distinct`` (fp: long) has each fingerprint once.
    """
    order, n = _order(distinct)
    bits = PREFIX_BITS
    while bits < MOST_BITS and n * (1 + bits + bits * (bits - 1) // 2) >> bits > prefix_rows:
        bits += 1
    back = [63 - order.index(63 - j) for j in range(64)]  # undoes the order of bits
    head = np.concatenate(_masks(64 - bits, 64, RADIUS // 2))
    flips = np.bitwise_count(head).astype(np.int8)

    def send(batches):
        for batch in batches:
            fps = _permuted(batch.column(0).to_numpy().astype(np.int64).view(np.uint64), order)
            for some in np.array_split(fps, max(1, len(fps) * len(head) // SLICE)):
                to = ((some[:, None] ^ head[None, :]) >> np.uint64(64 - bits)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(to.ravel()), pa.array(np.repeat(some, len(head)).view(np.int64)), pa.array(np.tile(flips, len(some)))], ["prefix", "fp", "flips"])

    def meet(batches):
        def found(prefix_rows):
            got = _meet(np.concatenate([x[0] for x in prefix_rows]), np.concatenate([x[1] for x in prefix_rows]), bits)
            return pa.RecordBatch.from_arrays([pa.array(_permuted(got[:, i], back).view(np.int64)) for i in (0, 1)], ["a", "b"])

        at, rows = None, []
        for batch in batches:
            prefix = batch.column(0).to_numpy()
            fps, flip = batch.column(1).to_numpy().view(np.uint64), batch.column(2).to_numpy()
            cuts = np.flatnonzero(np.diff(prefix)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(prefix)], strict=True):
                if a == b:
                    continue
                if rows and prefix[a] != at:
                    yield found(rows)
                    rows = []
                at = prefix[a]
                rows.append((fps[a:b], flip[a:b]))
        if rows:
            yield found(rows)

    sent = distinct.mapInArrow(send, "prefix long, fp long, flips byte")
    sent = sent.repartition(min(1 << bits, 1 + n * len(head) // _ROWS), "prefix").sortWithinPartitions("prefix")
    return sent.mapInArrow(meet, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp, component_id): the smallest doc_id that can be reached over links."""
    with temporary(docs.sparkSession):
        fps = materialize(fingerprints(docs, id_col=id_col, text_col=text_col, shingle=shingle), "fps", keep=True)
        distinct = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("low")), "fps-distinct")
        roots = materialize(connected_components(links(distinct.select("fp"))), "fps-roots")
        placed = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
        least = placed.groupBy(F.col("root").alias("r")).agg(F.min("low").alias("component_id"))
        classes = materialize(placed.join(least, F.col("root") == F.col("r")).select(F.col("fp").alias("f"), "component_id"), "fps-classes", keep=True)
    return fps.join(classes, F.col("fp") == F.col("f")).select("doc_id", "fp", "component_id")


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from those of ``near_duplicates``."""
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def brute_force(texts: dict, shingle: int = SHINGLE) -> dict:
    """{doc_id: (fingerprint, component_id)} by comparing all pairs; for tests."""
    fps = {}
    for k, text in texts.items():
        data = (text or "").encode()
        for c in b"ABCDEFGHIJKLMNOPQRSTUVWXYZ":
            data = data.replace(bytes([c]), bytes([c + 32]))
        words = [w for w in data.replace(b"\t", b" ").replace(b"\n", b" ").replace(b"\x0b", b" ").replace(b"\x0c", b" ").replace(b"\r", b" ").split(b" ") if w]
        m = min(shingle, len(words))
        hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + m]), SEED) for i in range(len(words) - m + 1)] if m else []
        fps[k] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    root = {k: k for k in fps}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(fps)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= RADIUS:
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {k: (fps[k], top(k)) for k in ids}


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, find=near_duplicates) -> DataFrame:
    """The documents without near-duplicates, with all columns: of each component the
    document with the smallest id stays (null ids last, then by a hash of the text).
    ``find`` gives the components.

    Rows that are equal in id and text are one document, of which one row stays.
    """
    ident = F.struct(column(id_col).isNull().alias("none"), column(id_col).alias("id"), F.xxhash64(column(text_col)).alias("hash"))
    names = [f"c{i}" for i in range(len(docs.columns))]
    marked = docs.select(F.struct(*[column(c).alias(n) for c, n in zip(docs.columns, names, strict=True)]).alias("__doc"), ident.alias("__id"))
    text = F.col("__doc")[names[docs.columns.index(text_col)]]
    found = find(marked.select("__id", text.alias("__text")), id_col="__id", text_col="__text", shingle=shingle)
    found = materialize(found.groupBy("doc_id", "component_id").agg(F.count("*").alias("n")), "near-dups")
    gone = found.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("__gone"))
    n_gone, repeated = found.agg(F.sum((~F.col("doc_id").eqNullSafe(F.col("component_id"))).cast("int")), F.max("n")).first()
    same = F.col("__id.none") == F.col("__gone.none")
    same &= F.col("__id.id").eqNullSafe(F.col("__gone.id")) & (F.col("__id.hash") == F.col("__gone.hash"))
    out = marked.join(broadcast_if_small(gone, n_gone or 0), same, "left_anti")
    if (repeated or 0) > 1:
        out = out.dropDuplicates(["__id"])
    return out.select("__doc.*").toDF(*docs.columns)
