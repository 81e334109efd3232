"""SimHash near-dedup at a similarity: ball hashing of several fingerprints, verified exactly.

Two texts are linked if the sets of their five-word shingles have a Jaccard similarity of 0.8
or more.  One fingerprint of 64 bits can't find such pairs within a few bits: at 0.8 a bit
differs with probability 0.15.  So ``TABLES`` independently seeded fingerprints are hashed,
each in a ball of ``RADIUS`` bits around its first ``KEY`` bits, by meeting in the middle as in
``simhash``: every fingerprint emits all variants within half the radius, is sent once to each
prefix that its variants have, and equal variants meet there.  What meets is verified three
times: by the other bits of the fingerprint and the sizes of the sets in the task, by the bits
of all fingerprints together, and at last by the exact similarity of both whole sets, in
integers, so no link is below the threshold.

Sets are deduplicated first (exact copies are one set).  Pairs are taken in two steps, so that
a large group of near copies does not make all its pairs:

1. in each prefix of each table a set goes on with the one closest to it of the ``LAGS`` that stand
   next to it among those it meets; the verified links give first components;
2. the sets that met any, and all those of groups too large for step 1 to compare each with
   each, are sent again with their component and ``BESIDE`` more of their fingerprints, and all
   pairs that meet, lie in different components and are close in those too go on.

A pair that is left out is connected already, so the components are those of all pairs that
meet.  Nothing is capped: what step 1 doesn't compare step 2 does, which grows with the pairs that
meet and are not near copies.

A pair at similarity s meets in a table if at most ``RADIUS`` of ``KEY`` bits differ: with
probability 0.12 at 0.8, 0.2 at 0.85, 0.34 at 0.9, so in one of 32 tables with 0.98, 0.999 and
more.  The recall that was measured is in the README.

Edge cases: null, empty and wordless texts have the empty set and are copies of each other; a
text of fewer words than the shingle is one shingle of all of them.  Null doc_ids and repeated
rows are as in ``simhash``.  Shingles and sets are known by 64-bit hashes.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import simhash
from corpusloom.llm.components import connected_components
from corpusloom.llm.shared import broadcast_if_small, column, materialize, sliced, spread, temporary, text_bytes

SHINGLE = 5
#: The least similarity, NEAR / OF.
NEAR, OF = 4, 5
TABLES, KEY, RADIUS = 32, 32, 2
#: Of the other bits of a fingerprint so many may differ, and of the bits of all such a share.
REST_BITS, ALL_BITS = 14, 0.2
#: Fingerprints of other tables that travel along in the second step, and their share.
BESIDE, BESIDE_BITS = 8, 0.195
SEED = 42
#: Directions whose votes are added up; the fingerprints are signs of mixtures of them.
DIRECTIONS = 256
#: Bits of the shortest prefix, and sets under one prefix that are expected at most.
PREFIX_BITS, PREFIX_ROWS = 5, 200_000
#: Neighbours in a variant's group that a set is compared with in the first step; larger groups are compared in the second.
LAGS = 16
_CHUNK = 1 << 13
#: Rows that a task of a meeting gets, about.
_ROWS = 100_000
_BYTES = 1 << 19

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_GAP = re.compile(rb"[\t-\r ]")
_ODD = np.random.default_rng(SEED).integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LETTER = np.random.default_rng(SEED + 1).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _ODD[0]
    x = (x ^ (x >> np.uint64(29))) * _ODD[1]
    return x ^ (x >> np.uint64(32))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of an odd base and of its inverse, modulo 2 ** 64."""
    out = []
    for b in (_BASE, pow(_BASE, -1, 1 << 64)):
        p = np.full(n, b, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def _word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the words of lower-cased UTF-8, piece by piece."""
    at, places, hashes = 0, [], []
    up, down = _powers(min(len(data), _BYTES) + 1)
    while at < len(data):
        gap = _GAP.search(data, at + _BYTES) if at + _BYTES < len(data) else None
        end = gap.start() if gap else len(data)
        piece = np.frombuffer(data, np.uint8, end - at, at)
        if len(piece) >= len(up):
            up, down = _powers(len(piece) + 1)
        word = np.zeros(len(piece) + 2, np.int8)
        word[1:-1] = ~_SPACE[piece]
        turn = np.diff(word)
        first, last = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
        sums = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(_LETTER[piece] * up[: len(piece)], out=sums[1:])
        places.append(first + at)
        hashes.append(_mixed((sums[last] - sums[first]) * down[first]))
        at = end
    if not places:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    return np.concatenate(places), np.concatenate(hashes)


def shingle_sets(texts: list, shingle: int = SHINGLE) -> list[np.ndarray]:
    """The sorted hashes of the different shingles of each text (UTF-8 or None)."""
    lower = [(t or b"").lower() for t in texts]  # bytes.lower() changes ASCII letters only
    ends = np.cumsum([len(t) + 1 for t in lower])
    places, words = _word_hashes(b"\n".join(lower))
    at = np.searchsorted(places, ends)
    out = []
    for a, b in zip([0, *at[:-1]], at, strict=True):
        own = words[a:b]
        k = min(shingle, len(own))
        total = np.zeros(max(0, len(own) - k + 1) if k else 0, np.uint64)
        for j in range(k):
            total += own[j : len(own) - k + 1 + j] * _ODD[2 + j % 60]
        out.append(np.unique(_mixed(total + np.uint64(k))))
    return out


def _votes(own: np.ndarray) -> np.ndarray:
    """The sums over a set of +1 and -1 in each direction."""
    total = np.zeros(DIRECTIONS, np.int64)
    for at in range(0, len(own), _CHUNK):
        h = own[at : at + _CHUNK, None] * _ODD[None, 2 : 2 + DIRECTIONS // 64]
        bits = np.unpackbits(_mixed(h).view(np.uint8).reshape(len(h), -1), axis=1)
        full = len(bits) // 255 * 255  # sums of at most 255 rows fit a byte, which adds fastest
        if full:
            total += np.add.reduce(bits[:full].reshape(-1, 255, DIRECTIONS), axis=1, dtype=np.uint8).sum(0, dtype=np.int64)
        total += bits[full:].sum(0, dtype=np.int64)
    return 2 * total - len(own)


def _mixtures() -> np.ndarray:
    return np.random.default_rng(SEED + 2).standard_normal((DIRECTIONS, 64 * TABLES), np.float32)


def sketches(sets: list[np.ndarray], mixtures: np.ndarray) -> np.ndarray:
    """The fingerprints of each set, one row of ``TABLES`` numbers."""
    votes = np.array([_votes(own) for own in sets], np.float32).reshape(len(sets), DIRECTIONS)
    return np.packbits(votes @ mixtures > 0, axis=1).view(np.uint64).byteswap().reshape(len(sets), TABLES)


def near(one: np.ndarray, other: np.ndarray) -> bool:
    """Whether two sorted sets are at least NEAR / OF similar."""
    n, m = len(one), len(other)
    if OF * min(n, m) < NEAR * max(n, m):
        return False
    both = np.sort(np.concatenate([one, other]), kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return OF * common >= NEAR * (n + m - common)


def _node(own: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(own.tobytes())


def _sets(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(doc_id, node: the set's hash, n: its size, sketch: its fingerprints)."""

    def run(batches):
        mixtures = _mixtures()
        for batch in sliced(batches, rows=2000, of="text"):
            sets = shingle_sets(text_bytes(batch.column("text")), shingle)
            node = np.array([_node(x) for x in sets], np.uint64).view(np.int64)
            sketch = [row.tobytes() for row in sketches(sets, mixtures)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(node), pa.array([len(x) for x in sets], pa.int32()), pa.array(sketch, pa.binary())], ["doc_id", "node", "n", "sketch"])

    rows = docs.select(column(id_col).alias("doc_id"), column(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, node long, n int, sketch binary")


def _pairs_of(fps: np.ndarray, nodes: np.ndarray, sizes: np.ndarray, flips: np.ndarray, bits: int, roots: np.ndarray | None, beside: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the pairs that meet under one prefix of ``bits`` bits; with ``roots`` all
    pairs of different ones, else for each its closest, and with itself each that stood in a group
    in which not all were compared."""
    free = KEY - bits
    tails = (fps >> np.uint64(64 - KEY)) & np.uint64((1 << free) - 1)
    straight = np.flatnonzero(flips == 0)
    masks = np.concatenate([np.zeros(1, np.uint64), np.uint64(1) << np.arange(free, dtype=np.uint64)])
    variants = np.concatenate([(tails[straight][:, None] ^ masks[None, :]).ravel(), tails[flips > 0]])
    owners = np.concatenate([np.repeat(straight, len(masks)), np.flatnonzero(flips > 0)]).astype(np.int64)
    order = np.lexsort((owners, variants)) if roots is None else np.lexsort((owners, roots[owners], variants))
    v, who = variants[order], owners[order]
    # groups of one member, or of one component, have no pair
    group = np.cumsum(np.concatenate([[True], v[1:] != v[:-1]])) - 1
    size = np.bincount(group)
    many = size > 1
    if roots is not None:
        ends = np.cumsum(size) - 1
        many &= roots[who[ends]] != roots[who[ends - size + 1]]
    crowded = np.unique(who[size[group] > LAGS + 1]) if roots is None else np.empty(0, np.int64)
    v, who = v[many[group]], who[many[group]]
    found: list[np.ndarray] = []
    longest = int(size[many].max()) if many.any() else 0
    for lag in range(1, min(longest, LAGS + 1) if roots is None else longest):
        a, b = who[:-lag], who[lag:]
        good = v[lag:] == v[:-lag]
        if not good.any():
            break
        if roots is not None:
            good &= roots[a] != roots[b]
        a, b = a[good], b[good]
        x = fps[a] ^ fps[b]
        good = (np.bitwise_count(x >> np.uint64(64 - KEY)) <= RADIUS) & (np.bitwise_count(x & np.uint64((1 << 64 - KEY) - 1)) <= REST_BITS)
        if beside:
            far = sum(np.bitwise_count(x[a] ^ x[b]).astype(np.int32) for x in beside)
            good &= far <= BESIDE_BITS * 64 * len(beside)
        good &= (OF * np.minimum(sizes[a], sizes[b]) >= NEAR * np.maximum(sizes[a], sizes[b])) & (nodes[a] != nodes[b])
        found.append(np.unique(np.minimum(a, b)[good] * len(fps) + np.maximum(a, b)[good]))
    keys = np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)
    a, b = keys // len(fps), keys % len(fps)
    if roots is None and len(a):
        far = np.bitwise_count(fps[a] ^ fps[b])
        a, b, far = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([far, far])
        # where a set has come by a flip it has its turn under its own prefix, unless both have come
        own = (flips[a] == 0) | (flips[b] > 0)
        a, b, far = a[own], b[own], far[own]
        order = np.lexsort((nodes[b], far, a))
        first = np.ones(len(order), bool)
        first[1:] = a[order][1:] != a[order][:-1]
        a, b = a[order][first], b[order][first]
    return np.concatenate([a, crowded]), np.concatenate([b, crowded])


def _meetings(sets: DataFrame, count: int, rooted: bool, prefix_rows: int) -> DataFrame:
    """(a, b) nodes, a < b, of ``sets`` (node, n, sketch, root) that meet; each pair once.

    Without roots also a = b of sets that did not meet all of their groups."""
    bits = PREFIX_BITS
    while bits < KEY and count * (1 + bits) >> bits > prefix_rows:
        bits += 1

    def send(batches):
        head = np.concatenate([np.zeros(1, np.uint64), np.uint64(1) << np.arange(64 - bits, 64, dtype=np.uint64)])
        flips = (np.arange(len(head)) > 0).astype(np.int64)
        for batch in sliced(batches, rows=1000):
            fps = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint64).reshape(-1, TABLES)
            node, n = batch.column("node").to_numpy(), batch.column("n").to_numpy().astype(np.int64)
            sized = pa.array((2 * n[:, None] + flips[None, :]).ravel())
            root = batch.column("root").to_numpy(zero_copy_only=False)
            for t in range(TABLES):
                to = ((fps[:, t][:, None] ^ head[None, :]) >> np.uint64(64 - bits)).astype(np.int64) + (t << bits)
                each = lambda x: pa.array(np.repeat(x, len(head)))
                arrays = [pa.array(to.ravel()), each(fps[:, t].view(np.int64)), each(node), sized]
                more = [each(fps[:, (t + 1 + i) % TABLES].view(np.int64)) for i in range(BESIDE)]
                yield pa.RecordBatch.from_arrays([*arrays, each(root), *more] if rooted else arrays, names)

    def meet(batches):
        def found(parts):
            fps, node, sized, *more = (np.concatenate(x) for x in zip(*parts, strict=True))
            a, b = _pairs_of(fps.view(np.uint64), node, sized >> 1, sized & 1, bits, more[0] if rooted else None, [x.view(np.uint64) for x in more[1:]])
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(node[a], node[b])), pa.array(np.maximum(node[a], node[b]))], ["a", "b"])

        at, parts = None, []
        for batch in batches:
            bucket = batch.column("bucket").to_numpy()
            cols = [batch.column(c).to_numpy() for c in names[1:]]
            cuts = np.flatnonzero(np.diff(bucket)) + 1
            for x, y in zip([0, *cuts], [*cuts, len(bucket)], strict=True):
                if x == y:
                    continue
                if parts and bucket[x] != at:
                    yield found(parts)
                    parts = []
                at = bucket[x]
                parts.append([c[x:y].copy() for c in cols])
        if parts:
            yield found(parts)

    more = ["root", *[f"fp{i}" for i in range(BESIDE)]] if rooted else []
    names = ["bucket", "fp", "node", "sized", *more]  # sized: twice the set's size, and whether a bit was flipped
    kind = ", ".join(f"{c} long" for c in names)
    sent = spread(sets, count, TABLES * (1 + bits), len(names), "node").mapInArrow(send, kind)
    sent = sent.repartition(min(TABLES << bits, 1 + count * TABLES * (1 + bits) // _ROWS), "bucket").sortWithinPartitions("bucket")
    return sent.mapInArrow(meet, "a long, b long").distinct()


def _alike(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs that differ in at most ``ALL_BITS`` of the bits of all fingerprints."""
    one = sets.select(F.col("node").alias("na"), F.col("sketch").alias("sa"))
    other = sets.select(F.col("node").alias("nb"), F.col("sketch").alias("sb"))
    rows = pairs.join(one, F.col("a") == F.col("na")).join(other, F.col("b") == F.col("nb")).select("a", "b", "sa", "sb")

    def run(batches):
        for batch in sliced(batches):
            one, other = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(-1, TABLES) for c in ("sa", "sb"))
            far = np.bitwise_count(one ^ other).sum(1, dtype=np.int64)
            yield batch.select(["a", "b"]).filter(pa.array(far <= ALL_BITS * 64 * TABLES))

    return materialize(rows.mapInArrow(run, "a long, b long"), "near-alike")


def _verified(pairs: DataFrame, placed: DataFrame, docs: DataFrame, shingle: int) -> DataFrame:
    """The pairs (a, b) of which the whole sets are near.

    ``placed`` (node, low): the document of which each set is made again, from ``docs``
    (doc_id, text).
    """
    needed = pairs.select(F.col("a").alias("x")).union(pairs.select("b")).distinct()
    ids = materialize(placed.join(needed, F.col("node") == F.col("x"), "left_semi").select("low"), "near-needed")
    texts = docs.join(broadcast_if_small(ids, ids.count()), F.col("doc_id").eqNullSafe(F.col("low")), "left_semi").select("text")

    def again(batches):
        for batch in sliced(batches, of="text"):
            sets = shingle_sets(text_bytes(batch.column("text")), shingle)
            yield pa.RecordBatch.from_arrays([pa.array(np.array([_node(x) for x in sets], np.uint64).view(np.int64)), pa.array([x.tobytes() for x in sets], pa.binary())], ["node", "own"])

    own = materialize(texts.mapInArrow(again, "node long, own binary").dropDuplicates(["node"]), "near-sets")
    one = own.select(F.col("node").alias("na"), F.col("own").alias("oa"))
    other = own.select(F.col("node").alias("nb"), F.col("own").alias("ob"))
    rows = pairs.join(one, F.col("a") == F.col("na")).join(other, F.col("b") == F.col("nb")).select("a", "b", "oa", "ob")

    def run(batches):
        for batch in sliced(batches, rows=200):
            sides = zip(batch.column("oa").to_pylist(), batch.column("ob").to_pylist(), strict=True)
            good = [near(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in sides]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return materialize(rows.mapInArrow(run, "a long, b long"), "near-links")


def links(sets: DataFrame, docs: DataFrame, *, shingle: int = SHINGLE, prefix_rows: int = PREFIX_ROWS) -> DataFrame:
    """(a, b) links whose components are those of all near pairs that meet.

    ``sets`` (node, low, n, sketch) has each set once; ``docs`` is (doc_id, text).
    """
    sets = sets.where("n > 0")
    plain = sets.select("node", "n", "sketch", F.lit(None).cast("long").alias("root"))
    seen = materialize(_meetings(plain, sets.count(), False, prefix_rows), "near-met")
    met = seen.where("a < b")
    placed, known = sets.select("node", "low"), sets.select("node", "sketch")
    first = _verified(_alike(met, known), placed, docs, shingle)
    roots = materialize(connected_components(first).select(F.col("node").alias("x"), "root"), "near-roots")
    nodes = materialize(seen.select(F.col("a").alias("y")).union(seen.select("b")).distinct(), "near-nodes")
    again = sets.join(nodes, F.col("node") == F.col("y"), "left_semi").join(roots, F.col("node") == F.col("x"), "left")
    again = again.select("node", "n", "sketch", F.coalesce("root", "node").alias("root"))
    rest = _meetings(again, nodes.count(), True, prefix_rows).join(met, ["a", "b"], "left_anti")
    return first.unionByName(_verified(_alike(rest, known), placed, docs, shingle))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, prefix_rows: int = PREFIX_ROWS) -> DataFrame:
    """(doc_id, component_id): the smallest doc_id that can be reached over links."""
    with temporary(docs.sparkSession):
        sets = materialize(_sets(docs, id_col, text_col, shingle), "near-sketches")
        named = materialize(sets.select("doc_id", "node"), "near-named", keep=True)
        one = materialize(sets.groupBy("node").agg(F.min("doc_id").alias("low"), F.first("n").alias("n"), F.first("sketch").alias("sketch")), "near-distinct")
        # a set of which all ids are null is made again from any of them
        texts = docs.select(column(id_col).alias("doc_id"), column(text_col).alias("text"))
        roots = materialize(connected_components(links(one, texts, shingle=shingle, prefix_rows=prefix_rows)).withColumnRenamed("node", "x"), "near-roots")
        placed = one.select("node", "low").join(roots, F.col("node") == F.col("x"), "left").select("node", "low", F.coalesce("root", "node").alias("root"))
        least = placed.groupBy(F.col("root").alias("r")).agg(F.min("low").alias("component_id"))
        classes = materialize(placed.join(least, F.col("root") == F.col("r")).select(F.col("node").alias("x"), "component_id"), "near-classes", keep=True)
    return named.join(classes, F.col("node") == F.col("x")).select("doc_id", "component_id")


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """The documents without near-duplicates, as ``simhash.keep_one`` keeps them."""
    return simhash.keep_one(docs, id_col=id_col, text_col=text_col, shingle=shingle, find=near_duplicates)


def brute_force(texts: dict, shingle: int = SHINGLE) -> dict:
    """{doc_id: component_id} by comparing all pairs of sets of words; for tests."""
    sets = {}
    for k, text in texts.items():
        words = (text or "").encode().lower().split()
        m = min(shingle, len(words))
        sets[k] = frozenset(tuple(words[i : i + m]) for i in range(len(words) - m + 1)) if m else frozenset()
    root = {k: k for k in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            common = len(sets[a] & sets[b])
            if OF * common >= NEAR * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {k: top(k) for k in ids}
