"""SimHash near-dedup at a similarity, which the pipeline uses, against brute force."""

import random

import numpy as np

import corpus_pipeline
from corpusloom.llm import shared, similar, simhash

DOC = "doc_id long, text string"


def texts_of_groups():
    random.seed(3)
    words = [f"w{i}" for i in range(3000)]
    some = lambda n: [random.choice(words) for _ in range(n)]
    texts = []
    for n, changes in ((60, 1), (200, 3), (200, 5), (200, 8), (900, 20), (900, 40)):
        base = some(n)
        for _ in range(12):
            own = list(base)
            for _ in range(random.randint(0, changes)):
                own[random.randrange(n)] = random.choice(words)
            texts.append(" ".join(own))
    # a chain: each is near to the next, the ends are not near
    long = some(400)
    texts += [" ".join(long[i * 20 : i * 20 + 250]) for i in range(7)]
    return texts + [texts[0]] * 3 + [texts[1].upper(), "", " \t", "one two", "One  two", "one two three", None]


def test_components_equal_brute_force(spark):
    texts = dict(enumerate(texts_of_groups()))
    got = {r.doc_id: r.component_id for r in similar.near_duplicates(spark.createDataFrame([*texts.items()], DOC)).collect()}
    assert got == similar.brute_force(texts)
    assert similar.near_duplicates(spark.createDataFrame([], DOC)).count() == 0


def test_similar_of_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = {r.doc_id: r.component_id for r in similar.near_duplicates(docs).collect()}
    assert got == similar.brute_force({r.doc_id: r.text for r in docs.collect()})


def test_short_prefixes_and_long_ones_agree(spark):
    df = spark.createDataFrame([*enumerate(texts_of_groups())], DOC)
    one, other = (sorted(map(tuple, similar.near_duplicates(df, prefix_rows=n).collect())) for n in (1, 200_000))
    assert one == other


def test_sets_of_a_large_group_are_all_compared():
    """500 unrelated sets under one key; two with equal fingerprints stand far apart in the group."""
    rnd = np.random.default_rng(7)
    key = np.uint64(0xABCD1234) << np.uint64(32)
    fps = key | rnd.integers(0, 1 << 32, 500, dtype=np.uint64)
    fps[300] = fps[3]
    nodes, sizes, flips = np.arange(500, dtype=np.int64), np.full(500, 100, np.int64), np.zeros(500, np.int64)
    a, b = similar._pairs_of(fps, nodes, sizes, flips, 8, None, [])
    assert set(a[a == b]) == set(range(500))  # the second step gets them all
    a, b = similar._pairs_of(fps, nodes, sizes, flips, 8, nodes, [])
    apart = np.bitwise_count(fps[:, None] ^ fps[None, :])
    want = {(i, j) for i, j in zip(*np.nonzero(apart <= similar.REST_BITS), strict=True) if i < j}
    assert {tuple(sorted(p)) for p in zip(a.tolist(), b.tolist(), strict=True)} == want and (3, 300) in want
    a, b = similar._pairs_of(fps[:10], nodes[:10], sizes[:10], flips[:10], 8, None, [])
    assert not (a == b).any()


def test_sets_equal_the_definition():
    texts = [*texts_of_groups(), "a\x0bb\tc\r\nd  e f", "\u00a0x y z w v u", "w " * 400_000]
    got = similar.shingle_sets([None if t is None else t.encode() for t in texts])
    plain = []
    for t in texts:
        words = (t or "").encode().lower().split()
        k = min(5, len(words))
        plain.append(frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if k else frozenset())
    assert [len(x) for x in got] == [len(x) for x in plain]
    for i in range(0, len(texts), 3):
        for j in range(len(texts)):
            assert len(np.intersect1d(got[i], got[j])) == len(plain[i] & plain[j])


def test_pipeline_drops_near_copies_beyond_four_bits(spark, small):
    random.seed(5)
    base = [f"x{random.randrange(5000)}" for _ in range(300)]
    near, far = list(base), list(base)
    near[50] = near[150] = near[250] = "other"
    for i in range(5, 300, 12):
        far[i] = "other"
    rows = [(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(far))]
    a, b, _ = (simhash.fingerprint(t.encode()) for _, t in rows)
    assert (a ^ b).bit_count() > simhash.RADIUS
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], DOC + ", lang string, source string, n_chars long")
    out = corpus_pipeline.drop_near_duplicates(spark, docs, small)
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == [1, 3]


def test_few_large_parts_are_spread_before_they_are_sent(spark, monkeypatch):
    """A task that makes 192 rows of each set of a thin table would hold them all for the shuffle."""
    rng = np.random.default_rng(9)
    rows = [(i, 100, rng.bytes(8 * similar.TABLES), None) for i in range(300)]
    sets = spark.createDataFrame(rows, "node long, n int, sketch binary, root long").coalesce(1)
    monkeypatch.setattr(shared, "SENT_BYTES", 1 << 16)
    assert shared.spread(sets, 300, similar.TABLES * 6, 4, "node").rdd.getNumPartitions() == 1 + 300 * 192 * 48 // (1 << 16)
    for rooted in (False, True):
        plan = similar._meetings(sets, 300, rooted, 200_000)._jdf.queryExecution().optimizedPlan().toString()
        assert "RepartitionByExpression [node" in plan
