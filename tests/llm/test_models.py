"""SimHash, suffix dedup, the models and the pipeline against brute force or held-out data."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpusloom.llm import components, decontam, langid, linededup, mixing, queries, similar, simhash, suffix, toxicity
from tests.llm import brute

DOC = "doc_id long, text string"


# components


def test_components(spark):
    random.seed(1)
    pairs = [(random.randint(0, 300), random.randint(0, 300)) for _ in range(220)] + [(1000, 1000 + i) for i in range(1, 400)] + [(i, i + 1) for i in range(5000, 5060)] + [(5, None), (7, 7)]
    root = {}

    def top(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            x, y = sorted((top(a), top(b)))
            root[y] = x
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: top(x) for x in root}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# SimHash


def test_simhash_equals_brute_force(spark, small):
    df = spark.read.parquet(f"{small}/documents.parquet")
    got = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in simhash.digest(simhash.near_duplicates(df)).collect()}
    assert got == simhash.brute_force({r.doc_id: r.text for r in df.collect()})


def test_keep_one_with_any_column_name(spark, small):
    df = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", F.lit(1).alias("a.b"), F.lit(2).alias("fp"), F.lit(3).alias("__doc"))
    for keep in (simhash.keep_one, similar.keep_one):
        out = keep(df)
        assert out.columns == df.columns and 0 < out.count() < df.count()


def test_links_of_close_fingerprints(spark):
    random.seed(2)
    fps = set()
    for _ in range(12):
        base = random.getrandbits(64)
        for _ in range(30):
            v = base
            for _ in range(random.randint(0, 5)):
                v ^= 1 << random.randrange(64)
            fps.add(v)
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    found = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), prefix_rows=100)
    got = {r.node: r.root for r in components.connected_components(found).collect()}
    groups = {}
    for k, x in enumerate(signed):
        groups.setdefault(got.get(x, x), set()).add(k)
    root = {k: k for k in range(len(fps))}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= simhash.RADIUS:
                root[max(top(i), top(j))] = min(top(i), top(j))
    want = {}
    for k in root:
        want.setdefault(top(k), set()).add(k)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_slices_of_a_prefix_change_nothing(monkeypatch):
    rng = np.random.default_rng(3)
    fps = np.unique(rng.integers(0, 1 << 63, 40, dtype=np.uint64) & np.uint64(0x00FF00FF0000FFFF))
    flips = np.zeros(len(fps), np.int8)
    whole = simhash._meet(fps, flips, 4)
    monkeypatch.setattr(simhash, "SLICE", 5000)
    assert (np.sort(simhash._meet(fps, flips, 4), 0) == np.sort(whole, 0)).all()
    assert len(simhash.ball(fps[:1])[0]) == len(set(simhash.ball(fps[:1])[0].tolist())) == 2081


def test_simhash_edges_and_keep_one(spark):
    same = "one two three four five six"
    rows = [(5, same), (3, same.upper()), (None, same), (9, None), (8, ""), (7, " \t"), (4, "word"), (2, "Word"), (2, "Word"), (None, "quite another text it is"), (None, "and one more that differs")]
    df = spark.createDataFrame([(*r, 1) for r in rows], DOC + ", fp int")
    got = sorted(map(str, ((r.doc_id, r.component_id) for r in simhash.near_duplicates(df).collect())))
    want = [(5, 3), (3, 3), (None, 3), (9, 7), (8, 7), (7, 7), (4, 2), (2, 2), (2, 2), (None, None), (None, None)]
    assert got == sorted(map(str, want))
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(map(str, ((r.doc_id, r.text) for r in kept.collect()))) == sorted(map(str, [(3, same.upper()), (7, " \t"), (2, "Word"), (None, "quite another text it is"), (None, "and one more that differs")]))
    assert simhash.near_duplicates(df.limit(0)).count() == 0


# suffixes


def random_texts():
    random.seed(1)
    text = lambda n: "".join(random.choice("abcd é") for _ in range(n))
    base = [text(random.randint(0, 300)) for _ in range(40)]
    shared = [text(60), text(45), text(40), text(100)]
    mixed = [text(random.randint(0, 80)) + random.choice(shared) + text(random.randint(0, 80)) for _ in range(120)]
    return base + mixed + [base[5]] * 9 + [None, "", "a" * 500, "ab" * 300, "a" * 100, "b" * 39]


@pytest.mark.parametrize("group", [2000, 3])
def test_suffixes_equal_brute_force(spark, group):
    texts = random_texts()
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], DOC + ", size string")
    got = {r.doc_id: tuple(r)[1:] for r in suffix.digest(suffix.remove_repeats(df, threshold=40, group=group)).collect()}
    assert [got[i] for i in range(len(texts))] == suffix.brute_force(texts, 40)


def test_suffixes_of_a_hot_passage(spark):
    random.seed(9)
    text = lambda n: "".join(random.choice("abcdefgh ") for _ in range(n))
    passage = text(44)
    texts = [text(50) + passage + text(50) for _ in range(200)]
    df = spark.createDataFrame([*enumerate(texts)], DOC)
    got = {r.doc_id: tuple(r)[1:] for r in suffix.digest(suffix.remove_repeats(df, threshold=40, group=10)).collect()}
    assert [got[i] for i in range(len(texts))] == suffix.brute_force(texts, 40)


def test_suffixes_at_400_bytes(spark, small):
    df = spark.read.parquet(f"{small}/documents.parquet")
    rows = df.collect()
    got = {r.doc_id: tuple(r)[1:] for r in suffix.digest(suffix.remove_repeats(df)).collect()}
    assert [got[r.doc_id] for r in rows] == suffix.brute_force([r.text for r in rows])


def test_suffixes_of_a_row_that_is_repeated_very_often(spark):
    rnd = random.Random(6)
    word = lambda n: "".join(rnd.choice("abcdefgh") for _ in range(n))
    common = word(600)
    rows = [(1, word(700) + common + word(300))] * 5000 + [(2, word(400) + common + word(500)), (3, word(900))]
    df = spark.createDataFrame(rows, DOC)
    texts = suffix._named(df, "doc_id", "text")
    level = suffix._sorted_out(texts.mapInArrow(suffix._first_rows(400, 64), suffix._ROW), [], 1000)
    open_ = suffix._with_bytes(level.where("onward").select("key", "span", "rid", "alt", "pos", "settled", "members"), texts, 400)
    most = open_.groupBy("key").count().agg(F.max("count")).first()[0]
    assert 1 <= most <= 10  # and not 5001
    got = suffix.digest(suffix.remove_repeats(df)).groupBy("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").count().collect()
    want = suffix.brute_force([rows[0][1], rows[0][1], rows[5000][1], rows[5001][1]])
    assert {(r.doc_id, *tuple(r)[1:5]): r["count"] for r in got} == {(1, *want[0]): 5000, (2, *want[2]): 1, (3, *want[3]): 1}


def test_suffixes_of_long_texts(spark):
    random.seed(4)
    long = "".join(random.choice("abcdefghij") for _ in range(1_300_000))
    texts = [long, "x" + long[900_000:1_000_000] + "y", long[10:409]]
    df = spark.createDataFrame([*enumerate(texts)], DOC)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in suffix.digest(suffix.remove_repeats(df)).collect()}
    assert got == {0: (1_300_000, 100_000, 1), 1: (100_002, 100_000, 1), 2: (399, 0, 0)}


def test_suffixes_of_nothing(spark):
    assert suffix.remove_repeats(spark.createDataFrame([], DOC)).count() == 0


# language


def test_segments_equal_the_plain_recursion():
    rng = np.random.default_rng(1)
    lens = np.array([1, 2, 31, 32, 33, 64, 65, 200, 5])
    e, switch = rng.normal(size=(lens.sum(), 3)) * 2, rng.normal(size=(3, 3))
    got, at = langid.expected(e, lens, switch), 0
    for i, n in enumerate(lens):
        plain, _ = langid._marginals(e[None, at : at + n], switch)
        assert np.allclose(plain[0].sum(0), got[i])
        at += n


def test_language_on_held_out_documents(spark):
    folder = "/root/testdata/sf0.01"
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = queries.op3_language(spark, folder).collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(lang) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) >= 0.99
    assert all(0 <= r.score <= 1 for r in rows)


def test_words_of_switched_text_get_their_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(docs)
    pick = {r.lang: r.text for r in docs.where("lang in ('en', 'de') and length(text) between 300 and 900").collect()}
    words = langid.words_of(pick["en"].encode())[:40] + langid.words_of(pick["de"].encode())[:40]
    gamma, _ = langid._marginals(model.emissions(words)[None], model.switch)
    best = [model.languages[k] for k in gamma[0].argmax(1)]
    assert np.mean([b == "en" for b in best[:40]]) > 0.9 and np.mean([b == "de" for b in best[40:]]) > 0.9


def test_more_languages_than_a_few(spark):
    rng = random.Random(1)
    stems = [["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(30)] for _ in range(70)]
    rows = [(i * 4 + 3, " ".join(rng.choice(stems[k]) for _ in range(60)), f"l{k:02}") for i, k in enumerate([*range(70)] * 4)]
    rows = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2]
    long = [(9000 + i, " ".join(rng.choice(stems[0]) + "x" for _ in range(4000)), "long") for i in range(8)]
    df = spark.createDataFrame(rows + long, DOC + ", lang string")
    got = {r.doc_id: r.lang_pred for r in langid.identify(df, langid.fit(df, sample_chars=2000)).collect()}
    assert np.mean([got[i] == lang for i, _, lang in rows]) > 0.95 and all(got[i] == "long" for i, *_ in long)


def test_language_edges(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 ?!"), (4, "¿… —"), (None, "the and of"), (5, "the " * 50_000)], DOC + "")
    model = langid.fit(docs)
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(odd.withColumn("score", F.lit("x")), model).collect()}
    assert [got[i][0] for i in (1, 2, 3, 4)] == ["und"] * 4 and got[None][0] == got[5][0] == "en"
    none = langid.fit(docs.limit(0))
    assert {r.lang_pred for r in langid.identify(odd, none).collect()} == {"und"}
    assert langid.identify(odd.limit(0), model).count() == 0


# toxicity


def test_toxicity_on_held_out_documents(spark):
    folder = "/root/testdata/sf0.1"
    label = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = queries.op7_toxicity(spark, folder).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.5) for r in rows)
    held = [(r.predicted, label[r.doc_id]) for r in rows if r.held_out and r.doc_id in label]
    assert len(held) > 500 and np.mean([a == b for a, b in held]) >= 0.97


def test_toxicity_reads_no_held_out_label(spark):
    folder = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    flipped = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    score = lambda x: sorted(map(tuple, toxicity.score(docs, toxicity.fit(docs, x)).select("doc_id", "score").collect()))
    assert score(labels) == score(flipped)
    assert toxicity.fit(docs, labels).mix == toxicity.fit(docs, flipped).mix


def test_log_ratios_equal_the_definition(spark):
    folder = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    model = toxicity.fit(docs, labels)
    toxic = {r.doc_id: r.toxic for r in labels.collect()}
    text = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    fold = lambda i: zlib.crc32(str(i).encode()) % 5
    known = [(text[i], t) for i, t in toxic.items() if fold(i) in (1, 2, 3)]
    words = sorted({w for t in text.values() for w in toxicity.words_of(t)})
    assert len(words) > 1000 and sum(t for _, t in known) >= 3
    want = brute.word_ratios(known, words)
    assert np.allclose(toxicity.ratios_of(words, model.arrays), want, atol=1e-3)
    ratios = dict(zip(words, want, strict=True))
    for r in toxicity.score(docs, model).collect():
        evidence = brute.evidence(text[r.doc_id], ratios, model.mix)
        assert r.evidence == pytest.approx(evidence, abs=1e-6)
        odds = min(40.0, max(-40.0, model.base + model.slope * np.log(evidence + 2 * model.mix)))
        assert r.score == pytest.approx(1 / (1 + np.exp(-odds)), abs=1e-4)
    # an unseen toxic beginning backs off and the ratio goes on: words of the ordinary class speak against
    assert min(want) < -8 and sum(x < -1 for x in want) > 100


def test_toxicity_of_a_model_that_is_not_broadcast(spark):
    folder = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    docs = docs.unionByName(docs.limit(3)).unionByName(docs.limit(1).withColumn("text", F.lit(None).cast("string"))).withColumn("a.b", F.lit(1))
    one, other = toxicity.fit(docs, labels), toxicity.fit(docs, labels, model_rows=0)
    assert one.arrays is not None and other.arrays is None and one.mix == other.mix and (one.base, one.slope) == pytest.approx((other.base, other.slope), rel=1e-4)
    a, b = (sorted((r.doc_id, r.score) for r in toxicity.score(docs, m).collect()) for m in (one, other))
    assert [i for i, _ in a] == [i for i, _ in b] and np.allclose([x for _, x in a], [x for _, x in b])
    a, b = (toxicity.drop_toxic(docs, m) for m in (one, other))
    assert a.columns == b.columns == docs.columns and sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(i, "bad awful " * 3 if i % 3 == 0 else "fine good words here") for i in range(200)] + [(500, None), (501, ""), (None, "bad"), (502, "x" * 5000)], DOC)
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(200)] + [(None, 1), (3, None), (4, 0)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r.score for r in toxicity.score(docs.withColumn("score", F.lit(1)), model).collect()}
    assert got[0] > 0.5 > got[1] and all(0 <= s <= 1 for s in got.values())
    assert {r.doc_id for r in toxicity.drop_toxic(docs, model).collect()} >= {1, 500, 501}
    one = toxicity.fit(docs, labels.where("toxic = 0"))
    assert all(r.score < 0.01 for r in toxicity.score(docs, one).collect())
    none = toxicity.fit(docs.limit(0), labels.limit(0))
    assert toxicity.score(docs, none).count() == 204 and toxicity.score(docs.limit(0), model).count() == 0


# pipeline


def test_pipeline_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = lambda df: sorted(map(tuple, df.select(docs.columns).collect()))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before, out = docs.collect(), stage(spark, docs, small)
        if k == 0:
            scores = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.fit(docs, spark.read.parquet(f"{small}/labels.parquet"))).collect()}
            want = [r for r in before if scores[r.doc_id] < 0.5]
        elif k == 1:
            kept = linededup.brute_force([r.text for r in before])
            got = {r.doc_id: r for r in out.collect()}
            assert [hashlib.sha256(got[r.doc_id].text.encode()).hexdigest() for r in before] == [h for *_, h in kept]
            assert all(len(r.text) == r.n_chars for r in got.values())
            want = None
        elif k == 2:
            roots = similar.brute_force({r.doc_id: r.text for r in before})
            want = [r for r in before if roots[r.doc_id] == r.doc_id]
        elif k == 3:
            items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
            want = [r for r in before if not decontam.brute_force(r.text, items)[1]]
        else:
            assert out.columns == [*docs.columns, "copies"]
            draws = [(r.doc_id, (r.source, r.size, r.u)) for r in mixing._thin(docs, "doc_id", "text", "source").collect()]
            goals = {r.source: (r.source_size, r.target) for r in mixing.plan_mix(docs).collect()}
            copies = {r.doc_id: r.copies for r in out.collect()}
            assert min(copies.values()) > 0
            brute.check_mix([x for _, x in draws], goals, {i: copies.get(d, 0) for i, (d, _) in enumerate(draws)})
            want = None
        if want is not None:
            assert rows(out) == sorted(map(tuple, want))
        docs = spark.createDataFrame(out.collect(), out.schema)
    assert corpus_pipeline.run(spark, small).count() == docs.count()
