"""The orchestrated plan, answer metrics, the stored index, sketches and further joins."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import alignment, cells, dedup, inverted, metrics, relational, retrieve, sketches
from corpusloom.plans import orchestrate

QUESTION = "query_id long, text string, vec array<double>, tenant_id long, session_id long, asked_at timestamp"
CACHE = "id string, tenant_id long, vec array<double>, created_at timestamp, answer string, citations array<struct<doc_id:string,chunk_id:string,quote:string,score:double>>, confidence string"


def at(day, hour=0):
    import datetime

    return datetime.datetime(2024, 1, day, hour)


@pytest.fixture(scope="module")
def searched(spark):
    docs = spark.createDataFrame([(i, f"word{i} common text. Second part {i}.", "s") for i in range(12)], "id long, text string, source string")
    corpus = spark.createDataFrame([(i, [math.cos(i), math.sin(i), 0.1]) for i in range(12)], "id long, vec array<double>")
    return orchestrate.searching(docs, corpus, 2)


def asked(spark, rows):
    return spark.createDataFrame([(i, text, vec, tenant, session, at(10)) for i, text, vec, tenant, session in rows], QUESTION)


def test_branches(spark, searched):
    route = lambda c: F.when(c.contains("beyond"), '{"complexity": "beyond_kb", "confidence": 0.9}').when(c.contains("hard"), '{"complexity": "complex", "confidence": 0.9}')
    rows = [
        (1, "word3", [1.0, 0.0, 0.0], 1, None),
        (2, "word5 beyond", [0.0, 1.0, 0.0], 1, None),
        (3, "hard word4 with many other words", [0.0, 0.0, 1.0], 1, 7),
        (4, "word7", [0.6, 0.8, 0.0], 1, None),
        (5, "word7", [0.6, 0.8, 0.0], 2, None),
        (6, "word9", None, 2, None),
        (7, "and she?", [0.0, 0.0, 1.0], 1, 7),
    ]
    cache = spark.createDataFrame([("a", 1, [0.6, 0.8, 0.0], at(9), "kept", [], "high"), ("b", 2, [0.6, 0.8, 0.0], at(1), "too old", [], "high"), ("a", 1, [0.6, 0.8, 0.0], at(8), "older", [], "low")], CACHE)
    history = spark.createDataFrame([(7, k, f"spoken {k}") for k in range(5)], "conv_id long, turn long, text string")
    models = orchestrate.Models(rewrite=lambda c, past: F.concat(F.lit('{"rewritten": "word2 '), F.element_at(past, -1), F.lit('", "confidence": 0.8}')), route=route)
    got = {r.query_id: r for r in orchestrate.orchestrate(asked(spark, rows), searched, cache=cache, history=history, models=models).collect()}
    assert {i: r.branch for i, r in got.items()} == {1: "direct", 2: "beyond_kb", 3: "agent", 4: "cache", 5: "direct", 6: "direct", 7: "direct"}
    assert (got[4].answer, got[4].hit, got[4].confidence, got[4].rounds) == ("kept", "a", "high", 0)
    assert got[2].answer == "word5 beyond" and got[2].citations == [] and got[2].confidence == "high"
    assert got[1].answer.startswith("word3") and got[1].citations[0].doc_id == "3" and len(got[1].citations) == 2
    assert got[3].rounds == 2 and len(got[3].citations) == 4 and got[3].citations[0].doc_id == "4" and got[3].confidence == "medium"
    assert got[6].citations and got[6].hit is None
    assert got[7].was_rewritten and got[7].citations[0].doc_id == "2" and not got[1].was_rewritten


def test_stored_indexes_find_the_same(spark):
    docs = spark.createDataFrame([(i, f"word{i % 7} common text {'x' * (i % 3)}. Second part {i}.", "s") for i in range(80)], "id long, text string, source string")
    corpus = spark.createDataFrame([(i, [math.cos(i), math.sin(i), 0.1 * (i % 4)]) for i in range(80)], "id long, vec array<double>")
    rows = asked(spark, [(1, "word3 second", [1.0, 0.0, 0.0], 1, None), (2, "text word5 part 7", [0.0, 1.0, 0.2], 1, None), (3, "nothing known", None, 1, None)]).withColumn("complexity", F.lit("simple"))
    near, index = cells.Cells.build(corpus, cells=6), inverted.Index.build(docs.select("id", "text"), block=8)
    one, other = orchestrate.searching(docs, corpus, 10), orchestrate.searching(docs, corpus, 10, near=near, index=index)
    same = lambda df: sorted((r.query_id, r.rank, r.id, round(r.final_score, 9)) for r in df.collect())
    assert same(one(rows)) == same(other(rows)) and len(same(one(rows))) == 20


def test_stream_fills_the_cache_and_reruns_agree(spark, searched, tmp_path):
    rows = [(1, "word3", [1.0, 0.0, 0.0], 1, 5), (2, "word5", [0.0, 1.0, 0.0], 1, None), (3, "word3 once more", [1.0, 0.01, 0.0], 1, 5), (4, "word3", [1.0, 0.0, 0.0], 2, None)]
    for k, some in enumerate((rows[:2], rows[2:])):
        asked(spark, some).coalesce(1).write.parquet(str(tmp_path / "in" / f"b={k}"))
    stream = spark.readStream.schema(QUESTION).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    store = orchestrate.Store(spark, str(tmp_path / "store"))
    run = orchestrate.orchestrate_stream(stream, searched, store, str(tmp_path / "out"), str(tmp_path / "at"))
    assert run.awaitTermination(300)
    read = lambda: {r.query_id: (r.branch, r.hit, r.answer, r.batch) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    got = read()
    first = {i for i, r in got.items() if r[3] == 0}
    assert len(got) == 4 and {r[3] for r in got.values()} == {0, 1}
    if first == {1, 2}:  # the files may be read in either order
        assert got[3][:2] == ("cache", "1") and got[3][2] == got[1][2] and got[4][0] == "direct"
    assert store.before("cache", 0) is None and store.before("cache", 9).count() == sum(r[0] != "cache" for r in got.values())
    said = store.before("sessions", 9).orderBy("turn").collect()
    assert [r.role for r in said][:2] == ["user", "assistant"] and {r.conv_id for r in said} == {5}
    # a batch that runs again after a failure sees what it saw before
    orchestrate.answer_batch(asked(spark, rows[2:] if first == {1, 2} else rows[:2]), 1, searched, store, str(tmp_path / "out"))
    assert read() == got


def test_compacted_store_keeps_its_rows(spark, tmp_path):
    store = orchestrate.Store(spark, str(tmp_path))
    for k in range(5):
        store.put("cache", spark.createDataFrame([(k, "a"), (k, "b")], "batch_id int, x string"), k)
    rows = lambda k: sorted(map(tuple, store.before("cache", k).collect()))
    want = {k: rows(k) for k in (4, 5)}
    store.compact("cache", 3)
    assert sorted(p.name for p in (tmp_path / "cache").iterdir()) == ["batch=3", "batch=4", "merged=2"]
    assert {k: rows(k) for k in (4, 5)} == want and len(want[5]) == 10
    store.put("cache", spark.createDataFrame([(9, "left over")], "batch_id int, x string"), 1)  # of a compaction that broke off
    (tmp_path / "cache" / "merged=3").mkdir()  # begun, not whole
    assert {k: rows(k) for k in (4, 5)} == want
    store.compact("cache", 5)
    assert rows(5) == want[5] and [p.name for p in (tmp_path / "cache").iterdir() if p.name.startswith("b")] == []
    store.compact("other", 5)


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(max(new[-1], row[j + 1], row[j] + 1 if x == y else 0))
        row = new
    return row[-1]


def test_common_subsequence(spark):
    rnd = random.Random(4)
    pairs = [([rnd.choice("abcd") for _ in range(rnd.randint(0, 9))], [rnd.choice("abcde") for _ in range(rnd.randint(0, 12))]) for _ in range(200)]
    df = spark.createDataFrame([(k, *p) for k, p in enumerate(pairs)], "k int, a array<string>, b array<string>")
    got = {r.k: r.n for r in df.select("k", alignment.common_subsequence(F.col("a"), F.col("b")).alias("n")).collect()}
    assert all(got[k] == lcs(*p) for k, p in enumerate(pairs))


def test_answer_metrics(spark):
    text = "the cat sat on the mat. dogs bark at night."
    cases = spark.createDataFrame(
        [
            (1, "where did the cat sit", text, [text, "nothing of use here"], text),
            (2, "where", "stars shine. the cat sat on the mat.", ["nothing of use here", text], None),
            (3, "cat", "", ["the cat"], "the cat sat on the mat."),
            (4, None, None, None, "  "),
        ],
        "case_id int, question string, answer string, contexts array<string>, truth string",
    )
    got = {r.case_id: r for r in alignment.scores(cases).collect()}
    assert [got[1][m] for m in alignment.METRICS] == pytest.approx([1, got[1].answer_relevancy, 1, 1, 1]) and 0 < got[1].answer_relevancy < 1
    assert (got[2].faithfulness, got[2].context_precision, got[2].context_recall, got[2].answer_correctness) == (0.5, 0.5, None, None)
    assert got[3].faithfulness is None and got[3].answer_correctness == 0
    assert (got[4].faithfulness, got[4].context_precision, got[4].context_recall) == (None, 0, None)
    assert alignment.long(alignment.scores(cases)).count() == 20


@pytest.mark.parametrize("block", [3, 64])
def test_index_equals_scoring_everything(spark, small, block):
    rnd = random.Random(2)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(rnd.choices(words, weights=[1 / (k + 1) for k in range(60)], k=rnd.randint(0, 40)))) for i in range(300)] + [(900, None), (901, ""), (902, "w1 w1 w1")] + [(1000 + i, "w5 w6") for i in range(30)]
    docs = spark.createDataFrame(rows, "id long, text string").repartition(3)
    queries = spark.createDataFrame([(1, "w5 w6 w59"), (2, "w1"), (3, "unknown"), (4, "w58 w57 w56 w0"), (5, "")], "query_id long, text string")
    index = inverted.Index.build(docs, block=block)
    for k in (1, 5, 50):
        want = sorted((r.query_id, r.rank, r.id, round(r.score, 6)) for r in retrieve.bm25(queries, docs, k).collect())
        for skip in (True, False):
            read = inverted.Read()
            got = sorted((r.query_id, r.rank, r.id, round(r.score, 6)) for r in index.search(queries, k, read, skip=skip).collect())
            assert got == want and 0 < read.read <= read.possible
            assert skip or read.read == read.possible
        if block == 3 and k == 1:
            index.search(queries, k, read)
            assert read.read < read.possible
    again = inverted.Index(spark, index.folder)
    assert (again.n, again.mean) == (index.n, index.mean) and again.terms.where("term = 'w5'").first().df > 30
    index.drop()


def test_index_of_nothing(spark):
    index = inverted.Index.build(spark.createDataFrame([], "id long, text string"))
    assert index.search(spark.createDataFrame([(1, "a")], "query_id long, text string")).count() == 0


def test_bucket_quantiles(spark):
    rows = [("a", "1.0", 10), ("a", "2.0", 30), ("a", "+Inf", 40), ("b", "1.0", 0), ("b", "+Inf", 0), ("c", "5.0", 3), ("d", "-1.0", 4), ("d", "+Inf", 4), ("e", "1.0", 0), ("e", "2.0", 0), ("e", "4.0", 8), ("e", "+Inf", 8)]
    hist = spark.createDataFrame(rows + [("a", "1.0", 10), ("a", "2.0", 10), ("a", "+Inf", 10)], "k string, le string, n long")
    got = {r.k: (r.n, r["p50"], r["p90"]) for r in metrics.bucket_quantiles(hist, ["k"], (0.5, 0.9)).collect()}
    assert got["a"] == (50, pytest.approx(1 + (25 - 20) / 20), 2.0)
    assert got["b"] == (0, None, None) and got["c"][1:] == (None, None) and got["d"] == (4, -1.0, -1.0)
    assert got["e"] == (8, 3.0, pytest.approx(2 + 2 * 0.9))


def test_sketches_merge(spark):
    rows = spark.range(20000).select((F.col("id") % 7).alias("day"), (F.col("id") % 3000).alias("user"), (F.col("id") % 1000).cast("double").alias("v"))
    days = sketches.states(rows, ["day"], "user", "v")
    one = sketches.read(sketches.merged(days.withColumn("all", F.lit(1)), ["all"]), (0.1, 0.9)).first()
    assert one.n == 20000 and abs(one.distinct - 3000) < 90 and abs(one.quantiles[0] - 100) < 20 and abs(one.quantiles[1] - 900) < 20
    assert days.count() == 7 and abs(days.select(sketches.rank(days, 499.0).alias("r")).first().r - 0.5) < 0.02
    assert sketches.read(sketches.merged(days, ["day"], rollup=True), (0.5,)).count() == 8


def test_merged_sketches_count_as_the_whole(spark):
    """In one part the whole's sketch is never merged; it estimates what the days' merged ones do."""
    rows = spark.range(60000, numPartitions=1).select((F.col("id") % 10).alias("day"), F.lit(1).alias("all"), (F.col("id") * 7919 % 8999).alias("user"), F.lit(0.0).alias("v"))
    days = sketches.read(sketches.merged(sketches.states(rows, ["day", "all"], "user", "v"), ["all"]), (0.5,)).first()
    assert days.distinct == sketches.read(sketches.states(rows, ["all"], "user", "v"), (0.5,)).first().distinct


def test_overlapping_intervals(spark):
    rnd = random.Random(8)
    length = lambda: rnd.choice([0, 0.5, 1, 3, 17, 400, 100000])
    sides = [[(i, rnd.choice("xy"), s, s + length()) for i in range(150) for s in [rnd.choice([rnd.uniform(-50, 50), float(rnd.randint(-20, 20))])]] for _ in range(2)]
    sides[0] += [(500, "x", None, 3.0), (501, "x", 1.0, None), (502, None, 0.0, 1.0), (503, "x", 5.0, 2.0)]
    a, b = (spark.createDataFrame(s, "id int, k string, low double, high double") for s in sides)
    got = [(r.a.id, r.b.id) for r in relational.overlapping(a, b, "low", "high", ("k",)).collect()]
    meet = lambda p, q: None not in p and None not in q and p[1] == q[1] and p[2] < p[3] and q[2] < q[3] and p[2] < q[3] and q[2] < p[3]
    want = [(p[0], q[0]) for p in sides[0] for q in sides[1] if meet(p, q)]
    assert sorted(got) == sorted(want) and len(want) > 3000
    assert relational.overlapping(a, b, "low", "high", unit=8.0).count() > len(want)


def test_overlapping_by_the_comparisons_alone(spark):
    rnd = random.Random(9)
    length = lambda: rnd.choice([0, 0, -2, -300, 0.5, 3, 17, 400])
    sides = [[(i, s, s + length()) for i in range(150) for s in [rnd.choice([rnd.uniform(-50, 50), float(rnd.randint(-20, 20))])]] + [(500, None, 3.0), (501, 1.0, None)] for _ in range(2)]
    a, b = (spark.createDataFrame(s, "id int, low double, high double") for s in sides)
    got = [(r.a.id, r.b.id) for r in relational.overlapping(a, b, "low", "high", unit=2.0, empty=True).collect()]
    want = [(p[0], q[0]) for p in sides[0] for q in sides[1] if None not in p and None not in q and p[1] < q[2] and q[1] < p[2]]
    assert sorted(got) == sorted(want)
    assert any(sides[0][x][1] >= sides[0][x][2] for x, _ in want) and len(want) > 3000


def test_kept_first_equals_a_pass_in_order(spark):
    rnd = random.Random(3)
    pairs = {tuple(sorted(rnd.sample(range(120), 2))) for _ in range(150)} | {(i, i + 1) for i in range(200, 215)}
    dropped, of = set(), {}
    for i in range(220):
        near = sorted(a for a, b in pairs if b == i and a not in dropped)
        if near:
            dropped.add(i)
            of[i] = near[0]
    rows = dedup.kept_first(spark.range(220).withColumnRenamed("id", "doc_id"), spark.createDataFrame([*pairs, (3, 3)][:-1], "a long, b long"))
    got = {r.doc_id: (r.kept, r.of) for r in rows.collect()}
    assert got == {i: (i not in dropped, of.get(i)) for i in range(220)}
    alone = dedup.kept_first(spark.range(3).withColumnRenamed("id", "doc_id"), spark.createDataFrame([], "a long, b long"))
    assert sorted(map(tuple, alone.collect())) == [(0, True, None), (1, True, None), (2, True, None)]


def test_kept_documents_with_copies(spark):
    prints = [0, 0, 7, 7, 63, 0, 1 << 40]  # 0 and 7 are three bits apart, 7 and 63 too
    rows = dedup.kept_documents(spark.createDataFrame([(i, p) for i, p in enumerate(prints)], "doc_id long, fp long")).collect()
    assert {r.doc_id: (r.kept, r.of) for r in rows} == {0: (True, None), 1: (False, 0), 2: (False, 0), 3: (False, 0), 4: (True, None), 5: (False, 0), 6: (False, 0)}
    assert np.all([r.kept is not None for r in rows])


def recall(index, queries, corpus, k, reach):
    read = inverted.Read()
    want = {(r.query_id, r.id) for r in retrieve.dense(queries, corpus, k).collect()}
    got = {(r.query_id, r.id) for r in index.search(queries, k, reach, read).collect()}
    return len(want & got) / len(want), read.read / read.possible


def test_cells_of_clustered_vectors(spark, monkeypatch):
    monkeypatch.setattr(cells, "PART_ROWS", 70)
    rnd = np.random.default_rng(5)
    centres = rnd.normal(size=(20, 16))
    rows = [(i, (centres[i % 20] + 0.25 * rnd.normal(size=16)).tolist()) for i in range(2000)] + [(5000, [0.0] * 16), (5001, None)] + [(6000 + i, centres[0].tolist()) for i in range(300)]
    corpus = spark.createDataFrame(rows, "id long, vec array<double>").repartition(3)
    queries = spark.createDataFrame([(i, rows[i * 7][1]) for i in range(30)] + [(100, [0.0] * 16), (101, None)], "query_id long, vec array<double>")
    index = cells.Cells.build(corpus, cells=30)
    whole, share = recall(index, queries, corpus, 10, 1.0)
    assert whole == 1.0 and share < 0.4
    some, fewer = recall(index, queries, corpus, 10, 0.75)
    assert some >= 0.95 and fewer <= share
    same = lambda df: sorted((r.query_id, r.rank, r.id, round(r.score, 6)) for r in df.collect())
    assert same(index.search(queries, 10)) == same(retrieve.dense(queries, corpus, 10))
    monkeypatch.setattr(cells, "QUERY_ROWS", 4)
    assert same(cells.Cells(spark, index.folder).search(queries, 10)) == same(retrieve.dense(queries, corpus, 10))
    index.drop()


def test_cells_of_the_embeddings(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    corpus = table.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    queries = table.where("vec_id % 40 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec"))
    index = cells.Cells.build(corpus, cells=200)
    found, share = recall(index, queries, corpus, 50, 0.0)
    assert found >= 0.95 and share <= 1.0


def test_cells_of_nothing(spark):
    index = cells.Cells.build(spark.createDataFrame([], "id long, vec array<double>"))
    assert index.search(spark.createDataFrame([(1, [1.0])], "query_id long, vec array<double>"), 3).count() == 0
