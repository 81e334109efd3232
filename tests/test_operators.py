"""Operators on small tables that are worked out by hand, and properties."""

import itertools

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.operators import agent, chunking, dedup, evaluate, index, registry, relational, retrieve


def lists(spark, rows):
    return spark.createDataFrame(rows, "query_id int, source string, pos int, id string, rank int, score double")


def test_fusion_scores(spark):
    rows = lists(spark, [(1, "bm25", 0, "c1", 1, 9.0), (1, "dense", 1, "c1", 2, 0.5), (1, "dense", 1, "c2", 1, 0.9), (2, "dense", 1, "x", 1, None)])
    got = {(r.query_id, r.id): r for r in retrieve.fused(rows, F.lit(30)).collect()}
    assert got[1, "c1"].sources == ["bm25", "dense"] and got[1, "c1"].rank == 1
    assert got[1, "c1"].individual_scores == {"bm25": 9.0, "dense": 0.5}
    assert got[2, "x"].rrf_score == pytest.approx(1 / 31)
    assert retrieve.fused(rows.where("query_id = 2")).first().rrf_score == pytest.approx(1 / 61)


def test_fusion_does_not_depend_on_row_order(spark):
    rows = [(1, "a", 0, "x", 1, 1.0), (1, "b", 1, "x", 2, 2.0), (1, "b", 1, "y", 1, 3.0)]
    every = [sorted(map(str, retrieve.fused(lists(spark, list(p))).collect())) for p in itertools.permutations(rows)]
    assert all(x == every[0] for x in every)


def test_fusion_constants(spark):
    got = spark.range(1).select(*[retrieve.fusion_k(F.lit(c)).alias(str(c)) for c in ("simple", "moderate", "complex", "beyond_kb", "odd", None)]).first()
    assert tuple(got) == (30, 60, 90, 60, 60, 60)


def test_rerank_takes_the_best_and_falls_back(spark):
    rows = spark.createDataFrame([(1, f"c{i}", i / 10, 0.0) for i in range(10)] + [(2, "a", None, 0.2), (2, "b", None, 0.3)], "query_id int, id string, rerank_score double, rrf_score double")
    got = retrieve.reranked(rows, 3).orderBy("query_id", "rank").collect()
    assert [r.id for r in got if r.query_id == 1] == ["c9", "c8", "c7"]
    assert [r.id for r in got if r.query_id == 2] == ["b", "a"]


def test_coverage_reads_2000_characters(spark):
    q = spark.createDataFrame([(1, "alpha")], "query_id int, text string")
    docs = spark.createDataFrame([(1, "near", "alpha"), (1, "far", "x " * 1200 + "alpha")], "query_id int, id string, text string")
    got = {r.id: r.rerank_score for r in retrieve.coverage(q, docs).collect()}
    assert got == {"near": 1.0, "far": 0.0}


def test_dense_blocks_agree(spark, small, monkeypatch):
    corpus = spark.read.parquet(f"{small}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    queries = corpus.where("id < 40").select(F.col("id").alias("query_id"), "vec")
    whole = sorted(map(tuple, retrieve.dense(queries, corpus, 5).select("query_id", "id", "rank").collect()))
    monkeypatch.setattr(retrieve, "QUERY_ROWS", 7)
    assert sorted(map(tuple, retrieve.dense(queries, corpus, 5).select("query_id", "id", "rank").collect())) == whole
    assert all(q == i for q, i, r in whole if r == 1)


def test_tenant_is_mandatory(spark):
    rows = spark.createDataFrame([("default", 1), ("a", 2), ("a", 3)], "tenant_id string, k int")
    assert [r.k for r in index.tenant_scan(rows, " ").collect()] == [1]
    assert [r.k for r in index.tenant_scan(rows, "a", {"k": [3, 4]}).collect()] == [3]
    with pytest.raises(TypeError):
        index.tenant_scan(rows, "a", "k = 1")


def test_index_is_saved_by_tenant(spark, tmp_path):
    path = str(tmp_path / "index")
    index.save(spark.createDataFrame([("a", 1), ("b", 2)], "tenant_id string, k int"), path)
    index.save(spark.createDataFrame([("b", 3)], "tenant_id string, k int"), path)
    assert sorted((r.tenant_id, r.k) for r in spark.read.parquet(path).collect()) == [("a", 1), ("b", 3)]


def test_simhash_of_short_and_equal_texts(spark):
    rows = spark.createDataFrame([(1, "ab"), (2, "hello world " * 5), (3, "hello  world " * 5), (4, None)], "doc_id int, text string")
    got = {r.doc_id: r.fp for r in dedup.fingerprints(rows).collect()}
    assert got[1] == got[4] == 0 and got[2] == got[3] != 0


def test_bands_find_all_near_pairs(spark, small):
    fps = dedup.fingerprints(spark.read.parquet(f"{small}/documents.parquet"))
    one = {}
    for r in fps.orderBy("doc_id").collect():
        one.setdefault(r.fp, r.doc_id)
    mask = (1 << 64) - 1
    want = {(min(i, j), max(i, j)) for (a, i), (b, j) in itertools.combinations(one.items(), 2) if ((a ^ b) & mask).bit_count() <= 3}
    assert {(r.a, r.b) for r in dedup.near_pairs(fps).collect()} == want


def plain_pieces(s, size):
    """The rules on strings, one part at a time; slow."""
    tokens = chunking.estimated_tokens
    if tokens(s) <= size:
        return [s]
    for sep in chunking.SEPARATORS:
        out, now = [], ""
        for part in s.split(sep) if sep in s else []:
            if now and tokens(now + sep + part) <= size:
                now += sep + part
                continue
            out += [now] if now else []
            now = part
            if tokens(part) > size:
                inner = plain_pieces(part, size) or [""]
                out, now = out + inner[:-1], inner[-1]
        out = [x.strip() for x in out + [now] * bool(now)]
        if len(out) > 1:
            return [x for x in out if x]
    return [" ".join(s.split()[: 2 * size])]


@settings(deadline=None, max_examples=300)
@given(st.lists(st.sampled_from(["\n\n", "\n", ". ", " ", "a", "bcd", "中文", "\t", "   ", "word"]), max_size=150).map("".join), st.integers(2, 30), st.integers(1, 8))
def test_chunks_equal_the_rules(s, size, least):
    pieces = plain_pieces(s, size)
    assert chunking.Splitter(s, size).pieces() == pieces
    chunks, dropped, lost = chunking.chunks_of(s, size, least)
    assert all(chunking.estimated_tokens(c) >= least for _, c in chunks)
    assert [i for i, _ in chunks] == sorted({i for i, _ in chunks})
    small = [p for p in pieces if chunking.estimated_tokens(p) < least]
    assert dropped <= len(small) and lost >= 0
    words = "".join(s.split())
    assert all(w in words for _, c in chunks for w in c.split())


def test_chunk_rules():
    long = "a" * 400
    pieces = lambda s, size: chunking.Splitter(s, size).pieces()
    assert pieces("short", 10) == ["short"]
    assert pieces("aaaa aaaa\nbbbb bbbb", 3) == ["aaaa aaaa", "bbbb bbbb"]
    assert pieces(long, 10) == [long]  # nothing cuts it
    small = "x" * 40
    assert chunking.chunks_of("\n".join([long, small]), 100, 20)[0] == [(0, long + "\n\n" + small)]
    assert chunking.chunks_of(small, 100, 20) == ([], 1, 0)
    assert chunking.chunks_of("\t".join("w" * 30), 3, 1)[2] == 24  # six words stay


def test_chunk_table_function(spark):
    rows = spark.createDataFrame([(1, "word " * 3000), (2, ""), (3, None)], "doc_id int, text string")
    got = chunking.recursive_chunks(rows, 100, 10).collect()
    assert {r.doc_id for r in got} == {1} and all(10 <= r.token_count <= 150 for r in got)
    assert got[0].chunk_id == "1_chunk_0"
    assert sorted(map(tuple, chunking.losses(rows, 100, 10).collect()))[1:] == [(2, 0, 1, 0), (3, 0, 1, 0)]
    spark.udtf.register("chunk_text", chunking.ChunkText)
    again = spark.sql("SELECT d.doc_id, c.* FROM {rows} d, LATERAL chunk_text(d.text, 100, 10) c", rows=rows).collect()
    assert sorted((r.doc_id, r.chunk_index, r.chunk_text) for r in again) == sorted((r.doc_id, r.chunk_index, r.text) for r in got)


def test_retrieval_with_text_ids_and_blocks(spark, small, monkeypatch):
    docs = spark.read.parquet(f"{small}/documents.parquet").select(F.concat(F.lit("d"), "doc_id").alias("id"), "text")
    asked = spark.read.parquet(f"{small}/benchmark.parquet").select(F.concat(F.lit("q"), "item_id").alias("query_id"), "text")
    rows = lambda: sorted((r.query_id, r.id, r.rank, round(r.score, 5)) for r in retrieve.bm25(asked, docs, 4).collect())
    whole = rows()
    monkeypatch.setattr(retrieve, "QUERY_ROWS", 9)
    monkeypatch.setattr(retrieve, "ROWS", 17)
    assert rows() == whole and len(whole) == 4 * asked.count()
    assert retrieve.bm25(asked.limit(0), docs).count() == retrieve.bm25(asked, docs.limit(0)).count() == 0
    vecs = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 0.0]), ("c", None), ("d", [2.0, 0.1])], "id string, vec array<double>")
    got = retrieve.dense(vecs.where("id <> 'b'").select(F.col("id").alias("query_id"), "vec"), vecs, 2)
    assert sorted((r.query_id, r.id, r.rank) for r in got.collect()) == [("a", "a", 1), ("a", "d", 2), ("d", "a", 2), ("d", "d", 1)]


def test_documents_that_hold_an_item(spark):
    docs = [(1, "x one two three four five six seven y"), (2, "prone two three four five six sevens"), (3, "one  two three four five six seven"), (4, "ab"), (5, None), (6, "one two\nthree"), (7, "")]
    items = [(10, "one two three four five six seven"), (11, "ab"), (12, "one two"), (13, "two\nthr"), (14, ""), (15, None), (16, "one two three")]
    got = evaluate.containing(spark.createDataFrame(docs, "id int, text string"), spark.createDataFrame(items, "query_id int, item string"))
    want = {(q, i) for q, x in items if x for i, t in docs if t and x in t}
    assert {(r.query_id, r.id) for r in got.collect()} == want


def test_running_maximum(spark):
    from corpusloom.streaming import windows

    values = [(i, (i * 7919) % 101) for i in range(3, 400, 3)]
    got = {r.k: r.top for r in windows.running_max(spark.createDataFrame(values, "k long, v int"), "k", "v", "top", block=5).collect()}
    assert got == {k: max((v for j, v in values if j < k), default=None) for k, _ in values}


def test_index_is_declared_once_and_checks_vectors(spark):
    name = "declared_index"
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    assert index.declare(spark, name, 2) and not index.declare(spark, name, 3)
    assert index.declared(spark, name) == {"vector_size": "2", "distance": "cosine"}
    rows = spark.createDataFrame([(1, [1.0, 2.0])], "k int, embedding array<float>")
    assert index.checked(rows, 2).first().embedding == [1.0, 2.0]
    for bad in (rows, spark.createDataFrame([(1, None)], rows.schema)):
        with pytest.raises(Exception, match="vector of 3 expected"):
            index.checked(bad, 3).collect()
    with pytest.raises(ValueError):
        index.declare(spark, "other_index", 2, "odd")
    spark.sql(f"DROP TABLE {name}")


def test_model_is_asked_again_unless_the_error_is_final(spark):
    from corpusloom.plans import model

    def call(prompt):
        if prompt == "value":
            raise ValueError("no")
        if prompt == "down":
            raise TimeoutError
        return f'{{"answer": "{prompt}!", "confidence": "high"}}'

    rows = spark.createDataFrame([("a",), ("value",), ("down",), (None,)], "prompt string")
    got = {r.prompt: (r.reply.answer, r.reply.ok) for r in model.asked(rows, "prompt", model.calling(call), F.lit("rule")).collect()}
    assert got == {"a": ("a!", True), "value": ("rule", False), "down": ("rule", False), None: ("rule", False)}


def test_tools(spark):
    from corpusloom.operators import tools

    own = tools.standard(lambda q: F.concat(F.lit("found "), q)).register("calculator", "new", lambda x: F.lit("42"))
    assert own.names() == ["retrieve", "calculator", "datetime"] and [x["function"]["name"] for x in own.schema()] == own.names()
    rows = spark.createDataFrame([("retrieve", "x"), ("calculator", "1+1"), ("odd", "y"), (None, None)], "name string, argument string")
    assert [r.v for r in rows.select(own.call(F.col("name"), F.col("argument")).alias("v")).collect()] == ["found x", "42", tools.UNKNOWN + "odd", tools.UNKNOWN]


def test_calculator_writes_numbers_as_sql_does(spark):
    import duckdb

    from corpusloom.operators import tools

    asked = [("6000000", "+", "6000000"), ("9999999", "*", "1"), ("1", "/", "3"), ("1", "/", "8000"), ("1", "/", "80000"), ("9999999999", "*", "9999999999"), ("1234567890123456", "*", "10"), ("0", "-", "20000000"), ("0.1", "+", "30318594544552592")]
    rows = spark.createDataFrame([(" ".join(x),) for x in asked] + [("1e7 + 1",), ("1 / 0",)], "a string")
    got = {r.a: r.v for r in rows.select("a", tools.standard().call(F.lit("calculator"), F.col("a")).alias("v")).collect()}
    want = {" ".join(x): duckdb.connect().sql(f"select ({x[0]}::double {x[1]} {x[2]}::double)::varchar").fetchall()[0][0] for x in asked}
    assert got == want | {"1e7 + 1": None, "1 / 0": None}



def test_scratch_needs_a_shared_folder_on_a_cluster(spark, monkeypatch):
    from corpusloom.operators import tables

    class Context:
        master, applicationId = "spark://host:7077", "x"  # noqa: N815

        def getCheckpointDir(self):  # noqa: N802
            return None

    class Session:
        sparkContext = Context()  # noqa: N815
        conf = type("C", (), {"get": staticmethod(lambda k, d: None)})

    with pytest.raises(ValueError):
        tables.scratch(Session())
    Context.master = "local[2]"
    assert tables.scratch(Session())
    one = tables.written(spark.range(3), "t")
    path = one.inputFiles()[0]
    tables.dropped(one)
    import os

    assert not os.path.exists(path.removeprefix("file://"))


def test_registry_versions_and_updates(spark):
    rows = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "id int, v int, s string")
    now = registry.latest(rows, ["id"], "v")
    assert sorted((r.id, r.s) for r in now.collect()) == [(1, "b"), (2, "c")]
    ups = spark.createDataFrame([(2, None, 9), (7, "z", 9)], "id int, s string, v int")
    assert sorted((r.id, r.s, r.v) for r in registry.updated(now, ups, "id", ["s", "v"]).collect()) == [(1, "b", 2), (2, "c", 9)]


def test_cache_hits_and_misses(spark):
    q = spark.sql("select 1 as query_id, 'a' as tenant_id, array(1d, 0d) as vec, timestamp'2024-01-08' as asked_at union all select 2, 'b', array(0d, 1d), timestamp'2024-01-08'")
    e = spark.sql("select 5 as id, 'a' as tenant_id, array(1d, 0.3d) as vec, timestamp'2024-01-05' as created_at union all select 6, 'a', array(1d, 0d), timestamp'2023-12-05' union all select 7, 'b', array(1d, 0d), timestamp'2024-01-05'")
    assert [(r.query_id, r.hit) for r in registry.cache_lookup(q, e).collect()] == [(1, 5)]


def test_reports(spark):
    rows = spark.createDataFrame([(1, "faithfulness", 0.9), (1, "answer_relevancy", 0.8), (2, "faithfulness", 0.5), (2, "answer_relevancy", None), (3, "faithfulness", None)], "case_id int, metric string, score double")
    got = {r.case_id: (r.passed, r.weakest) for r in evaluate.case_report(rows).collect()}
    assert got == {1: (True, "answer_relevancy"), 2: (False, "faithfulness"), 3: (False, None)}
    report = evaluate.ci_fails(evaluate.batch_report(rows)).first()
    assert (report.total, report.passed, report.regression, report.weakest, report.fails) == (3, 1, True, "faithfulness", True)


def test_gate(spark):
    runs = spark.createDataFrame([("a", "p", 1, 0.9), ("b", "p", 2, 0.86), ("c", "p", 3, 0.7), ("d", "q", 4, 0.1)], "run_id string, prompt_hash string, started_at int, m double")
    got = {r.run_id: (r.previous_id, r.passed) for r in evaluate.diff_gate(runs, ["m"]).collect()}
    assert got == {"a": (None, True), "b": ("a", True), "c": ("b", False), "d": (None, True)}


def test_ranking_metrics(spark):
    ranked = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "x", 1)], "query_id int, id string, rank int")
    relevant = spark.createDataFrame([(1, "b"), (3, "z")], "query_id int, id string")
    got = {r.query_id: (r.recall, r.mrr, round(r.ndcg, 4)) for r in evaluate.ir_metrics(ranked, relevant).collect()}
    assert got == {1: (1.0, 0.5, 0.6309), 3: (0.0, 0.0, 0.0)}


def test_agent_loop_is_bounded(spark):
    questions = spark.createDataFrame([(1, "a"), (2, "b")], "query_id int, text string")
    think = lambda q, k: q.withColumns({"action": F.lit("retrieve"), "confidence": F.when((F.col("query_id") == 1) & (F.lit(k) > 0), 0.9).otherwise(0.1)})
    ended, found = agent.run(questions, think, lambda q: q.select("query_id"), rounds=3)
    assert sorted(map(tuple, ended.collect())) == [(1, "finish", 1, 0.9), (2, "max_iter", 3, 0.1)]
    assert sorted((r.query_id, r.round) for r in found.collect()) == [(1, 0), (2, 0), (2, 1), (2, 2)]


def test_agent_sees_what_it_found(spark):
    questions = spark.createDataFrame([(1, "a"), (2, "b")], "query_id int, text string")

    def think(q, k):
        enough = F.col("observation") == "a found"
        return q.withColumns({"action": F.when(enough, "finish").otherwise("retrieve"), "confidence": F.lit(0.5), "text": F.concat("text", F.lit(k))})

    seen = lambda rows: rows.where("query_id = 1").select("query_id", F.lit("a found").alias("observation"))
    ended, found = agent.run(questions, think, lambda q: q.select("query_id", "text"), 3, seen)
    assert sorted((r.query_id, r.node, r.round) for r in ended.collect()) == [(1, "finish", 1), (2, "max_iter", 3)]
    assert sorted((r.query_id, r.text) for r in found.collect()) == [(1, "a0"), (2, "b0"), (2, "b01"), (2, "b012")]


def test_as_of_and_range(spark):
    left = spark.createDataFrame([(1, 5), (1, 1), (2, 9)], "k int, t int")
    right = spark.createDataFrame([(1, 2, 20), (1, 5, 50)], "k int, t int, v int")
    got = {(r.k, r.t): r.v for r in relational.as_of(left, right, "k", "t", "v").collect()}
    assert got == {(1, 5): 50, (1, 1): None, (2, 9): None}
    points = spark.createDataFrame([(x / 2,) for x in range(20)], "x double")
    ranges = spark.createDataFrame([(1, 1.0, 3.5), (2, 9.0, 9.5)], "r int, a double, b double")
    assert sorted((r.r, r.x) for r in relational.in_range(points, ranges, "x", "a", "b", 1.0).collect()) == [(1, 1.0), (1, 1.5), (1, 2.0), (1, 2.5), (1, 3.0), (2, 9.0)]


def test_counts_in_range_make_no_pairs(spark):
    points = spark.createDataFrame([(0.0,), (1.0,), (1.0,), (1.5,), (2.5,), (None,), (-7.0,), (30.0,)], "x double")
    ranges = spark.createDataFrame([(1, 1.0, 2.5), (2, 9.0, 40.0), (3, 5.0, 6.0), (4, 2.5, 1.0), (5, 1.0, 2.5), (6, None, 3.0), (7, -8.0, 1.0), (8, 1.0, 1.0)], "r int, a double, b double")
    got = relational.counts_in_range(points, ranges, "x", "a", "b").collect()
    assert sorted((r.r, r.a, r.b, r.n) for r in got) == [(1, 1.0, 2.5, 3), (2, 9.0, 40.0, 1), (5, 1.0, 2.5, 3), (7, -8.0, 1.0, 2)]
    assert relational.counts_in_range(points.limit(0), ranges, "x", "a", "b").count() == 0
    # 9 * 10^10 pairs
    many = spark.range(300_000).select((F.col("id") / 1e6).alias("x"))
    wide = spark.range(300_000).select((-1 - F.col("id")).alias("a"), (1 + F.col("id")).alias("b"))
    assert relational.counts_in_range(many, wide, "x", "a", "b").agg(F.count("*"), F.sum("n")).first() == (300_000, 300_000**2)
