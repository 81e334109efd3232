"""Functions on values that are worked out by hand."""

import uuid

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import calc, signals, text, vectors
from corpusloom.operators import metrics
from corpusloom.sources.settings import Settings, prompts


def one(spark, kind, *values):
    names = [x.split()[0] for x in kind.split(", ")]
    return spark.createDataFrame([values], kind), names


def value(spark, column, kind="x string", *values):
    df, _ = one(spark, kind, *(values or (None,)))
    got = df.select(column.alias("v")).first()["v"]
    return got.asDict() if hasattr(got, "asDict") else got


@pytest.mark.parametrize("s, n", [("", 0), (None, 0), ("abcd", 1), ("abcdefg", 1), ("中文字符", 2), ("中 a", 1)])
def test_token_count(spark, s, n):
    assert value(spark, text.token_count(F.col("x")), "x string", s) == n


@pytest.mark.parametrize("s, t", [("# A b\nx", "A b"), ("x\n# A", "stem"), ("", "stem")])
def test_title_only_from_the_first_line(spark, s, t):
    assert value(spark, text.title(F.col("x"), F.lit("stem")), "x string", s) == t


def test_headings_and_units(spark):
    s = "# One\ntext\n### Three\n\n\n\n  para  \n#no"
    assert [tuple(x) for x in value(spark, text.headings(F.col("x")), "x string", s)] == [(1, "One"), (3, "Three")]
    assert value(spark, text.text_units(F.col("x")), "x string", s) == ["# One\ntext\n### Three", "para  \n#no".strip()]


def test_html(spark):
    s = "<style>p{}</style><p>a <a class='x' href=\"u\">b</a><img src='i'></p><script>x<y</script><!-- c --> d"
    assert value(spark, text.html_to_text(F.col("x")), "x string", s) == "a [b](u) d"


@pytest.mark.parametrize("s", ["a", "documents/1", "é"])
def test_uuid5(spark, s):
    assert value(spark, text.uuid5(F.col("x")), "x string", s) == str(uuid.uuid5(uuid.NAMESPACE_DNS, s))


def test_decoding_falls_back_to_gbk(spark):
    assert value(spark, text.decoded(F.col("x")), "x binary", "中文".encode("gbk")) == "中文"
    assert value(spark, text.decoded(F.col("x")), "x binary", "中文é".encode()) == "中文é"


@pytest.mark.parametrize("s, n", [("ab", []), ("a b\nc d", ["abc", "bcd"]), (None, [])])
def test_char_ngrams(spark, s, n):
    assert (value(spark, text.char_ngrams(F.col("x")), "x string", s) or []) == n


@pytest.mark.parametrize("t, norm, suffix", [(None, "default", "_tdefault"), ("  ", "default", "_tdefault"), (" a ", " a ", "_ta"), ("A/b-c_1!", "A/b-c_1!", "_tAb-c_1")])
def test_tenants(spark, t, norm, suffix):
    assert value(spark, text.tenant_norm(F.col("x")), "x string", t) == norm
    assert value(spark, text.tenant_sanitized(F.col("x")), "x string", t) == suffix


@pytest.mark.parametrize(
    "q, pronoun, hop, quote, entities",
    [
        ("他的合同", True, False, False, 0),
        ("What is it?", True, False, False, 1),
        ("Compare Apple Inc and Google", False, True, False, 2),
        ('say "x"', False, False, True, 0),
        ("清华大学和北京银行的关系", False, True, False, 2),
        ("“curly”", False, False, False, 0),
        ("", False, False, False, 0),
        (None, False, False, False, 0),
    ],
)
def test_signals(spark, q, pronoun, hop, quote, entities):
    got = value(spark, F.struct(*[c.alias(n) for n, c in signals.signals(F.col("x")).items()]), "x string", q)
    assert (got["has_pronoun"], got["is_multi_hop"], got["has_quote"], got["entity_count"], got["query_length"]) == (pronoun, hop, quote, entities, len(q or ""))


@pytest.mark.parametrize("length, pronoun, hop, entities, hint", [(10, False, False, 0, "simple"), (8, True, False, 0, "moderate"), (50, False, True, 3, "complex"), (25, False, False, 1, "moderate")])
def test_hint(spark, length, pronoun, hop, entities, hint):
    assert value(spark, signals.complexity_hint(F.lit(pronoun), F.lit(hop), F.lit(entities), F.lit(length))) == hint


@pytest.mark.parametrize(
    "reply, complexity, confidence",
    [
        ('{"complexity": "simple", "confidence": 0.4}', "moderate", 0.4),
        ('{"complexity": "moderate", "confidence": 0.3}', "complex", 0.3),
        ('{"complexity": "odd", "confidence": 0.9}', "moderate", 0.9),
        ("not json", "moderate", 0.0),
        (None, "simple", 0.5),
    ],
)
def test_route(spark, reply, complexity, confidence):
    assert value(spark, signals.route(F.col("x"), F.lit("simple")), "x string", reply) == {"complexity": complexity, "confidence": confidence}


def test_rewrite(spark):
    got = lambda r: value(spark, signals.rewrite_accepted(F.lit("old"), F.col("x")), "x string", r)
    assert got('{"rewritten": "new", "confidence": 0.9}') == {"rewritten": "new", "was_rewritten": True, "confidence": 0.9}
    assert got('{"rewritten": "new", "confidence": 0.6}') == {"rewritten": "old", "was_rewritten": False, "confidence": 0.6}
    assert got('{"rewritten": "new"}')["confidence"] == 0.8
    assert got("x") == {"rewritten": "old", "was_rewritten": False, "confidence": 0.0}


def test_self_rag(spark):
    got = lambda *v: value(spark, signals.self_rag(*map(F.lit, v)))
    assert got("correct", 0.9, None, None) == {"verdict": "correct", "confidence": 0.9, "hint": False, "refined": False}
    assert got("incorrect", 0.3, "correct", 0.9) == {"verdict": "correct", "confidence": 0.9, "hint": False, "refined": True}
    assert got("correct", 0.5, "incorrect", 0.4)["refined"] is False
    assert got("ambiguous", 0.5, "correct", 0.9) == {"verdict": "ambiguous", "confidence": 0.5, "hint": True, "refined": False}


@pytest.mark.parametrize("m, transient, permanent", [("429 Too Many Requests", True, False), ("Unauthorized", False, True), ("connection reset", True, False), ("odd", False, False), (None, False, False)])
def test_errors(spark, m, transient, permanent):
    assert value(spark, signals.error_class(F.col("x")), "x string", m) == {"transient": transient, "permanent": permanent}


@pytest.mark.parametrize("action, conf, n, tools, node", [("finish", 0.1, 0, True, "finish"), ("think", 0.9, 9, True, "finish"), ("think", 0.1, 5, True, "max_iter"), ("tool_call", 0.1, 1, True, "tool"), ("tool_call", 0.1, 1, False, "retrieve"), ("odd", 0.1, 1, True, "think")])
def test_react(spark, action, conf, n, tools, node):
    assert value(spark, signals.react_next(*map(F.lit, (action, conf, n, tools)))) == node


def test_retry_grows_and_is_capped(spark):
    mids = [value(spark, signals.retry_bounds(F.lit(k)))["mid"] for k in range(6)]
    assert mids == [1, 2, 4, 8, 10, 10]


def test_vectors(spark):
    v = F.array(F.lit(3.0), F.lit(4.0), F.lit(0.0), F.lit(0.0))
    assert value(spark, vectors.l2_normalized(v)) == [0.6, 0.8, 0.0, 0.0]
    assert value(spark, vectors.l2_normalized(F.array(F.lit(0.0), F.lit(0.0)))) == [0.0, 0.0]
    assert value(spark, vectors.euclid(v, v)) == 0.0


@pytest.mark.parametrize("e, v", [("(2+3)*4", 20.0), ("math.sqrt(16)", 4.0), ("2 ** 10", 1024.0), ("max(1, x)", 7.0), ("1 / 0", None), ("-x", -7.0)])
def test_calculator(spark, e, v):
    assert value(spark, calc.compiled(e, x=F.lit(7))) == v


@pytest.mark.parametrize("e", ["__import__('os')", "x.y", "open('f')", "[1]", "'a'", "lambda: 1", "True"])
def test_calculator_refuses(spark, e):
    with pytest.raises(ValueError):
        calc.compiled(e, x=F.lit(1))


def test_settings():
    s = Settings.load({"chunk_size": "100", "odd": 1}, {"CORPUSLOOM_TOP_K": "7"})
    assert (s.chunk_size, s.top_k, s.rerank_k) == (100, 7, 5)
    with pytest.raises(ValueError):
        Settings.load({"distance": "odd"}, {})
    assert prompts("missing") == prompts("v1")


def test_settings_of_a_file(tmp_path):
    pytest.importorskip("yaml")
    from corpusloom.sources.settings import from_yaml

    path = tmp_path / "own.yaml"
    path.write_text("top_k: 9\nchunking:\n  chunk_size: 300\n  odd: x\n")
    got = from_yaml(str(path), {"CORPUSLOOM_CHUNK_SIZE": "301"})
    assert (got.top_k, got.chunk_size) == (9, 301) and from_yaml(str(tmp_path / "none.yaml"), {}) == Settings()


def test_exposition(spark):
    df = spark.createDataFrame([("a", 0.05), ("a", 3.0), ("a", 99.0)], "kind string, v double")
    lines = [r.line for r in metrics.exposition(metrics.histogram(df, "v", ["kind"], (0.1, 5.0)), "latency", "kind").collect()]
    assert lines == ['latency_bucket{kind="a",le="0.1"} 1', 'latency_bucket{kind="a",le="5.0"} 2', 'latency_bucket{kind="a",le="+Inf"} 3']


def test_rounding_as_in_sql(spark):
    import duckdb

    xs = [0.80125, 0.7917500000000001, 1.005, 2.5, -2.5, 0.285, 1e300, -0.5, 0.0, 8.0875, 1234567.891234565]
    rows = spark.createDataFrame([(x,) for x in xs], "x double").select(*[calc.rounded(F.col("x"), d).alias(f"d{d}") for d in (0, 2, 4, 6)])
    con = duckdb.connect()
    want = [tuple(con.execute("select round(x, 0), round(x, 2), round(x, 4), round(x, 6) from (select ?::double as x)", [x]).fetchall()[0]) for x in xs]
    assert [tuple(r) for r in rows.collect()] == want
