"""Streams give what batches give, and stateful processors keep their rules."""

import pytest
from pyspark.sql import functions as F

from corpusloom.sources import docx, files
from corpusloom.streaming import state, windows


@pytest.fixture
def run(spark, tmp_path):
    """Runs a streaming plan over rows in files to its end."""

    def go(rows, plan, mode="append", per_file=None):
        source = str(tmp_path / "in")
        for part in per_file or [rows]:
            part.coalesce(1).write.mode("append").parquet(source)
        stream = plan(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source))
        name = f"out_{abs(hash(str(tmp_path)))}"
        q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None
        return spark.table(name)

    return go


@pytest.fixture
def events(spark, small):
    return spark.read.parquet(f"{small}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def rows(df):
    return sorted(map(str, df.collect()))


def test_tumbling_stream_equals_batch_for_closed_windows(run, events):
    got = run(events, lambda s: windows.tumbling(s.withWatermark("ts", "0 seconds"), "1 hour", "event_type"))
    whole = set(rows(windows.tumbling(events, "1 hour", "event_type")))
    assert set(rows(got)) <= whole and len(whole) - got.count() <= 10


def test_session_stream_equals_batch_for_closed_windows(run, events):
    got = run(events, lambda s: windows.sessions(s.withWatermark("ts", "0 seconds"), "30 minutes", "user_id"))
    whole = set(rows(windows.sessions(events, "30 minutes", "user_id")))
    assert set(rows(got)) <= whole and len(whole) - got.count() <= 20


def test_stream_dedup(run, events):
    keys = ["user_id", "event_type"]
    got = run(events, lambda s: windows.deduplicated(s, keys, "60 days")).select(*keys)
    assert rows(got) == rows(windows.deduplicated(events, keys).select(*keys))


def timed(events):
    return events.select(F.col("user_id").alias("key"), "event_id", F.col("ts").cast("double").alias("at"), (F.col("event_type") == "error").alias("failed"), "value")


def test_rate_limiter_stream_equals_fold(run, events):
    day = 86400
    rows_ = timed(events)
    parts = [rows_.where(F.col("at") < 1.7054e9), rows_.where(F.col("at") >= 1.7054e9)]
    got = run(rows_, lambda s: state.limited(s, 2, day), "append", parts).where("accepted").groupBy("key").count()
    fold = rows_.groupBy("key").agg(F.array_sort(F.collect_list("at")).alias("ts")).select("key", F.size(F.filter(windows.accepted(F.col("ts"), day, 2), lambda x: x["ok"])).cast("long").alias("count"))
    assert rows(got) == rows(fold)


def test_breaker_stream_equals_batch(run, events):
    rows_ = timed(events)
    got = run(rows_, state.broken).select("key", "event_id", "allowed", "state")
    assert rows(got) == rows(state.breaker_states(rows_, "key"))


def test_remembered_values(run, events):
    rows_ = timed(events)
    got = run(rows_, lambda s: state.remembered(s, 3600), "append")
    last = rows_.groupBy("key").agg(F.max_by("value", F.struct("at", "event_id")).alias("value"))
    assert rows(got.select("key", "value")) == rows(last)


def late(spark, events):
    """Events in two files, each over the whole time, then two of another key that move the watermark."""
    rows_ = timed(events).withColumn("ts", F.timestamp_seconds("at"))
    end = spark.createDataFrame([(-1, -1, 2.0e9, False, 0.0), (-1, -2, 2.1e9, False, 0.0)], "key long, event_id long, at double, failed boolean, value double")
    end = end.withColumn("ts", F.timestamp_seconds("at")).select(rows_.columns)
    return rows_, [rows_.where("event_id % 2 = 1"), rows_.where("event_id % 2 = 0"), end.where("event_id = -1"), end.where("event_id = -2")]


def test_limiter_with_timers_equals_batch(spark, run, events):
    rows_, parts = late(spark, events)
    day = 86400
    got = run(rows_, lambda s: state.limited_in_order(s.withWatermark("ts", "90 days"), 2, day), "append", parts)
    assert rows(got.where("key >= 0")) == rows(state.rate_limited(rows_, "key", 2, day))


def test_breaker_with_timers_equals_batch(spark, run, events):
    rows_, parts = late(spark, events)
    limits = {"failures": 2, "recovery": 86400}
    got = run(rows_, lambda s: state.broken_in_order(s.withWatermark("ts", "90 days"), **limits), "append", parts).where("key >= 0")
    assert rows(got.where("event_id is not null")) == rows(state.breaker_states(rows_, "key", **limits))
    turned = got.where("event_id is null")
    opened = got.where("state = 'open' and allowed").count()
    assert {r.state for r in turned.collect()} == {"half_open"} and 0 < turned.count() <= opened


def test_breaker_rules():
    b = state.Breaker(failures=2, recovery=10, probes=2, successes=2)
    calls = [(0, True), (1, True), (2, False), (11, False), (12, False), (13, True), (14, False), (15, True), (16, True), (26, True), (27, False)]
    assert [b.call(*c) for c in calls] == [
        (True, "closed"), (True, "open"), (False, "open"), (True, "half_open"), (True, "closed"), (True, "closed"),
        (True, "closed"), (True, "closed"), (True, "open"), (True, "open"), (False, "open"),
    ]


def test_files_are_parsed(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.md").write_text("# Title\n\nfirst\n\n## Two")
    (tmp_path / "b.HTML").write_text("<p>x")
    (tmp_path / "c.html").write_text("<h1>H</h1><p>body</p>")
    (tmp_path / "d.txt").write_text("no")
    (tmp_path / "e.pdf").write_bytes(b"%PDF")
    (tmp_path / "f.docx").write_bytes(docx.packed("# Top\n\nfirst & <second>\n## Two\n"))
    (tmp_path / "g.docx").write_bytes(docx.packed("one")[:-30])
    (tmp_path / "h.doc").write_bytes(b"old")
    (tmp_path / "i.docx").write_bytes(docx.packed(" \n "))
    found = files.read_folder(spark, str(tmp_path))
    got = {r.source_path.rsplit("/", 1)[1]: r for r in files.parsed(found).collect()}
    assert set(got) == {"a.md", "c.html", "f.docx"}
    assert got["f.docx"].content == "# Top\n\nfirst & <second>\n\n## Two" and got["f.docx"].title == "Top" and got["f.docx"].text_units[1] == "first & <second>"
    assert [tuple(h) for h in got["f.docx"].headings] == [(1, "Top"), (2, "Two")]
    assert got["a.md"].title == "Title" and [tuple(h) for h in got["a.md"].headings] == [(1, "Title"), (2, "Two")]
    assert got["c.html"].content == "H body" and got["c.html"].title == "c"
    left = {r.path.rsplit("/", 1)[1]: r.reason for r in files.unparsed(found).collect()}
    assert left == {"e.pdf": "no parser", "g.docx": "damaged", "h.doc": "damaged", "i.docx": "no text"} | ({"b.HTML": left["b.HTML"]} if "b.HTML" in left else {})
    with_pdf = files.parsed(found, lambda c: F.hex(c))
    assert with_pdf.where("parser = 'pdf'").first().content == "25504446"
    large = found.withColumn("length", F.when(F.col("path").endswith("a.md"), files.MAX_BYTES + 1).otherwise(F.col("length")))
    assert sorted(r.reason for r in files.unparsed(large, {"pdf": lambda c: F.hex(c)}).collect() if r.path.rsplit("/", 1)[1][0] in "ae") == ["too large"]


def test_word_files_of_other_shapes():
    import io
    import zipfile

    def word(body):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr("word/document.xml", f'<w:document xmlns:w="{docx._W[1:-1]}"><w:body>{body}</w:body></w:document>')
        return out.getvalue()

    run = lambda t: f"<w:r><w:rPr><w:b/></w:rPr><w:t>{t}</w:t></w:r>"
    row = lambda *cells: "<w:tr>" + "".join(f"<w:tc><w:p>{run(c)}</w:p></w:tc>" for c in cells) + "</w:tr>"
    body = f'<w:p>{run("one ")}<w:hyperlink>{run("link")}</w:hyperlink><w:del><w:r><w:delText>gone</w:delText></w:r></w:del><w:r><w:tab/><w:t>x</w:t></w:r></w:p><w:tbl>{row("a", "b")}{row("", "")}{row("c", "")}</w:tbl><w:sdt><w:sdtContent><w:p>{run("in a box")}</w:p></w:sdtContent></w:sdt>'
    assert docx.text_of(word(body)) == "one link\tx\n\na | b\n\nc | \n\nin a box"
    assert docx.text_of(word("")) == "" and docx.text_of(None) is None and docx.text_of(b"PK") is None
    assert docx.text_of(word("<w:p>")) is None


def test_word_files_as_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "f.docx").write_bytes(docx.packed("one\ntwo"))
    stream = files.parsed(files.watch_folder(spark, str(tmp_path / "in")))
    run = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
    assert run.awaitTermination(120)
    batch = files.parsed(files.read_folder(spark, str(tmp_path / "in")))
    same = lambda df: sorted(map(str, df.select("doc_id", "content", "text_units").collect()))
    assert same(spark.read.parquet(str(tmp_path / "out"))) == same(batch) and batch.first().text_units == ["one", "two"]


def test_answers_to_a_stream_of_questions_equal_the_batch(spark, small, tmp_path):
    from corpusloom.plans import answer

    docs = spark.read.parquet(f"{small}/documents.parquet").select(F.col("doc_id").alias("id"), "text", "source")
    corpus = spark.read.parquet(f"{small}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec")).join(docs, "id", "left_semi")
    asked = spark.read.parquet(f"{small}/benchmark.parquet").where("item_id < 6").join(corpus, F.col("item_id") == F.col("id")).select(F.col("item_id").alias("query_id"), "text", "vec")
    asked.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(asked.schema).parquet(str(tmp_path / "in"))
    run = answer.answer_stream(stream, docs, corpus, str(tmp_path / "out"), str(tmp_path / "at"))
    assert run.awaitTermination(120)
    rows = lambda df: sorted(map(str, df.select("query_id", "answer", "confidence", "prompt").collect()))
    got = rows(spark.read.parquet(str(tmp_path / "out")))
    assert got == rows(answer.answers(asked, docs, corpus)) and len(got) == asked.count() > 0
