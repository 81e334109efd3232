"""WARC, search, PII, decontamination, line dedup and mixing against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from corpusloom.llm import decontam, linededup, mixing, pii, queries, topk, warc
from tests import compare
from tests.llm import brute

DOC = "doc_id long, text string"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(spark, small, name):
    got = compare.spark_rows(queries.queries()[name](spark, small))
    assert got == compare.sql_rows(compare.connect(small), queries.oracle_sql()[name])


# WARC


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, sha1 int, salt string")


def test_warc_round_trip_and_revisits(spark):
    big, other = "é" * 600, "b" * 1000
    rows = [(1, "http://a/1", big, 0, ""), (2, None, big, 0, ""), (2, "http://a/ 2\n", big, 0, ""), (3, "u", "small", 0, ""), (4, "u", "small", 0, ""), (5, "u", None, 0, ""), (6, "u", other, 0, ""), (None, "u", big, 0, "")]
    bundles = warc.write_bundles(pages(spark, rows), frame_bytes=1500)
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.digest(warc.read_records(bundles)).collect()), key=str)
    h = lambda s: hashlib.sha1(s.encode()).hexdigest()
    want = [(1, 1200, h(big), "revisit", 2), (2, 1200, h(big), "response", None), (2, 1200, h(big), "response", None), (3, 5, h("small"), "response", None), (4, 5, h("small"), "response", None), (5, 0, h(""), "response", None), (6, 1000, h(other), "response", None), (None, 1200, h(big), "revisit", 2)]
    assert got == sorted(want, key=str)
    payloads = {r.page: r.payload for r in warc.read_records(bundles, payloads=True).collect()}
    assert payloads["6"].decode() == other and payloads["1"] is None


@pytest.mark.parametrize("groups, heavy", [(100, 100), (0, 2), (0, 100)])
def test_warc_groups_of_any_size(spark, groups, heavy):
    rows = [(i, "u", "x" * (1000 + i % 4 * (i % 3)), 0, "") for i in range(40)] + [(None, "u", "x" * 1000, 0, "")]
    got = warc.digest(warc.read_records(warc.write_bundles(pages(spark, rows), groups=groups, heavy=heavy))).collect()
    last = {}
    for i, _, html, *_ in rows:
        last[html] = max(last.get(html, -1), -1 if i is None else i)
    want = {i: None if last[html] == i else last[html] for i, _, html, *_ in rows}
    assert len(got) == len(rows) and {r.page_id: r.refers_to for r in got} == want


def test_warc_names_of_pages_without_an_id(spark):
    df = spark.createDataFrame([(None, "a", "one"), (None, "a", "one"), ("null", "b", "two"), ("urn:x", "c", None)], "page_id string, url string, html string")
    bundles = warc.write_bundles(df)
    index = [r.record_id for r in warc.record_index(bundles).collect()]
    assert len(index) == len(set(index)) == 4
    rows = warc.digest(warc.read_records(bundles), "string").collect()
    assert sorted(map(str, [r.page_id for r in rows if r.page_id is not None])) == ["null", "urn:x"] and sum(r.page_id is None for r in rows) == 2


def test_warc_index_points_into_frames(spark, small):
    bundles = warc.write_bundles(spark.read.parquet(f"{small}/pages.parquet"), bundle_bytes=100_000)
    assert bundles.count() > 1
    row = bundles.first()
    frames = warc.seek_table(bytes(row.archive))
    for e in row.entries:
        raw = warc.read_frame(bytes(row.archive), frames, e.frame)
        assert warc.parse_record(raw[e.offset : e.offset + e.length])["page"] == e.record_id
    stream = zstandard.ZstdDecompressor().stream_reader(bytes(row.archive), read_across_frames=True)
    assert stream.read().count(b"WARC/1.1\r\n") == len(row.entries)
    wanted = [row.entries[0].record_id]
    assert [r.page for r in warc.read_records(bundles, only=wanted).collect()] == wanted
    assert warc.record_index(bundles).count() == sum(len(r.entries) for r in bundles.collect())


def test_warc_damage_is_found():
    record = warc.make_record("1", "u", b"abc", hashlib.sha1(b"abc").hexdigest(), None, "1970-01-01T00:00:00Z")
    assert warc.parse_record(record)["payload"] == b"abc"
    with pytest.raises(ValueError):
        warc.parse_record(record.replace(b"abc", b"abd"))


def test_warc_empty(spark):
    assert warc.digest(warc.read_records(warc.write_bundles(pages(spark, [])))).count() == 0


# search


def nearest(rows, k=10):
    good = [(i, [int(np.floor(1024 * float(x))) for x in e]) for i, e in rows if e and all(x is not None and np.isfinite(x) for x in e)]
    out = []
    for at, (q, v) in enumerate(good):
        if q is not None and q % 100 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i is None, i or 0) for j, (i, w) in enumerate(good) if j != at and len(w) == len(v))
            out += [(q, r, None if none else i, -s) for r, (s, none, i) in enumerate(scored[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [7, 4096])
def test_search_with_ties_and_bad_vectors(spark, block):
    random.seed(2)
    rows = [(i, [float(random.choice([0, 1, 1, -2])) for _ in range(3)]) for i in range(350)]
    rows += [(1000, None), (1001, [None, 1.0, 2.0]), (1002, [float("nan"), 1.0, 1.0]), (1003, [float("inf")] * 3), (1100, [1e6, 1e6, -1e6]), (1200, []), (1300, [1.0, 2.0]), (1301, [1.0, 3.0]), (None, [2.0, 2.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"score": F.lit(1), "rank": F.lit("x")})
    got = topk.search(df, F.col("vec_id") % 100 == 0, block=block, query_block=2)
    assert sorted(map(tuple, got.collect()), key=str) == nearest(rows)


def test_search_counts_every_row(spark):
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (1, [3.0, 1.0]), (1, [3.0, 1.0]), (2, [0.5, 0.5]), (100, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, topk.search(df, F.col("vec_id") % 100 == 0, k=3).collect()), key=str)
    assert got == nearest(rows, 3) and len(got) == 9
    import duckdb

    con = duckdb.connect()
    con.sql("create table embeddings as select * from (values " + ", ".join(f"({i}, {e})" for i, e in rows) + ") t(vec_id, embedding)")
    assert sorted(con.sql(queries.OP2_SQL).fetchall(), key=str) == sorted(map(tuple, topk.search(df, F.col("vec_id") % 100 == 0).collect()), key=str)


def test_search_beyond_doubles_and_empty(spark):
    rows = [(0, [3e9, 1.0]), (1, [3e9, 2.0]), (2, [3e9, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert [(r.vec_id, r.score) for r in topk.search(df, F.col("vec_id") == 0).orderBy("rank").collect()] == [(1, (1 << 62) - 1), (2, (1 << 62) - 1)]
    assert topk.search(df.limit(0), F.col("vec_id") == 0).count() == 0


# PII

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    twice = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(x - 9 if x > 9 else x for x in twice) % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            good = kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or kind == "card" and 16 <= len(d) <= 19 and luhn(d) or kind == "phone" and 8 <= len(d) <= 15
            out += [f"{kind}:{m.start()}:{m.end()}"] * good
    return ",".join(out)


def check_pii(df):
    texts = {r.doc_id: r.text for r in df.collect()}
    got = pii.digest(pii.find_pii(df)).collect()
    assert len(got) == len(texts)
    for r in got:
        base = base_spans(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest(), texts[r.doc_id]
        assert r.spans.startswith(base)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x.startswith(k) for x in base.split(",")) for k in BASE]
    return {r.doc_id: r.spans for r in got}


def test_pii_of_documents(spark, small):
    check_pii(spark.read.parquet(f"{small}/documents.parquet"))


def test_pii_of_random_texts(spark):
    random.seed(3)
    rows = [(i, "".join(random.choice("ab0123456789.@+-_ ()%é\n") for _ in range(random.choice([5, 40, 300])))) for i in range(1500)]
    rows += [(-1, None), (-2, ""), (-3, "x@a.b.c_d@e.f 1.2.3.4.5.6.7.8 256.1.1.1.1 é😀 a@b.c 4111 1111 1111 1111 007.1.1.255"), (-4, "a@" + "b." * 3000 + "c"), (-5, "1" * 5000), (-6, "+1" + " " * 5000 + "2")]
    check_pii(spark.createDataFrame(rows, DOC))


def test_pii_long_runs_take_linear_time(spark):
    df = spark.createDataFrame([(1, "a" * 2_000_000), (2, "1." * 500_000)], DOC)
    assert [r.spans[:2] for r in pii.digest(pii.find_pii(df)).orderBy("doc_id").collect()] == ["", "ip"]


def test_pii_validators_and_context(spark):
    texts = ["iban DE89370400440532013000", "GB82 WEST 1234 5698 7654 32", "GB82 WEST 1234 5698 7654 33", "ssn 123-45-6789", "123-45-6789", "666-45-6789 ssn", "call 555-123-4567", "order 555-123-4567", "amex card 378282246310005", "378282246310005"]
    got = check_pii(spark.createDataFrame([*enumerate(texts)], DOC))
    kinds = [[x.split(":")[0] for x in got[i].split(",") if x] for i in range(len(texts))]
    assert kinds == [["iban"], ["iban"], [], ["ssn"], [], [], ["local_phone"], [], ["short_card"], []]


# decontamination


@pytest.mark.parametrize("block_bytes", [400, 1 << 20])
def test_decontamination(spark, block_bytes):
    random.seed(4)
    w = [f"w{i}" for i in range(12)]
    text = lambda n: " ".join(random.choice(w) for _ in range(n))
    items = [(i, text(random.choice([1, 2, 3, 9, 10, 11, 30]))) for i in range(25)] + [(None, "odd one"), (7, "again here"), (50, None), (51, "?!"), (52, "Äb ß")]
    docs = [(i, text(random.randint(0, 60)) + " " + random.choice([x for _, x in items if x]).upper() + "," + text(20)) for i in range(60)]
    docs += [(900, None), (901, ""), (900, "odd-ONE"), (902, "äB ß Äb ß ÄB ß")]
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], DOC + ", n_words string, `a.b` int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(map(str, decontam.digest(decontam.find_hits(df, bench, block_bytes=block_bytes)).collect()))
    pairs = [("null" if i is None else str(i), t) for i, t in items if t is not None]
    want = []
    for i, t in docs:
        n, hit, found = decontam.brute_force(t, pairs)
        want.append((i, n, hit, len(found), decontam.items_digest(found), hit > 0))
    kinds = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert got == sorted(map(str, spark.createDataFrame(want, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean").select(kinds).collect()))
    clean = decontam.drop_contaminated(df, bench, block_bytes=block_bytes)
    assert clean.columns == df.columns
    assert sorted(map(str, (r[:2] for r in map(tuple, clean.collect())))) == sorted(map(str, (d for d, x in zip(docs, want, strict=True) if not x[-1])))


def test_decontamination_of_empty_tables(spark):
    none, bench = spark.createDataFrame([], DOC), spark.createDataFrame([], "item_id long, text string")
    assert decontam.digest(decontam.find_hits(none, bench)).count() == 0
    assert decontam.digest(decontam.find_hits(spark.createDataFrame([(1, "a b")], DOC), bench)).first().n_words == 2


# line dedup


def line_docs():
    random.seed(5)
    lines = ["", " ", "Common line", "  COMMON LINE\t", "é Rare", "É rare", "x", "ab", "seldom here", "\x0b \x0c"]
    docs = [(i, "\n".join(random.choice(lines) for _ in range(random.randint(1, 6)))) for i in range(80)]
    return docs + [(80, None), (81, ""), (80, "Common line"), (None, "Common line\nkeep"), (82, "\n\n")]


@pytest.mark.parametrize("min_chars, min_docs, broadcast_keys", [(1, 10, 1 << 21), (1, 10, 0), (3, 5, 1 << 21), (3, 5, 0), (1, 1000, 1 << 21)])
def test_line_dedup(spark, min_chars, min_docs, broadcast_keys):
    docs = line_docs()
    df = spark.createDataFrame([(*d, 5, "n") for d in docs], DOC + ", n_lines int, kept string")
    index = linededup.LineIndex.build(df, min_chars=min_chars, min_docs=min_docs, broadcast_keys=broadcast_keys, shard_keys=2)
    got = sorted(map(str, map(tuple, linededup.digest(index.drop_lines(df, keep_columns=["doc_id"])).collect())))
    want = linededup.brute_force([t for _, t in docs], min_chars, min_docs)
    assert got == sorted(str((i, *x)) for (i, _), x in zip(docs, want, strict=True))


def test_line_dedup_cleans_clashing_columns(spark, small):
    rows = [(i, f"Same line\nown {i}", 1, "k", 2, i) for i in range(12)]
    df = spark.createDataFrame(rows, DOC + ", n_lines int, kept string, n_dropped int, `a.b` int")
    out = linededup.clean(df, n_chars_col=None)
    assert out.columns == df.columns and sorted(map(tuple, out.collect())) == [(i, f"own {i}", 1, "k", 2, i) for i in range(12)]


def test_filters_are_probed_beyond_the_broadcast(spark):
    df = spark.createDataFrame([(i, "\n".join(f"line {j}" for j in range(i % 7, 40))) for i in range(60)], DOC)
    index = linededup.LineIndex.build(df, shard_keys=4, broadcast_keys=0, min_docs=30)
    assert index.shards > 5 and index._probe() is None
    rows = index._marked(df.select("doc_id", F.col("text").alias("__text")), "__text")
    pairs = spark.createDataFrame([(1, 1, 10**15 + i, i) for i in range(3000)], "__t long, __n int, hi long, lo long")
    known = index._frequent().select(F.lit(2).cast("long").alias("__t"), F.lit(1).alias("__n"), "hi", "lo")
    passed = index._passing(pairs.unionByName(known)).groupBy("__t").count().collect()
    assert {r["__t"]: r["count"] for r in passed}[2] == known.count() and {r["__t"]: r["count"] for r in passed}.get(1, 0) < 30
    assert rows.where("size(__drop) > 0").count() > 0


def test_shards_split_as_keys_grow(spark):
    text = lambda a, b: "\n".join(f"line {j}" for j in range(a, b))
    few, more = (spark.createDataFrame([(i, text(*r)) for i in range(12)], DOC) for r in ((0, 4), (4, 60)))
    index = linededup.LineIndex.build(few, shard_keys=4)
    grown = index.insert(more)
    assert index.shards == 1 and grown.shards == 15
    assert sorted(map(tuple, grown.drop_lines(more).collect())) == [(56, 56, "")] * 12


@pytest.mark.parametrize("broadcast_keys", [1 << 21, 0])
def test_line_dedup_is_reversible(spark, broadcast_keys):
    docs = [d for d in line_docs()]
    df = spark.createDataFrame(docs, DOC)
    first, second = df.where("doc_id < 15"), df.where("doc_id >= 15")
    build = lambda x: linededup.LineIndex.build(x, shard_keys=2, broadcast_keys=broadcast_keys)
    once = build(first)
    both = once.insert(second)
    back = both.delete(second)
    rows = lambda index: sorted(map(str, linededup.digest(index.drop_lines(df, keep_columns=["doc_id"])).collect()))
    counts = lambda index: sorted(map(tuple, index.counts.collect()))
    assert counts(back) == counts(once) and rows(back) == rows(once)
    assert rows(both) == rows(build(first.unionByName(second))) != rows(once)


def test_cuckoo_filter():
    rng = np.random.default_rng(0)
    keys = rng.integers(0, 1 << 63, 5000, dtype=np.uint64)
    f = linededup.CuckooFilter.of(keys)
    assert f.has(keys).all()
    assert f.has(rng.integers(0, 1 << 63, 20_000, dtype=np.uint64)).mean() < 0.001
    for k in keys[:2500]:
        assert f.delete(int(k))
    assert f.has(keys[2500:]).all() and f.has(keys[:2500]).mean() < 0.01


def test_line_dedup_of_nothing(spark):
    df = spark.createDataFrame([], DOC)
    assert linededup.LineIndex.build(df).drop_lines(df, keep_columns=["doc_id"]).count() == 0


# mixing


def mix_docs():
    random.seed(6)
    docs = [(i, " ".join("w" * random.randint(1, 3) for _ in range(random.randint(0, 80))), random.choice(["a", "a", "a", "b", "c", None, "é"])) for i in range(900)]
    return docs + [(None, "x y", "a"), (None, None, "b"), (5, " \t\n", "c"), (7, "same", "d"), (7, "same", "d"), (8, None, "empty")]


def plain_targets(sizes):
    """Shares by weight; what is above the cap is shared again, until none is."""
    names = sorted((n for n in sizes if n is not None), key=lambda x: x.encode()) + [None] * (None in sizes)
    weight = {n: 1.0 + i % 3 for i, n in enumerate(names)}
    target, left, open_ = {}, float(sum(sizes.values())), set(names)
    while open_:
        unit = left / sum(weight[n] for n in open_)
        over = {n for n in open_ if unit * weight[n] > 3 * sizes[n]}
        if not over:
            return target | {n: unit * weight[n] for n in open_}
        for n in over:
            target[n] = 3.0 * sizes[n]
            left -= target[n]
        open_ -= over
    return target


def test_mixing(spark):
    docs = mix_docs()
    df = spark.createDataFrame([(*d, 1, 2) for d in docs], DOC + ", source string, size int, copies int")
    plan = mixing.plan_mix(df)
    rows = plan.collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted((str(r.doc_id), str(r.source), r.size) for r in rows) == sorted((str(i), str(s), size(t)) for i, t, s in docs)
    sizes = {}
    for _, t, s in docs:
        sizes[s] = sizes.get(s, 0) + size(t)
    target = plain_targets(sizes)
    for s in sizes:
        own = [r for r in rows if r.source == s]
        assert all(r.source_size == sizes[s] and r.target == pytest.approx(target[s]) for r in own)
        assert abs(sum(r.taken for r in own) - target[s]) <= 40
        assert all(r.taken <= 3 * r.size for r in own)
    assert sorted(map(str, mixing.plan_mix(df.repartition(3)).collect())) == sorted(map(str, rows))
    mixed = mixing.mix(spark.createDataFrame(docs, DOC + ", source string"))
    assert mixed.columns == ["doc_id", "text", "source", "copies"]
    assert sorted((str(r.doc_id), r.copies) for r in mixed.collect()) == sorted((str(r.doc_id), r.copies) for r in rows if r.copies)


@pytest.mark.parametrize("near", [0, 3, mixing.NEAR])
def test_pareto_sample_equals_the_definition(spark, near):
    rows = [(i, "w " * (1 + (i * 37) % 400 + 3000 * (i % 71 == 0)), "abcd"[i % 4 if i % 3 else 0]) for i in range(900)]
    df = spark.createDataFrame(rows, DOC + ", source string")
    draws = {r.doc_id: r.u for r in mixing._thin(df, "doc_id", "text", "source").collect()}
    plan = {r.doc_id: r for r in mixing.plan_mix(df, near=near).collect()}
    figures = {r.source: (r.source_size, r.target) for r in plan.values()}
    brute.check_mix([(plan[i].source, plan[i].size, draws[i]) for i, *_ in rows], figures, {k: plan[i].copies for k, (i, *_) in enumerate(rows)}, near)
    # the probabilities add up to the sample's size, and that is what is taken
    thin = mixing._thin(df, "doc_id", "text", "source")
    sources = mixing._sources(thin, mixing.WEIGHTS, mixing.MAX_COPIES, 2.0)
    for s in sources.collect():
        own = [(r.size, s.scale * 2 ** (int(np.log2(r.size) * mixing.STEPS + 1e-9) * 2.0 / mixing.STEPS)) for r in plan.values() if r.source == s.source]
        p = [min(1.0, x) for _, x in own]
        assert s.rest == 0 or (round(sum(p)) == s.n and sum(x >= 1 for _, x in own) == s.sure and sum(a * b for (a, _), b in zip(own, p, strict=True)) == pytest.approx(s.rest))


def test_mix_of_small_sources_has_n_documents_near_its_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    plan = mixing.plan_mix(docs)
    draws = {r.doc_id: r.u for r in mixing._thin(docs, "doc_id", "text", "source").collect()}
    rows = plan.collect()
    brute.check_mix([(r.source, r.size, draws[r.doc_id]) for r in rows], {r.source: (r.source_size, r.target) for r in rows}, {k: r.copies for k, r in enumerate(rows)})
    sums = plan.groupBy("source").agg(F.first("target").alias("target"), F.sum("taken").alias("taken")).collect()
    assert max(abs(r.taken - r.target) / r.target for r in sums) < 0.01


def test_exchange_of_repeated_rows():
    inside, outside = [(5, 20.0, 2.0), (4, 10.0, 1.0)], [(6, 30.0, 2.0), (7, 11.0, 1.0), (8, 18.0, 1.0)]
    assert mixing.exchanged(inside, outside, 8.0) == [4, 8]
    assert mixing.exchanged(inside, outside, 10.0) == [5, 6]
    assert mixing.exchanged(inside, outside, 0.5) == [] == mixing.exchanged([], outside, 9.0)


def test_mix_keeps_clashing_columns(spark):
    rows = [(i, "a b c " * (i + 1), "st"[i % 2], 100 + i, 7) for i in range(40)]
    df = spark.createDataFrame(rows, DOC + ", source string, copies int, `__x.y` int")
    out = mixing.mix(df)
    assert out.columns == [*df.columns, "copies_2"]
    assert all(r["copies"] == 100 + r.doc_id and r["__x.y"] == 7 for r in out.collect())


def test_pareto_follows_inclusion_odds(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), F.when(F.col("id") % 2 == 0, 40).otherwise(10)).alias("text"), F.when(F.col("id") < 2000, "a").otherwise("b").alias("source"))
    got = {r.size: r.share for r in mixing.plan_mix(df, weights=(1.0, 3.0), tilt=0.5).where("source = 'a'").groupBy("size").agg(F.avg("copies").alias("share")).collect()}
    assert got[40] > got[10] > 0.05


def test_mixing_of_nothing(spark):
    df = spark.createDataFrame([], DOC + ", source string")
    assert mixing.plan_mix(df).count() == 0 and mixing.mix(df).count() == 0
