"""Conversation repair, whitening and packing against brute force."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import packing, queries, repair, whitening
from tests import compare

ROW = "conv_id long, turn long, role string, text string, role2 int, `a.b` string"


# conversation repair


def cheapest(rows):
    """(cost, audit) of rows (role, fault): all edits of every row, the least string for each state of the pattern."""
    best = {0: (0, "")}

    def inserted(b):
        b = dict(b)
        for _ in range(4):
            for s, (c, a) in list(b.items()):
                b[3 if s == 2 else 2] = min(b.get(3 if s == 2 else 2, (math.inf, "")), (c + 3, a + "I"))
        return b

    for role, fault in rows:
        found = collections.defaultdict(list)
        for s, (c, a) in inserted(best).items():
            found[s].append((c + 4, a + "D"))
            if fault in ("blank", "duplicate"):
                continue
            more = 3 * (fault == "truncated")
            found[3 if s == 2 else 2].append((c + more + 3, a + "R"))
            for initial, ways in {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}.items():
                if role[:1] == initial and s in ways:
                    found[ways[s]].append((c + more, a + "K"))
        best = {s: min(v) for s, v in found.items()}
    return min(v for s, v in inserted(best).items() if s in (0, 3))


def test_runs_give_the_least_audit():
    rnd = random.Random(5)
    for n in range(6000):
        rows = [(rnd.choice(["system", "user", "assistant", "tool", "user", ""]), rnd.choice(["", "", "", "truncated", "blank", "duplicate"])) for _ in range(rnd.randint(0, 9))]
        if n % 3 == 0:
            rows = [r for r in rows for _ in range(rnd.randint(1, 20))]
        done = repair.runs("".join(repair.symbol_of(r[:1], f == "blank", f == "truncated", f == "duplicate") for r, f in rows))
        after, cost = repair.END, 0
        for symbol, length in reversed(done):
            after, low = repair.before(symbol, length, after)
            cost += low
        letters, state = repair.walk(done, repair.END, repair.START)
        assert (cost + after[0], "".join(letters) + repair.ending(state)) == cheapest(rows)


def conversations(spark):
    rnd = random.Random(9)
    texts = ["Hello.", "How is it?", "no end", "", " \t\n", None, "x" * 5000 + "!", "é　", "a.\n"]
    rows = [(rnd.choice([1, 2, 3, None]), rnd.choice([None, *range(12)]), rnd.choice(["system", "user", "assistant", None, "", "tool"]), rnd.choice(texts), 1, "x") for _ in range(300)]
    return spark.createDataFrame(rows + rows[:40] + [(7, 0, "user", "Fine.", 0, "")], ROW)


@pytest.mark.parametrize("limits", [{}, {"long_rows": 20, "piece_bits": 3}, {"long_rows": 0, "piece_bits": 0}, {"long_bytes": 60000, "piece_bits": 12}])
def test_repair_edges_both_ways(spark, limits):
    rows = conversations(spark)
    con = compare.duckdb.connect()
    con.register("given", rows.select("conv_id", "turn", "role", "text").toArrow())
    con.execute("create table conversations as select * from given")
    done = repair.repair(repair.damage(rows), **limits)
    assert compare.spark_rows(repair.digest(done, rows)) == compare.sql_rows(con, queries.OP11_SQL)
    lines = collections.defaultdict(list)
    for r in done.messages().orderBy("at").collect():
        lines[r.conv].append(f"{r.role}:{r.text}")
    for r in repair.digest(done, rows).collect():
        assert hashlib.sha256("\n".join(lines[r.conv_id]).encode()).hexdigest() == r.repaired_sha256


def test_repair_of_a_third_of_all_rows_in_one_conversation(spark, small):
    rows = spark.read.parquet(f"{small}/conversations.parquet")
    hot = rows.unionByName(rows.limit(40).crossJoin(spark.range(30)).select(F.lit(-1).cast("long").alias("conv_id"), (F.col("id") % 7 * 9 + F.col("turn")).alias("turn"), "role", "text"))
    one = compare.spark_rows(repair.digest(repair.repair(repair.damage(hot)), hot))
    assert one == compare.spark_rows(repair.digest(repair.repair(repair.damage(hot), long_rows=100, piece_bits=4), hot))


def test_repair_of_nothing_and_of_dropped_rows(spark):
    empty = spark.createDataFrame([], ROW)
    assert repair.digest(repair.repair(repair.damage(empty)), empty).collect() == []
    dropped = [i for i in range(200) if zlib.crc32(f"{i}:0".encode()) % 20 == 0]
    rows = spark.createDataFrame([(i, 0, "user", "x", 0, "") for i in dropped], ROW)
    got = repair.digest(repair.repair(repair.damage(rows)), rows).collect()
    none = hashlib.sha256(b"").hexdigest()
    assert sorted(tuple(r) for r in got) == [(i, 0, 0, 0, 0, 0, 0, "", none) for i in dropped]


# whitening


def whitened(spark, rows, **names):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, row int, `x.y` string")
    return whitening.digest(whitening.whiten(df, **names)).toPandas()


def expected(vectors):
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    deviation = [sum((n * a - s) ** 2 for a, s in zip(v, sums, strict=True)) for v in x]
    centred = np.array([[(n * a - s) / n for a, s in zip(v, sums, strict=True)] for v in x])
    value, vector = np.linalg.eigh(centred.T @ centred / n)
    return deviation, centred, value[::-1], vector[:, ::-1]


def agrees(got, ids, vectors, components):
    deviation, centred, value, vector = expected(vectors)
    assert len(got) == len(ids) * components and set(got.n) == {len(ids)} and got.identity_error.max() < 1e-6
    for i, d in zip(ids, deviation, strict=True):
        assert set(got[got.vec_id == i].deviation) == {d}
    y = got.pivot(index="vec_id", columns="component", values="whitened").loc[ids].to_numpy()
    want = centred @ vector[:, :components] / np.sqrt(value[:components])
    assert np.abs(y * np.sign((y * want).sum(0)) - want).max() < 1e-6
    share = got.drop_duplicates("component").sort_values("component").explained.to_numpy()
    assert np.allclose(share, value[:components] / value.sum(), rtol=1e-6)


def test_whitening_query(spark, small):
    got = queries.op12_whitening(spark, small).toPandas()
    rows = spark.read.parquet(f"{small}/embeddings.parquet").orderBy("vec_id").collect()
    agrees(got, [r.vec_id for r in rows], [r.embedding for r in rows], 32)


def test_whitening_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK_ROWS", 7)
    monkeypatch.setattr(whitening, "BLOCK_COLUMNS", 2)
    rnd = np.random.default_rng(3)
    vectors = (rnd.normal(size=(200, 5)) @ rnd.normal(size=(5, 5)) + 40).tolist()
    got = whitened(spark, [(i, v, 0, "") for i, v in enumerate(vectors)])
    agrees(got, list(range(200)), vectors, 5)


def test_whitening_edges(spark):
    nan, inf = float("nan"), float("inf")
    good = [[0.1 * i, float(i * i % 7), 5.0] for i in range(12)]
    bad = [None, [], [1.0, None, 2.0], [1.0, nan, 2.0], [inf, 0.0, 0.0], [1.0], [1.0, 2.0]]
    got = whitened(spark, [(i, v, 0, "") for i, v in enumerate(good + bad)] + [(3, good[3], 1, "again"), (None, good[5], 1, "")])
    assert len(got) == 14 * 3 and set(got.n) == {14}
    flat = got[got.component == 3]
    assert (flat.whitened == 0).all() and (flat.explained == 0).all() and got.identity_error.max() < 1e-9
    assert got[got.vec_id == 3].groupby("component").whitened.nunique().max() == 1
    one = whitened(spark, [(1, [1.0, 2.0], 0, "")])
    assert list(one.whitened) == [0, 0] and list(one.deviation) == [0, 0] and list(one.identity_error) == [0, 0]
    assert len(whitened(spark, [])) == 0 and len(whitened(spark, [(1, None, 0, "")])) == 0


def test_whitening_of_huge_components(spark):
    vectors = [[float(1 << 33), 0.0], [-float(1 << 33), 1.0], [3.0, 2.0], [1e300, 5.0]]
    clipped = [[min(c, float(1 << 34)) for c in v] for v in vectors]
    got = whitened(spark, [(i, v, 0, "") for i, v in enumerate(vectors)])
    want = expected(clipped)[0]
    assert [None if d is None or d != d else int(d) for d in got[got.component == 1].sort_values("vec_id").deviation] == [d if d < 1 << 63 else None for d in want]


# packing


def naive(ids, df, docs, mean, window):
    """Windows of a shard's documents, scored term by term."""
    idf = lambda t: math.log1p((docs - df[t] + 0.5) / (df[t] + 0.5))

    def score(q, d):
        tf = collections.Counter(ids[d].tolist())
        norm = packing.K1 * (1 - packing.B + packing.B * len(ids[d]) / mean)
        return round(sum(idf(t) * tf[t] * (packing.K1 + 1) / (tf[t] + norm) for t in sorted(set(ids[q].tolist())) if t in tf), packing.DIGITS)

    free, windows, now, seed, carry = set(range(len(ids))), [], [], None, None
    while carry or free:
        if carry is None:
            near = [(-score(seed, d), d) for d in free] if seed is not None else []
            d = min(near)[1] if near and min(near)[0] < 0 else min(free)
            free.discard(d)
            carry = (d, 0)
        d, at = carry
        seed = d if seed is None else seed
        take = min(window - sum(n for _, _, n in now), len(ids[d]) - at)
        now.append((d, at, take))
        carry = (d, at + take) if at + take < len(ids[d]) else None
        if sum(n for _, _, n in now) == window:
            windows.append(now)
            now, seed = [], None
    return windows, now


def test_packing_equals_naive_retrieval(spark, small):
    rows = spark.read.parquet(f"{small}/documents.parquet").orderBy("doc_id").collect()
    slow = packing._encoders(packing.default_tokenizer())[0]
    ids = [np.array(slow.encode(r.text or "", add_special_tokens=False).ids + [1]) for r in rows]
    df = collections.Counter(t for x in ids for t in set(x.tolist()))
    mean, counts = sum(map(len, ids)) / len(ids), np.zeros(slow.get_vocab_size(), int)
    for t, n in df.items():
        counts[t] = n
    for window in (64, 2048):
        own = ids[:60]
        pieces = packing.pack_shard(own, packing.inverse_frequencies(counts, len(ids)), mean, window)
        windows, rest = naive(own, df, len(ids), mean, window)
        by = collections.defaultdict(list)
        for d, start, n, sequence, offset in pieces:
            by[sequence].append((offset, d, start, n))
        got = [[p[1:] for p in sorted(by[s])] for s in sorted(by)]
        assert got[: len(windows)] == windows
        flat = lambda ps: [(d, i) for d, s, n in ps for i in range(s, s + n)]
        assert flat([p for w in got[len(windows) :] for p in w]) == flat(rest)
    order = sorted(range(len(ids)), key=lambda k: (min((df[t], t) for t in set(ids[k].tolist()))[1], k))
    got = packing.pack(spark.createDataFrame([(r.doc_id, r.text) for r in rows], "doc_id long, text string").coalesce(1)).collect()
    windows, rest = naive([ids[k] for k in order], df, len(ids), mean, 2048)
    flat = [(rows[order[d]].doc_id, s, n) for w in windows for d, s, n in w]
    assert [(r.doc, r.start, r.length) for r in sorted(got, key=lambda r: (r.sequence_id, r.offset))][: len(flat)] == flat


def check_pieces(rows, docs, window=2048):
    """Every id of every document in exactly one piece, sequences without gaps or padding."""
    slow = packing._encoders(packing.default_tokenizer())[0]
    left = collections.Counter()
    for d, text in docs:
        left[d, tuple(slow.encode(text or "", add_special_tokens=False).ids + [1])] += 1
    by, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    for (d, ids), copies in left.items():
        want = collections.Counter()
        for r in by[d]:
            if r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()):
                want.update(range(r.start, r.start + r.length))
        assert all(want[i] == copies for i in range(len(ids)))
    assert sum(r.length for r in rows) == sum(len(ids) * n for (_, ids), n in left.items())
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at == window or at <= window and at & (at - 1) == 0


def test_packing_query(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    check_pieces(queries.op13_packing(spark, small).collect(), [(r.doc_id, r.text) for r in docs.collect()])


def test_packing_edges(spark, monkeypatch):
    monkeypatch.setattr(packing, "LONG_TEXT", 40)
    rnd = random.Random(1)
    word = lambda: "".join(rnd.choice("abcdeé ") for _ in range(rnd.randint(0, 60)))
    docs = [(i, word(), 0) for i in range(80)] + [(90, None, 0), (91, "", 0), (92, "one two " * 9000, 0), (93, "<|endoftext|> \x00", 0)] + [(None, "a null id", 0)] + [(5, "the same row", 0)] * 40
    df = spark.createDataFrame(docs, "doc_id long, text string, row int")
    for limits in ({}, {"shard_tokens": 50, "part_tokens": 300}):
        check_pieces(packing.digest(packing.pack(df, **limits)).collect(), [d[:2] for d in docs])
    assert packing.pack(df.limit(0)).count() == 0


def test_packing_puts_copies_into_many_shards(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "one very common passage of a dozen words").otherwise(F.concat(F.lit("w"), F.col("id"))).alias("text"))
    rows = packing.pack(df, shard_tokens=600, part_tokens=600).withColumn("part", F.shiftright("sequence_id", 33))
    copies = rows.where("doc % 3 = 0").groupBy("part").count().agg(F.count("*"), F.max("count")).first()
    assert copies[0] >= 6 and copies[1] <= 400


def test_both_tokenizers_agree(spark):
    slow, fast, _ = packing._encoders(packing.default_tokenizer())
    rows = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    points = [c for c in range(0, 0x30000, 7) if not 0xD800 <= c < 0xE000]
    rows += [f"a{chr(c)}a 1{chr(c)}1 !{chr(c)}!  {chr(c)} b" for c in points] + ["can't WE'LL", " \n\n  x\t y", "<|endoftext|>", "ab" * 3000]
    assert [e.ids for e in slow.encode_batch(rows, add_special_tokens=False)] == [fast.encode_ordinary(r) for r in rows]
