"""Retrieval: dense and BM25 legs, fusion, reranking."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text, vectors
from corpusloom.operators.tables import written

#: Fusion constants by complexity, sizes of the candidate pools.
FUSION_K = {"simple": 30, "moderate": 60, "complex": 90, "beyond_kb": 60}
DEFAULT_K, POOL, TOP = 60, 50, 5
#: BM25 in its usual form; the constants are ours.
K1, B = 1.2, 0.75
#: Queries that are sent to all tasks at once, and rows that are scored at once against them.
QUERY_ROWS, ROWS = 2000, 1000


def top_k(scored: DataFrame, k: int, score: str, *ids: str) -> DataFrame:
    """The k best rows of each query with ``rank``; ties go to the smaller ids.  Written so
    that Spark limits each group before the shuffle."""
    order = Window.partitionBy("query_id").orderBy(F.round(score, 6).desc(), *ids)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


class _Best:
    """The k best candidates of each query that a task has seen, by rounded score, then id."""

    def __init__(self, queries: int, k: int):
        self.k, self.n = k, queries
        self.rows, self.scores, self.ids = np.empty(0, np.int64), np.empty(0), None

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        """``scores``: a row for each query, -inf where a candidate does not count."""
        near = np.round(scores, 6)
        if near.shape[1] > self.k:
            least = -np.partition(-near, self.k - 1, axis=1)[:, self.k - 1 : self.k]
            use = (near >= least) & np.isfinite(near)
        else:
            use = np.isfinite(near)
        r, c = np.nonzero(use)
        rows, all_scores = np.concatenate([self.rows, r]), np.concatenate([self.scores, scores[r, c]])
        all_ids = ids[c] if self.ids is None else np.concatenate([self.ids, ids[c]])
        order = np.lexsort((all_ids, -np.round(all_scores, 6), rows))
        rows = rows[order]
        first = np.arange(len(rows)) - np.searchsorted(rows, rows) < self.k
        self.rows, self.scores, self.ids = rows[first], all_scores[order[first]], all_ids[order[first]]

    def table(self, query_ids: pa.Array, kind: pa.DataType) -> pa.RecordBatch:
        ids = pa.array([] if self.ids is None else self.ids.tolist(), kind)
        return pa.RecordBatch.from_arrays([query_ids.take(pa.array(self.rows)), ids, pa.array(self.scores)], ["query_id", "id", "score"])


def _in_blocks(queries: DataFrame, rows: int) -> list[pa.Table]:
    """The queries in blocks of about ``rows``, one after the other on the driver."""
    blocks = max(1, -(-queries.count() // rows))
    for block in range(blocks):
        some = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block) if blocks > 1 else queries
        yield some.toArrow()


def _matrix(column) -> np.ndarray:
    """A list column of equal lengths as a matrix of doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten()).astype(np.float64).reshape(len(column), -1)


def dense(queries: DataFrame, corpus: DataFrame, k: int = POOL, *, allowed: Callable[[pa.Table, pa.RecordBatch], np.ndarray] | None = None) -> DataFrame:
    """(query_id, id, score, rank): the k nearest by cosine, exact.

    The corpus is scanned once for each block of at most about ``QUERY_ROWS`` queries
    (query_id, vec, …), which is broadcast.  A task scores ``ROWS`` rows at a time with one
    matrix product, holds k rows for each query and passes those on, so the shuffle has k rows
    for each query and task.  Zero vectors are no candidates.  ``allowed(queries, rows)`` may
    give a mask, a row for each query, from the other columns of both sides.
    """
    spark, id_type = queries.sparkSession, corpus.schema["id"].dataType.simpleString()
    queries = queries.withColumn("vec", vectors.l2_normalized(F.col("vec"))).where("vec is not null")
    found = None
    for table in _in_blocks(queries, QUERY_ROWS):
        sent = spark.sparkContext.broadcast(table)

        def score(batches, sent=sent):
            own = sent.value
            if not own.num_rows:
                return
            q, best, kind = _matrix(own.column("vec")), _Best(own.num_rows, k), None
            for batch in batches:
                kind = batch.schema.field("id").type
                for at in range(0, batch.num_rows, ROWS):
                    some = batch.slice(at, ROWS)
                    m = _matrix(some.column("vec"))
                    norms = np.sqrt((m * m).sum(1))
                    s = np.where(norms > 0, (q @ m.T) / np.where(norms > 0, norms, 1), -np.inf)
                    if allowed is not None:
                        s = np.where(allowed(own, some), s, -np.inf)
                    best.add(s, np.asarray(some.column("id").to_pylist()))
            if kind is not None:
                yield best.table(own.column("query_id").combine_chunks(), kind)

        part = corpus.where("vec is not null").mapInArrow(score, f"query_id {queries.schema['query_id'].dataType.simpleString()}, id {id_type}, score double")
        found = part if found is None else found.unionByName(part)
    return top_k(found, k, "score", "id")


def term_counts(docs: DataFrame, wanted: list[str]) -> DataFrame:
    """(id, len, terms, tfs) of every document (id, text): its words, and which of ``wanted``
    (by place) it holds how often.  Written once, so that texts are split once."""
    sent = docs.sparkSession.sparkContext.broadcast({w: k for k, w in enumerate(wanted)})

    def count(batches):
        import pyarrow.compute as pc

        index = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                some = batch.slice(at, ROWS)
                words = some.column("ws")
                coded = pc.dictionary_encode(words.flatten())
                known = np.array([index.get(w, -1) for w in coded.dictionary.to_pylist()], np.int64)
                lens = np.asarray(words.value_lengths())
                term, row = known[np.asarray(coded.indices)] if len(coded) else np.empty(0, np.int64), np.repeat(np.arange(some.num_rows), lens)
                use = term >= 0
                keys, n = np.unique(row[use] * (len(index) + 1) + term[use], return_counts=True)
                offsets = np.searchsorted(keys, np.arange(some.num_rows + 1) * (len(index) + 1))
                lists = [pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(x.astype(np.int32))) for x in (keys % (len(index) + 1), n)]
                yield pa.RecordBatch.from_arrays([some.column("id"), pa.array(lens.astype(np.int32)), *lists], ["id", "len", "terms", "tfs"])

    rows = docs.select("id", text.words(F.col("text")).alias("ws")).where("ws is not null")
    return written(rows.mapInArrow(count, f"id {docs.schema['id'].dataType.simpleString()}, len int, terms array<int>, tfs array<int>"), "term-counts")


def bm25(queries: DataFrame, docs: DataFrame, k: int = POOL) -> DataFrame:
    """(query_id, id, score, rank): the k best of ``docs`` (id, text) for each query
    (query_id, text), whose distinct terms count once.

    Documents are scored where they lie: one pass counts the query terms of each document, a
    thin aggregation their document frequencies, and a pass over the thin counts scores them
    against each block of about ``QUERY_ROWS`` queries.  A task passes on k rows for each query,
    so a term that nearly all documents hold costs no shuffle.
    """
    spark, id_type = queries.sparkSession, docs.schema["id"].dataType.simpleString()
    found = None
    for table in _in_blocks(queries.select("query_id", F.array_distinct(text.words(F.col("text"))).alias("ws")), QUERY_ROWS):
        own = [ws or [] for ws in table.column("ws").to_pylist()]
        wanted = sorted({w for ws in own for w in ws})
        place = {w: i for i, w in enumerate(wanted)}
        counts = term_counts(docs, wanted)
        n, total = counts.agg(F.count("*"), F.coalesce(F.avg("len"), F.lit(0.0))).first()
        df = np.zeros(len(wanted))
        for r in counts.select(F.explode("terms").alias("t")).groupBy("t").count().toArrow().to_pylist():
            df[r["t"]] = r["count"]
        asking = sorted((place[w], q) for q, ws in enumerate(own) for w in ws)
        first = np.searchsorted([t for t, _ in asking], np.arange(len(wanted) + 1))
        sent = spark.sparkContext.broadcast((table.column("query_id").combine_chunks(), np.log(1 + (n - df + 0.5) / (df + 0.5)), first, np.array([q for _, q in asking], np.int64)))

        def score(batches, sent=sent, avgdl=total):
            query_ids, idf, first, by_term = sent.value
            best, kind = _Best(len(query_ids), k), None
            for batch in batches:
                kind = batch.schema.field("id").type
                for at in range(0, batch.num_rows, ROWS):
                    some = batch.slice(at, ROWS)
                    per = np.asarray(some.column("terms").value_lengths())
                    row, term = np.repeat(np.arange(some.num_rows), per), np.asarray(some.column("terms").flatten())
                    tf, length = np.asarray(some.column("tfs").flatten()).astype(np.float64), np.asarray(some.column("len"))[row]
                    part = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / avgdl))
                    times = first[term + 1] - first[term]  # each part goes to the queries that ask for its term
                    which = np.repeat(first[term], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                    cell = by_term[which] * some.num_rows + np.repeat(row, times)
                    s = np.bincount(cell, np.repeat(part, times), len(query_ids) * some.num_rows).reshape(len(query_ids), some.num_rows)
                    best.add(np.where(s > 0, s, -np.inf), np.asarray(some.column("id").to_pylist()))
            if kind is not None:
                yield best.table(query_ids, kind)

        part = counts.mapInArrow(score, f"query_id {queries.schema['query_id'].dataType.simpleString()}, id {id_type}, score double")
        found = part if found is None else found.unionByName(part)
    return top_k(found, k, "score", "id")


def fusion_k(complexity: Column, dynamic: bool = True) -> Column:
    """The fusion constant of a complexity; 60 for unknown ones or without ``dynamic``."""
    if not dynamic:
        return F.lit(DEFAULT_K)
    known = F.create_map(*[F.lit(x) for kv in FUSION_K.items() for x in kv])
    return F.coalesce(F.try_element_at(known, F.coalesce(complexity, F.lit(""))), F.lit(DEFAULT_K))


def fused(lists: DataFrame, k: Column | None = None) -> DataFrame:
    """Reciprocal rank fusion of ranked lists (query_id, source, pos, id, rank, score).

    (query_id, id, rrf_score, rank, sources in order of lists, individual_scores).  A union
    and one aggregation, no outer joins.
    """
    share = 1.0 / ((F.lit(DEFAULT_K) if k is None else k) + F.col("rank"))
    out = lists.withColumn("share", share).groupBy("query_id", "id").agg(
        F.sum("share").alias("rrf_score"),
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "source"))), lambda x: x["source"]).alias("sources"),
        F.map_from_entries(F.collect_list(F.struct("source", F.coalesce("score", "share")))).alias("individual_scores"),
    )
    order = Window.partitionBy("query_id").orderBy(F.round("rrf_score", 9).desc(), "id")
    return out.withColumn("rank", F.row_number().over(order))


def hybrid(queries: DataFrame, docs: DataFrame, corpus: DataFrame, k: int = POOL, pool: int = POOL, *, near=None, index=None) -> DataFrame:
    """Dense and BM25 candidates of each query (query_id, text, vec, complexity), fused.  The
    pools are written once, however often the result is read.

    ``near`` (``cells.Cells``) and ``index`` (``inverted.Index``) are stored indexes that are read
    instead of ``corpus`` and ``docs``.
    """
    vecs, texts = queries.where("vec is not null").select("query_id", "vec"), queries.select("query_id", "text")
    legs = [("dense", dense(vecs, corpus, k) if near is None else near.search(vecs, k)), ("bm25", bm25(texts, docs, k) if index is None else index.search(texts, k))]
    lists = None
    for pos, (name, leg) in enumerate(legs):
        part = leg.select("query_id", "id", "rank", "score", F.lit(name).alias("source"), F.lit(pos).alias("pos"))
        lists = part if lists is None else lists.unionByName(part)
    lists = lists.join(queries.select("query_id", fusion_k(F.col("complexity")).alias("k")), "query_id")
    return written(fused(lists, F.col("k")).where(F.col("rank") <= pool), "pools")


def deduplicated(candidates: DataFrame) -> DataFrame:
    """The first candidate of each (query_id, chunk_id) by (source_pos, rank); rows without
    an id go."""
    order = Window.partitionBy("query_id", "chunk_id").orderBy("source_pos", "rank")
    rows = candidates.where("chunk_id is not null and chunk_id <> ''")
    return rows.withColumn("at", F.row_number().over(order)).where("at = 1").drop("at")


def coverage(queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """(query_id, id, rerank_score): the share of a query's term weight that a candidate's
    first 2000 characters hold; a reranker without a model.

    Weights are ln(1 + N / df) over the candidates of all queries.
    """
    rows = candidates.select("query_id", "id", F.array_distinct(text.words(F.substring("text", 1, 2000))).alias("ws"))
    terms = queries.select("query_id", F.explode(F.array_distinct(text.words(F.col("text")))).alias("term"))
    total = rows.agg(F.count("*").alias("n"))
    df = rows.select(F.explode("ws").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    weights = terms.join(df, "term", "left").crossJoin(F.broadcast(total)).withColumn("w", F.ln(1 + F.col("n") / (F.coalesce("df", F.lit(0)) + 1.0)))
    per = weights.groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("term", "w"))).alias("ws_q"), F.sum("w").alias("all"))
    both = rows.join(per, "query_id")
    hit = F.aggregate(F.map_values(F.map_filter("ws_q", lambda k, _v: F.array_contains("ws", k))), F.lit(0.0), lambda a, x: a + x)
    return both.select("query_id", "id", F.try_divide(hit, F.col("all")).alias("rerank_score"))


def scored_by(queries: DataFrame, candidates: DataFrame, score: Callable[[Column, Column], Column]) -> DataFrame:
    """The candidates (query_id, id, text, …) with ``rerank_score`` by a model's function of
    the query's and the candidate's text, of which it gets the first 2000 characters.

    A pandas UDF fits here.  Where the function gives null the fused score counts.
    """
    asked = queries.select("query_id", F.col("text").alias("__query"))
    rows = candidates.join(asked, "query_id")
    return rows.withColumn("rerank_score", score(F.col("__query"), F.substring("text", 1, 2000))).drop("__query")


def reranked(scored: DataFrame, k: int = TOP) -> DataFrame:
    """The k best by rerank_score, or by rrf_score where a candidate has none."""
    scored = scored.withColumn("final_score", F.coalesce("rerank_score", "rrf_score"))
    return top_k(scored, k, "final_score", "id")
