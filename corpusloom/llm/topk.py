"""Exact top-k search by distributed histogram selection.

Everything is scored, in blocks: the candidates are dealt into blocks of about
``BLOCK`` vectors, the queries into blocks of ``QUERY_BLOCK``, and each pair of blocks is
one matrix product in a task.  A pass does not keep the scores.  It counts, for each
query, how many fall into each bin of the interval that is known to hold the query's kth
value; the counts of all blocks add up to a global histogram, whose bin with the kth
value is the next, smaller interval.  When an interval is one score wide, that score is
the kth value: the last pass keeps the scores from it upwards and breaks ties by the
smaller id.

A block sends only its highest bins that are not empty until they hold k candidates: the
global kth value cannot lie below any block's kth value, so lower bins never matter.  In
the last pass a block likewise needs at most k rows for each query.

Scale: blocks are assigned by hash and of bounded size, whatever the data; queries are
not broadcast but joined block by block, so both sides may grow.  Per-query intervals are
thin tables in the shared folder; one number, the range of the scores, comes to the
driver.

Edge cases: vectors that are null, empty, or hold null or non-finite components take no
part.  Every row counts, repeated ones too: a query's candidates are all rows but its own, and
a query row that is repeated is answered once for each.  Null ids are candidates (after all others in ties), not queries.
Vectors of different lengths are not compared.  Scores are exact as long as they fit 53
bits and are then computed in doubles; larger ones go through Python integers and are
clipped to 62 bits.  Empty tables give empty results.  Only the named columns are read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.shared import column, materialize

K = 10
SCALE = 1024
BLOCK = 4096
QUERY_BLOCK = 512
#: Bins of a histogram, as a power of two.
BIN_BITS = 10
_EXACT = 1 << 53
_LONG = (1 << 63) - 1
#: Largest score that is told apart.
_MOST = (1 << 62) - 1


def quantized(vector: Column, scale: int = SCALE) -> Column:
    """array<double> of floor(scale * x); null unless all components are finite."""
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("double"))
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.when(vector.isNotNull() & (F.size(vector) > 0) & good, whole)


def _floats(vectors) -> np.ndarray:
    """A list-of-doubles Arrow column of equal lengths as a matrix."""
    return np.asarray(vectors.flatten()).reshape(len(vectors), -1)


def _blocked(rows: DataFrame, blocks: int, name: str) -> DataFrame:
    """(dim, name, ids, keys, mat): vectors packed into blocks by hash.

    ``rows``: id long, key long (of the row), vec array<double>.  A block is bounded by the
    choice of ``blocks``.
    """
    block = F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int").alias(name)
    sets = rows.groupBy(F.size("vec").alias("dim"), block).agg(F.collect_list(F.struct("id", "key", "vec")).alias("vs"))

    def pack(batches):
        for batch in batches:
            ids, keys, mats = [], [], []
            for vs in batch.column("vs"):
                values = vs.values
                own = values.field("id")
                ids.append(pa.array(np.where(np.asarray(own.is_null()), _LONG, np.asarray(own.fill_null(0)))).to_numpy().astype(np.int64).tobytes())
                keys.append(np.asarray(values.field("key")).astype(np.int64).tobytes())
                mats.append(_floats(values.field("vec")).astype(np.float64).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("dim"), batch.column(name), *[pa.array(x, pa.binary()) for x in (ids, keys, mats)]], ["dim", name, "ids", "keys", "mat"])

    return sets.mapInArrow(pack, f"dim int, {name} int, ids binary, keys binary, mat binary")


def _scores(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Integer inner products, exact."""
    top = float(np.abs(queries).max(initial=0)) * float(np.abs(candidates).max(initial=0)) * queries.shape[1]
    if top < _EXACT:
        return (queries @ candidates.T).astype(np.int64)
    whole = [np.array([[int(x) for x in row] for row in m.tolist()], object) for m in (queries, candidates)]
    return np.clip(whole[0] @ whole[1].T, -_MOST, _MOST).astype(np.int64)


def _scored(batch: pa.RecordBatch):
    """For each pair of blocks: its place, query ids, candidate ids, scores, and which
    candidates are other rows than the query's."""
    for i in range(batch.num_rows):
        get = lambda c, i=i: batch.column(c)[i].as_py()
        dim = get("dim")
        qid, cid = np.frombuffer(get("qids"), np.int64), np.frombuffer(get("ids"), np.int64)
        scores = _scores(np.frombuffer(get("qmat"), np.float64).reshape(-1, dim), np.frombuffer(get("mat"), np.float64).reshape(-1, dim))
        yield i, qid, cid, scores, np.frombuffer(get("qkeys"), np.int64)[:, None] != np.frombuffer(get("keys"), np.int64)[None, :]


def _pairs(queries: DataFrame, candidates: DataFrame, blocks: int) -> DataFrame:
    """Each block of queries beside each block of candidates of the same length.

    Both sides are shuffled: the blocks of queries are so many times a small table, which Spark would take to be small enough
    for the driver.
    """
    spread = queries.withColumn("to", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumnRenamed("dim", "qdim")
    return spread.join(candidates.hint("merge"), (F.col("qdim") == F.col("dim")) & (F.col("to") == F.col("block"))).drop("qdim", "to")


def _histogram(pairs: DataFrame, k: int) -> DataFrame:
    """(dim, qblock, row, bin, n): a block's counts in the highest bins of each query's
    interval, which starts at ``lo`` and has bins of ``width`` scores."""

    def count(batches):
        for batch in batches:
            for i, _qid, _cid, scores, other in _scored(batch):
                lo = np.frombuffer(batch.column("lo")[i].as_py(), np.int64)[:, None]
                width = batch.column("width")[i].as_py()
                bins = np.minimum((scores - lo) // width, (1 << BIN_BITS) - 1)
                bins = np.where(other & (scores >= lo), bins, -1)
                if bins.shape[1] > k:  # the k largest are enough: lower bins never matter
                    bins = -np.partition(-bins, k - 1, axis=1)[:, :k]
                rows = np.repeat(np.arange(len(bins)), bins.shape[1])
                keys, n = np.unique((rows << (BIN_BITS + 1)) + bins.ravel() + 1, return_counts=True)
                at, b = keys >> (BIN_BITS + 1), (keys & ((2 << BIN_BITS) - 1)) - 1
                use = b >= 0
                m = int(use.sum())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(m, batch.column(c)[i].as_py(), np.int32)) for c in ("dim", "qblock")] + [pa.array(at[use].astype(np.int32)), pa.array(b[use].astype(np.int32)), pa.array(n[use])], ["dim", "qblock", "row", "bin", "n"])

    return pairs.mapInArrow(count, "dim int, qblock int, row int, bin int, n long").groupBy("dim", "qblock", "row", "bin").agg(F.sum("n").alias("n"))


def _narrowed(queries: DataFrame, histogram: DataFrame, k: int) -> DataFrame:
    """The queries with the bin of the kth value as their new interval."""
    down = Window.partitionBy("dim", "qblock", "row").orderBy(F.col("bin").desc())
    sums = histogram.withColumn("above", F.sum("n").over(down.rowsBetween(Window.unboundedPreceding, -1)))
    # fewer than k candidates: the lowest bin that has any
    at = sums.where(F.coalesce("above", F.lit(0)) < k).groupBy("dim", "qblock", "row").agg(F.min("bin").alias("bin"))
    per = at.groupBy("dim", "qblock").agg(F.collect_list(F.struct("row", "bin")).alias("at"))

    def move(batches):
        for batch in batches:
            lows = []
            for low, width, some in zip(batch.column("lo").to_pylist(), batch.column("width").to_pylist(), batch.column("at").to_pylist(), strict=True):
                low = np.frombuffer(low, np.int64).copy()
                for x in some or ():
                    low[x["row"]] = int(low[x["row"]]) + x["bin"] * width
                lows.append(low.tobytes())
            out = {c: batch.column(c) for c in ("dim", "qblock", "qids", "qkeys", "qmat")} | {"lo": pa.array(lows, pa.binary()), "width": batch.column("width")}
            yield pa.RecordBatch.from_arrays([*out.values()], [*out])

    rows = queries.join(per, ["dim", "qblock"], "left").select("dim", "qblock", "qids", "qkeys", "qmat", "lo", "width", "at")
    return rows.mapInArrow(move, "dim int, qblock int, qids binary, qkeys binary, qmat binary, lo binary, width long")


def _kept(pairs: DataFrame, k: int) -> DataFrame:
    """(query_id, row, qblock, dim, vec_id, score) from the kth value upwards."""

    def keep(batches):
        for batch in batches:
            for i, qid, cid, scores, other in _scored(batch):
                lo = np.frombuffer(batch.column("lo")[i].as_py(), np.int64)
                r, c = np.nonzero(other & (scores >= lo[:, None]))
                s = scores[r, c]
                order = np.lexsort((cid[c], -s, r))
                r, c, s = r[order], c[order], s[order]
                first = np.searchsorted(r, r)
                use = np.arange(len(r)) - first < k
                r, c, s = r[use], c[use], s[use]
                ids = cid[c]
                yield pa.RecordBatch.from_arrays([*[pa.array(np.full(len(r), batch.column(x)[i].as_py(), np.int32)) for x in ("dim", "qblock")], pa.array(r.astype(np.int32)), pa.array(qid[r]), pa.array(ids, mask=ids == _LONG), pa.array(s)], ["dim", "qblock", "row", "query_id", "vec_id", "score"])

    return pairs.mapInArrow(keep, "dim int, qblock int, row int, query_id long, vec_id long, score long")


def search(vectors: DataFrame, is_query: Column, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, scale: int = SCALE, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``vectors`` with ``is_query`` the k
    other rows with the highest integer inner product."""
    rows = vectors.select(column(id_col).cast("long").alias("id"), column(vector_col).alias("vec"), F.coalesce(is_query, F.lit(False)).alias("is_query"))
    rows = rows.withColumn("vec", quantized(F.col("vec"), scale)).where("vec is not null")
    rows = materialize(rows.withColumn("key", F.monotonically_increasing_id()), "vectors")
    asked = F.col("is_query") & F.col("id").isNotNull()
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda acc, x: acc + x * x))
    n, n_queries, longest, asking = rows.agg(F.count("*"), F.coalesce(F.sum(asked.cast("int")), F.lit(0)), F.coalesce(F.max(norm), F.lit(0.0)), F.coalesce(F.max(F.when(asked, norm)), F.lit(0.0))).first()
    blocks, q_blocks = max(1, math.ceil(n / block)), max(1, math.ceil(n_queries / query_block))
    candidates = materialize(_blocked(rows, blocks, "block"), "vector-blocks").repartition(min(blocks, 2000), "dim", "block")
    queries = _blocked(rows.where(asked), q_blocks, "qblock").withColumnsRenamed({"ids": "qids", "keys": "qkeys", "mat": "qmat"})
    # all scores lie in [-bound, bound], which the first histogram spans
    bound = min(_MOST, int(longest * asking * (1 + 1e-9)) + 2)
    passes = max(1, math.ceil(math.log2(2 * bound + 1) / BIN_BITS))
    width = 1 << (BIN_BITS * (passes - 1))

    def begin(batches):
        for batch in batches:
            lows = [np.full(len(x.as_py()) // 8, -bound, np.int64).tobytes() for x in batch.column("qids")]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lows, pa.binary())], [*batch.schema.names, "lo"])

    queries = queries.mapInArrow(begin, "dim int, qblock int, qids binary, qkeys binary, qmat binary, lo binary")
    for _ in range(passes):
        queries = materialize(queries.withColumn("width", F.lit(width).cast("long")), "queries")
        queries = _narrowed(queries, materialize(_histogram(_pairs(queries, candidates, blocks), k), "histogram"), k)
        width >>= BIN_BITS
    queries = materialize(queries, "queries")
    kept = _kept(_pairs(queries, candidates, blocks), k)
    best = Window.partitionBy("dim", "qblock", "row").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    ranked = kept.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
