"""A dense index in cells: an inverted file of vectors around learned centroids.

K-means learns the centroids on all vectors.  A vector lies in the cell of its centroid, a cell
is a folder of the table, and of each cell the angles between its vectors and its centroid are known.  A
search scores the cells nearest to the query first.  Its kth best score so far is a threshold: a cell
whose centroid is at the angle a and whose vectors are within r of it holds nothing better than
cos(a - r), and only cells that may reach the threshold are scored then.

With ``reach`` 1, r is the largest angle of the cell and the result is exact.  Below 1, r is the angle
within which that share of the cell lies: fewer cells are scored and the outermost vectors of cells
that are left out can be missed.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from corpusloom.functions import vectors
from corpusloom.operators.inverted import Read
from corpusloom.operators.retrieve import POOL, QUERY_ROWS, top_k
from corpusloom.operators.tables import scratch, written

MOST_CELLS, ROUNDS, SEED = 4096, 10, 42
#: Vectors of a part of a cell, which meet a block of queries in one task.
PART_ROWS = 20_000
#: Vectors that are scored first, for k results: so many times k.
FIRST = 4
#: Shares of a cell for which the angle is kept.
SHARES = (0.0, 0.5, 0.75, 0.9, 0.95, 0.99, 1.0)
_SLACK = 2e-6


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten()).astype(np.float64).reshape(len(column), -1)


class Cells:
    """The index in a folder: ``build`` writes it, ``Cells(spark, folder)`` opens it.

    vectors (cell, part, id, unit), centroids (cell, centre, n, parts, angles); the latter is at most
    ``MOST_CELLS`` rows.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.centroids = spark.read.parquet(f"{self.folder}/centroids")
        self.vectors = spark.read.parquet(f"{self.folder}/vectors")

    @staticmethod
    def build(corpus: DataFrame, folder: str | None = None, cells: int | None = None) -> Cells:
        """Index ``corpus`` (id, vec); vectors of length zero are left out, as in ``retrieve.dense``."""
        spark = corpus.sparkSession
        folder = folder or f"{scratch(spark)}/corpusloom/cells-{uuid.uuid4().hex}"
        rows = corpus.where("vec is not null").select("id", vectors.l2_normalized(F.col("vec")).alias("unit"))
        rows = written(rows.where(F.exists("unit", lambda x: x != 0)), "units").withColumn("features", array_to_vector("unit"))
        n = rows.count()
        cells = min(cells or max(1, min(MOST_CELLS, int(n**0.5))), max(1, n))
        if n:
            model = KMeans(k=cells, distanceMeasure="cosine", maxIter=ROUNDS, seed=SEED, initSteps=2).fit(rows)
            centres = [c / (np.linalg.norm(c) or 1.0) for c in model.clusterCenters()]
            placed = model.transform(rows).select("id", "unit", F.col("prediction").alias("cell"))
        else:
            centres, placed = [], rows.select("id", "unit", F.lit(0).alias("cell"))
        known = spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(centres)], "cell int, centre array<double>")
        near = placed.join(F.broadcast(known), "cell").withColumn("angle", F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), vectors.dot(F.col("unit"), F.col("centre"))))))
        near = written(near.drop("centre"), "placed")
        inner = F.percentile_approx("angle", F.array(*[F.lit(s) for s in SHARES[:-1]]))
        stats = near.groupBy("cell").agg(F.count("*").alias("n"), F.concat(inner, F.array(F.max("angle"))).alias("angles"))
        stats = known.join(stats, "cell").withColumn("parts", F.ceil(F.col("n") / PART_ROWS).cast("int"))
        stats.coalesce(1).write.mode("overwrite").parquet(f"{folder}/centroids")
        sizes = spark.read.parquet(f"{folder}/centroids").select("cell", "parts")
        parts = near.join(F.broadcast(sizes), "cell").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
        out = parts.select("cell", "part", "id", "unit").repartition("cell", "part").write.mode("overwrite")
        (out.partitionBy("cell") if n else out).parquet(f"{folder}/vectors")
        return Cells(spark, folder)

    def drop(self) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def _bounds(self, queries: DataFrame, k: int, reach: float) -> DataFrame:
        """(query_id, q, cell, parts, n, first, bound) for each query and cell."""
        table = self.centroids.orderBy("cell").toArrow()  # at most ``MOST_CELLS`` rows
        sent = self.spark.sparkContext.broadcast(table)
        kind = queries.schema["query_id"].dataType.simpleString()
        share = SHARES.index(min(s for s in SHARES if s >= reach))

        def bound(batches):
            own = sent.value
            if not own.num_rows:
                return
            centres, n = _matrix(own.column("centre")), own.column("n").to_numpy()
            radius = _matrix(own.column("angles"))[:, share]
            for batch in batches:
                for at in range(0, batch.num_rows, 500):
                    some = batch.slice(at, 500)
                    angle = np.arccos(np.clip(_matrix(some.column("q")) @ centres.T, -1, 1))
                    order = np.argsort(angle, axis=1, kind="stable")
                    before = np.cumsum(n[order], axis=1) - n[order]
                    first = np.zeros(angle.shape, bool)
                    np.put_along_axis(first, order, before < FIRST * k, axis=1)
                    row = pa.array(np.repeat(np.arange(some.num_rows), len(n)))
                    cell = pa.array(np.tile(np.arange(len(n)), some.num_rows))
                    columns = [some.column("query_id").take(row), *(own.column(c).combine_chunks().take(cell) for c in ("cell", "parts", "n"))]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(first.ravel()), pa.array(np.cos(np.maximum(0, angle - radius)).ravel())], ["query_id", "cell", "parts", "n", "first", "bound"])

        return queries.mapInArrow(bound, f"query_id {kind}, cell int, parts int, n long, first boolean, bound double")

    def search(self, queries: DataFrame, k: int = POOL, reach: float = 1.0, read: Read | None = None) -> DataFrame:
        """(query_id, id, score, rank): the k nearest by cosine to each query (query_id, vec)."""
        q = queries.where("vec is not null").select("query_id", vectors.l2_normalized(F.col("vec")).alias("q"))
        q = written(q, "query-units")
        blocks = max(1, -(-q.count() // QUERY_ROWS))
        bounds = written(self._bounds(q, k, reach), "cell-bounds")
        found = written(self._scored(bounds.where("first"), q, k, blocks), "first-cells")
        least = top_k(found, k, "score", "id").groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("least"))
        rest = bounds.where("not first").join(least, "query_id", "left")
        rest = written(rest.where(F.col("least").isNull() | (F.col("bound") >= F.col("least") - _SLACK)).drop("least"), "more-cells")
        if read is not None:
            total = lambda df: df.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
            read.possible, read.read = total(bounds), total(bounds.where("first")) + total(rest)
        return top_k(found.unionByName(self._scored(rest, q, k, blocks)), k, "score", "id")

    def _scored(self, pairs: DataFrame, q: DataFrame, k: int, blocks: int) -> DataFrame:
        """(query_id, id, score): of each part of a cell the k best for each query that looks there, and ties."""
        block = F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")
        asked = pairs.select("query_id", "cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).join(q, "query_id").withColumn("block", block)
        there = self.vectors.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        wanted = pairs.select("cell").distinct()
        there = there.join(F.broadcast(wanted), "cell")  # at most ``MOST_CELLS`` rows
        types = [to_arrow_type(asked.schema["query_id"].dataType), to_arrow_type(there.schema["id"].dataType)]

        def score(own: pa.Table, mine: pa.Table) -> pa.Table:
            rows, cols, scores = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
            if own.num_rows and mine.num_rows:
                s = _matrix(own.column("q")) @ _matrix(mine.column("unit")).T
                near = s.round(6)
                least = np.partition(near, -k, axis=1)[:, -k][:, None] if k < near.shape[1] else -np.inf
                rows, cols = np.nonzero(near >= least)
                scores = s[rows, cols]
            ids = [c.combine_chunks().take(pa.array(i)) for c, i in ((own.column("query_id"), rows), (mine.column("id"), cols))]
            return pa.table([ids[0].cast(types[0]), ids[1].cast(types[1]), pa.array(scores)], ["query_id", "id", "score"])

        key = ["cell", "part", "block"]
        kind = f"query_id {asked.schema['query_id'].dataType.simpleString()}, id {there.schema['id'].dataType.simpleString()}, score double"
        left, right = asked.select(*key, "query_id", "q"), there.select(*key, "id", "unit")
        return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(score, kind)
