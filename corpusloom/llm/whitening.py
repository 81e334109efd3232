"""Whitening of embeddings with MLlib's BlockMatrix.

The centred rows get consecutive numbers and are dealt into the blocks of a BlockMatrix C.
Its transpose times C is the scatter matrix, whose eigenvectors are found on the driver (its
size is that of one vector squared, whatever the number of rows).  C times the whitening
matrix projects all rows, and the covariance of what comes out is measured the same way.

Precision: a component c becomes the whole number x = floor(SCALE * c) (+ OFFSET).  Sums are
exact, the mean is kept as a whole number and a rest, so x - mean is right to the last bit
before anything is multiplied.  ``deviation`` is computed in whole numbers only: in longs
where the measured ranges prove that they suffice, in decimals otherwise.

Scale: every product runs on blocks; the middle dimension of the scatter, the rows, is split so that
a task holds a few blocks.  To the driver come the dimension's sums, the scatter and the numbers of rows of
each task.  The rows are written once to the shared folder, which a lost executor can't take away.

Edge cases: vectors that are null or hold a null or a non-finite component take no part.  A
matrix needs one width: vectors of another length than the commonest (of equally common ones
the longest), empty ones included, take no part either.  Repeated rows, null ids and repeated ids count like any
other row.  Components beyond +-2^40 / SCALE are taken as that.  A component without variance
(fewer rows than dimensions, constant dimensions) has ``whitened`` 0, and the identity is
measured over the others; where nothing varies ``explained`` is 0.  A deviation that no long
holds is null.  An empty table gives an empty result.  Only the two named columns are read.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import JavaModelWrapper, callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.shared import column, materialize, temporary

SCALE = 64
OFFSET = 1_000_000
COMPONENTS = 32
_MOST = float(1 << 40)
#: Rows of a block: at least so many, and more as the rows do, up to so many numbers.
BLOCK_ROWS, BLOCK_CELLS = 4096, 1 << 23
BLOCK_COLUMNS = 1024
#: Blocks that a task of the scatter holds.
BLOCKS_A_TASK = 4


def quantized(vector: Column, scale: int = SCALE) -> Column:
    """array<long> of floor(scale * c); null unless all components are finite."""
    whole = F.transform(vector, lambda c: F.floor(F.greatest(F.least(c.cast("double") * scale, F.lit(_MOST)), F.lit(-_MOST))))
    good = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    return F.when(vector.isNotNull() & good, whole)


class Whitening:
    """A fitted model: ``n`` rows, their ``mean`` as whole numbers and rests, eigenvalues and the matrix.

    ``matrix`` (dimension x components) projects centred rows; ``rows`` are the numbered rows of
    the fit list: (row, id, x).
    """

    def __init__(self, rows: DataFrame, n: int, sums: list[int], least: list[int], most: list[int], components: int):
        self.rows, self.n, self.sums = rows, n, sums
        self.whole = [s // n for s in sums]
        self.rest = [s - n * w for s, w in zip(sums, self.whole, strict=True)]
        self.reach = [max(abs(n * a - s), abs(n * b - s)) for a, b, s in zip(least, most, sums, strict=True)]
        self.centred = self._blocks()
        scatter = _local(_gram(self.centred, self._splits()))
        value, vector = np.linalg.eigh((scatter + scatter.T) / (2 * n))
        value, vector = value[::-1].clip(0), vector[:, ::-1]
        vector = vector * np.where(vector[np.abs(vector).argmax(0), np.arange(len(value))] < 0, -1, 1)
        self.value, self.vector = value[:components], vector[:, :components]
        self.varies = self.value > max(value[0], 0) * len(value) * np.finfo(float).eps
        self.explained = self.value / value.sum() if value.sum() > 0 else self.value * 0
        self.matrix = np.where(self.varies, self.vector / np.sqrt(np.where(self.varies, self.value, 1)), 0.0)

    @property
    def _block_rows(self) -> int:
        return max(1, min(max(BLOCK_ROWS, self.n // 4096), BLOCK_CELLS // len(self.sums)))

    def _splits(self) -> int:
        return max(1, -(-self.n // (self._block_rows * BLOCKS_A_TASK)))

    def deltas(self, x: Column) -> Column:
        """array<double>: x less the mean, right to the last bit."""
        mean = F.array(*[F.struct(F.lit(w).cast("long").alias("w"), F.lit(r / self.n).alias("r")) for w, r in zip(self.whole, self.rest, strict=True)])
        return F.zip_with(x, mean, lambda v, m: (v - m["w"]).cast("double") - m["r"])

    def deviation(self, x: Column) -> Column:
        """long: the sum over dimensions of (n * x - sum)^2."""
        narrow = sum(r * r for r in self.reach) < 1 << 62 and max(self.reach, default=0) < 1 << 31
        kind = "long" if narrow else "decimal(38,0)"
        mean = F.array(*[F.struct(F.lit(w).cast("long").alias("w"), F.lit(str(r)).cast(kind).alias("r")) for w, r in zip(self.whole, self.rest, strict=True)])
        n = F.lit(str(self.n)).cast("long" if narrow else "decimal(19,0)")
        if narrow:
            apart = F.zip_with(x, mean, lambda v, m: n * (v - m["w"]) - m["r"])
            return F.aggregate(apart, F.lit(0).cast("long"), lambda total, d: total + d * d)
        apart = F.zip_with(x, mean, lambda v, m: (n * (v - m["w"]).cast("decimal(19,0)")).try_cast("decimal(38,0)") - m["r"])
        square = lambda d: F.try_multiply(d.try_cast("decimal(19,0)"), d.try_cast("decimal(19,0)")).try_cast("decimal(38,0)")
        return F.aggregate(apart, F.lit("0").cast("decimal(38,0)"), lambda total, d: F.try_add(total, square(d)).try_cast("decimal(38,0)")).try_cast("long")

    def _blocks(self) -> BlockMatrix:
        rows = self.rows.select("row", array_to_vector(self.deltas(F.col("x"))).alias("v"))
        d = len(self.sums)
        indexed = IndexedRowMatrix(MLUtils.convertVectorColumnsFromML(rows, "v"), self.n, d)
        return indexed.toBlockMatrix(self._block_rows, min(d, BLOCK_COLUMNS))

    def project(self) -> tuple[DataFrame, float]:
        """(row, y array<double>) of all rows, and the largest departure of their covariance from the identity."""
        spark = self.rows.sparkSession
        cols = self.centred.colsPerBlock
        parts = [((i // cols, 0), _matrix(self.matrix[i : i + cols])) for i in range(0, len(self.matrix), cols)]
        by = BlockMatrix(spark.sparkContext.parallelize(parts, 1), cols, self.matrix.shape[1], *self.matrix.shape)
        y = self.centred.multiply(by)
        got = _local(_gram(y, self._splits())) / self.n
        error = float(np.abs(got - np.diag(self.varies.astype(float))).max())
        rows = callMLlibFunc("getIndexedRows", y.toIndexedRowMatrix()._java_matrix_wrapper._java_model).toDF("row", "v")
        return rows.select("row", vector_to_array("v", "float64").alias("y")), error


def _matrix(a: np.ndarray) -> DenseMatrix:
    return DenseMatrix(a.shape[0], a.shape[1], a.ravel(order="F"))


def _gram(m: BlockMatrix, splits: int):
    """m transposed times m, the rows split into ``splits`` parts."""
    own = m._java_matrix_wrapper._java_model
    return own.transpose().multiply(own, splits)


def _local(java_matrix) -> np.ndarray:
    return JavaModelWrapper(java_matrix).call("toLocalMatrix").toArray()


def _numbered(rows: DataFrame) -> DataFrame:
    """``rows`` (at: number within the task that wrote them) with consecutive numbers ``row``."""
    part = F.shiftright("at", 33)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(part.alias("part")).count().select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    within = F.col("at").bitwiseAND((1 << 33) - 1)
    return rows.withColumn("part", part).join(F.broadcast(starts), "part").select((F.col("start") + within).alias("row"), "id", "x")


def fit(df: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS, scale: int = SCALE) -> Whitening | None:
    """The model of all vectors of ``df``; None if there are none."""
    x = quantized(column(vector_col), scale)
    rows = df.select(column(id_col).alias("id"), x.alias("x")).where(F.size("x") > 0)
    sizes = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    if not sizes:
        return None
    d, n = sizes[0]["d"], sizes[0]["count"]
    rows = materialize(rows.where(F.size("x") == d).withColumn("at", F.monotonically_increasing_id()), "vectors")
    low = 1 << 20
    stats = (
        rows.select(F.posexplode("x").alias("p", "x"))
        .groupBy("p")
        .agg(F.sum(F.shiftright("x", 20)).alias("high"), F.sum(F.col("x").bitwiseAND(low - 1)).alias("low"), F.min("x").alias("least"), F.max("x").alias("most"))
        .orderBy("p")
        .collect()
    )
    return Whitening(_numbered(rows), n, [r["high"] * low + r["low"] for r in stats], [r["least"] for r in stats], [r["most"] for r in stats], components)


def whiten(df: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """(id, n, deviation, whitened array<double>, explained array<double>, identity_error), a row for each vector."""
    spark = df.sparkSession
    with temporary(spark):
        model = fit(df, id_col=id_col, vector_col=vector_col, components=components, scale=scale)
        if model is None:
            kind = df.select(column(id_col).alias("id")).schema["id"].dataType.simpleString()
            return spark.createDataFrame([], f"id {kind}, n long, deviation long, whitened array<double>, explained array<double>, identity_error double")
        y, error = model.project()
        rows = model.rows.select("row", "id", model.deviation(F.col("x")).alias("deviation")).join(y, "row")
        explained = F.array(*[F.lit(float(e)) for e in model.explained])
        out = rows.select("id", F.lit(model.n).cast("long").alias("n"), "deviation", F.col("y").alias("whitened"), explained.alias("explained"), F.lit(error).alias("identity_error"))
        return materialize(out, "whitened", keep=True)


def digest(whitened: DataFrame) -> DataFrame:
    """A row for each vector and component."""
    each = whitened.select("id", "n", "deviation", "identity_error", "explained", F.posexplode("whitened").alias("p", "whitened"))
    return each.select(
        F.col("id").alias("vec_id"), (F.col("p") + 1).cast("int").alias("component"), "n", "deviation", "whitened", F.element_at("explained", F.col("p") + 1).alias("explained"), "identity_error"
    )
