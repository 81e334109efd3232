"""General joins that need more than one DataFrame call."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.tables import written


def as_of(left: DataFrame, right: DataFrame, by: str, at: str, value: str) -> DataFrame:
    """Each left row with the last ``value`` of the right side at or before its ``at``.

    Both sides are merged and one window carries the last value forward, so no pairs are
    made.  Right rows come first among equal times; of several at one time the largest value
    counts.
    """
    a = left.withColumns({"__left": F.lit(True), "__value": F.lit(None).cast(right.schema[value].dataType)})
    b = right.groupBy(by, at).agg(F.max(value).alias("__value")).withColumn("__left", F.lit(False))
    order = Window.partitionBy(by).orderBy(F.col(at), F.col("__left")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = a.unionByName(b, allowMissingColumns=True)
    carried = both.withColumn(value, F.last("__value", ignorenulls=True).over(order))
    return carried.where("__left").drop("__left", "__value")


def in_range(points: DataFrame, ranges: DataFrame, at: str, low: str, high: str, width: float) -> DataFrame:
    """Pairs with low <= at < high as an equi-join: ranges are laid over cells of ``width``
    and each point looks into its own cell only."""
    cell = lambda c: F.floor(F.col(c) / width).cast("long")
    cells = ranges.withColumn("__cell", F.explode(F.sequence(cell(low), cell(high))))
    both = points.withColumn("__cell", cell(at)).join(cells, "__cell")
    return both.where((F.col(at) >= F.col(low)) & (F.col(at) < F.col(high))).drop("__cell")


def counts_in_range(points: DataFrame, ranges: DataFrame, at: str, low: str, high: str) -> DataFrame:
    """The ranges that hold a point, low <= at < high, with the number ``n`` of these, without any pairs.

    ``n`` is the number of points below ``high`` less that below ``low``.  Those are running sums over the different points
    and ends in their order, which is parted by ranges of them: within a part by a window, over the parts by their totals, a
    row each.  So the work grows with points and ranges, not with their product.
    """
    ends = ranges.select(low, high).where(F.col(low) < F.col(high)).distinct()
    marks = ends.select(F.col(low).alias("__x")).unionByName(ends.select(F.col(high).alias("__x"))).select("__x", F.lit(0).alias("__n"))
    all_ = points.select(F.col(at).alias("__x"), F.lit(1).alias("__n")).where("__x is not null").unionByName(marks)
    # written, since the bounds of the parts come from a sample
    sums = all_.groupBy("__x").agg(F.sum("__n").alias("__n")).repartitionByRange("__x").withColumn("__part", F.spark_partition_id())
    sums = written(sums, "running-sums")
    before = lambda w: F.coalesce(F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = sums.groupBy("__part").agg(F.sum("__n").alias("__n")).select(F.col("__part").alias("__p"), before(Window.orderBy("__part")).alias("__earlier"))
    own = sums.withColumn("__below", before(Window.partitionBy("__part").orderBy("__x")))
    below = own.join(F.broadcast(parts), F.col("__part") == F.col("__p")).select("__x", (F.col("__below") + F.col("__earlier")).alias("__below"))
    for c, name in ((low, "__l"), (high, "__h")):
        ends = ends.join(below.withColumnsRenamed({"__x": f"{name}x", "__below": name}), F.col(c) == F.col(f"{name}x"))
    counted = ends.select(F.col(low).alias("__low"), F.col(high).alias("__high"), (F.col("__h") - F.col("__l")).alias("n")).where("n > 0")
    return ranges.join(counted, (F.col(low) == F.col("__low")) & (F.col(high) == F.col("__high"))).drop("__low", "__high")


def salted_sum(rows: DataFrame, key: str, value: str, salts: int = 16) -> DataFrame:
    """(key, total) for a skewed key: partial sums by a salt, then their sum."""
    part = rows.groupBy(key, F.pmod(F.xxhash64(value), F.lit(salts)).alias("__salt")).agg(F.sum(value).alias("__part"))
    return part.groupBy(key).agg(F.sum("__part").alias("total"))


def _reaching(least: Column):
    return lambda level: level >= least


def overlapping(left: DataFrame, right: DataFrame, low: str, high: str, keys: tuple[str, ...] = (), unit: float = 1.0, empty: bool = False) -> DataFrame:
    """Pairs of intervals [low, high) that overlap, as an equi-join: (keys…, a, b), the rows as structs.

    Each interval belongs to the level whose cells, ``unit`` times a power of two wide, are the
    narrowest that are at least as long as it, and so touches two cells at most.  It looks into
    the cells of its own level and, for the partners that are longer, into those of all wider levels that occur; so a
    long interval is not spread over many cells.  A pair that meets in two cells counts in the one that
    holds the later beginning.  Empty intervals and nulls overlap nothing; with ``empty`` the comparisons a.low < b.high
    and b.low < a.high alone decide, so an interval without length, or one that ends before it begins, overlaps
    those that hold both its ends inside.  ``unit`` only sets the narrowest cell.
    """

    def marked(rows: DataFrame, name: str) -> DataFrame:
        whole = rows.select(*keys, F.struct(*rows.columns).alias(name), F.col(low).cast("double").alias(f"__{name}l"), F.col(high).cast("double").alias(f"__{name}h"))
        # of a pair that overlaps one at most ends before it begins: the longer one begins first and ends last
        some = F.col(f"__{name}l").isNotNull() & F.col(f"__{name}h").isNotNull()
        whole = whole.where(some if empty else F.col(f"__{name}l") < F.col(f"__{name}h"))
        length = F.abs(F.col(f"__{name}h") - F.col(f"__{name}l"))
        return whole.withColumn(f"__{name}level", F.greatest(F.lit(0), F.ceil(F.log2(length / unit))).cast("int"))

    def cells(rows: DataFrame, name: str, levels: Column) -> DataFrame:
        size = lambda k: F.lit(unit) * F.pow(F.lit(2.0), k)
        at = lambda c, k: F.floor(F.col(c) / size(k)).cast("long")
        each = F.transform(levels, lambda k: F.transform(F.sequence(at(f"__{name}l", k), at(f"__{name}h", k)), lambda c: F.struct(k.alias("__level"), c.alias("__cell"))))
        return rows.withColumn("__at", F.explode(F.flatten(each))).select("*", "__at.__level", "__at.__cell").drop("__at")

    a, b = marked(left, "a"), marked(right, "b")
    found = []
    # the one of a pair that is not shorter stays at its level, the other one looks there
    for short, long_, x, y, wider in ((a, b, "a", "b", False), (b, a, "b", "a", True)):
        levels = sorted(r[0] for r in long_.select(f"__{y}level").distinct().collect())  # a few dozen numbers
        all_levels = F.array(*[F.lit(k) for k in levels]).cast("array<int>")
        least = F.col(f"__{x}level") + int(wider)
        look = F.filter(all_levels, _reaching(least))
        here, there = cells(short, x, look), cells(long_, y, F.array(F.col(f"__{y}level")))
        both = here.join(there, [*keys, "__level", "__cell"])
        later = F.greatest("__al", "__bl")
        once = F.floor(later / (F.lit(unit) * F.pow(F.lit(2.0), F.col("__level")))).cast("long") == F.col("__cell")
        found.append(both.where((F.col("__al") < F.col("__bh")) & (F.col("__bl") < F.col("__ah")) & once).select(*keys, "a", "b"))
    return found[0].unionByName(found[1])
