"""Mixing sources to target weights by Pareto order sampling.

Each source has a target number of words.  A document first gets the whole copies that its
source's ratio target / size grants everyone.  What is left of the target is filled by a
Pareto sample: document i has an inclusion probability p_i, draws a uniform number u_i from a
hash, the documents are ranked by

    q_i = (u_i / (1 - u_i)) / (p_i / (1 - p_i))

and the first n are taken.  p_i is proportional to a weight of the document's size class
(its size to the power ``tilt``, in steps of an eighth of a doubling) and scaled so that the
sample's expected words are the rest of the target; documents whose p_i would reach 1 are
certain and taken out until all others are below it.  n is the sum of all p_i, rounded: the
sample's size is fixed.

A fixed number of documents has a random number of words.  So the words are brought to the
target around the cut: of the last ``NEAR`` documents taken and the next ``NEAR`` ones, one taken
is exchanged for one not taken of another size, pair by pair, until no pair brings the words
nearer.  The number of documents stays n in every source.

Scale: a thin table (id, source, size, draw) is written once.  Classes of sizes are counted by
partial aggregations, at most a few hundred rows a source.  The cut in the order is found by
histograms over digits of the ranking key, most significant digit first: each pass is one
partial aggregation per source and digit, so a source that holds a third of all rows is
spread over all tasks and nothing is sorted whole.  The documents around a cut are limited in
each task before they meet.

Edge cases: a null or blank text has size 0 and nothing is taken of it; the null source is a
source of its own, last in order; null and repeated doc_ids are fine, since u_i also depends
on the text.  Rows that are equal in id, source and text share one draw and are taken or left
together; at the cut the sample may then have more rows than n.  Empty tables give empty results.  Only the named columns are read in ``plan_mix``;
``mix`` keeps all columns and adds ``copies`` (``copies_2`` and so on if there is such a
column already).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.shared import broadcast_if_small, column, materialize, temporary

#: Weights of the sources by code point, repeating.
WEIGHTS = (1.0, 2.0, 3.0)
MAX_COPIES = 3
TILT = 0.25
SEED = 20240607
#: Digits of the ranking key and bits in each.
DIGITS, BITS = 3, 12
#: Classes of sizes in a doubling.
STEPS = 8
#: Documents on either side of the cut that may be left or taken for the words' sake.
NEAR = 4096


def size_of(text: Column) -> Column:
    """Number of `[^\\x20\\x09-\\x0D]+` in a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _uniform(*parts: Column) -> Column:
    """A number strictly between 0 and 1, fixed by the parts."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(SEED), *parts), 11)
    return (bits.cast("double") + 0.5) / F.lit(float(1 << 53))


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """(source, source_size, target) from one row per source (source, source_size).

    The targets share the total size by weight; none is over ``max_copies`` times its
    source's size and the excess is shared by weight among the others.  This is
    min(cap, level * weight) for the one level that spends the total: in the order of
    cap / weight, the capped sources are a prefix.  The windows run over one row per
    source.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.col("at") - 1) % len(weights) + 1).cast("int"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    rows = sizes.withColumn("at", F.row_number().over(by_name)).withColumn("w", w)
    rows = rows.withColumn("cap", max_copies * F.col("source_size").cast("double")).withColumn("ratio", F.col("cap") / F.col("w"))
    up = Window.orderBy("ratio", "at").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumns({"before": F.coalesce(F.sum("cap").over(up), F.lit(0.0)), "w_before": F.coalesce(F.sum("w").over(up), F.lit(0.0))})
    rows = rows.withColumns({"total": F.sum("source_size").over(every).cast("double"), "w_all": F.sum("w").over(every)})
    # the level if all before this source are capped and it is the first that is not
    rows = rows.withColumn("level", (F.col("total") - F.col("before")) / (F.col("w_all") - F.col("w_before")))
    rows = rows.withColumn("fits", F.col("level") <= F.col("ratio"))
    level = F.min(F.when(F.col("fits"), F.struct("ratio", "at", "level"))).over(every)["level"]
    return rows.select("source", "source_size", F.least("cap", F.coalesce(level * F.col("w"), F.col("cap"))).alias("target"))


def _class(size: Column) -> Column:
    """The class of a size of at least 1."""
    return F.floor(F.log2(size.cast("double")) * STEPS + 1e-9).cast("int")


def _weight(klass: Column, tilt: float) -> Column:
    return F.pow(F.lit(2.0), klass * F.lit(tilt / STEPS))


def _key(u: Column, p: Column) -> Column:
    """The rank q of a draw as an integer, increasing; -1 for certain documents."""
    odds = (u / (1 - u)) * ((1 - p) / p)
    top = 1 << DIGITS * BITS
    key = F.least(F.floor(odds / (1 + odds) * F.lit(float(top))), F.lit(top - 1)).cast("long")
    return F.when(p >= 1, F.lit(-1).cast("long")).otherwise(key)


def _chance(size: Column, scale: Column, tilt: float) -> Column:
    """The inclusion probability of a document of at least one word."""
    return F.least(F.lit(1.0), F.greatest(scale * _weight(_class(size), tilt), F.lit(1e-12)))


def _sources(thin: DataFrame, weights: Sequence[float], max_copies: int, tilt: float) -> DataFrame:
    """One row per source: source, source_size, target, whole (copies for everyone), rest
    (words of the sample), scale (of the inclusion probabilities), n (documents of the sample)
    and sure (those of them that are certain)."""
    classes = materialize(thin.groupBy("source", F.when(F.col("size") > 0, _class(F.col("size"))).alias("k")).agg(F.count("*").alias("n"), F.sum("size").alias("words")), "mix-classes")
    goals = targets(classes.groupBy("source").agg(F.sum("words").alias("source_size")), weights, max_copies)
    ratio = F.coalesce(F.try_divide(F.col("target"), F.col("source_size").cast("double")), F.lit(0.0))
    goals = goals.withColumn("whole", F.floor(ratio + 1e-12).cast("long"))
    left = F.col("target") - F.col("whole") * F.col("source_size")
    goals = materialize(goals.withColumn("rest", F.when(left > 1e-9 * F.col("target"), left).otherwise(0.0)), "mix-targets")
    own = classes.where("k is not null").alias("c").join(broadcast_if_small(goals.select(F.col("source").alias("s"), "rest"), goals.count()), F.col("source").eqNullSafe(F.col("s"))).where("rest > 0")
    # the classes from the largest on are certain up to the first one whose scaled weight is under 1
    down = Window.partitionBy("source").orderBy(F.col("k").desc())
    up = Window.partitionBy("source").orderBy("k")
    w = _weight(F.col("k"), tilt)
    own = own.withColumns({"w": w, "sure": F.coalesce(F.sum("n").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "sure_words": F.coalesce(F.sum("words").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    own = own.withColumns({"tilted": F.sum(w * F.col("words")).over(up), "docs": F.sum(w * F.col("n")).over(up)})
    own = own.withColumn("scale", (F.col("rest") - F.col("sure_words")) / F.col("tilted")).where("scale * w < 1")
    best = own.groupBy("s").agg(F.max(F.struct("k", "scale", "sure", (F.col("sure") + F.col("scale") * F.col("docs")).alias("n"))).alias("b"))
    best = best.select("s", F.greatest("b.scale", F.lit(0.0)).alias("scale"), F.round("b.n").cast("long").alias("n"), F.col("b.sure").alias("sure"))
    both = goals.join(best, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    return materialize(both.fillna({"scale": 0.0, "n": 0, "sure": 0}), "mix-sources")


def _thin(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    text = column(text_col)
    return docs.select(column(id_col).alias("doc_id"), column(source_col).alias("source"), size_of(text).alias("size"), _uniform(column(id_col), column(source_col), text).alias("u"))


def _with_keys(rows: DataFrame, sources: DataFrame, count: int, tilt: float) -> DataFrame:
    """``rows`` (source, size, u, …) with ``__mix``, their source's figures, and the key."""
    figures = sources.select(F.struct(*sources.columns).alias("__mix"))
    rows = rows.join(broadcast_if_small(figures, count), F.col("source").eqNullSafe(F.col("__mix.source")))
    draws = (F.col("__mix.rest") > 0) & (F.col("size") > 0)
    return rows.withColumn("key", F.when(draws, _key(F.col("u"), _chance(F.col("size"), F.col("__mix.scale"), tilt))))


def _cuts(sampled: DataFrame, sources: DataFrame) -> DataFrame:
    """(s, last): the key of the last document of each source's sample; -1 if only certain
    ones are in it."""
    drawn = sources.where("n > sure").select("source", F.lit(0).cast("long").alias("prefix"), (F.col("n") - F.col("sure")).alias("left"))
    state = drawn
    for k in range(DIGITS):
        low = (DIGITS - 1 - k) * BITS
        here = broadcast_if_small(state.select(F.col("source").alias("s"), "prefix", "left"), state.count())
        rows = sampled.where("key >= 0").join(here, F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("key", low + BITS) == F.col("prefix")))
        bins = rows.groupBy("s", "left", F.shiftright("key", low).alias("bin")).agg(F.count("*").alias("n"))
        order = Window.partitionBy("s").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        back = Window.partitionBy("s").orderBy(F.col("bin").desc())
        bins = bins.withColumns({"sum": F.sum("n").over(order), "from_end": F.row_number().over(back)})
        # the bin that reaches the sample's size; the last one if none does
        first = bins.where((F.col("sum") >= F.col("left")) | (F.col("from_end") == 1)).groupBy("s").agg(F.min(F.struct("bin", "n", "sum", "left")).alias("b"))
        state = materialize(first.select(F.col("s").alias("source"), F.col("b.bin").alias("prefix"), (F.col("b.left") - F.col("b.sum") + F.col("b.n")).alias("left")), "mix-cut")
    rest = sources.select(F.col("source").alias("s"))
    found = rest.join(state.select("source", "prefix"), F.col("s").eqNullSafe(F.col("source")), "left")
    return materialize(found.select("s", F.coalesce("prefix", F.lit(-1).cast("long")).alias("last")), "mix-cuts")


def exchanged(inside: list[tuple], outside: list[tuple], short: float) -> list[int]:
    """The keys that change sides so that ``short``, the words that the sample lacks (negative: has too
    many), comes near 0.

    inside, outside: (key, size, rows) of those taken and not taken, the nearest to the cut first.  One taken is
    exchanged for one not taken of as many rows, always the pair that leaves the least, among
    the 16 nearest on either side, then 64, 256 and so on; so the sample keeps its size.
    """
    sides = [np.array([x[1:] for x in side], float).reshape(-1, 2) for side in (inside, outside)]
    free, changed, reach = [np.ones(len(x), bool) for x in sides], [], 16
    while abs(short) >= 1:
        best = None
        for rows in np.intersect1d(sides[0][:reach, 1], sides[1][:reach, 1]):
            i, j = (np.nonzero(f[:reach] & (x[:reach, 1] == rows))[0] for f, x in zip(free, sides, strict=True))
            if not len(i) or not len(j):
                continue
            j = j[np.argsort(sides[1][j, 0], kind="stable")]
            small, large = sides[0][i, 0], sides[1][j, 0]
            at = np.searchsorted(large, small + short)
            for k in (np.clip(at, 0, len(j) - 1), np.clip(at - 1, 0, len(j) - 1)):
                left = short - (large[k] - small)
                m = int(np.abs(left).argmin())
                if best is None or abs(left[m]) < abs(best[0]):
                    best = (left[m], int(i[m]), int(j[k[m]]))
        if best is not None and abs(best[0]) < abs(short):
            short, x, y = best
            free[0][x] = free[1][y] = False
            changed += [inside[x][0], outside[y][0]]
        elif reach >= max(len(inside), len(outside)):
            break
        else:
            reach *= 4
    return changed


def _changes(sampled: DataFrame, sources: DataFrame, cuts: DataFrame, near: int) -> DataFrame:
    """(s, changed): the keys around each source's cut that change sides for the words' sake."""
    here = broadcast_if_small(cuts.join(sources.select("source", "rest"), F.col("s").eqNullSafe(F.col("source"))).drop("source"), cuts.count())
    rows = sampled.join(here, F.col("source").eqNullSafe(F.col("s"))).select("s", "rest", "key", "size", (F.col("key") <= F.col("last")).alias("taken"))
    words = rows.groupBy(F.col("s").alias("t")).agg((F.max("rest") - F.sum(F.when(F.col("taken"), F.col("size")).otherwise(0))).alias("short"))
    inside, outside = Window.partitionBy("s").orderBy(F.col("key").desc()), Window.partitionBy("s").orderBy("key")
    last = rows.where("taken and key >= 0").withColumn("at", F.row_number().over(inside)).where(F.col("at") <= near)
    after = rows.where("not taken").withColumn("at", F.row_number().over(outside)).where(F.col("at") <= near)
    around = last.unionByName(after).groupBy("s", "key", "taken").agg(F.sum("size").cast("double").alias("size"), F.count("*").cast("double").alias("rows"))
    around = around.join(broadcast_if_small(words, cuts.count()), F.col("s").eqNullSafe(F.col("t"))).drop("t")

    def each(group: pd.DataFrame) -> pd.DataFrame:
        sides = [group[group.taken].sort_values("key", ascending=False), group[~group.taken].sort_values("key")]
        keys = exchanged(*[list(zip(x.key.tolist(), x["size"], x["rows"], strict=True)) for x in sides], group.short.iloc[0])
        return pd.DataFrame({"s": group.s.iloc[:1], "changed": [keys]})

    return materialize(around.groupBy("s").applyInPandas(each, f"s {sources.schema['source'].dataType.simpleString()}, changed array<long>"), "mix-changes")


def _plan(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: Sequence[float], max_copies: int, tilt: float, near: int) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """The thin table, the sources with their cuts, the changed keys and their number."""
    with temporary(docs.sparkSession):
        thin = materialize(_thin(docs, id_col, text_col, source_col), "mix-sizes", keep=True)
        sources = _sources(thin, weights, max_copies, tilt)
        sampled = _with_keys(thin, sources, sources.count(), tilt).where("key is not null").select("source", "size", "key")
        cuts = _cuts(sampled, sources)
        changed = materialize(_changes(sampled, sources, cuts, near).select(F.col("s").alias("cs"), F.explode("changed").alias("ck")).distinct(), "mix-changed", keep=True)
        sources = materialize(sources.join(cuts, F.col("source").eqNullSafe(F.col("s"))).drop("s"), "mix-figures", keep=True)
    return thin, sources, changed, changed.count()


def _taken(rows: DataFrame, sources: DataFrame, changed: DataFrame, n: int, tilt: float) -> DataFrame:
    """``rows`` (source, size, u, …) with ``__mix`` and ``__copies``."""
    rows = _with_keys(rows, sources, sources.count(), tilt)
    rows = rows.join(broadcast_if_small(changed, n), F.col("source").eqNullSafe(F.col("cs")) & (F.col("key") == F.col("ck")), "left")
    first = F.coalesce(F.col("key") <= F.col("__mix.last"), F.lit(False))
    return rows.withColumn("__copies", F.col("__mix.whole") + (first != F.col("ck").isNotNull()).cast("long"))


def plan_mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = WEIGHTS, max_copies: int = MAX_COPIES, tilt: float = TILT, near: int = NEAR) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies and
    taken (copies times size)."""
    thin, sources, changed, n = _plan(docs, id_col, text_col, source_col, weights, max_copies, tilt, near)
    rows = _taken(thin, sources, changed, n, tilt)
    return rows.select("doc_id", "source", "size", F.col("__mix.source_size").alias("source_size"), F.col("__mix.target").alias("target"), F.col("__copies").alias("copies"), (F.col("__copies") * F.col("size")).alias("taken"))


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = WEIGHTS, max_copies: int = MAX_COPIES, tilt: float = TILT, near: int = NEAR) -> DataFrame:
    """The documents of the mix with all their columns and ``copies``, how often each
    is taken; those that are not taken go."""
    _, sources, changed, n = _plan(docs, id_col, text_col, source_col, weights, max_copies, tilt, near)
    own = docs.select(F.struct(*[column(c) for c in docs.columns]).alias("__doc"))
    part = lambda c: F.col("__doc")[c]
    own = own.withColumns({"source": part(source_col), "size": size_of(part(text_col)), "u": _uniform(part(id_col), part(source_col), part(text_col))})
    rows = _taken(own, sources, changed, n, tilt).where("__copies > 0")
    names = {c.lower() for c in docs.columns}
    name = next(x for x in ["copies", *[f"copies_{k}" for k in range(2, len(names) + 3)]] if x not in names)
    return rows.select(*[part(c).alias(c) for c in docs.columns], F.col("__copies").alias(name))


def digest(plan: DataFrame) -> DataFrame:
    """The contract's columns from those of ``plan_mix``."""
    return plan.select("doc_id", "size", "source_size", "target", "taken")
