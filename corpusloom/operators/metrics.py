"""Metrics of requests: histograms, counters, quantiles, shares."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Upper bounds of the histograms' buckets.
LATENCY_BUCKETS = (0.1, 0.25, 0.5, 1.0, 2.0, 5.0, 10.0, 20.0, 30.0)
COUNT_BUCKETS = (1, 2, 5, 10, 20, 50, 100)
SCORE_BUCKETS = (0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 1.0)
TOKEN_BUCKETS = (1, 16, 64, 256, 512, 1024, 2048, 4096, 8192)


def stage_share(stage: Column, total: Column) -> Column:
    """Per cent of a stage in the total, which counts as at least 1."""
    return 100 * stage / F.greatest(total, F.lit(1.0))


def histogram(rows: DataFrame, value: str, labels: Sequence[str], buckets: Sequence[float]) -> DataFrame:
    """(labels…, le, n): cumulative counts for each bound and +Inf, in one aggregation."""
    counts = [F.struct(F.lit(str(float(b))).alias("le"), F.count_if(F.col(value) <= b).alias("n")) for b in buckets]
    counts.append(F.struct(F.lit("+Inf").alias("le"), F.count(value).alias("n")))
    return rows.groupBy(*labels).agg(F.array(*counts).alias("b")).select(*labels, F.explode("b").alias("x")).select(*labels, "x.le", "x.n")


def exposition(histogram_: DataFrame, name: str, label: str) -> DataFrame:
    """Lines of the text format for a histogram with one label."""
    return histogram_.select(F.format_string(f'{name}_bucket{{{label}="%s",le="%s"}} %d', label, "le", "n").alias("line"))


def counters(rows: DataFrame, labels: Sequence[str]) -> DataFrame:
    return rows.groupBy(*labels).agg(F.count("*").alias("n"))


def quantiles(rows: DataFrame, value: str, ts: str, every: str = "5 minutes", *, exact: bool = False) -> DataFrame:
    """(start, n, p50, p95, p99) for each window of time; exact ones hold a window's values in memory."""
    find = F.percentile if exact else F.percentile_approx
    out = rows.groupBy(F.window(ts, every).alias("w")).agg(F.count("*").alias("n"), find(value, F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99))).alias("p"))
    return out.select(F.col("w.start").alias("start"), "n", *[F.col("p")[i].alias(f"p{q}") for i, q in enumerate((50, 95, 99))])


def bucket_quantiles(histogram_: DataFrame, labels: Sequence[str], quantiles_: Sequence[float] = (0.5, 0.95, 0.99)) -> DataFrame:
    """(labels…, n, p50, …) from the cumulative counts (labels…, le, n) of a histogram.

    The quantile lies in the first bucket whose count reaches its share of the total, at the place
    that a linear course between the bucket's bounds gives; the lowest bucket begins at 0, or
    is its own bound if that is not positive.  In the open bucket it is the highest bound.  Without
    values, or without the open bucket, it is null.  Histograms of the same labels may come in several rows for a
    bound, of several servers say; their counts are added.
    """
    bound = F.when(F.col("le").isin("+Inf", "Inf", "inf"), F.lit(float("inf"))).otherwise(F.col("le").try_cast("double"))
    sums = histogram_.groupBy(*labels, bound.alias("le")).agg(F.sum("n").cast("double").alias("n"))
    rows = sums.groupBy(*labels).agg(F.sort_array(F.collect_list(F.struct("le", "n"))).alias("b"))
    total = F.element_at("b", -1)["n"]
    whole = (F.element_at("b", -1)["le"] == float("inf")) & (total > 0) & (F.size("b") > 1)

    def at(q: float) -> Column:
        rank = F.lit(q) * total
        k = F.size(F.filter("b", lambda x: x["n"] < rank))  # buckets before the quantile's
        here, before = F.get("b", k), F.get("b", k - 1)
        low = F.when(k == 0, F.lit(0.0)).otherwise(before["le"])
        under = F.when(k == 0, F.lit(0.0)).otherwise(before["n"])
        inside = low + (here["le"] - low) * F.coalesce(F.try_divide(rank - under, here["n"] - under), F.lit(1.0))
        return F.when(whole, F.when(k >= F.size("b") - 1, F.get("b", F.size("b") - 2)["le"]).when((k == 0) & (here["le"] <= 0), here["le"]).otherwise(inside))

    return rows.select(*labels, total.cast("long").alias("n"), *[at(q).alias(f"p{q * 100:g}") for q in quantiles_])


def rates(rows: DataFrame, ts: str, labels: Sequence[str], every: str = "5 minutes") -> DataFrame:
    """(start, labels…, n, per_second) for each window of time."""
    seconds = F.unix_timestamp("w.end") - F.unix_timestamp("w.start")
    out = rows.groupBy(F.window(ts, every).alias("w"), *labels).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), *labels, "n", F.round(F.col("n") / seconds, 8).alias("per_second"))


def hit_rate(hits: Column, misses: Column) -> Column:
    return F.coalesce(F.try_divide(hits, hits + misses), F.lit(0.0))
