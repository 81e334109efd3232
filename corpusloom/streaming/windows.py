"""Windows and state over events, for batches and streams alike.

The functions take static or streaming DataFrames with an event time ``ts`` (timestamp).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tumbling(events: DataFrame, every: str, *labels: str) -> DataFrame:
    out = events.groupBy(F.window("ts", every).alias("w"), *labels).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), *labels, "n")


def sliding(events: DataFrame, length: str, step: str, *labels: str) -> DataFrame:
    out = events.groupBy(F.window("ts", length, step).alias("w"), *labels).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), *labels, "n")


def sessions(events: DataFrame, gap: str, key: str) -> DataFrame:
    out = events.groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count("*").alias("n"))
    return out.select(key, F.col("w.start").alias("start"), "n")


def rate(events: DataFrame, key: str, seconds: int) -> DataFrame:
    """Each event with the number of its key's events in the last ``seconds``, itself
    included."""
    by = Window.partitionBy(key).orderBy(F.col("ts").cast("double")).rangeBetween(-seconds, Window.currentRow)
    return events.withColumn("in_window", F.count("*").over(by))


def accepted(times: Column, seconds: float, most: int) -> Column:
    """array<struct<t, ok, left>> for the sorted times (doubles) of one key.

    An event is accepted if fewer than ``most`` accepted ones lie in the last ``seconds``;
    rejected ones don't count.  The state is the last ``most`` accepted times.
    """
    start = F.struct(F.array().cast("array<double>").alias("held"), F.array().cast("array<struct<t:double,ok:boolean,left:int>>").alias("out"))

    def step(acc: Column, t: Column) -> Column:
        held = F.filter(acc["held"], lambda x: x > t - seconds)
        ok = F.size(held) < most
        left = F.greatest(F.lit(0), most - F.size(held) - 1)
        return F.struct(F.when(ok, F.array_append(held, t)).otherwise(held).alias("held"), F.array_append(acc["out"], F.struct(t.alias("t"), ok.alias("ok"), left.alias("left"))).alias("out"))

    return F.aggregate(times, start, step, lambda acc: acc["out"])


def running_max(events: DataFrame, order: str, value: str, name: str, block: int = 1000, levels: int = 3) -> DataFrame:
    """Each event with the largest ``value`` of all events before it by ``order``, an integer.

    Arrival is one order over all events, so the maximum is carried over blocks: within a block
    of ``block`` events, over the blocks of a larger one, and so on; only a row for each
    ``block ** levels`` events is ordered in one task.
    """
    ids = [F.floor(F.col(order) / block**k).cast("long") for k in range(1, levels + 1)]
    rows = events.withColumns({f"__b{k}": c for k, c in enumerate(ids, 1)})
    before = lambda by, at: Window.partitionBy(*by).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__m0", F.max(value).over(before(["__b1"], order)))
    for k in range(1, levels + 1):
        parents = [f"__b{k + 1}"] if k < levels else []
        tops = events.withColumns({f"__b{i}": c for i, c in enumerate(ids, 1)}).groupBy(f"__b{k}", *parents).agg(F.max(value).alias("__top"))
        tops = tops.select(F.col(f"__b{k}").alias("__b"), F.max("__top").over(before(parents, f"__b{k}")).alias(f"__m{k}"))
        rows = rows.join(tops, F.col(f"__b{k}") == F.col("__b")).drop("__b")
    parts = [f"__m{k}" for k in range(levels + 1)]
    return rows.withColumn(name, F.greatest(*parts)).drop(*parts, *[f"__b{k}" for k in range(1, levels + 1)])


def failure_streaks(events: DataFrame, key: str, failed: Column, order: str = "event_id") -> DataFrame:
    """(key, start, length) of runs of consecutive failures."""
    by = Window.partitionBy(key).orderBy("ts", order)
    rows = events.withColumn("bad", failed).withColumn("island", F.sum(F.when(F.col("bad"), 0).otherwise(1)).over(by))
    return rows.where("bad").groupBy(key, "island").agg(F.min("ts").alias("start"), F.count("*").alias("length")).drop("island")


def deduplicated(events: DataFrame, keys: list[str], lateness: str = "1 day") -> DataFrame:
    """The first event of each key: within the watermark for streams."""
    if events.isStreaming:
        return events.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(keys)
    by = Window.partitionBy(*keys).orderBy("ts", "event_id")
    return events.withColumn("__at", F.row_number().over(by)).where("__at = 1").drop("__at")


def encoded(events: DataFrame) -> DataFrame:
    """Rows as server-sent events."""
    return events.select(F.concat(F.lit("data: "), F.to_json(F.struct(*events.columns)), F.lit("\n\n")).alias("event"))
