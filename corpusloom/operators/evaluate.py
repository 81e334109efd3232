"""Evaluation: retrieval metrics, reports per case and per run, gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Thresholds of the metrics and of the gates.
THRESHOLDS = {"faithfulness": 0.85, "answer_relevancy": 0.75, "context_precision": 0.70, "context_recall": 0.70, "answer_correctness": 0.80}
MIN_PASS_RATE, MAX_DROP = 0.8, 0.05
QUERY_CHARS, ANSWER_CHARS = 2000, 8000


def ir_metrics(ranked: DataFrame, relevant: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, precision, recall, mrr, ndcg) at k for queries with relevant rows.

    ranked: query_id, id, rank; relevant: query_id, id.  Queries without any relevant row
    are left out.
    """
    n = relevant.groupBy("query_id").agg(F.count("*").alias("n"))
    hits = ranked.where(F.col("rank") <= k).join(relevant, ["query_id", "id"], "left_semi")
    gain = F.sum(1 / F.log2(F.col("rank") + 1))
    per = hits.groupBy("query_id").agg(F.count("*").alias("hits"), F.min("rank").alias("first"), gain.alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n", F.lit(k)).cast("int")), F.lit(0.0), lambda acc, i: acc + 1 / F.log2(i + 1))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return n.join(per, "query_id", "left").select(
        "query_id",
        (zero(F.col("hits").cast("double")) / k).alias("precision"),
        (zero(F.col("hits").cast("double")) / F.col("n")).alias("recall"),
        zero(1 / F.col("first")).alias("mrr"),
        (zero(F.col("dcg")) / ideal).alias("ndcg"),
    )


def containing(docs: DataFrame, items: DataFrame, inner: int = 5) -> DataFrame:
    """(query_id, id) of the documents (id, text) that hold the whole text of an item
    (query_id, item).

    An item that stands in a text has its words there one after the other; its first and last
    may be parts of longer words, those between are whole.  So ``inner`` words after the first
    are the key of an equi-join with all runs of as many words, and what meets is verified.  An
    item of fewer than three words has no whole word; such items are looked for one by one.
    """
    words = lambda c: F.split(c, r"\s+")
    runs = lambda ws, k: F.transform(F.sequence(F.lit(0), F.size(ws) - k), lambda i: F.xxhash64(F.array_join(F.slice(ws, i + 1, k), " ")))
    marked = items.where("item is not null and item <> ''").withColumn("ws", words(F.col("item"))).withColumn("k", F.least(F.lit(inner), F.size("ws") - 2))
    keys = marked.where("k > 0").select("query_id", "item", "k", F.xxhash64(F.array_join(F.slice("ws", F.lit(2), F.col("k")), " ")).alias("key"))
    lengths = [r["k"] for r in keys.select("k").distinct().collect()]  # at most ``inner`` numbers
    found = None
    for k in lengths:
        own = docs.where("text is not null").select("id", "text", words(F.col("text")).alias("ws")).where(F.size("ws") >= k)
        thin = own.select("id", F.explode(F.array_distinct(runs(F.col("ws"), k))).alias("key"))
        some = keys.where(F.col("k") == k).select("query_id", "item", F.col("key").alias("own"))
        met = thin.join(some, F.col("key") == F.col("own")).select("query_id", "id", "item")
        part = met.join(docs.withColumnRenamed("id", "__id"), F.col("id") == F.col("__id")).where(F.contains("text", "item")).select("query_id", "id")
        found = part if found is None else found.unionByName(part)
    short = marked.where("k <= 0").select("query_id", "item").collect()
    for r in short:
        part = docs.where(F.contains("text", F.lit(r["item"]))).select(F.lit(r["query_id"]).alias("query_id"), "id")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return items.select("query_id").crossJoin(docs.select("id").limit(0)).limit(0)
    return found.distinct()


def stored_runs(runs: DataFrame, new: DataFrame, extra: tuple[str, ...] = ("prompt_version", "prompt_hash", "git_commit")) -> DataFrame:
    """Runs (run_id, …, metadata map) after ``new`` ones are stored.

    A known run is replaced.  The ``extra`` columns that are not empty are merged into the
    metadata, where keys that are there already stay as they are.
    """
    given = F.coalesce("metadata", F.create_map().cast("map<string,string>"))
    pairs = F.map_filter(F.create_map(*[x for c in extra for x in (F.lit(c), F.col(c).cast("string"))]), lambda k, v: v.isNotNull() & (v != "") & ~F.map_contains_key(given, k))
    fresh = new.withColumn("metadata", F.map_concat(given, pairs))
    return runs.join(new.select("run_id"), "run_id", "left_anti").unionByName(fresh)


def case_report(scores: DataFrame, thresholds: dict[str, float] | None = None) -> DataFrame:
    """(case_id, passed, mean, weakest) from (case_id, metric, score); null scores are absent.

    A case passes if all its scores reach their thresholds; one without scores fails.  Its scores are added in the order of
    the thresholds, other metrics after them by name, so that the mean's last bit does not depend on the order of the rows.
    """
    places = F.create_map(*[F.lit(x) for k, m in enumerate(thresholds or THRESHOLDS) for x in (m, k)])
    parts = F.array_sort(F.collect_list(F.when(F.col("score").isNotNull(), F.struct(F.coalesce(F.try_element_at(places, "metric"), F.lit(len(thresholds or THRESHOLDS))).alias("place"), "metric", "score"))))
    mean = F.try_divide(F.aggregate(parts, F.lit(0.0), lambda total, x: total + x["score"]), F.size(parts))
    limits = F.create_map(*[F.lit(x) for kv in (thresholds or THRESHOLDS).items() for x in kv])
    ok = F.col("score") >= F.coalesce(F.try_element_at(limits, "metric"), F.lit(0.0))
    out = scores.groupBy("case_id").agg(F.bool_and(F.when(F.col("score").isNotNull(), ok)).alias("p"), mean.alias("mean"), F.min(F.when(F.col("score").isNotNull(), F.struct("score", "metric"))).alias("w"))
    return out.select("case_id", F.coalesce("p", F.lit(False)).alias("passed"), "mean", F.col("w.metric").alias("weakest"))


def metric_means(scores: DataFrame) -> DataFrame:
    return scores.groupBy("metric").agg(F.avg("score").alias("mean")).where("mean is not null")


def batch_report(scores: DataFrame, thresholds: dict[str, float] | None = None) -> DataFrame:
    """One row: total, passed, pass_rate, mean of the cases' means, regression (a metric's
    mean is under its threshold) and the weakest metric."""
    limits = F.create_map(*[F.lit(x) for kv in (thresholds or THRESHOLDS).items() for x in kv])
    cases = case_report(scores, thresholds).agg(F.count("*").alias("total"), F.count_if("passed").alias("n"), F.avg("mean").alias("mean"))
    low = F.col("mean") < F.coalesce(F.try_element_at(limits, "metric"), F.lit(0.0))
    metrics = metric_means(scores).agg(F.coalesce(F.bool_or(low), F.lit(False)).alias("regression"), F.min(F.struct("mean", "metric")).alias("w"))
    rate = F.coalesce(F.try_divide(F.col("n"), F.col("total")), F.lit(0.0))
    out = cases.withColumnRenamed("mean", "m").crossJoin(metrics)  # a row each
    return out.select("total", F.col("n").alias("passed"), rate.alias("pass_rate"), F.col("m").alias("mean"), "regression", F.col("w.metric").alias("weakest"))


def ci_fails(report: DataFrame) -> DataFrame:
    """The report with ``fails``: too few cases passed or a metric regressed."""
    return report.withColumn("fails", (F.col("pass_rate") < MIN_PASS_RATE) | F.col("regression"))


def diff_gate(runs: DataFrame, metrics: list[str], most: float = MAX_DROP) -> DataFrame:
    """(run_id, previous_id, passed, failed): each run against the latest earlier one with
    its prompt_hash (any earlier one if it has none).

    A metric fails if it drops by more than ``most``; null counts as 0; the first run passes.
    """
    by = Window.partitionBy("prompt_hash").orderBy("started_at", "run_id")
    prev = {f"__{m}": F.lag(F.coalesce(m, F.lit(0.0))).over(by) for m in metrics}
    rows = runs.withColumns(prev | {"previous_id": F.lag("run_id").over(by)})
    drops = [F.when(F.col(f"__{m}") - F.coalesce(m, F.lit(0.0)) > most, F.lit(m)) for m in metrics]
    rows = rows.withColumn("failed", F.array_compact(F.array(*drops)))
    return rows.select("run_id", "previous_id", (F.size("failed") == 0).alias("passed"), "failed")


def normalized_samples(samples: DataFrame, metrics: list[str]) -> DataFrame:
    """Samples as they are stored: texts cut, missing metrics 0."""
    return samples.withColumns({"query": F.substring("query", 1, QUERY_CHARS), "answer": F.substring("answer", 1, ANSWER_CHARS)} | {m: F.coalesce(m, F.lit(0.0)) for m in metrics})


def sampled(rows: DataFrame, key: str, percent: int) -> DataFrame:
    """A fixed sample by the hash of ``key``."""
    return rows.where(F.conv(F.substring(F.md5(F.col(key).cast("string").cast("binary")), 1, 8), 16, 10).cast("long") % 100 < percent)
