"""Metrics of answers by aligning claims with passages, without a model.

A claim is a sentence of an answer or of a reference.  How well a passage supports it is the mean of
two shares: of the weight of its different words that the passage holds, and of its words that
stand in the passage in the same order (longest common subsequence).  From ``SUPPORTED`` on the
passage supports it.  A word's weight is ln(1 + N / (1 + df)) over all contexts of all cases.

These are proxies with the names of the metrics that they stand for; a model's judgement may
replace any of them, the reports only need (case_id, metric, score).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import words

METRICS = ("faithfulness", "answer_relevancy", "context_precision", "context_recall", "answer_correctness")
SUPPORTED = 0.5
_ENDS = r"[.!?\n。！？]+"


def claims(text: Column) -> Column:
    """array<array<string>>: the words of each sentence that has any."""
    return F.filter(F.transform(F.split(text, _ENDS), words), lambda ws: F.size(ws) > 0)


def common_subsequence(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two arrays.

    One row of the table for each element of ``a``: a cell is the larger of the one above and,
    where the elements are equal, the one before that plus one; then the row's running maximum.
    """

    def row(above: Column, x: Column) -> Column:
        met = F.transform(b, lambda y, j: F.greatest(F.get(above, j + 1), F.when(x == y, F.get(above, j) + 1).otherwise(0)))
        return F.aggregate(met, F.array(F.lit(0)), lambda done, c: F.array_append(done, F.greatest(c, F.element_at(done, -1))))

    return F.element_at(F.aggregate(a, F.array_repeat(F.lit(0), F.size(b) + 1), row), -1)


def weighted(rows: DataFrame, passages: DataFrame) -> DataFrame:
    """``rows`` (key, ws) with ``terms``: array<struct<term, w>> of their different words, weighed over
    the distinct words of ``passages`` (ws)."""
    total = passages.agg(F.count("*").alias("n"))
    df = passages.select(F.explode(F.array_distinct("ws")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    terms = rows.select("key", F.explode(F.array_distinct("ws")).alias("term")).join(df, "term", "left")
    w = F.ln(1 + F.col("n") / (1.0 + F.coalesce("df", F.lit(0))))
    terms = terms.crossJoin(F.broadcast(total)).groupBy("key").agg(F.collect_list(F.struct("term", w.alias("w"))).alias("terms"))  # one row crosses
    return rows.join(terms, "key", "left")


def held(terms: Column, ws: Column) -> Column:
    """The share of the terms' weight that ``ws`` holds."""
    add = lambda t: F.aggregate(t, F.lit(0.0), lambda s, x: s + x["w"])
    return F.try_divide(add(F.filter(terms, lambda x: F.array_contains(ws, x["term"]))), add(terms))


def support(terms: Column, claim: Column, passage: Column) -> Column:
    order = common_subsequence(claim, passage) / F.size(claim)
    return (F.coalesce(held(terms, passage), F.lit(0.0)) + order) / 2


def scores(cases: DataFrame, supported: float = SUPPORTED) -> DataFrame:
    """(case_id, faithfulness, answer_relevancy, context_precision, context_recall, answer_correctness).

    cases: case_id, question, answer, contexts (array by rank), truth.  Without a truth, recall and
    correctness are null and the precision goes by the answer's claims.  Faithfulness: supported
    claims of the answer.  Relevancy: the weight of the question's words in the answer.  Precision:
    mean precision at the ranks of contexts that support a claim of the reference.  Recall: claims of the
    truth that a context supports.  Correctness: F1 of the answer's claims that the truth supports and of the truth's that
    the answer does.  Claims meet the contexts of their own case only; nothing is broadcast but
    one number.
    """
    base = cases.select("case_id", "question", "answer", "contexts", "truth")
    contexts = base.select("case_id", F.posexplode("contexts").alias("pos", "text")).where("text is not null")
    contexts = contexts.select("case_id", F.lit("context").alias("part"), F.col("pos").cast("int").alias("pos"), words(F.col("text")).alias("ws"))
    others = base.select("case_id", F.explode(F.array(*[F.struct(F.lit(p).alias("part"), F.lit(-1).alias("pos"), words(F.coalesce(p, F.lit(""))).alias("ws")) for p in ("answer", "truth")])).alias("p")).select("case_id", "p.*")
    said = base.select("case_id", F.explode(F.array(*[F.struct(F.lit(p).alias("by"), claims(F.coalesce(p, F.lit(""))).alias("claims")) for p in ("answer", "truth")])).alias("c"))
    said = said.select("case_id", "c.by", F.posexplode("c.claims").alias("claim", "ws"))
    asked = base.select("case_id", F.lit("question").alias("by"), F.lit(0).alias("claim"), words(F.coalesce("question", F.lit(""))).alias("ws"))
    key = F.struct("case_id", "by", "claim")
    known = weighted(said.unionByName(asked).select(key.alias("key"), "ws"), contexts).select("key.*", F.col("ws").alias("claim_ws"), "terms")

    pairs = known.join(contexts.unionByName(others), "case_id")
    meets = (F.col("by") != "question") & (F.col("part") != F.col("by")) | (F.col("by") == "question") & (F.col("part") == "answer")
    level = F.when(F.col("by") == "question", F.coalesce(held(F.col("terms"), F.col("ws")), F.lit(0.0))).otherwise(support(F.col("terms"), F.col("claim_ws"), F.col("ws")))
    pairs = pairs.where(meets).select("case_id", "by", "claim", "part", "pos", level.alias("level"))

    best = pairs.where("by <> 'question'").groupBy("case_id", "by", "part", "claim").agg(F.max("level").alias("level"))
    share = best.groupBy("case_id", "by", "part").agg(F.avg((F.round("level", 9) >= supported).cast("double")).alias("share"))
    one = lambda by, part: F.max(F.when((F.col("by") == by) & (F.col("part") == part), F.col("share")))
    shares = share.groupBy("case_id").agg(one("answer", "context").alias("faithful"), one("truth", "context").alias("recall"), one("answer", "truth").alias("p"), one("truth", "answer").alias("r"))
    relevancy = pairs.where("by = 'question'").select("case_id", F.col("level").alias("answer_relevancy"))

    has_truth = F.coalesce(F.trim("truth") != "", F.lit(False))
    reference = base.select("case_id", F.when(has_truth, "truth").otherwise("answer").alias("by"))
    fits = pairs.where("part = 'context'").join(reference, ["case_id", "by"]).groupBy("case_id", "pos").agg((F.round(F.max("level"), 9) >= supported).alias("fits"))
    ranked = fits.groupBy("case_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "fits"))), lambda x: x["fits"].cast("double")).alias("f"))
    hits = lambda f, k: F.aggregate(F.slice(f, 1, k), F.lit(0.0), lambda s, x: s + x)
    summed = F.aggregate(F.transform("f", lambda x, i: x * hits(F.col("f"), i + 1) / (i + 1)), F.lit(0.0), lambda s, x: s + x)
    precision = ranked.select("case_id", F.coalesce(F.try_divide(summed, hits(F.col("f"), F.size("f"))), F.lit(0.0)).alias("context_precision"))

    zero = lambda c: F.coalesce(c, F.lit(0.0))
    rows = base.select("case_id", has_truth.alias("has_truth"), F.size(claims(F.coalesce("answer", F.lit("")))).alias("n"))
    rows = rows.join(shares, "case_id", "left").join(relevancy, "case_id", "left").join(precision, "case_id", "left")
    f1 = zero(F.try_divide(2 * zero(F.col("p")) * zero(F.col("r")), zero(F.col("p")) + zero(F.col("r"))))
    return rows.select(
        "case_id",
        F.when(F.col("n") > 0, zero(F.col("faithful"))).alias("faithfulness"),
        zero(F.col("answer_relevancy")).alias("answer_relevancy"),
        zero(F.col("context_precision")).alias("context_precision"),
        F.when(F.col("has_truth"), zero(F.col("recall"))).alias("context_recall"),
        F.when(F.col("has_truth"), f1).alias("answer_correctness"),
    )


def long(scores_: DataFrame) -> DataFrame:
    """(case_id, metric, score), as the reports take it."""
    return scores_.unpivot("case_id", list(METRICS), "metric", "score")
