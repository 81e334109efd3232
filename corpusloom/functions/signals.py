"""Rule-based signals of a question, routing and rewriting decisions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words that the rules look for.
PRONOUNS_ZH = "我|你|他|她|它|们|这|那|这些|那些|此|本|该|其"
PRONOUNS_EN = "I|you|he|she|it|they|we|this|that|these|those|such|said"
MULTI_HOP = "之后|然后|并且|以及|对比|相比|比较|影响|关系|交叉|结合|综合|and then|after|afterward|combine|compare|contrast|impact|relationship|cross|merge|synthesize"
ENTITY_SUFFIXES = ("公司", "集团", "大学", "学院", "银行", "保险", "证券", "先生", "女士", "教授", "博士", "总裁", "经理", "主任")
REWRITE_EN = "i|you|he|she|it|we|they|this|that|these|those|what|which"
REWRITE_ZH = "[这那它她他我你咱哪些们]"
TRANSIENT = ("rate limit", "rate_limit", "ratelimit", "too many requests", "timeout", "timed out", "connection reset", "temporarily", "service unavailable", "503", "429")
PERMANENT = ("unauthorized", "401", "403", "forbidden", "invalid api key", "invalid_api_key", "bad request", "400", "valueerror", "typeerror", "validation error", "schema")
#: Thresholds of confidence and complexity.
ESCALATE_BELOW, ACCEPT_FROM, JUDGE_FROM = 0.6, 0.7, 0.85
COMPLEXITIES = ("simple", "moderate", "complex", "beyond_kb")


#: Any Chinese character; the Chinese rules are tried only where there is one.
_CJK = "[一-鿿]"
#: Other characters that a comparison without case takes for s, k and i.
_ODD_CASE = "[ſKİı]"


def has_pronoun(query: Column) -> Column:
    chinese = query.rlike(_CJK) & query.rlike(rf"(?iuU)\b(?:{PRONOUNS_ZH})")
    return query.rlike(rf"(?iuU)\b(?:{PRONOUNS_EN})\b") | chinese


def is_multi_hop(query: Column) -> Column:
    """Whether a word of ``MULTI_HOP`` stands anywhere in the text, whatever its case: plain searches in the
    lower-cased text, which take a fraction of one alternation's time."""
    words = MULTI_HOP.split("|")
    low = F.lower(query)
    found = query.rlike(_ODD_CASE) & query.rlike(rf"(?iu)(?:{MULTI_HOP})")
    chinese = F.lit(False)
    for w in words:
        if w.isascii():
            found = found | low.contains(w)
        else:
            chinese = chinese | query.contains(w)
    return found | (query.rlike(_CJK) & chinese)


def has_quote(query: Column) -> Column:
    return query.contains('"') | query.contains("'")


def entity_count(query: Column) -> Column:
    """Distinct runs of one to three capitalised words, and of names with a suffix."""
    english = F.size(F.array_distinct(F.regexp_extract_all(query, F.lit(r"(\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,2}\b)"), F.lit(1))))
    found = [F.regexp_extract_all(query, F.lit(rf"([一-鿿]{{2,4}}{s})"), F.lit(1)) for s in ENTITY_SUFFIXES]
    return english + F.when(query.rlike(_CJK), F.size(F.array_distinct(F.concat(*found)))).otherwise(0)


def signals(query: Column) -> dict[str, Column]:
    """All signals by name; a null or empty question has none."""
    q = F.coalesce(query, F.lit(""))
    return {"has_pronoun": has_pronoun(q), "is_multi_hop": is_multi_hop(q), "has_quote": has_quote(q), "entity_count": entity_count(q), "query_length": F.length(q)}


def complexity_hint(has_pronoun: Column, is_multi_hop: Column, entity_count: Column, query_length: Column) -> Column:
    """Complexity by rules; the first that holds decides."""
    return (
        F.when(is_multi_hop & ((entity_count >= 2) | (query_length >= 30)), "complex")
        .when(has_pronoun & (query_length < 30), "moderate")
        .when((query_length <= 15) & (entity_count <= 1), "simple")
        .otherwise("moderate")
    )


def needs_rewrite(query: Column) -> Column:
    """Whether a question depends on its history: pronouns, or very short."""
    pronoun = F.lower(query).rlike(rf"\b(?:{REWRITE_EN})\b") | query.rlike(REWRITE_ZH)
    few = (F.size(F.filter(F.split(query, r"\s+"), lambda x: x != "")) < 6) & (F.length(query) < 30)
    return pronoun | F.when(query.rlike(r"[一-鿿]"), F.length(query) <= 8).otherwise(few)


def rewrite_accepted(query: Column, response: Column) -> Column:
    """struct<rewritten, was_rewritten, confidence> from a model's JSON answer.

    Under 0.7 the question stays; a missing confidence counts as 0.8, an answer that can't
    be parsed as 0.
    """
    got = F.from_json(response, "struct<rewritten:string,confidence:double,_bad:string>", {"columnNameOfCorruptRecord": "_bad"})
    bad = response.isNull() | got["_bad"].isNotNull() | got.isNull()
    confidence = F.when(bad, 0.0).otherwise(F.coalesce(got["confidence"], F.lit(0.8)))
    text = F.when(bad | (confidence < ACCEPT_FROM), query).otherwise(F.coalesce(got["rewritten"], query))
    return F.struct(text.alias("rewritten"), (text != query).alias("was_rewritten"), confidence.alias("confidence"))


def route(response: Column, hint: Column) -> Column:
    """struct<complexity, confidence> from a model's JSON answer.

    No answer: the hint with 0.5.  An answer that can't be parsed: moderate with 0.  Unknown
    labels count as moderate; under 0.6 simple and moderate go one step up.
    """
    got = F.from_json(response, "struct<complexity:string,confidence:double,_bad:string>", {"columnNameOfCorruptRecord": "_bad"})
    bad = got["_bad"].isNotNull() | got.isNull()
    confidence = F.coalesce(got["confidence"], F.lit(0.5))
    label = F.coalesce(got["complexity"], F.lit("moderate"))
    label = F.when(label.isin(*COMPLEXITIES), label).otherwise("moderate")
    low = confidence < ESCALATE_BELOW
    label = F.when(low & (label == "simple"), "moderate").when(low & (label == "moderate"), "complex").otherwise(label)
    complexity = F.when(response.isNull(), hint).when(bad, "moderate").otherwise(label)
    return F.struct(complexity.alias("complexity"), F.when(response.isNull(), 0.5).when(bad, 0.0).otherwise(confidence).alias("confidence"))


def error_class(message: Column) -> Column:
    """struct<transient, permanent> by keywords."""
    low = F.lower(message)
    has = lambda words: F.coalesce(low.rlike("|".join(words)), F.lit(False))
    return F.struct(has(TRANSIENT).alias("transient"), has(PERMANENT).alias("permanent"))


def confidence_level(score: Column) -> Column:
    return F.when(score >= 0.85, "high").when(score >= 0.6, "medium").when(score >= 0.3, "low").otherwise("insufficient")


def complexity_label(score: Column) -> Column:
    return F.when(score.isNull(), "unknown").when(score < 0.3, "simple").when(score < 0.6, "moderate").otherwise("complex")


def retry_bounds(attempt: Column, base: float = 1.0, most: float = 10.0) -> Column:
    """struct<low, mid, high>: the capped exponential delay and its jitter of half."""
    mid = F.least(F.lit(base) * F.pow(F.lit(2.0), attempt), F.lit(most))
    return F.struct((mid * 0.5).alias("low"), mid.alias("mid"), (mid * 1.5).alias("high"))


def react_next(action: Column, confidence: Column, iterations: Column, has_tools: Column, most: int = 5) -> Column:
    """The next node of the reasoning loop."""
    return (
        F.when((action == "finish") | (confidence >= JUDGE_FROM), "finish")
        .when(iterations >= most, "max_iter")
        .when((action == "tool_call") & has_tools, "tool")
        .when(action.isin("retrieve", "tool_call"), "retrieve")
        .otherwise("think")
    )


def self_rag(verdict: Column, confidence: Column, verdict2: Column, confidence2: Column) -> Column:
    """struct<verdict, confidence, hint, refined> from a first and a second judgement.

    A confident `correct` passes, `ambiguous` gets a hint, all else is refined once and the
    second judgement is kept only if it is more confident.
    """
    direct = ((verdict == "correct") & (confidence >= JUDGE_FROM)) | (verdict == "ambiguous")
    refined = ~direct & F.coalesce(confidence2 > confidence, F.lit(False))
    return F.struct(
        F.when(refined, verdict2).otherwise(verdict).alias("verdict"),
        F.when(refined, confidence2).otherwise(confidence).alias("confidence"),
        (verdict == "ambiguous").alias("hint"),
        refined.alias("refined"),
    )
