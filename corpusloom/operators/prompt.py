"""Contexts, citations and prompts from ranked chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labels in contexts and prompts, and lengths of quotes.
SOURCE, NOTHING, CONTEXT, QUESTION = "来源", "（未检索到相关文档）", "[检索到的上下文]", "[用户问题]"
TEXT_CHARS, QUOTE_CHARS, MOST_CITED = 500, 200, 5


def _in_order(rows: DataFrame, value: Column, name: str, *more: Column) -> DataFrame:
    """(query_id, …, name): the values of each query as an array by rank."""
    items = F.transform(F.array_sort(F.collect_list(F.struct("rank", value.alias("v")))), lambda x: x["v"])
    return rows.groupBy("query_id").agg(*more, items.alias(name))


def context(rows: DataFrame) -> DataFrame:
    """(query_id, context) from (query_id, rank, doc_id, section_path, text): numbered parts
    with their source, each cut to 500 characters, between rules."""
    section = F.coalesce("section_path", F.lit(""))
    label = F.concat(F.col("doc_id").cast("string"), F.when(section != "", F.concat(F.lit(" / "), section)).otherwise(""))
    cut = F.when(F.length("text") > TEXT_CHARS, F.concat(F.substring("text", 1, TEXT_CHARS), F.lit("..."))).otherwise(F.col("text"))
    part = F.concat(F.lit("["), F.col("rank"), F.lit(f"] {SOURCE}: "), label, F.lit("\n"), cut)
    return _in_order(rows, part, "parts").select("query_id", F.array_join("parts", "\n\n---\n\n").alias("context"))


def context_or_nothing(context: Column) -> Column:
    return F.coalesce(context, F.lit(NOTHING))


def brief(rows: DataFrame, chunks: int, chars: int, separator: str = "\n") -> DataFrame:
    """(query_id, brief): the first chunks of each query, cut and joined."""
    out = _in_order(rows.where(F.col("rank") <= chunks), F.substring("text", 1, chars), "parts")
    return out.select("query_id", F.array_join("parts", separator).alias("brief"))


def citations(rows: DataFrame) -> DataFrame:
    """(query_id, citations): array<struct<doc_id, chunk_id, quote, score>> by rank; the score
    is the reranker's, else the fusion's, else 0."""
    score = F.coalesce("rerank_score", "rrf_score", F.lit(0.0))
    return _in_order(rows, F.struct("doc_id", "chunk_id", F.substring("text", 1, QUOTE_CHARS).alias("quote"), score.alias("score")), "citations")


def prompt(question: Column, context: Column, *, system: str, cite: str = "", rate: str = "") -> Column:
    """The whole prompt; empty requirements are left out."""
    wanted = "\n".join(x for x in (cite, rate) if x)
    return F.concat_ws("\n", F.lit(system), F.concat(F.lit(f"\n\n{CONTEXT}\n"), context), F.concat(F.lit(f"\n\n{QUESTION}\n"), question), F.lit("\n\n" + wanted))
