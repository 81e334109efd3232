"""From questions to answers with citations: one plan for many questions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import signals
from corpusloom.operators import prompt, retrieve
from corpusloom.operators.tables import written
from corpusloom.sources.settings import prompts


def best_sentence(question_words, text):
    """The sentence of a text that shares the most words with the question; an answer without
    a model."""
    from corpusloom.functions.text import words

    sentences = F.filter(F.split(text, r"[.\n]\s*"), lambda s: s != "")
    scored = F.transform(sentences, lambda s: F.struct(F.size(F.array_intersect(words(s), question_words)).alias("n"), s.alias("s")))
    return F.array_max(scored)["s"]


def answers(questions: DataFrame, docs: DataFrame, corpus: DataFrame, version: str = "v1") -> DataFrame:
    """One row per question: complexity, answer, citations, confidence and the prompt.

    questions: query_id, text, vec; docs: id, text, source; corpus: id, vec.  Route by rules,
    retrieve on both legs, fuse with the route's constant, rerank, quote.
    """
    from corpusloom.functions.text import words

    templates = prompts(version)
    marked = questions.withColumns(signals.signals(F.col("text")))
    hint = signals.complexity_hint(*[F.col(c) for c in ("has_pronoun", "is_multi_hop", "entity_count", "query_length")])
    asked = marked.select("query_id", "text", "vec", hint.alias("complexity"))
    fused = retrieve.hybrid(asked, docs.select("id", "text"), corpus).select("query_id", "id", "rrf_score")
    found = written(fused.join(docs, "id"), "answers-found")
    scored = found.join(retrieve.coverage(asked.select("query_id", "text"), found), ["query_id", "id"])
    top = written(retrieve.reranked(scored), "answers-top").withColumns({"doc_id": F.col("id"), "chunk_id": F.col("id").cast("string"), "section_path": F.col("source")})
    parts = prompt.citations(top).join(prompt.context(top), "query_id")
    first = top.where("rank = 1").select("query_id", F.col("text").alias("best"), F.col("final_score").alias("score"))
    rows = asked.join(parts, "query_id", "left").join(first, "query_id", "left")
    context = prompt.context_or_nothing(F.col("context"))
    return rows.select(
        "query_id",
        "complexity",
        best_sentence(words(F.col("text")), F.col("best")).alias("answer"),
        "citations",
        signals.confidence_level(F.coalesce("score", F.lit(0.0))).alias("confidence"),
        prompt.prompt(F.col("text"), context, **templates).alias("prompt"),
    )


def answer_stream(questions: DataFrame, docs: DataFrame, corpus: DataFrame, out: str, checkpoint: str, version: str = "v1"):
    """Answers to a stream of questions (query_id, text, vec): each micro-batch goes through the
    same plan and is appended to the Parquet folder ``out``.  Returns the running query.

    A batch that is run again after a failure replaces its own folder, so no question is
    answered twice.
    """

    def batch(some: DataFrame, batch_id: int) -> None:
        answers(written(some, "questions"), docs, corpus, version).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return questions.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
