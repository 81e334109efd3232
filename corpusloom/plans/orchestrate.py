"""Many questions through cache, rewriting, routes and persistence.

Every question takes one branch: ``cache`` (an earlier answer of its tenant is near enough),
``direct`` (one retrieval), ``agent`` (rounds of thinking and retrieval) or ``beyond_kb`` (no
retrieval).  A branch is a filtered table, so no branch does work for the questions of another.  The
branches meet again in one result, from which the cache's and the sessions' new rows are
derived.  ``Store`` keeps those by batch: batch k reads what batches before k wrote, so a batch
that runs again sees the same cache, replaces its own rows and gives the same answers.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import signals
from corpusloom.functions.text import words
from corpusloom.operators import agent, cells, inverted, prompt, registry, retrieve
from corpusloom.operators.tables import temporary, written
from corpusloom.plans.answer import best_sentence

BRANCHES = ("cache", "direct", "agent", "beyond_kb")
#: Messages that a rewrite sees, confidence of an answer without retrieval, and its prompt.
HISTORY, DIRECT_CONFIDENCE, DIRECT_PROMPT = 3, 0.9, "请回答以下问题："
#: Words of the best chunk that the next round of the agent looks for, too.
OBSERVED = 10

_CITATION = "array<struct<doc_id:string,chunk_id:string,quote:string,score:double>>"


def looking_further(opened: DataFrame, k: int) -> DataFrame:
    """Thinking without a model: one retrieval for moderate questions, a second one for complex
    ones that also asks for the beginning of the best chunk so far."""
    again = (F.col("complexity") == "complex") & (F.lit(k) == 1) & F.col("observation").isNotNull()
    more = F.lit(k) == 0
    return opened.withColumns(
        {
            "action": F.when(more | again, "retrieve").otherwise("finish"),
            "confidence": F.when(more | again, 0.5).otherwise(0.7),
            "text": F.when(again, F.concat_ws(" ", "text", "observation")).otherwise(F.col("text")),
        }
    )


@dataclass
class Models:
    """Functions of columns where a service would answer; the defaults are rules.

    ``rewrite(text, history)`` and ``route(text)`` give JSON replies or null, ``answer(text, best
    chunk)`` and ``direct(prompt)`` texts; ``think`` is the agent's step.
    """

    rewrite: Callable[[Column, Column], Column] = lambda text, history: F.lit(None).cast("string")
    route: Callable[[Column], Column] = lambda text: F.lit(None).cast("string")
    answer: Callable[[Column, Column], Column] = lambda text, best: best_sentence(words(text), best)
    direct: Callable[[Column], Column] = lambda asked: F.regexp_replace(asked, f"^{DIRECT_PROMPT}", "")
    think: Callable[[DataFrame, int], DataFrame] = field(default=looking_further)


def searching(docs: DataFrame, corpus: DataFrame, k: int = retrieve.TOP, *, near: cells.Cells | None = None, index: inverted.Index | None = None) -> Callable[[DataFrame], DataFrame]:
    """A search over docs (id, text, source) and corpus (id, vec): hybrid, fused, reranked.

    With stored indexes a search reads those, and of the documents only the candidates' rows.
    """

    def search(asked: DataFrame) -> DataFrame:
        asked = written(asked.select("query_id", "text", "vec", "complexity"), "looked-for")
        pool = retrieve.hybrid(asked, docs.select("id", "text"), corpus, near=near, index=index).select("query_id", "id", "rrf_score")
        found = written(pool.join(docs, "id"), "pool")
        scored = found.join(retrieve.coverage(asked.select("query_id", "text"), found), ["query_id", "id"])
        return retrieve.reranked(scored, k).select("query_id", "id", "rank", "final_score", "text", "source")

    return search


def rewritten(asked: DataFrame, history: DataFrame | None, rewrite: Callable[[Column, Column], Column]) -> DataFrame:
    """``asked`` with the text that is looked for, ``display``, and ``was_rewritten``.

    Only questions that depend on what was said before go to the model, with the last messages
    (conv_id, turn, text) of their session.
    """
    if history is None:
        rows = asked.withColumn("past", F.array().cast("array<string>"))
    else:
        last = registry.last_messages(history.select("conv_id", "turn", "text"), HISTORY)
        last = last.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "text"))), lambda m: m["text"]).alias("past"))
        rows = asked.join(last, F.col("session_id") == F.col("conv_id"), "left").drop("conv_id").withColumn("past", F.coalesce("past", F.array().cast("array<string>")))
    needs = signals.needs_rewrite(F.col("text")) & (F.size("past") > 0)
    reply = F.when(needs, rewrite(F.col("text"), F.col("past")))
    got = signals.rewrite_accepted(F.col("text"), reply)
    rows = rows.withColumn("r", F.when(needs, got))
    return rows.withColumns({"display": F.coalesce("r.rewritten", "text"), "was_rewritten": F.coalesce("r.was_rewritten", F.lit(False))}).drop("r", "past")


def routed(asked: DataFrame, route: Callable[[Column], Column]) -> DataFrame:
    """``asked`` with complexity, the route's confidence and the branch."""
    marked = asked.withColumns({f"s_{k}": v for k, v in signals.signals(F.col("display")).items()})
    hint = signals.complexity_hint(*[F.col(f"s_{c}") for c in ("has_pronoun", "is_multi_hop", "entity_count", "query_length")])
    rows = marked.withColumn("r", signals.route(route(F.col("display")), hint)).withColumns({"complexity": F.col("r.complexity"), "score": F.col("r.confidence")})
    branch = F.when(F.col("complexity") == "simple", "direct").when(F.col("complexity") == "beyond_kb", "beyond_kb").otherwise("agent")
    return rows.withColumn("branch", branch).select(*asked.columns, "complexity", "score", "branch")


def _cited(chunks: DataFrame) -> DataFrame:
    """(query_id, citations, best): citations in the order of rounds and ranks, and the best chunk's text."""
    rows = chunks.withColumns({"rank": F.struct("round", "rank"), "doc_id": F.col("id").cast("string"), "chunk_id": F.col("id").cast("string"), "rerank_score": F.col("final_score"), "rrf_score": F.lit(None).cast("double")})
    best = chunks.groupBy("query_id").agg(F.min_by("text", F.struct(-F.col("final_score"), "round", "rank")).alias("best"))
    return prompt.citations(rows).join(best, "query_id")


def _looked(chunks: DataFrame) -> DataFrame:
    """(query_id, observation): the first words of each question's best chunk."""
    first = F.array_join(F.slice(words(F.col("text")), 1, OBSERVED), " ")
    return chunks.where("rank = 1").select("query_id", first.alias("observation"))


_RESULT = ("query_id", "tenant_id", "session_id", "asked_at", "text", "vec", "branch", "hit", "complexity", "was_rewritten", "answer", "citations", "confidence", "rounds")


def _result(rows: DataFrame, answer: Column, citations: Column, confidence: Column, **more: Column) -> DataFrame:
    nothing = {"hit": F.lit(None).cast("string"), "complexity": F.lit(None).cast("string"), "was_rewritten": F.lit(False), "rounds": F.lit(0)}
    given = {c: F.col(c) for c in ("branch", *nothing) if c in rows.columns}
    columns = nothing | given | more | {"answer": answer, "citations": F.coalesce(citations.cast(_CITATION), F.array().cast(_CITATION)), "confidence": confidence}
    return rows.withColumns(columns).select(*_RESULT)


def orchestrate(
    questions: DataFrame,
    search: Callable[[DataFrame], DataFrame],
    *,
    cache: DataFrame | None = None,
    history: DataFrame | None = None,
    models: Models | None = None,
    least: float = registry.CACHE_SIMILARITY,
    days: int = registry.CACHE_DAYS,
    rounds: int = agent.MOST_ROUNDS,
) -> DataFrame:
    """A row for each question (query_id, text, vec, tenant_id, session_id, asked_at): branch,
    hit, complexity, was_rewritten, answer, citations, confidence, rounds.

    cache: id, tenant_id, vec, created_at, answer, citations, confidence; an entry with the
    question's own id doesn't count.  history: conv_id, turn, text.  Citations of the agent are
    those of all its rounds.  A question without a vector is not looked up and goes to BM25 alone.
    """
    models, spark = models or Models(), questions.sparkSession
    with temporary(spark):
        asked = written(questions.select("query_id", "text", "vec", "tenant_id", "session_id", "asked_at"), "asked")
        parts, missed = [], asked
        if cache is not None:
            near = registry.cache_lookup(asked.where("vec is not null"), cache, least, days, others=True).select("query_id", "hit")
            kept = registry.latest(cache, ["id"], "created_at").select(F.col("id").alias("hit"), F.col("answer").alias("said"), F.col("citations").alias("cited"), F.col("confidence").alias("level"))
            near = written(near.join(kept, "hit").withColumn("hit", F.col("hit").cast("string")), "near")
            parts.append(_result(asked.join(near, "query_id"), F.col("said"), F.col("cited"), F.col("level"), branch=F.lit("cache")))
            missed = asked.join(near.select("query_id"), "query_id", "left_anti")
        rows = written(routed(rewritten(missed, history, models.rewrite), models.route), "routed")
        level = signals.confidence_level

        direct = rows.where("branch = 'direct'")
        found = written(search(direct.withColumn("text", F.col("display"))).withColumn("round", F.lit(0)), "found")
        each = direct.join(_cited(found), "query_id", "left")
        parts.append(_result(each, models.answer(F.col("display"), F.col("best")), F.col("citations"), level(F.col("score")), rounds=F.lit(1)))

        looping = rows.where("branch = 'agent'")
        start = looping.select("query_id", F.col("display").alias("text"), "vec", "complexity")
        ended, chunks = agent.run(start, models.think, search, rounds, _looked)
        each = looping.join(ended.select("query_id", "round", F.col("confidence").alias("own")), "query_id").join(_cited(chunks), "query_id", "left")
        parts.append(_result(each, models.answer(F.col("display"), F.col("best")), F.col("citations"), level(F.col("own")), rounds=F.col("round")))

        beyond = rows.where("branch = 'beyond_kb'")
        said = models.direct(F.concat(F.lit(DIRECT_PROMPT), "display"))
        parts.append(_result(beyond, said, F.lit(None), level(F.lit(DIRECT_CONFIDENCE))))
        return written(reduce(DataFrame.unionByName, parts), "orchestrated", keep=True)


def cache_rows(result: DataFrame) -> DataFrame:
    """What the cache learns from a result: its answers that it didn't have."""
    new = result.where("branch <> 'cache' and answer is not null and answer <> '' and vec is not null")
    return new.select(F.col("query_id").cast("string").alias("id"), "tenant_id", "vec", F.col("asked_at").alias("created_at"), "answer", "citations", "confidence")


def session_rows(result: DataFrame) -> DataFrame:
    """The messages that the questions' sessions get: question and answer."""
    new = result.where("branch <> 'cache' and session_id is not null and answer is not null and answer <> ''")
    said = F.explode(F.array(F.struct(F.lit("user").alias("role"), "text"), F.struct(F.lit("assistant").alias("role"), F.col("answer").alias("text"))))
    rows = new.select(F.col("session_id").alias("conv_id"), "asked_at", "query_id", said.alias("m"))
    micros = F.unix_micros(F.col("asked_at").cast("timestamp"))
    return rows.select("conv_id", (micros * 2 + F.when(F.col("m.role") == "user", 0).otherwise(1)).alias("turn"), "m.role", "m.text")


class Store:
    """The cache and the sessions in a folder, a subfolder for each batch."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def put(self, kind: str, rows: DataFrame, batch: int) -> None:
        """Replace what ``batch`` has written."""
        rows.write.mode("overwrite").parquet(f"{self.folder}/{kind}/batch={batch}")

    def _folders(self, kind: str):
        """The file system and the names of the kind's finished folders: (what, batch) -> path."""
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        path = hadoop.Path(f"{self.folder}/{kind}")
        system = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in system.listStatus(path)] if system.exists(path) else []
        found = {(what, int(k)): hadoop.Path(path, n) for n in names for what, _, k in [n.partition("=")] if what in ("batch", "merged") and k.isdigit()}
        return system, {k: p for k, p in found.items() if system.exists(hadoop.Path(p, "_SUCCESS"))}

    def before(self, kind: str, batch: int) -> DataFrame | None:
        """All rows of earlier batches; None if there is none."""
        _, found = self._folders(kind)
        merged = max((k for what, k in found if what == "merged" and k < batch), default=-1)
        paths = [str(p) for (what, k), p in found.items() if (k == merged if what == "merged" else merged < k < batch)]
        return self.spark.read.parquet(*paths) if paths else None

    def compact(self, kind: str, batch: int) -> None:
        """Put the rows of the batches before ``batch``, which won't run again, into one folder.

        The folder counts from the moment it is whole, and what it holds counts no more in its old place,
        so a compaction that breaks off loses and repeats nothing.
        """
        rows = self.before(kind, batch)
        if rows is None:
            return
        system, found = self._folders(kind)
        if ("merged", batch - 1) not in found:
            rows.write.mode("overwrite").parquet(f"{self.folder}/{kind}/merged={batch - 1}")
        for (what, k), path in found.items():
            if k < batch - 1 or (what, k) == ("batch", batch - 1):
                system.delete(path, True)


def answer_batch(questions: DataFrame, batch: int, search: Callable[[DataFrame], DataFrame], store: Store, out: str, **options) -> None:
    """Answer one batch with what earlier ones left, and write its answers, cache and session rows.

    Idempotent by the batch's number.  The answers come last: where they are, the rest is.
    """
    with temporary(questions.sparkSession):
        asked = written(questions, "questions")
        result = orchestrate(asked, search, cache=store.before("cache", batch), history=store.before("sessions", batch), **options)
        store.put("cache", cache_rows(result), batch)
        store.put("sessions", session_rows(result), batch)
        result.write.mode("overwrite").parquet(f"{out}/batch={batch}")


def orchestrate_stream(questions: DataFrame, search: Callable[[DataFrame], DataFrame], store: Store, out: str, checkpoint: str, **options):
    """Answer a stream of questions; what a micro-batch answers is in the cache of the next."""

    def batch(some: DataFrame, batch_id: int) -> None:
        answer_batch(some, batch_id, search, store, out, **options)

    return questions.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
