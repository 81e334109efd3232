"""All registered queries of the library outside ``llm``: name -> (function, SQL)."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.plans import answer
from corpusloom.queries import registry

MODULES = ("text", "corpus", "state", "relational", "answers")


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"corpusloom.queries.{name}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return registry.QUERIES | {"answers": flagship}


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(registry.SQL)


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """Answers to the benchmark's questions over the documents, with citations."""
    t = registry.Tables(spark, folder)
    vectors = t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    questions = t.benchmark.join(vectors, F.col("item_id") == F.col("id"), "left").select(F.col("item_id").alias("query_id"), "text", "vec")
    docs = t.documents.select(F.col("doc_id").alias("id"), "text", "source")
    return answer.answers(questions, docs, vectors.join(docs.select("id"), "id", "left_semi"))
