"""The boundary to a language model: prompts go out as a column, replies come back as one.

A model is a function from a column of prompts to a column of replies; on a cluster a pandas
UDF that calls a service fits.  Replies are JSON and are checked against the schema of their
use; what does not fit falls back to a rule, so every row has a result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Levels of confidence that a reply may name, calls of a model at most, kinds of
#: errors that are not tried again, characters of an error's text.
LEVELS = ("high", "medium", "low", "insufficient")
ATTEMPTS = 3
FINAL = (ValueError, TypeError, KeyError)
ERROR_CHARS = 500

_ANSWER = "answer string, citations array<int>, confidence string"


def answer(reply: Column, otherwise: Column) -> Column:
    """struct<answer, citations, confidence, ok> of a reply.

    A reply is taken if it is JSON with a text ``answer`` and a known ``confidence``; missing
    citations are none.  Any other one gives ``otherwise`` without citations, insufficient.
    """
    got = F.from_json(reply, _ANSWER)
    ok = F.coalesce((F.trim(got["answer"]) != "") & got["confidence"].isin(*LEVELS), F.lit(False))
    return F.struct(
        F.when(ok, got["answer"]).otherwise(otherwise).alias("answer"),
        F.when(ok, F.coalesce(got["citations"], F.array().cast("array<int>"))).otherwise(F.array().cast("array<int>")).alias("citations"),
        F.when(ok, got["confidence"]).otherwise(F.lit("insufficient")).alias("confidence"),
        ok.alias("ok"),
    )


def asked(rows: DataFrame, prompt: str, model: Callable[[Column], Column], otherwise: Column) -> DataFrame:
    """``rows`` with ``reply``, the struct that ``answer`` makes of the model's reply."""
    return rows.withColumn("reply", answer(model(F.col(prompt)), otherwise))


def calling(call: Callable[[str], str], attempts: int = ATTEMPTS) -> Callable[[Column], Column]:
    """A model of a function of one prompt, for ``asked``.

    A call that fails is tried again up to ``attempts`` times in all, but not after a
    ValueError, TypeError or KeyError; a prompt whose calls all fail has a null reply.
    """

    def once(prompt: str | None) -> str | None:
        for _ in range(attempts if prompt is not None else 0):
            try:
                return call(prompt)
            except FINAL:
                return None
            except Exception:  # noqa: BLE001, S112  any other error of a service is worth another try
                continue
        return None

    def run(prompts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for some in prompts:
            yield some.map(once)

    return F.pandas_udf(run, "string")


def retries(kind: Column, attempt: Column, attempts: int = ATTEMPTS) -> Column:
    """Whether a call that failed with an error of that kind at the ``attempt``th try (from 0)
    is tried again."""
    return ~kind.isin(*[x.__name__ for x in FINAL]) & (attempt < attempts - 1)


def error_text(message: Column) -> Column:
    """An error's text as it is stored."""
    return F.substring(message, 1, ERROR_CHARS)


def thought(reply: Column, called: Column | None = None) -> Column:
    """struct<action, confidence> of a model that thinks about the next step.

    With ``called``, the name of the tool that the model called itself (null: none), that is the
    action: retrieve for the tool of that name, tool_call for others, finish for none, with
    confidence 0.6, and 0.8 without a call.  Else the reply is JSON, by default to think with
    0.5; one that is no JSON finishes with 0.
    """
    if called is not None:
        action = F.when(called.isNull(), "finish").when(called == "retrieve", "retrieve").otherwise("tool_call")
        return F.struct(action.alias("action"), F.when(called.isNull(), 0.8).otherwise(0.6).alias("confidence"))
    got = F.from_json(reply, "action string, confidence double, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"})
    bad = reply.isNull() | got["_corrupt"].isNotNull()
    return F.struct(
        F.when(bad, "finish").otherwise(F.coalesce(got["action"], F.lit("think"))).alias("action"),
        F.when(bad, 0.0).otherwise(F.coalesce(got["confidence"], F.lit(0.5))).alias("confidence"),
    )
