"""The reasoning loop over DataFrames: bounded rounds of retrieval for many questions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import signals
from corpusloom.operators.tables import written

MOST_ROUNDS = 5
#: What kind of step each node of the loop is, and that of others.
STEPS = {"think": "thought", "act": "action", "observe": "observation", "retrieve": "action", "finish": "final", "max_iter": "warning"}
OTHER_STEP = "thought"


def step_type(node: Column) -> Column:
    """The kind of step that a node's event shows."""
    known = F.create_map(*[F.lit(x) for kv in STEPS.items() for x in kv])
    return F.coalesce(F.try_element_at(known, F.coalesce(node, F.lit(""))), F.lit(OTHER_STEP))


def accumulated(rounds: list[DataFrame]) -> DataFrame:
    """The chunks of all rounds, repeats kept."""
    return reduce(DataFrame.unionByName, rounds)


def run(
    questions: DataFrame,
    think: Callable[[DataFrame, int], DataFrame],
    retrieve: Callable[[DataFrame], DataFrame],
    rounds: int = MOST_ROUNDS,
    observe: Callable[[DataFrame], DataFrame] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Loop all questions (query_id, text) until they finish or ``rounds`` are over.

    ``think(open questions, round)`` adds action and confidence, and may change the text that is
    looked for; ``retrieve`` returns chunks (query_id, …) for questions whose next node is
    retrieve.  With ``observe`` the next round's questions have ``observation``: what it makes of
    the chunks, (query_id, observation), null in the first round and where nothing was found.
    Returns (query_id, node, round, confidence) of each question's end, and all chunks with their
    round.  The plan has at most ``rounds`` rounds and ends when no question is open; each is written,
    so that a model is asked once for each open question and round.
    """
    opened, ended, found = questions, [], []
    if observe is not None:
        opened = questions.withColumn("observation", F.lit(None).cast("string"))
    for k in range(rounds + 1):
        node = signals.react_next(F.col("action"), F.col("confidence"), F.lit(k), F.lit(False), rounds)
        thought = written(think(opened, k).withColumn("node", node), f"round-{k}")
        ended.append(thought.where("node in ('finish', 'max_iter')").select("query_id", "node", F.lit(k).alias("round"), "confidence"))
        found.append(written(retrieve(thought.where("node = 'retrieve'")).withColumn("round", F.lit(k)), f"found-{k}"))
        opened = thought.where("node not in ('finish', 'max_iter')").select(*questions.columns)
        if opened.isEmpty():
            break
        if observe is not None:
            opened = opened.join(observe(found[-1]), "query_id", "left")
    return accumulated(ended), accumulated(found)
