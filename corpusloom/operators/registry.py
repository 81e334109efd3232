"""Tables that change: document registry, chat history, semantic cache.

Parquet has no in-place update, so an upsert appends a row and readers take the latest.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators import retrieve

#: States of a document, thresholds and life times.
STATES = ("queued", "processing", "indexed", "failed")
CACHE_SIMILARITY, CACHE_DAYS, CHAT_DAYS = 0.85, 7, 30


def latest(versions: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The last row of each key by ``order``."""
    by = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return versions.withColumn("__at", F.row_number().over(by)).where("__at = 1").drop("__at")


def updated(records: DataFrame, updates: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Records with the fields that an update gives; others keep theirs.  Updates of unknown
    keys change nothing."""
    new = updates.select(F.col(key).alias("__key"), *[F.col(c).alias(f"__{c}") for c in fields])
    rows = records.join(new, F.col(key) == F.col("__key"), "left")
    return rows.withColumns({c: F.coalesce(f"__{c}", c) for c in fields}).drop("__key", *[f"__{c}" for c in fields])


def of_tenant(records: DataFrame, tenant: str, key: str, status: str | None = None, skip: int = 0, limit: int | None = None) -> DataFrame:
    """A page of a tenant's records in the order of ``key``."""
    rows = records.where(F.col("tenant_id") == tenant)
    rows = rows.where(F.col("status") == status) if status is not None else rows
    rows = rows.orderBy(key).offset(skip)
    return rows if limit is None else rows.limit(limit)


def last_messages(messages: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """Of each conversation the newest ``limit`` messages after ``offset``, oldest first by
    ``at``."""
    newest = Window.partitionBy("conv_id").orderBy(F.col("turn").desc())
    rows = messages.withColumn("rn", F.row_number().over(newest)).where(F.col("rn").between(offset + 1, offset + limit))
    oldest = Window.partitionBy("conv_id").orderBy("turn")
    return rows.withColumn("at", F.row_number().over(oldest)).drop("rn")


def history(messages: DataFrame, rewriting: int = 3, routing: int = 2) -> DataFrame:
    """Each message with the texts of the ones before it, for rewriting and for routing, and
    the key under which a rewrite is kept."""
    before = Window.partitionBy("conv_id").orderBy("turn")
    past = lambda n: F.collect_list("text").over(before.rowsBetween(-n, -1))
    rows = messages.withColumns({"for_rewrite": past(rewriting), "for_route": past(routing)})
    key = F.concat(F.col("text"), F.lit("|"), F.array_join(F.transform("for_rewrite", lambda x: F.concat(x, F.lit("|"))), ""))
    return rows.withColumn("cache_key", F.md5(key.cast("binary")))


def cache_lookup(queries: DataFrame, entries: DataFrame, least: float = CACHE_SIMILARITY, days: int = CACHE_DAYS, *, others: bool = False) -> DataFrame:
    """(query_id, hit, similarity): the most similar entry of the same tenant that is not
    expired, if it reaches ``least``; ties go to the smaller id.

    queries: query_id, tenant_id, vec, asked_at; entries: id, tenant_id, vec, created_at.
    Entries are scanned in ``retrieve.dense``'s blocks, where tenant and age are checked, so no
    tenant's pairs meet in one task.  With ``others`` an entry with the query's id is left out.
    """
    seconds = days * 86400
    asked = queries.select("query_id", "tenant_id", "vec", F.col("asked_at").cast("timestamp").cast("double").alias("t"))
    rows = entries.select("id", "tenant_id", "vec", F.col("created_at").cast("timestamp").cast("double").alias("t"))

    def allowed(q, c):
        codes: dict = {}
        code = lambda column: np.array([codes.setdefault(x, len(codes)) for x in column.to_pylist()])
        at, made = np.asarray(q.column("t"))[:, None], np.asarray(c.column("t"))[None, :]
        mask = (code(q.column("tenant_id"))[:, None] == code(c.column("tenant_id"))[None, :]) & (made <= at) & (made > at - seconds)
        if others:
            mask &= code(q.column("query_id"))[:, None] != code(c.column("id"))[None, :]
        return mask

    best = retrieve.dense(asked, rows, 1, allowed=allowed).withColumn("similarity", F.round("score", 6))
    return best.where(F.col("similarity") >= least).select("query_id", F.col("id").alias("hit"), "similarity")


def alive(created: Column, now: Column, days: int) -> Column:
    """Whether a row's time to live is not over."""
    return created > now - F.make_dt_interval(F.lit(days))
