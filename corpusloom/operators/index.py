"""The index as ordinary tables: chunks, postings, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text

PAYLOAD_CHARS = 2000


#: Columns of the index that every table has, and what a filter may use.
COLUMNS = "chunk_id string, doc_id string, tenant_id string, chunk_index int, section_path string, token_count int, text string, embedding array<float>"
FILTERS = ("doc_id", "chunk_index", "section_path", "token_count", "tenant_id")


def declare(spark: SparkSession, name: str, vector_size: int, distance: str = "cosine") -> bool:
    """Create the index's table, a folder for each tenant, unless it is there; True if it was
    created.  Its vectors' size and distance are kept with the table."""
    if distance not in ("cosine", "dot", "euclid"):
        raise ValueError(f"unknown distance: {distance}")
    if spark.catalog.tableExists(name):
        return False
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({COLUMNS}) USING parquet PARTITIONED BY (tenant_id) TBLPROPERTIES ('vector_size' = '{int(vector_size)}', 'distance' = '{distance}')")
    return True


def declared(spark: SparkSession, name: str) -> dict[str, str]:
    """vector_size and distance of a table that ``declare`` made."""
    return {r["key"]: r["value"] for r in spark.sql(f"SHOW TBLPROPERTIES {name}").collect() if r["key"] in ("vector_size", "distance")}


def checked(rows: DataFrame, vector_size: int, vector: str = "embedding") -> DataFrame:
    """``rows`` whose vectors have the declared length; a row with another one, or without a
    vector, stops the job with its length."""
    n = F.size(vector)
    bad = F.coalesce(n != vector_size, F.lit(True))
    return rows.withColumn(vector, F.when(bad, F.raise_error(F.concat(F.lit(f"vector of {vector_size} expected, got "), F.coalesce(n.cast("string"), F.lit("none")))).cast(rows.schema[vector].dataType)).otherwise(F.col(vector)))


def payload(chunks: DataFrame) -> DataFrame:
    """The rows that the index stores: the text is cut to 2000 characters."""
    return chunks.select("chunk_id", "doc_id", "tenant_id", "chunk_index", "token_count", F.substring("text", 1, PAYLOAD_CHARS).alias("text"), text.size_category(F.col("token_count")).alias("chunk_size_category"))


def postings(chunks: DataFrame, key: str = "chunk_id") -> DataFrame:
    """(term, key, tf, len): occurrences of each term, and the length of its row."""
    rows = chunks.select(key, text.words(F.col("text")).alias("ws")).withColumn("len", F.size("ws"))
    return rows.select(key, "len", F.explode("ws").alias("term")).groupBy("term", key, "len").agg(F.count("*").alias("tf"))


def term_stats(postings_: DataFrame) -> DataFrame:
    return postings_.groupBy("term").agg(F.count("*").alias("df"))


def corpus_stats(chunks: DataFrame) -> DataFrame:
    """One row: number of rows and their mean length in terms."""
    return chunks.agg(F.count("*").alias("n"), F.avg(F.size(text.words(F.col("text")))).alias("avgdl"))


def without_documents(chunks: DataFrame, doc_ids: DataFrame) -> DataFrame:
    """The index after the documents in ``doc_ids`` are deleted."""
    return chunks.join(doc_ids, "doc_id", "left_anti")


def save(chunks: DataFrame, path: str) -> None:
    """Write or replace the chunks of the tenants in ``chunks``, a folder for each tenant."""
    chunks.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("tenant_id").parquet(path)


def tenant_scan(chunks: DataFrame, tenant: str | None, filters: dict | None = None) -> DataFrame:
    """Rows of one tenant; the tenant is mandatory, more filters are ANDed.

    A scalar means equality, a list membership.  Anything but a dict is a TypeError.
    """
    if filters is not None and not isinstance(filters, dict):
        raise TypeError("filters must be a dict")
    out = chunks.where(F.col("tenant_id") == ((tenant or "").strip() or "default"))
    for name, value in (filters or {}).items():
        out = out.where(F.col(name).isin(value) if isinstance(value, list) else F.col(name) == value)
    return out
