"""A training-data pipeline over ``documents`` from five of the operators.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept:

1. toxicity: documents that the model rejects go.
2. line dedup: lines that ten or more documents hold go; the documents stay.
3. SimHash near-dedup: of each group of documents linked by five-word Jaccard similarity (at
   least 0.8; candidates by ball hashing of SimHash fingerprints) one stays.
4. benchmark decontamination: documents with a benchmark window go.
5. mixing: the documents of a mix of the sources, with ``copies``, how often each is taken.

Stages 1 to 4 return the columns of ``documents``; the last adds ``copies``.  SQL can't
express stages 1, 3 and 5, so the tests hold each stage against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import decontam, linededup, mixing, shared, similar, toxicity


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.drop_toxic(docs, model)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return linededup.clean(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return similar.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("line dedup", drop_repeated_lines),
    ("simhash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("mixing", mix_sources),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` through all stages, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        kept = shared.materialize(stage(spark, docs, sf_dir), f"stage-{k + 1}")
        if k:
            shared.drop_table(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
