"""Connected components of a table of links, by repeated stars over DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.shared import drop_table, materialize

MAX_ROUNDS = 60


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) for all nodes of ``links`` (a, b: long), root the smallest node that
    is reachable.

    Rounds of large-star and small-star: every node passes its smallest neighbour to its
    other neighbours, until each component is a star around its smallest node.  Minima
    are partial aggregations and each round reads and writes tables in the shared folder,
    so no neighbourhood is ever collected and AQE can split the partitions of a hot node
    in the joins.  Links with a null end or from a node to itself add nothing.
    """
    links = links.where("a is not null and b is not null and a <> b")
    links = materialize(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    first = links
    for _ in range(MAX_ROUNDS):
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy(F.col("a").alias("n")).agg(F.least(F.min("b"), F.first("a")).alias("low"))
        # large star: larger neighbours go to the smallest one
        large = both.where("b > a").join(low, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").distinct()
        large = materialize(large, "links-large")
        # small star: smaller neighbours, and the node, go to the smallest one
        low = large.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("low"))
        small = large.join(low, F.col("a") == F.col("n"))
        new = small.select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").unionByName(low.select(F.col("n").alias("a"), F.col("low").alias("b"))).distinct()
        new = materialize(new, "links")
        # a star forest stays as it is; compare by count and by a sum of hashes
        mark = [F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")]
        same = links.agg(*mark).first() == new.agg(*mark).first()
        drop_table(large)
        if links is not first:
            drop_table(links)
        links = new
        if same:
            break
    else:
        raise RuntimeError("components did not settle")
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
