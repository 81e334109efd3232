"""An inverted index that is stored once and read instead of the corpus.

Documents are numbered and lie in blocks of ``BLOCK``.  A posting list is cut at the blocks:
one row for each term and block, with the documents' places in the block and their impacts (BM25
without the term's weight).  A second, thin table has the largest impact of each such row.  A search
adds up these maxima: no document of a block can score more.  The blocks with the highest
bounds are scored first; their kth best score is a threshold, and of all other blocks only those
whose bound reaches it are read.  The result is that of scoring everything.

The tables are Parquet folders: ``documents`` (num, id, len), ``terms`` (term, df), ``maxima``
and ``postings``, both sorted by term so that row groups of other terms are skipped.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from corpusloom.functions import text
from corpusloom.operators.retrieve import K1, POOL, B, top_k
from corpusloom.operators.tables import scratch, written

#: Documents of a block.
BLOCK = 64
#: Blocks of a query that are scored first, for k results: so many times k documents.
FIRST = 4
#: Rows of (query, block, term) that are broadcast to the postings after counting them.
BROADCAST_ROWS = 1_000_000
#: How much less than the threshold a bound may be; sums in another order differ by less.
_SLACK = 1e-5
#: Rows of a result batch.
ROWS = 10_000


def commonest(ws: Column) -> Column:
    """The word that stands most often in an array of words, of equally frequent ones the last in order."""
    none = F.struct(F.lit("").alias("word"), F.lit(0).alias("n"), F.lit("").alias("best"), F.lit(0).alias("most"))

    def step(a: Column, w: Column) -> Column:
        n = F.when(w == a["word"], a["n"] + 1).otherwise(1)
        return F.struct(w.alias("word"), n.alias("n"), F.when(n >= a["most"], w).otherwise(a["best"]).alias("best"), F.greatest(n, a["most"]).alias("most"))

    return F.aggregate(F.array_sort(ws), none, step)["best"]


def numbered(docs: DataFrame) -> DataFrame:
    """(num, id, ws): documents with a text, numbered without gaps from 0.

    Within each task they are numbered in the order of their commonest words, so that texts of one
    language, and to a degree of one subject, share blocks: fewer lists, and bounds that tell
    blocks apart.  Nothing is shuffled for that.
    """
    rows = docs.where("text is not null").select("id", text.words(F.col("text")).alias("ws")).withColumn("key", commonest(F.col("ws")))
    rows = rows.sortWithinPartitions("key", "id").select("id", "ws", F.monotonically_increasing_id().alias("at"))
    rows = written(rows, "numbered")
    part = F.shiftright("at", 33)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(part.alias("part")).count().select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))  # a row for each task
    return rows.withColumn("part", part).join(F.broadcast(starts), "part").select((F.col("start") + F.col("at").bitwiseAND((1 << 33) - 1)).alias("num"), "id", "ws")


@dataclass
class Read:
    """How many rows of the postings a search could read, and how many it read."""

    possible: int = 0
    read: int = 0


class Index:
    """The index in a folder.  ``build`` writes it, ``Index(spark, folder)`` opens it."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.documents, self.terms, self.maxima, self.postings = (spark.read.parquet(f"{self.folder}/{t}") for t in ("documents", "terms", "maxima", "postings"))
        self.n, self.mean = self.documents.agg(F.count("*"), F.coalesce(F.avg("len"), F.lit(0.0))).first()

    @staticmethod
    def build(docs: DataFrame, folder: str | None = None, block: int = BLOCK) -> Index:
        """Index ``docs`` (id, text); texts are split once.  Without a folder it is an intermediate table."""
        import uuid

        spark = docs.sparkSession
        folder = folder or f"{scratch(spark)}/corpusloom/inverted-{uuid.uuid4().hex}"
        rows = numbered(docs)
        rows.select("num", "id", F.size("ws").alias("len")).write.mode("overwrite").parquet(f"{folder}/documents")
        own = spark.read.parquet(f"{folder}/documents")
        mean = own.agg(F.coalesce(F.avg("len"), F.lit(0.0))).first()[0]
        counts = rows.select("num", F.size("ws").alias("len"), F.explode("ws").alias("term")).groupBy("num", "len", "term").agg(F.count("*").alias("tf"))
        impact = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.lit(mean or 1.0)))
        entry = F.struct(F.pmod("num", F.lit(block)).cast("int").alias("place"), impact.alias("impact"))
        lists = counts.groupBy("term", F.floor(F.col("num") / block).alias("block")).agg(F.sort_array(F.collect_list(entry)).alias("e"))  # at most ``block`` entries
        lists = lists.select("term", "block", F.transform("e", lambda x: x["place"]).alias("places"), F.transform("e", lambda x: x["impact"]).alias("impacts"))
        lists.sortWithinPartitions("term", "block").write.mode("overwrite").parquet(f"{folder}/postings")
        lists = spark.read.parquet(f"{folder}/postings")
        maxima = lists.select("term", "block", F.size("places").alias("n"), F.array_max("impacts").alias("top"), F.lit(block).alias("size"))
        maxima.write.mode("overwrite").parquet(f"{folder}/maxima")
        maxima = spark.read.parquet(f"{folder}/maxima")
        maxima.groupBy("term").agg(F.sum("n").alias("df")).write.mode("overwrite").parquet(f"{folder}/terms")
        return Index(spark, folder)

    def drop(self) -> None:
        """Delete the index."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def weight(self, df: Column) -> Column:
        return F.log(1 + (F.lit(self.n) - df + 0.5) / (df + 0.5))

    def search(self, queries: DataFrame, k: int = POOL, read: Read | None = None, *, skip: bool = True) -> DataFrame:
        """(query_id, id, score, rank): the k best documents of each query (query_id, text), whose
        distinct terms count once.  With ``skip`` off every block is scored."""
        asked = queries.select("query_id", F.explode(F.array_distinct(text.words(F.col("text")))).alias("term"))
        terms = written(asked.join(self.terms, "term").select("query_id", "term", self.weight(F.col("df")).alias("w")), "query-terms")
        each = terms.join(self.maxima, "term")
        bounds = written(each.groupBy("query_id", "block").agg(F.sum(F.col("w") * F.col("top")).alias("bound"), F.count("*").alias("lists")), "bounds")
        size = self.maxima.select("size").limit(1).collect()
        size = size[0]["size"] if size else BLOCK
        order = Window.partitionBy("query_id").orderBy(F.col("bound").desc(), "block")
        first = bounds.withColumn("at", F.row_number().over(order)).where(F.col("at") <= -(-FIRST * k // size)) if skip else bounds
        found = written(self._scored(first.select("query_id", "block"), terms, size, k), "first-blocks")
        used = first.select("lists")
        if skip:
            best = top_k(found, k, "score", "num").groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("least"))
            rest = bounds.join(first.select("query_id", "block"), ["query_id", "block"], "left_anti").join(best, "query_id", "left")
            rest = written(rest.where(F.col("least").isNull() | (F.col("bound") >= F.col("least") - _SLACK)), "more-blocks")
            used = used.unionByName(rest.select("lists"))
            found = found.unionByName(self._scored(rest.select("query_id", "block"), terms, size, k))
        if read is not None:
            read.possible = bounds.agg(F.coalesce(F.sum("lists"), F.lit(0))).first()[0]
            read.read = used.agg(F.coalesce(F.sum("lists"), F.lit(0))).first()[0]
        # ties go by id, so all that tie with the kth stay until the ids are known
        order = Window.partitionBy("query_id").orderBy(F.round("score", 6).desc())
        near = found.withColumn("place", F.rank().over(order)).where(F.col("place") <= k).drop("place")
        named = near.join(self.documents.select("num", "id"), "num").select("query_id", "id", "score")
        return top_k(named, k, "score", "id")

    def _scored(self, blocks: DataFrame, terms: DataFrame, size: int, k: int) -> DataFrame:
        """(query_id, num, score) of the documents of ``blocks`` (query_id, block): of each block the k best and
        what ties with the kth."""
        wanted = written(blocks.join(terms, "query_id"), "wanted")
        few = wanted.count() <= BROADCAST_ROWS
        lists = self.postings.join(F.broadcast(wanted) if few else wanted, ["term", "block"]).select("query_id", "block", "w", "places", "impacts")
        kind = blocks.schema["query_id"].dataType.simpleString()
        schema = to_arrow_type(blocks.schema["query_id"].dataType)

        def score(batches):
            last, sums, done, held = None, np.zeros(size), [], 0

            def best():
                near = sums.round(6)
                least = np.partition(near, -k)[-k] if k < size else 0.0
                at = np.nonzero((near >= least) & (sums > 0))[0]
                done.append((last[0], at + last[1] * size, sums[at]))
                return len(at)

            def rows():
                names = pa.array([q for q, at, _ in done for _ in at], schema)
                return pa.RecordBatch.from_arrays([names, pa.array(np.concatenate([at for _, at, _ in done])), pa.array(np.concatenate([s for *_, s in done]))], ["query_id", "num", "score"])

            for batch in batches:
                ids, of = batch.column("query_id"), batch.column("block").to_pylist()
                keys, weights = list(zip(ids.to_pylist(), of, strict=True)), batch.column("w").to_pylist()
                places, impacts = batch.column("places"), batch.column("impacts")
                flat, values = np.asarray(places.flatten()), np.asarray(impacts.flatten())
                ends = np.concatenate([[0], np.cumsum(np.asarray(places.value_lengths()))])
                for i, key in enumerate(keys):
                    if key != last:
                        if last is not None:
                            held += best()
                            if held > ROWS:
                                yield rows()
                                done, held = [], 0
                        last = key
                        sums[:] = 0
                    a, b = ends[i], ends[i + 1]
                    sums[flat[a:b]] += weights[i] * values[a:b]
            if last is not None:
                best()
                yield rows()

        return lists.repartition("query_id", "block").sortWithinPartitions("query_id", "block").mapInArrow(score, f"query_id {kind}, num long, score double")
