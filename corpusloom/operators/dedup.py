"""Duplicate detection on ingest: content hashes and a 64-bit SimHash of characters."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.tables import written

#: Characters in a gram, bits that near-duplicates may differ in.
GRAM, MAX_BITS = 3, 3
#: Distinct grams whose votes a task remembers.
_HELD = 300_000


def _simhashes(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """64-bit SimHash over occurrences of 3-grams of the text without white space: the first
    eight bytes of each gram's MD5 vote, a bit is set if its votes are positive.

    Grams are packed into integers, 21 bits a character, so that only distinct ones are
    hashed and a text's votes are one product of counts and rows of the table of votes.
    """
    rows: dict[int, int] = {}
    table = np.empty((1 << 12, 64), np.float32)

    def votes(code: int) -> np.ndarray:
        gram = "".join(chr(code >> s & 0x1FFFFF) for s in (42, 21, 0))
        return np.unpackbits(np.frombuffer(hashlib.md5(gram.encode("utf-8", "replace")).digest()[:8], np.uint8)).astype(np.float32) * 2 - 1

    def one(text: str | None) -> int:
        nonlocal table
        points = np.frombuffer("".join((text or "").split()).encode("utf-32-le", "replace"), "<u4").astype(np.int64)
        if len(points) < GRAM:
            return 0
        codes, counts = np.unique((points[:-2] << 42) | (points[1:-1] << 21) | points[2:], return_counts=True)
        at = []
        for code in codes.tolist():
            k = rows.get(code)
            if k is None:
                k = rows[code] = len(rows)
                if k == len(table):
                    table = np.concatenate([table, np.empty_like(table)])
                table[k] = votes(code)
            at.append(k)
        total = counts.astype(np.float64) @ table[at]
        return int.from_bytes(np.packbits(total > 0).tobytes(), "big", signed=True)

    for some in texts:
        yield some.map(one)
        if len(rows) > _HELD:
            rows.clear()


def simhash(text: Column | str) -> Column:
    """The fingerprint of a text as a long, in Arrow batches."""
    return F.pandas_udf(_simhashes, "long")(text)


def fingerprints(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", simhash("text").alias("fp"))


def near_pairs(fps: DataFrame, most: int = MAX_BITS) -> DataFrame:
    """(a, b, distance) of distinct fingerprints up to ``most`` bits apart.

    The 64 bits are cut into 2 * ``most`` blocks.  At most ``most`` of them differ, so some
    ``most`` blocks are equal: an equi-join on each choice of ``most`` blocks finds all pairs.
    With 3 bits that is 20 rows a fingerprint and buckets of 32 bits, few of which are shared
    by chance.  Equal fingerprints are joined once, by their smallest document.  Both sides are
    shuffled: the rows are 20 times those of a small table, which Spark would take to be small
    enough for the driver.
    """
    one = written(fps.groupBy("fp").agg(F.min("doc_id").alias("doc_id")), "fingerprints")
    count = max(1, 2 * most)
    cuts = [64 * i // count for i in range(count + 1)]
    masks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    choices = [signed(sum(some)) for some in combinations(masks, max(1, most))]
    bands = [F.struct(F.lit(k).alias("band"), F.col("fp").bitwiseAND(F.lit(m)).alias("bits")) for k, m in enumerate(choices)]
    rows = one.select("doc_id", "fp", F.explode(F.array(*bands)).alias("k")).select("doc_id", "fp", "k.band", "k.bits")
    left = rows.withColumnsRenamed({"doc_id": "a", "fp": "fa"})
    right = rows.withColumnsRenamed({"doc_id": "b", "fp": "fb"})
    pairs = left.join(right.hint("merge"), ["band", "bits"]).where("a < b")
    near = pairs.withColumn("distance", F.bit_count(F.col("fa").bitwiseXOR(F.col("fb")))).where(F.col("distance") <= most)
    return near.select("a", "b", "distance").distinct()


def kept_first(ids: DataFrame, pairs: DataFrame) -> DataFrame:
    """(doc_id, kept, of): documents in the order of their ids, each kept unless it is near one that is kept.

    ``pairs``: a, b with a < b.  A document that is near only to dropped ones stays, as in a pass over the documents one by
    one.  ``of`` is the first kept one that a dropped document is near.  Rounds over the pairs: whoever has no earlier open
    neighbour is kept, and drops its later neighbours; the pairs of decided documents go.  A round is
    two aggregations; their number is the longest chain of open neighbours with rising ids, in
    practice a few.
    """
    edges = written(pairs.select("a", "b").distinct(), "near-pairs")
    state = None  # doc_id, kept
    open_ = edges
    while not open_.isEmpty():
        held = open_.select(F.col("b").alias("doc_id")).distinct()
        free = open_.select(F.col("a").alias("doc_id")).distinct().join(held, "doc_id", "left_anti")
        gone = open_.join(free, F.col("a") == F.col("doc_id")).select(F.col("b").alias("doc_id")).distinct()
        now = written(free.withColumn("kept", F.lit(True)).unionByName(gone.withColumn("kept", F.lit(False))), "decided")
        state = now if state is None else state.unionByName(now)
        out = now.where("not kept").select("doc_id")
        kept = now.where("kept").select("doc_id")
        left = open_.join(kept, F.col("a") == F.col("doc_id"), "left_anti").join(out, F.col("a") == F.col("doc_id"), "left_anti")
        open_ = written(left.join(out, F.col("b") == F.col("doc_id"), "left_anti"), "open-pairs")
    if state is None:
        return ids.select("doc_id", F.lit(True).alias("kept"), F.lit(None).cast(ids.schema["doc_id"].dataType).alias("of"))
    state = state.groupBy("doc_id").agg(F.max("kept").alias("kept"))
    rows = ids.select("doc_id").join(state, "doc_id", "left").withColumn("kept", F.coalesce("kept", F.lit(True)))
    # a document whose pairs all went with dropped neighbours is kept, which is the default above
    alive = written(rows, "kept")
    near = edges.join(alive.where("kept").select(F.col("doc_id").alias("a")), "a").groupBy(F.col("b").alias("doc_id")).agg(F.min("a").alias("of"))
    return alive.join(near, "doc_id", "left").select("doc_id", "kept", F.when(~F.col("kept"), F.col("of")).alias("of"))


def kept_documents(fps: DataFrame, most: int = MAX_BITS) -> DataFrame:
    """``kept_first`` of documents (doc_id, fp) by near fingerprints, through the first document of each.

    Later documents of a fingerprint never stay: they are near the first one or what that is near.  The fingerprints are
    written first, as they are read four times.
    """
    fps = written(fps, "document-fingerprints")
    firsts = written(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "first-documents")
    decided = kept_first(firsts.select(F.col("first").alias("doc_id")), near_pairs(fps, most)).withColumnsRenamed({"doc_id": "first_", "kept": "first_kept"})
    rows = fps.join(firsts, "fp").join(decided, F.col("first") == F.col("first_"))
    is_first = F.col("doc_id") == F.col("first")
    return rows.select("doc_id", (is_first & F.col("first_kept")).alias("kept"), F.when(~is_first & F.col("first_kept"), F.col("first")).otherwise(F.col("of")).alias("of"))


def first_of_copies(docs: DataFrame, keys: list[str], order: str) -> DataFrame:
    """(…, is_duplicate): rows after the first of each key, by ``order``."""
    by = Window.partitionBy(*keys).orderBy(order)
    return docs.withColumn("is_duplicate", F.row_number().over(by) > 1)


def admitted(uploads: DataFrame, registry: DataFrame, *, extensions: list[str], max_bytes: int) -> DataFrame:
    """Uploads with an allowed extension and size whose (tenant, content hash) is not
    indexed yet; of equal uploads the first."""
    fit = uploads.where(F.col("ext").isin(extensions) & (F.col("size") <= max_bytes))
    known = registry.where("status = 'indexed'").select("tenant_id", "content_hash")
    new = fit.join(known, ["tenant_id", "content_hash"], "left_anti")
    return first_of_copies(new, ["tenant_id", "content_hash"], "file_id").where("not is_duplicate").drop("is_duplicate")
