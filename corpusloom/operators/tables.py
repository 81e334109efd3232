"""Intermediate tables in the shared folder: they cut the lineage and are read many times."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Folders of local sessions that name none, by application.
_own: dict[str, str] = {}


def scratch(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: ``spark.checkpoint.dir`` of the session, or
    the folder of ``SparkContext.setCheckpointDir``.

    Where neither is set a session on this machine gets a temporary folder; on a cluster, whose
    executors could not read that, it is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="corpusloom-")
    return _own[app]


#: Paths of the tables that each open ``temporary`` block of this thread has written, outermost block first.
_open: ContextVar[tuple[list[str], ...]] = ContextVar("open", default=())


def written(df: DataFrame, name: str, *, keep: bool = False) -> DataFrame:
    """Write ``df`` to a new table in the shared folder and read it back.

    A lost executor costs no more than the tasks after the table, since the table's files
    outlive it.  Within ``temporary`` the table goes at the end of the block, or with ``keep``
    at the end of the block around it, if there is one.
    """
    spark = df.sparkSession
    path = f"{scratch(spark)}/corpusloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    blocks = _open.get()
    if len(blocks) > keep:
        blocks[-1 - keep].append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """A block whose tables are deleted at its end; what it returns must not read them."""
    own: list[str] = []
    token = _open.set((*_open.get(), own))
    try:
        yield
    finally:
        _open.reset(token)
        for path in own:
            _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def dropped(df: DataFrame) -> None:
    """Delete the files of a table that ``written`` wrote."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/corpusloom/" in path:
            _delete(df.sparkSession, path)
