"""Helpers that several operators of this subpackage use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.tables import dropped as drop_table
from corpusloom.operators.tables import scratch, temporary
from corpusloom.operators.tables import written as materialize

__all__ = ["scratch", "temporary", "materialize", "drop_table"]

#: ASCII upper case to lower case; all other bytes stay.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

#: Largest table, in rows, that an operator broadcasts after counting it.
BROADCAST_ROWS = 4_000_000


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def broadcast_if_small(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast if the counted ``rows`` stay in the bound; else Spark
    shuffles both sides."""
    return F.broadcast(df) if rows <= limit else df


#: Bytes of rows that a task hands to a shuffle, about.  Spark holds them in the executor's memory, and an executor
#: does not give back what its heap has grown by.
SENT_BYTES = 1 << 26


def spread(df: DataFrame, count: int, times: int, columns: int, key: str) -> DataFrame:
    """``df`` dealt by ``key`` over so many tasks that each, making ``times`` rows of ``columns`` numbers from each of the
    ``count`` rows, makes ``SENT_BYTES`` at most, about.  Without it thin tables come in few and large parts."""
    return df.repartition(1 + count * times * 8 * (columns + 2) // SENT_BYTES, column(key))


def text_bytes(column) -> list:
    """The UTF-8 bytes of each text of an Arrow string column; None for null."""
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def column(name: str) -> Column:
    """The column of that very name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def filtered(docs: DataFrame, text_col: str, keep) -> DataFrame:
    """``docs`` through ``keep``, a function of Arrow batches, in which the text is ``text``.

    The other columns have names of their own there, so that any name is safe.
    """
    names = ["text" if c == text_col else f"c{i}" for i, c in enumerate(docs.columns)]
    rows = docs.toDF(*names)
    return rows.mapInArrow(keep, rows.schema).toDF(*docs.columns)


#: Bytes of texts that a slice holds at most, where it has more than one row.
SLICE_BYTES = 2_000_000


def sliced(batches, rows: int = 500, of: str | None = None):
    """The batches in slices of at most ``rows`` rows, and of at most ``SLICE_BYTES`` in the
    text column ``of``, so that what a task makes of them stays small however many rows a
    batch has and however long they are."""
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        if of is None:
            cuts = [*range(0, batch.num_rows, rows), batch.num_rows]
        else:
            ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(of)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            cuts = [0]
            while cuts[-1] < batch.num_rows:
                at = cuts[-1]
                fits = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE_BYTES, "right"))
                cuts.append(min(max(fits, at + 1), at + rows, batch.num_rows))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b > a:
                yield batch.slice(a, b - a)
