"""Documents from folders of files, and uploads as a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions import text
from corpusloom.sources import docx

#: Fixed value: the largest file that is taken, in bytes.
MAX_BYTES = 50 * 1024 * 1024
_GLOB = "*.{" + ",".join(sorted(x[1:] for x in text.PARSERS)) + "}"


def read_folder(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """path, modificationTime, length and content of the files that a parser is known for."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", _GLOB)
    return reader.option("recursiveFileLookup", str(recursive).lower()).load(folder)


def watch_folder(spark: SparkSession, folder: str) -> DataFrame:
    """The same as a stream of new files."""
    kind = T.StructType([T.StructField("path", T.StringType()), T.StructField("modificationTime", T.TimestampType()), T.StructField("length", T.LongType()), T.StructField("content", T.BinaryType())])
    return spark.readStream.format("binaryFile").schema(kind).option("pathGlobFilter", _GLOB).load(folder)


def stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*?)(?:\.[^./]*)?$", 1)


#: Parsers of binary kinds: a function of the content column that gives the text, null where it can't.
BINARY: dict[str, Callable[[Column], Column]] = {"docx": docx.parsed}


def _with_text(files: DataFrame, parsers: dict[str, Callable[[Column], Column]]) -> DataFrame:
    rows = files.withColumn("parser", text.parser_of(F.col("path")))
    fits = F.col("length") <= MAX_BYTES
    plain = text.decoded(F.when(F.col("parser").isin("markdown", "html"), F.col("content")))
    body = F.when(F.col("parser") == "markdown", plain).when(F.col("parser") == "html", text.html_to_text(plain))
    for kind, parse in parsers.items():
        mine = F.col("parser") == kind
        body = body.when(mine, parse(F.when(mine & fits, F.col("content"))))
    return rows.withColumn("text", F.when(fits, body))


def _parsers(binary_parser: Callable[[Column], Column] | dict | None) -> dict[str, Callable[[Column], Column]]:
    if callable(binary_parser):
        return BINARY | {"pdf": binary_parser}
    return BINARY | (binary_parser or {})


def unparsed(files: DataFrame, binary_parser: Callable[[Column], Column] | dict | None = None) -> DataFrame:
    """(path, length, reason) of the files that ``parsed`` leaves out: too large, no parser for
    their kind, damaged (its parser can't read it), or no text in it."""
    parsers = _parsers(binary_parser)
    known = F.coalesce(F.col("parser").isin("markdown", "html", *parsers), F.lit(False))
    reason = F.when(F.col("length") > MAX_BYTES, "too large").when(~known, "no parser").when(F.col("text").isNull(), "damaged").otherwise("no text")
    return _with_text(files, parsers).where("text is null or text = ''").select("path", "length", reason.alias("reason"))


def parsed(files: DataFrame, binary_parser: Callable[[Column], Column] | dict | None = None) -> DataFrame:
    """doc_id, source_path, title, content, text_units, parser, headings, file_size_bytes.

    Markdown and HTML are parsed by column functions, Word files by ``docx``.  For PDF a function of
    the content column that gives their text may be passed, or a dict of such functions by
    parser's name for any binary kind.  Files that are not parsed are in ``unparsed`` with the reason.
    """
    binary_parser = _parsers(binary_parser)
    rows = _with_text(files, binary_parser).where("text <> ''")
    parent = F.regexp_extract("path", r"([^/]*)/[^/]*$", 1)
    return rows.select(
        text.document_key(parent, stem(F.col("path"))).alias("doc_id"),
        F.col("path").alias("source_path"),
        text.title(F.col("text"), stem(F.col("path"))).alias("title"),
        F.col("text").alias("content"),
        text.text_units(F.col("text")).alias("text_units"),
        "parser",
        text.headings(F.col("text")).alias("headings"),
        F.col("length").alias("file_size_bytes"),
    )
