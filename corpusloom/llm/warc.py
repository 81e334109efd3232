"""WARC archives in seekable Zstandard bundles.

A bundle is a run of WARC records, grouped into frames of about ``FRAME_BYTES``.  Each
frame is an independent Zstandard frame, and a seek table (a skippable frame with the
compressed and raw size of every frame, as the public seekable format lays it out) stands
at the end.  The index maps a record identifier to its bundle, frame and offset within the
frame's raw bytes, so one record costs one frame to read.  Any Zstandard reader can still
decompress a bundle as one stream.

Equal payloads of at least ``REVISIT_BYTES`` are stored once: the record with the largest
page id is the response, the others are revisits that refer to it.

Scale: digests are found by a thin aggregation that tasks combine before the shuffle.  Groups
of more than one page are broadcast while they are at most ``groups`` in number, so that no
html is shuffled.  Beyond that only the groups of more than ``heavy`` pages are broadcast,
of which there is at most one for each ``heavy`` pages, and the others join by shuffle: no key
is hot, whatever the payloads.  A task holds one bundle at a time.  Bundles
are rows of a Parquet table in the shared folder, committed by Spark's writer, so a retried
task leaves no half-written file.

Edge cases: a null html is an empty payload; a null url leaves the target URI out.  Null page
ids are smaller than any other and revisit the group's response (if a group has only null ids,
all are responses); rows that share their group's largest id are all responses.  A page without an
id gets a record identifier of its own and is read back without one.  Empty tables
give no bundles and no records.  Only the named columns are read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.shared import broadcast_if_small, column, materialize, sliced, text_bytes

FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 16 << 20
REVISIT_BYTES = 1000
#: Groups of equal payloads that are broadcast at most, and pages of a group that is not joined by shuffle.
GROUPS, HEAVY = 500_000, 50_000
LEVEL = 3

#: Fixed values of the seekable format: magic of a skippable frame and of the footer.
_SKIPPABLE, _SEEKABLE = 0x184D2A5E, 0x8F92EAB1
_PREFIX, _NONE = "urn:x-page:", "urn:x-null:"
_BUNDLES = "bundle_id string, archive binary, entries array<struct<record_id:string,frame:int,offset:int,length:int>>"


class BundleWriter:
    """Collects records and makes one bundle of them."""

    def __init__(self, frame_bytes: int = FRAME_BYTES, level: int = LEVEL):
        self.frame_bytes, self.codec = frame_bytes, zstandard.ZstdCompressor(level=level)
        self.frames: list[tuple[bytes, int]] = []
        self.entries: list[dict] = []
        self.open: list[bytes] = []
        self.size = self.raw = 0

    def add(self, record_id: str, record: bytes) -> None:
        if self.open and self.size + len(record) > self.frame_bytes:
            self._close()
        self.entries.append({"record_id": record_id, "frame": len(self.frames), "offset": self.size, "length": len(record)})
        self.open.append(record)
        self.size += len(record)
        self.raw += len(record)

    def _close(self) -> None:
        self.frames.append((self.codec.compress(b"".join(self.open)), self.size))
        self.open, self.size = [], 0

    def finish(self) -> bytes:
        if self.open:
            self._close()
        table = b"".join(struct.pack("<II", len(data), raw) for data, raw in self.frames)
        footer = struct.pack("<IBI", len(self.frames), 0, _SEEKABLE)
        seek = struct.pack("<II", _SKIPPABLE, len(table) + len(footer)) + table + footer
        return b"".join(data for data, _ in self.frames) + seek


def seek_table(archive: bytes) -> list[tuple[int, int, int]]:
    """(start, compressed size, raw size) of each frame, from the footer."""
    count, flags, magic = struct.unpack_from("<IBI", archive, len(archive) - 9)
    if magic != _SEEKABLE:
        raise ValueError("no seek table at the end of the bundle")
    width = 12 if flags & 0x80 else 8
    at, start, out = len(archive) - 9 - count * width, 0, []
    for k in range(count):
        packed, raw = struct.unpack_from("<II", archive, at + k * width)
        out.append((start, packed, raw))
        start += packed
    return out


def read_frame(archive: bytes, frames: list[tuple[int, int, int]], k: int) -> bytes:
    """The raw bytes of frame ``k`` alone."""
    start, packed, raw = frames[k]
    return zstandard.ZstdDecompressor().decompress(archive[start : start + packed], max_output_size=raw)


def make_record(page: str, url: str | None, payload: bytes, sha1: str, refers_to: str | None, date: str) -> bytes:
    """A WARC/1.1 response record, or a revisit record without the payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{page if page.startswith(_NONE) else _PREFIX + page}>", f"WARC-Date: {date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url))
    lines.append("WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(sha1)).decode())
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <{_PREFIX}{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(record: bytes) -> dict:
    """The fields of a record that ``make_record`` wrote; checks the payload's digest."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    sha1 = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != sha1):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    name = lambda x: x and (None if x.startswith("<" + _NONE) else x[1:-1].removeprefix(_PREFIX))
    return {"page": name(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"), "record_type": kind, "payload_bytes": size, "payload_digest": sha1, "refers_to": name(fields.get("WARC-Refers-To")), "payload": payload if kind == "response" else None}


def _planned(pages: DataFrame, id_col: str, url_col: str, html_col: str, revisit_bytes: int, most_groups: int, heavy: int) -> DataFrame:
    """page, url, html, sha1 and refers_to (null for responses), ids as text."""
    rows = pages.select(column(id_col).alias("page"), column(url_col).alias("url"), F.coalesce(column(html_col), F.lit("")).alias("html"))
    rows = rows.withColumns({"sha1": F.sha1(F.col("html").cast("binary")), "size": F.octet_length("html")})
    groups = rows.where(F.col("size") >= revisit_bytes).groupBy("sha1").agg(F.max("page").alias("first"), F.count("*").alias("n")).where("n > 1")
    groups = materialize(groups.select(F.col("sha1").alias("g"), "first", "n"), "warc-groups")
    whole, large = groups.agg(F.count("*"), F.count_if(F.col("n") > heavy)).first()
    if whole <= most_groups:
        rows = rows.join(F.broadcast(groups), F.col("sha1") == F.col("g"), "left")
    else:
        some = groups.where(F.col("n") > heavy).select(F.col("g").alias("hg"), F.col("first").alias("hfirst"))
        rows = rows.join(broadcast_if_small(some, large), F.col("sha1") == F.col("hg"), "left")
        light = rows.where("hg is null").join(groups.where(F.col("n") <= heavy), F.col("sha1") == F.col("g"), "left")
        rows = light.drop("hg", "hfirst").unionByName(rows.where("hg is not null").select("page", "url", "html", "sha1", "size", F.col("hg").alias("g"), F.col("hfirst").alias("first"), F.lit(0).cast("long").alias("n")))
    refers = F.when(F.col("first").isNotNull() & ~F.col("page").eqNullSafe(F.col("first")), F.col("first"))
    name = F.coalesce(F.col("page").cast("string"), F.concat(F.lit(_NONE), F.monotonically_increasing_id()))
    return rows.select(name.alias("page"), "url", "html", "sha1", refers.cast("string").alias("refers_to"))


def write_bundles(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", revisit_bytes: int = REVISIT_BYTES, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES, groups: int = GROUPS, heavy: int = HEAVY, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Archive all pages.  Returns the written table of bundles: bundle_id (hash of the
    bundle), archive (its bytes) and entries (record_id, frame, offset, length)."""

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(writer: BundleWriter) -> pa.RecordBatch:
            archive = writer.finish()
            kind = pa.list_(pa.struct([("record_id", pa.string()), ("frame", pa.int32()), ("offset", pa.int32()), ("length", pa.int32())]))
            return pa.RecordBatch.from_arrays([pa.array([hashlib.sha256(archive).hexdigest()]), pa.array([archive], pa.binary()), pa.array([writer.entries], kind)], ["bundle_id", "archive", "entries"])

        writer = BundleWriter(frame_bytes)
        for batch in sliced(batches, of="html"):
            html = text_bytes(batch.column("html"))
            rest = [batch.column(c).to_pylist() for c in ("page", "url", "sha1", "refers_to")]
            for payload, page, url, sha1, refers_to in zip(html, *rest, strict=True):
                writer.add(page, make_record(page, url, payload, sha1, refers_to, date))
                if writer.raw >= bundle_bytes:
                    yield row(writer)
                    writer = BundleWriter(frame_bytes)
        if writer.entries:
            yield row(writer)

    return materialize(_planned(pages, id_col, url_col, html_col, revisit_bytes, groups, heavy).mapInArrow(bundle, _BUNDLES), "warc")


def record_index(bundles: DataFrame) -> DataFrame:
    """record_id, bundle_id, frame, offset and length of every record."""
    return bundles.select("bundle_id", F.explode("entries").alias("e")).select("e.record_id", "bundle_id", "e.frame", "e.offset", "e.length")


_RECORD = "page string, url string, record_type string, payload_bytes long, payload_digest string, refers_to string"


def read_records(bundles: DataFrame, *, only: list[str] | None = None, payloads: bool = False) -> DataFrame:
    """Read the archives back by seek table and index: all records, or those in ``only``
    (then only the frames that hold them are decompressed)."""
    wanted = None if only is None else set(only)
    if wanted is not None:
        bundles = bundles.where(F.exists("entries", lambda e: e["record_id"].isin(only)))
    schema = _RECORD + (", payload binary" if payloads else "")
    names = [x.split()[0] for x in schema.split(", ")]

    def read(batches):
        for batch in batches:
            for archive, entries in zip(batch.column("archive"), batch.column("entries"), strict=True):
                data = archive.as_py()
                frames, at, raw, rows = seek_table(data), -1, b"", []
                for e in entries.as_py():
                    if wanted is not None and e["record_id"] not in wanted:
                        continue
                    if e["frame"] != at:
                        at, raw = e["frame"], read_frame(data, frames, e["frame"])
                    rows.append(parse_record(raw[e["offset"] : e["offset"] + e["length"]]))
                    if not payloads:
                        rows[-1]["payload"] = None
                types = {"payload_bytes": pa.int64(), "payload": pa.binary()}
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], types.get(c, pa.string())) for c in names], names)

    return bundles.select("archive", "entries").mapInArrow(read, schema)


def digest(records: DataFrame, id_type: str = "long") -> DataFrame:
    """The contract's columns from those of ``read_records``."""
    return records.select(F.col("page").cast(id_type).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(id_type).alias("refers_to"))
