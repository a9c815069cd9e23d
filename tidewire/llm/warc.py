"""WARC archives in seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each with whole records, and a seek table in a skippable
frame at its end. An index maps each record's identifier to bundle, frame and the offset within the frame, so one
record costs one frame. Payloads that occur again are written once and revisited.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..common.store import bounded_broadcast, new_path, small_batches, written
from .files import create, open_for_reading
from .textbatch import slices

#: Bytes of records in a frame and in a bundle (a longer record has a frame of its own), and rows of a broadcast.
FRAME, BUNDLE, BROADCAST_ROWS = 256 << 10, 32 << 20, 200_000
#: Payloads shorter than this are written each time.
REVISIT_FROM = 100
DATE = "1970-01-01T00:00:00Z"

#: Fixed values of the Zstandard seekable format: the skippable frame's and the footer's magic numbers.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class BundleWriter:
    """Writes records into frames; :meth:`close` appends the seek table."""

    def __init__(self, stream, frame: int = FRAME, level: int = 3):
        self.stream, self.limit, self.size = stream, frame, 0
        self.compressor = zstandard.ZstdCompressor(level=level, write_content_size=True)
        self.open: list[bytes] = []
        self.open_size = 0
        self.table: list[tuple[int, int]] = []

    def add(self, record: bytes) -> tuple[int, int]:
        """Frame number and offset within the frame's content."""
        if self.open and self.open_size + len(record) > self.limit:
            self._flush()
        place = len(self.table), self.open_size
        self.open.append(record)
        self.open_size += len(record)
        self.size += len(record)
        return place

    def _flush(self) -> None:
        frame = self.compressor.compress(b"".join(self.open))
        self.stream.write(frame)
        self.table.append((len(frame), self.open_size))
        self.open, self.open_size = [], 0

    def close(self) -> None:
        if self.open:
            self._flush()
        entries = b"".join(struct.pack("<II", *e) for e in self.table)
        footer = struct.pack("<IBI", len(self.table), 0, SEEKABLE)
        self.stream.write(struct.pack("<II", SKIPPABLE, len(entries) + len(footer)) + entries + footer)
        self.stream.close()


class BundleReader:
    """Reads single frames of a bundle by its seek table."""

    def __init__(self, stream):
        self.stream = stream
        size = stream.size()
        stream.seek(size - 9)
        n, _, magic = struct.unpack("<IBI", stream.read(9))
        if magic != SEEKABLE:
            raise ValueError("no seek table at the end of the bundle")
        stream.seek(size - 9 - 8 * n)
        table = struct.unpack(f"<{2 * n}I", stream.read(8 * n))
        self.frames, at = [], 0
        for packed, plain in zip(table[::2], table[1::2], strict=True):
            self.frames.append((at, packed, plain))
            at += packed
        self.decompressor = zstandard.ZstdDecompressor()

    def frame(self, k: int) -> bytes:
        at, packed, plain = self.frames[k]
        self.stream.seek(at)
        return self.decompressor.decompress(self.stream.read(packed), max_output_size=plain)


def urn(of: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, of)}>"


def record(page_id, url: str | None, payload: bytes, digest: str, own: str, refers_to=None, revisit: bool = False, date: str = DATE) -> bytes:
    """One response or revisit record; ``own`` is what its record id is made of, and a revisit names its response's."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {urn(own)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A") if "\r" in url or "\n" in url else f"WARC-Target-URI: {url}")
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if revisit:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {urn(f'page:{refers_to}:{digest}')}", f"X-Refers-To-Page-ID: {refers_to}"]
    block = http if revisit else http + payload
    head += ["Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha256:{digest}", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """Headers and block of the record at ``at``, and where the next one begins."""
    end = data.index(b"\r\n\r\n", at)
    lines = data[at:end].decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no WARC record at {at}")
    head = dict(line.split(": ", 1) for line in lines[1:])
    stop = end + 4 + int(head["Content-Length"])
    return head, data[end + 4 : stop], stop + 4


INDEX = "bundle string, record_id string, urn string, frame int, offset int, length int"


def write_archive(pages: DataFrame, root: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", frame: int = FRAME, bundle: int = BUNDLE) -> None:
    """Write a record per row of ``pages`` into bundles below ``root``, and their index as Parquet.

    Of rows with equal payloads of at least REVISIT_FROM bytes, that with the smallest id is a response and
    the others revisit it; rows that repeat this id and payload are responses too, for a record cannot
    revisit itself. A null payload is empty; a null id comes last and is not referred to. Rows that share an id have
    records of their own: a record's URN follows from its place in its bundle, and that of a response that others revisit from
    its id and digest. Tasks write bundles under unique names, and the index, written by Spark's commit, names the bundles that
    count, with every record's id (``record_id``), URN, frame and offset.
    """
    pages = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(html_col, F.lit("")).alias("html"))
    pages = pages.withColumn("digest", F.sha2("html", 256)).withColumn("long", F.octet_length("html") >= REVISIT_FROM)
    groups = pages.where("long").groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    again = written(groups.where("n > 1").select("digest", "first"), "payloads")
    # Short payloads never meet the repeated ones: each has a key of its own, so that a join that shuffles spreads them.
    key = F.when(F.col("long"), F.col("digest")).otherwise(F.concat(F.lit("short "), F.monotonically_increasing_id().cast("string")))
    again = bounded_broadcast(again.withColumnRenamed("digest", "key"), BROADCAST_ROWS)
    rows = pages.withColumn("key", key).join(again, "key", "left")
    revisit = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    rows = rows.select(F.col("id").cast("string"), "url", "html", "digest", F.when(revisit, F.col("first")).cast("string").alias("refers_to"), revisit.alias("revisit"), (F.col("first").isNotNull() & ~revisit).alias("named"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = uri = None
        done = 0
        for batch in batches:
            for part in slices(batch, "html"):
                out = []
                for page_id, url, html, digest, refers_to, revisit, named in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    if writer is None:
                        stream, uri = create(f"{root}/bundles", ".warc.zst")
                        writer, done = BundleWriter(stream, frame), 0
                    own = f"page:{page_id}:{digest}" if named else f"{uri}#{done}"
                    data = record(page_id, url, html.encode(), digest, own, refers_to, revisit)
                    done += 1
                    out.append((uri, page_id, urn(own), *writer.add(data), len(data)))
                    if writer.size >= bundle:
                        writer.close()
                        writer = None
                columns = [list(c) for c in zip(*out, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32()), strict=True)], ["bundle", "record_id", "urn", "frame", "offset", "length"])
        if writer is not None:
            writer.close()

    rows.mapInArrow(run, INDEX).write.parquet(f"{root}/index")


RECORDS = "record_id string, urn string, payload_bytes long, payload_digest string, record_type string, refers_to string, url string, payload binary"


def _fields(head: dict[str, str], block: bytes, payloads: bool) -> tuple:
    digest = head["WARC-Payload-Digest"].removeprefix("sha256:")
    http, _, payload = block.partition(b"\r\n\r\n")
    revisit = head["WARC-Type"] == "revisit"
    if revisit:  # its payload is elsewhere: the HTTP headers that were kept tell its size
        size, payload = int(http.rpartition(b"Content-Length: ")[2]), None
    else:
        size = len(payload)
        if hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError(f"payload of {head['WARC-Record-ID']} does not have its digest")
    return head.get("X-Page-ID"), head["WARC-Record-ID"], size, digest, head["WARC-Type"], head.get("X-Refers-To-Page-ID"), head.get("WARC-Target-URI"), payload if payloads else None


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.binary())
    columns = zip(*rows, strict=True) if rows else [[]] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [f.split()[0] for f in RECORDS.split(", ")])


def read_archive(spark: SparkSession, root: str, payloads: bool = False) -> DataFrame:
    """All records of the archive at ``root``, bundle by bundle and frame by frame; payloads' digests are verified.

    ``payload`` is null unless asked for, and for revisits.
    """
    index = spark.read.schema(INDEX).parquet(f"{root}/index")
    bundles = index.select("bundle").distinct()
    n = bundles.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                with open_for_reading(uri) as stream:
                    reader = BundleReader(stream)
                    for k in range(len(reader.frames)):
                        data, at, rows = reader.frame(k), 0, []
                        while at < len(data):
                            head, block, at = parse(data, at)
                            rows.append(_fields(head, block, payloads))
                        yield _batch(rows)

    return bundles.repartition(max(1, n), "bundle").mapInArrow(run, RECORDS)


def fetch(spark: SparkSession, root: str, ids: DataFrame, id_col: str = "page_id") -> DataFrame:
    """The records of some ids, with payloads, by the index: only their frames are read."""
    wanted = ids.select(F.col(id_col).cast("string").alias("record_id")).distinct()
    places = spark.read.schema(INDEX).parquet(f"{root}/index").join(wanted, "record_id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = uri = None
            reader = data = None
            rows = []
            for bundle, frame, offset in zip(*(batch.column(c).to_pylist() for c in ("bundle", "frame", "offset")), strict=True):
                if bundle != uri:
                    reader, uri, at = BundleReader(open_for_reading(bundle)), bundle, None
                if frame != at:
                    data, at = reader.frame(frame), frame
                head, block, _ = parse(data, offset)
                rows.append(_fields(head, block, True))
            yield _batch(rows)

    return places.repartition("bundle").sortWithinPartitions("bundle", "frame", "offset").mapInArrow(run, RECORDS)


def archived(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write ``pages`` to a new archive in shared storage and read it back: one row per row of ``pages``.

    ``page_id``, ``payload_bytes``, ``payload_digest``, ``record_type``, ``refers_to``; see :func:`write_archive` for nulls and repeated rows.
    An empty table gives an empty archive and result. Other columns, whatever their names, are not read.
    """
    spark = pages.sparkSession
    small_batches(spark)
    root = new_path(spark, "warc")
    write_archive(pages, root, id_col, url_col, html_col)
    kind = pages.schema[id_col].dataType
    return read_archive(spark, root).select(
        F.col("record_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to")
    )
