"""Packet captures as a Spark data source: ``spark.read.format("capture").load(folder)`` and ``df.write.format("capture")``."""

from __future__ import annotations

import os
import re
import socket
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

SCHEMA = (
    "timestamp double, src_ip string, dst_ip string, ip_version int, protocol int, packet_length int, src_port int, dst_port int, ttl int, fragment_offset int,"
    " more_fragments int, dont_fragment int, tcp_flags int, tcp_seq long, tcp_ack long, tcp_window int, payload_length int, capture string"
)
#: Further columns, given where they are asked for: the captured part of the payload, the address in the capture's name.
FURTHER = "payload binary, capture_host string"
COLUMNS = dict(f.split() for f in f"{SCHEMA}, {FURTHER}".split(", "))
# Magic numbers of the format (microseconds, nanoseconds, the newer format) and the longest frame.
MICRO, NANO, NEWER = 0xA1B2C3D4, 0xA1B23C4D, 0x0A0D0D0A
LONGEST = 262144
CHUNK = 8 << 20
#: Bytes of the header of a file and of a record.
HEAD, RECORD = 24, 16
#: Bits of ``tcp_flags``.
FLAGS = {"fin": 1, "syn": 2, "rst": 4, "psh": 8, "ack": 16, "urg": 32}


def filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else "file://" + os.path.abspath(path))


class Format:
    """Order of bytes and unit of time that the header of a file gives; None for a file too short to have one."""

    def __init__(self, order: str, unit: float):
        self.order, self.unit = order, unit
        self.kept = struct.Struct(f"{order}8xI4x")  # of a record's header, the length that was kept

    @classmethod
    def of(cls, head: bytes, name: str) -> Format | None:
        if len(head) < HEAD:
            return None
        little, big = struct.unpack("<I", head[:4])[0], struct.unpack(">I", head[:4])[0]
        if little not in (MICRO, NANO) and big not in (MICRO, NANO):
            raise ValueError(f"{name} is {'the newer capture format' if little == NEWER else 'not a capture'}")
        return cls("<" if little in (MICRO, NANO) else ">", 1e9 if NANO in (little, big) else 1e6)

    def records(self, block: bytes, at: int, stop: int) -> tuple[np.ndarray, int, bool]:
        """Where the whole records of a block begin from ``at`` until ``stop``, where the next one begins, and whether that one is broken.

        Only lengths are read one by one, since each says where the next stands.
        """
        found, kept, last = [], self.kept.unpack_from, len(block) - RECORD
        stop = min(stop, last + 1)
        while at < stop:
            (n,) = kept(block, at)
            if n == 0 or n > LONGEST:
                return np.array(found, dtype=np.int64), at, True
            if at + n > last:
                break
            found.append(at)
            at += RECORD + n
        return np.array(found, dtype=np.int64), at, False

    def fields(self, block: bytes, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lengths and times of the records that begin at ``at``."""
        head = np.frombuffer(block, np.uint8)[at[:, None] + np.arange(12)].view(f"{self.order}u4").astype(np.int64)
        return head[:, 2], head[:, 0] + head[:, 1] / self.unit


def _addresses(raw: np.ndarray, family: int) -> pa.Array:
    """Text of addresses given as rows of bytes; each distinct one is written once."""
    if not len(raw):
        return pa.array([], pa.string())
    keys, where = np.unique(np.ascontiguousarray(raw).view(f"V{raw.shape[1]}").reshape(-1), return_inverse=True)
    return pa.array([socket.inet_ntop(family, k.tobytes()) for k in keys], pa.string()).take(pa.array(where.reshape(-1)))


def _slices(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.Array:
    """Stretches of ``data`` as a binary column."""
    ends = np.cumsum(size)
    at = np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data[at].tobytes())])


def decode(block: bytes, offsets: np.ndarray, lengths: np.ndarray, times: np.ndarray, capture: str, columns: list[str]) -> pa.RecordBatch:
    """Packets of the IPv4 and IPv6 frames of a block, those of their fields that ``columns`` names; other frames give no row."""
    data = np.frombuffer(block + bytes(96), dtype=np.uint8)
    byte = lambda at: data[at].astype(np.int64)
    word = lambda at: byte(at) << 8 | byte(at + 1)
    long = lambda at: word(at) << 16 | word(at + 2)
    kind, start = word(offsets + 12), offsets + 14
    tagged = (kind == 0x8100) & (lengths >= 18)
    kind, start = np.where(tagged, word(offsets + 16), kind), np.where(tagged, offsets + 18, start)
    room = offsets + lengths - start
    v4, v6 = (kind == 0x0800) & (room >= 20), (kind == 0x86DD) & (room >= 40)
    use = (v4 | v6) & (lengths >= 14)
    offsets, lengths, times, start, v4 = offsets[use], lengths[use], times[use], start[use], v4[use]
    protocol = np.where(v4, byte(start + 9), byte(start + 6))
    body = start + np.where(v4, (byte(start) & 15) * 4, 40)
    body_room = np.maximum(offsets + lengths - body, 0)
    tcp, udp = (protocol == 6) & (body_room >= 20), (protocol == 17) & (body_room >= 8)
    body = np.where(tcp | udp, body, 0)
    head = np.where(tcp, (byte(body + 12) >> 4) * 4, 8)
    size = np.where(tcp, np.maximum(body_room - head, 0), np.where(udp, np.maximum(word(body + 4) - 8, 0), 0))

    def address(a: int, b: int) -> pa.Array:
        """The address ``a`` bytes into an IPv4 header or ``b`` into an IPv6 one."""
        four, six = (_addresses(data[start[rows][:, None] + np.arange(width) + at], family) for rows, at, width, family in ((v4, a, 4, socket.AF_INET), (~v4, b, 16, socket.AF_INET6)))
        order = np.empty(len(start), dtype=np.int64)
        order[v4], order[~v4] = np.arange(len(four)), np.arange(len(six)) + len(four)
        return pa.concat_arrays([four, six]).take(pa.array(order))

    def payload() -> pa.Array:
        first = body + head
        return _slices(data, first, np.where(tcp | udp, np.clip(offsets + lengths - first, 0, size), 0))

    fragment = lambda: np.where(v4, word(start + 6), 0)
    i32 = lambda v, absent=None: pa.array(v.astype(np.int32), mask=absent)
    i64 = lambda v, absent=None: pa.array(v.astype(np.int64), mask=absent)
    same = lambda text: pa.repeat(pa.scalar(text, pa.string()), len(start))
    ported = ~(tcp | udp)
    fields = {
        "timestamp": lambda: pa.array(times), "src_ip": lambda: address(12, 8), "dst_ip": lambda: address(16, 24), "ip_version": lambda: i32(np.where(v4, 4, 6)), "protocol": lambda: i32(protocol), "packet_length": lambda: i32(lengths),
        "src_port": lambda: i32(word(body), ported), "dst_port": lambda: i32(word(body + 2), ported), "ttl": lambda: i32(np.where(v4, byte(start + 8), byte(start + 7))),
        "fragment_offset": lambda: i32((fragment() & 0x1FFF) * 8), "more_fragments": lambda: i32(fragment() >> 13 & 1), "dont_fragment": lambda: i32(fragment() >> 14 & 1),
        "tcp_flags": lambda: i32(byte(body + 13) & 63, ~tcp), "tcp_seq": lambda: i64(long(body + 4), ~tcp), "tcp_ack": lambda: i64(long(body + 8), ~tcp), "tcp_window": lambda: i32(word(body + 14), ~tcp), "payload_length": lambda: i32(size),
        "capture": lambda: same(capture), "payload": payload, "capture_host": lambda: same(capture_host(capture)),
    }
    return pa.RecordBatch.from_arrays([fields[c]() for c in columns], names=columns)


def read_range(source, name: str, start: int, stop: int | None, columns: list[str]) -> Iterator[pa.RecordBatch]:
    """Packets of the records of an open file that begin from ``start`` and before ``stop``, block by block.

    ``start`` is where a record begins. Reading ends at a record of length nought or above ``LONGEST`` and at a cut record; what precedes stays.
    """
    form = Format.of(source.read_at(HEAD, 0), name)
    end = source.size() if stop is None else stop
    while form is not None and start < end:
        # A record that begins before the end may reach beyond it.
        block = source.read_at(min(CHUNK, end - start) + RECORD + LONGEST, start)
        at, then, broken = form.records(block, 0, min(CHUNK, end - start))
        if len(at):
            lengths, times = form.fields(block, at)
            yield decode(block, at + RECORD, lengths, times, name, columns)
        if broken or not then:
            return
        start += then


def listing(folder: str) -> tuple[object, list]:
    """The file system of a folder of captures, or of one capture, and its files in order of their names; no links, nothing hidden."""
    from pyarrow import fs

    system, path = filesystem(folder)
    info = system.get_file_info(path)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(path, recursive=True))
    return system, sorted((f for f in found if f.type == fs.FileType.File and not f.base_name.startswith(("_", ".")) and not f.base_name.endswith(".lnk")), key=lambda f: f.path)


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class CaptureReader(DataSourceReader):
    """Reads a file a task, only the columns of the schema; :mod:`capture_ranges` cuts large files."""

    def __init__(self, folder: str, columns: list[str]):
        if unknown := set(columns) - set(COLUMNS):
            raise ValueError(f"captures have no {sorted(unknown)}")
        self.folder, self.columns = folder, columns

    def partitions(self):
        return [_File(f.path) for f in listing(self.folder)[1]]

    def read(self, partition):
        system, _ = filesystem(self.folder)
        with system.open_input_file(partition.path) as source:
            yield from read_range(source, partition.path.rsplit("/", 1)[-1], HEAD, None, self.columns)


class _Done(WriterCommitMessage):
    def __init__(self, paths: list[str]):
        self.paths = paths


class CaptureWriter(DataSourceArrowWriter):
    """Writes rows (``timestamp`` double, ``frame`` binary), a file a partition; only a commit gives files their final names.

    With a column ``capture``, a row goes to a file whose name begins with it; sort partitions by it, for each change opens a new file.
    """

    def __init__(self, folder: str):
        self.folder = folder

    def write(self, iterator):
        system, folder = filesystem(self.folder)
        system.create_dir(folder, recursive=True)
        out, name, paths = None, None, []
        for batch in iterator:
            names = batch.column("capture").to_pylist() if "capture" in batch.schema.names else ["part"] * batch.num_rows
            cuts = [k for k in range(batch.num_rows) if not k or names[k] != names[k - 1]] + [batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if out is None or names[a] != name:
                    if out is not None:
                        out.close()
                    name = names[a]
                    paths.append(f"{folder}/_{name}-{uuid.uuid4().hex}.pcap")
                    out = system.open_output_stream(paths[-1])
                    out.write(struct.pack("<IHHiIII", MICRO, 2, 4, 0, 0, LONGEST, 1))
                out.write(_records(batch.slice(a, b - a)))
        if out is not None:
            out.close()
        return _Done(paths)

    def commit(self, messages):
        system, _ = filesystem(self.folder)
        for path in (p for m in messages if m is not None for p in m.paths):
            folder, name = path.rsplit("/", 1)
            system.move(path, f"{folder}/{name[1:]}")

    def abort(self, messages):
        system, _ = filesystem(self.folder)
        for path in (p for m in messages if m is not None for p in m.paths):
            system.delete_file(path)


def _records(batch: pa.RecordBatch) -> bytes:
    """Records of a batch's frames: all headers are made at once and laid between the frames."""
    frames = batch.column("frame").cast(pa.large_binary())
    offsets = np.frombuffer(frames.buffers()[1], np.int64)[frames.offset : frames.offset + len(frames) + 1]
    micros = np.round(batch.column("timestamp").to_numpy(zero_copy_only=False) * 1e6).astype(np.int64)
    size = np.diff(offsets)
    heads = np.stack([micros // 1_000_000, micros % 1_000_000, size, size], axis=1).astype("<u4").view(np.uint8).reshape(-1)
    pieces = np.empty(len(size) * 2, dtype=np.int64)
    pieces[0::2], pieces[1::2] = RECORD, size
    is_head = np.repeat(np.arange(len(pieces)) % 2 == 0, pieces)
    out = np.empty(len(is_head), dtype=np.uint8)
    out[is_head] = heads
    if offsets[-1] > offsets[0]:
        out[~is_head] = np.frombuffer(frames.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return out.tobytes()


class CaptureSource(DataSource):
    """A folder of captures, or one capture. A schema with some of the columns reads these alone."""

    @classmethod
    def name(cls):
        return "capture"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return CaptureReader(self.options["path"], schema.fieldNames())

    def writer(self, schema, overwrite):
        return CaptureWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(CaptureSource)


#: Address of a host in the name of its capture.
HOST_IN_NAME = r"((?:\d{1,3}\.){3}\d{1,3})"


def capture_host(name: str) -> str | None:
    """The address in a capture's name, if there is one."""
    found = re.search(HOST_IN_NAME, name)
    return found and found.group(1)
