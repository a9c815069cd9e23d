"""Captures read in byte ranges give the rows of one read, whatever the size of the ranges."""

import random
import struct

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewire.sources import capture, capture_ranges


def _frame(rng, k, payload=b""):
    ip = bytes([10, 0, k % 3, k % 7]) + bytes([10, 1, 0, k % 5])
    if k % 9 == 4:
        return bytes(12) + b"\x08\x06" + bytes(rng.randint(20, 60))  # no IP
    if k % 4 == 1:
        return bytes(12) + b"\x08\x00\x45" + bytes(7) + b"\x40\x11" + bytes(2) + ip + struct.pack("!HHHH", 53, 1000 + k, 8 + len(payload), 0) + payload
    if k % 4 == 2:
        return bytes(12) + b"\x86\xdd\x60" + bytes(5) + b"\x06\x07" + ip * 4 + struct.pack("!HHIIBBHI", 1000 + k, 80, k, 0, 0x50, 24, 7, 0) + payload
    return bytes(12) + b"\x81\x00\x00\x05\x08\x00\x45" + bytes(7) + b"\x80\x06" + bytes(2) + ip + struct.pack("!HHIIBBHI", 1000 + k, 80, k, 0, 0x60, 18, 7, 0) + bytes(4) + payload


def _capture(seed, order="<", magic=capture.MICRO, n=300, spoil=None, nested=False):
    rng = random.Random(seed)
    record = lambda k, f: struct.pack(f"{order}IIII", 1_500_000_000 + k, k * 1000 % 1_000_000, len(f), len(f) + 4) + f
    # A capture sent over the network: chains of headers that are no records of this file.
    inner = b"".join(record(k, b"x" * 20) for k in range(40))
    out = [struct.pack(f"{order}IHHiIII", magic, 2, 4, 0, 0, 65535, 1)]
    for k in range(n):
        if k == spoil:
            out.append(struct.pack(f"{order}IIII", 1_500_000_000, 0, 0, 0))
        out.append(record(k, _frame(rng, k, inner if nested and k % 5 == 3 else rng.randbytes(rng.choice((0, 3, 40, 1400))))))
    return b"".join(out)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("captures")
    whole = _capture(1)
    files = {"plain.pcap": whole, "UCAP10.1.2.3.pcap": _capture(2, ">", capture.NANO), "spoilt.pcap": _capture(3, spoil=130), "nested.pcap": _capture(4, nested=True), "cut.pcap": whole[:-37], "head.pcap": whole[:24], "short.pcap": whole[:10], "tail.pcap": whole + b"\x01\x02"}
    for name, data in files.items():
        (root / name).write_bytes(data)
    (root / "x.lnk").write_bytes(b"junk")
    return str(root)


COLUMNS = ["timestamp", "src_ip", "dst_ip", "protocol", "packet_length", "src_port", "tcp_seq", "payload_length", "capture"]


@pytest.fixture(autouse=True)
def few_tasks(monkeypatch):
    monkeypatch.setattr(capture_ranges, "TASKS", 8)


@pytest.mark.parametrize("size", [2_500, 30_000, 1 << 30])
def test_ranges_give_the_rows_of_one_read(spark, folder, size):
    capture.register(spark)
    want = sorted(map(repr, spark.read.format("capture").load(folder).select(*COLUMNS).collect()))
    assert len(want) > 1200
    assert sorted(map(repr, capture_ranges.packets(spark, folder, COLUMNS, size).collect())) == want


def test_ranges_hold_all_records(spark, folder):
    found = capture_ranges.record_ranges(spark, folder, 5_000).groupBy("path").agg(F.sum("records").alias("n"), F.count("*").alias("parts")).collect()
    n = {r.path.rsplit("/", 1)[-1]: r.n for r in found}
    assert n == {"plain.pcap": 300, "UCAP10.1.2.3.pcap": 300, "spoilt.pcap": 130, "nested.pcap": 300, "cut.pcap": 299, "tail.pcap": 300}
    assert max(r.parts for r in found) > 10


def test_columns_are_pruned(spark, folder):
    capture.register(spark)
    some = spark.read.format("capture").schema("src_port int, capture_host string, payload binary").load(f"{folder}/UCAP10.1.2.3.pcap")
    rows = some.collect()
    assert {r.capture_host for r in rows} == {"10.1.2.3"} and some.columns == ["src_port", "capture_host", "payload"]
    same = capture_ranges.packets(spark, f"{folder}/UCAP10.1.2.3.pcap", ["payload", "payload_length", "protocol"], 9_000).collect()
    assert sorted(bytes(r.payload) for r in same) == sorted(bytes(r.payload) for r in rows)
    assert all(len(r.payload) == r.payload_length for r in same) and {len(r.payload) for r in same} == {0, 3, 40, 1400}
    with pytest.raises(ValueError):
        capture_ranges.packets(spark, folder, ["colour"])


def test_captures_are_listed_by_host(spark, folder):
    rows = {r.capture: (r.capture_host, r.bytes) for r in capture_ranges.captures(spark, folder).collect()}
    assert len(rows) == 8 and rows["UCAP10.1.2.3.pcap"][0] == "10.1.2.3" and rows["plain.pcap"][0] is None and rows["short.pcap"][1] == 10


def test_no_capture_is_refused(spark, tmp_path):
    (tmp_path / "x.pcap").write_bytes(bytes(200))
    with pytest.raises(Exception, match="not a capture"):
        capture_ranges.packets(spark, str(tmp_path)).count()


def test_rows_are_written_by_capture(spark, tmp_path):
    capture.register(spark)
    rows = [("10.0.0.1", 1.5, b"a" * 60), ("10.0.0.2", 2.25, b""), ("10.0.0.1", 3.0, bytes(12) + b"\x08\x00\x45" + bytes(8) + b"\x01" + bytes(2) + bytes(8))]
    spark.createDataFrame(rows, "capture string, timestamp double, frame binary").coalesce(1).sortWithinPartitions("capture").write.format("capture").mode("append").save(str(tmp_path))
    listed = capture_ranges.captures(spark, str(tmp_path)).collect()
    assert sorted(r.capture_host for r in listed) == ["10.0.0.1", "10.0.0.2"]
    got = spark.read.format("capture").load(str(tmp_path)).collect()
    assert [(r.timestamp, r.protocol) for r in got] == [(3.0, 1)]


def test_headers_between_frames():
    batch = pa.RecordBatch.from_pydict({"timestamp": [1.5, 2.000001], "frame": pa.array([b"abc", b"de"], pa.binary())})
    assert capture._records(batch) == struct.pack("<IIII", 1, 500_000, 3, 3) + b"abc" + struct.pack("<IIII", 2, 1, 2, 2) + b"de"


class _Source:
    """An open file that remembers how much was read of it."""

    def __init__(self, data):
        self.data, self.read = data, 0

    def read_at(self, n, at):
        part = self.data[at : at + n]
        self.read += len(part)
        return part


def test_the_first_record_is_found_by_reading_little(spark):
    record = lambda k, n: struct.pack("<IIII", 1_500_000_000 + k, k % 1_000_000, n, n) + b"A" * n
    head = struct.pack("<IHHiIII", capture.MICRO, 2, 4, 0, 0, 65535, 1)
    plain = _Source(head + b"".join(record(k, 80 + k % 9) for k in range(40_000)))
    form = capture.Format.of(plain.data[:24], "x")
    at, begins = 24, []
    while at < len(plain.data):
        begins.append(at)
        at += 16 + struct.unpack_from("<I", plain.data, at + 8)[0]
    low = 1_000_001
    assert capture_ranges.first_record(plain, form, low, low + (1 << 19), len(plain.data)) == next(b for b in begins if b >= low)
    assert plain.read <= 1 << 18
    # Chains that reach beyond what is read at first, and up to the file's end.
    wide = _Source(head + b"".join(record(k, 200_000) for k in range(12)))
    for low in (25, 24 + 200_016, 24 + 9 * 200_016 + 1):
        high = low + 400_000
        assert capture_ranges.first_record(wide, form, low, high, len(wide.data)) == 24 + -(-(low - 24) // 200_016) * 200_016


def test_small_ranges_share_tasks(spark, folder, monkeypatch):
    monkeypatch.setattr(capture_ranges, "TASKS", 100_000)
    ranges = capture_ranges.record_ranges(spark, folder, 2_500)
    assert ranges.count() > 100
    assert capture_ranges.packets(spark, folder, COLUMNS, ranges=ranges).rdd.getNumPartitions() <= 2 * spark.sparkContext.defaultParallelism


def test_a_host_is_no_one_task(spark, monkeypatch):
    from tidewire.plans.catalog import QUERIES

    listed = []
    read = capture_ranges.packets
    monkeypatch.setattr(capture_ranges, "packets", lambda s, path, *a, **k: listed.append(capture_ranges.captures(s, path).groupBy("capture_host").count().collect()) or read(s, path, *a, **k))
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    try:
        QUERIES["s04_host_captures"](spark, "/root/testdata/sf0.001")
    finally:
        spark.conf.unset(key)
    assert max(r["count"] for r in listed[0]) > 1
