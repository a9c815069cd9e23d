"""Flows over windows, sessions and payloads on small cases."""

import random
import struct
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import functions as F

from tidewire.functions import payload as Y
from tidewire.operators import packets as P
from tidewire.streaming.flow_table import flow_deltas

PACKET = "seq long, timestamp double, src_ip string, src_port int, dst_ip string, dst_port int, protocol int, packet_length int"


def _rows(n=400, seed=1):
    rng = random.Random(seed)
    ends = [("10.0.0.1", 5), ("10.0.0.2", 80), ("10.0.0.3", None)]
    t, out = 100.0, []
    for k in range(n):
        t += rng.choice((0.0, 0.5, 3.0, 31.0, 29.0)) if k % 10 else 70.0
        a, b = rng.sample(ends, 2) if k % 3 else (ends[0], ends[1])  # one flow holds a third of all packets
        out.append((k, t, *a, *b, 6, rng.randint(40, 1500)))
    return out


def test_steps_add_up_to_flows(spark):
    rows = _rows()
    got = P.flow_steps(spark.createDataFrame(rows, PACKET).repartition(4), 10.0, 30.0).collect()
    # Brute force: one flow after another, a step for each window.
    live, want = {}, defaultdict(lambda: [0, 0, 0, 0])
    for _, t, a, pa_, b, pb, proto, size in rows:
        key = (proto, *sorted([(a, pa_ or 0), (b, pb or 0)]))
        if key not in live or t - live[key][1] > 30.0:
            live[key] = [t, t, (a, pa_ or 0)]
        live[key][1] = t
        start, _, source = live[key]
        step = want[key, source, start, int(t // 10)]
        back = (a, pa_ or 0) != source
        step[back] += 1
        step[2 + back] += size
    assert {((r.protocol, *sorted([(r.src_ip, r.src_port), (r.dst_ip, r.dst_port)])), (r.src_ip, r.src_port), r.start, r.window): [r.fwd_packets, r.bwd_packets, r.fwd_bytes, r.bwd_bytes] for r in got} == dict(want)
    ends = {}
    for r in sorted(got, key=lambda r: r.window):
        flow = (r.src_ip, r.src_port, r.dst_ip, r.dst_port, r.start)
        assert r.new_flow == (flow not in ends)
        ends[flow] = [x + y for x, y in zip(ends.get(flow, [0, 0]), [r.fwd_packets, r.bwd_bytes], strict=True)]
        assert ends[flow] == [r.total_fwd_packets, r.total_bwd_bytes]
    assert P.flow_steps(spark.createDataFrame([], PACKET), 10.0).count() == 0


def test_steps_equal_the_stream(spark, tmp_path):
    """A trigger a window: the deltas of the live flow table are the steps."""
    rows = _rows(120, 2)
    windows = sorted({int(r[1] // 10) for r in rows})
    table = spark.createDataFrame(rows, PACKET).withColumn("ts", F.timestamp_seconds("timestamp"))
    for w in windows:
        table.where(F.floor(F.col("timestamp") / 10) == w).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    out = []
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = flow_deltas(stream, "1 hour").writeStream.foreachBatch(lambda df, _: out.extend(df.collect())).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    fields = ("protocol", "last", "new_flow", "fwd_packets", "bwd_packets", "fwd_bytes", "bwd_bytes")
    batch = P.flow_steps(table, 10.0, 30.0).collect()
    live = sorted((r.first, f"{r.src}>{r.dst}", *[r[f] for f in fields]) for r in out)
    assert live == sorted((r.start, f"{r.src_ip}:{r.src_port}>{r.dst_ip}:{r.dst_port}", *[r[f] for f in fields]) for r in batch)


def _question(*labels, tail=b"\x00\x00\x01\x00\x01"):
    return bytes(12) + b"".join(bytes([len(x)]) + x for x in labels) + tail


def test_question_names():
    cases = {
        _question(b"www", b"Example", b"org"): "www.example.org", _question(b"x"): "x", _question(): None, b"": None, bytes(12): None, _question(b"a" * 63): "a" * 63, bytes(12) + b"\x40" + b"a" * 64 + b"\x00": None,
        _question(b"cut", tail=b""): None, bytes(12) + b"\xc0\x0c\x00": None, _question("é".encode()): None, _question(b"a.b", b"c"): "a.b.c", bytes(12) + b"\x05abc": None, _question(*[b"l"] * 120): ".".join(["l"] * 120),
    }
    assert Y.question_names(pa.array(list(cases), pa.binary())).to_pylist() == list(cases.values())
    assert Y.question_names(pa.array([], pa.binary())).to_pylist() == []
    part = pa.array(list(cases), pa.binary()).slice(1, 2)
    assert Y.question_names(part).to_pylist() == list(cases.values())[1:3]


def test_payload_features(spark):
    get = lambda uri, verb=b"GET": verb + b" " + uri + b" HTTP/1.1\r\nA: b\r\n\r\n"
    rows = [
        ("a", 6, 9, 80, get(b"/aabb")), ("a", 6, 8080, 9, get(b"/a?b=\xff%41", b"POST")), ("a", 6, 9, 80, get(b"/x", b"BREW")), ("a", 6, 9, 81, get(b"/x")), ("a", 6, 9, 80, b"GET / H"), ("a", 6, 9, 80, b"HEAD          "),
        ("a", 17, 9, 53, _question(b"q", b"org")), ("a", 17, 53, 9, _question(b"Q", b"org")), ("a", 17, 9, 53, b"short"), ("a", 17, 9, 54, _question(b"z")), ("b", 1, None, None, None), ("b", 6, 9, 80, None),
    ]
    df = spark.createDataFrame([(0.5, *r[:-1], len(r[-1]) if r[-1] is not None else 0, r[-1]) for r in rows], "timestamp double, src_ip string, protocol int, src_port int, dst_port int, payload_length int, payload binary")
    got = {r.host: r for r in P.payload_features(df, 10).collect()}
    a = got["a"]
    assert (a.http_requests, a.dns_queries, a.dns_domains) == (3, 2, 1)
    # "/aabb" has 1.52 bits a character, "/a?b=%41" 3; one of five and four of eight are special.
    assert abs(a.http_uri_entropy_mean - (1.5219280948873621 + 3) / 2) < 1e-9 and abs(a.http_special_ratio - (1 / 5 + 4 / 8) / 2) < 1e-9
    assert tuple(got["b"])[2:] == (0, 0.0, 0.0, 0, 0, 0.0)


def test_session_ratios(spark):
    def p(k, a, b, flags, size=0):
        return (k, float(k), a, 1 if a == "a" else 2, b, 1 if b == "a" else 2, 6, flags, 10 + k, size)

    rows = [p(0, "a", "b", 2), p(1, "b", "a", 18), p(2, "a", "b", 16), p(3, "a", "c", 2), p(4, "c", "a", 4), p(5, "a", "c", 2), p(6, "a", "b", 10)]
    df = spark.createDataFrame(rows, "seq long, timestamp double, src_ip string, src_port int, dst_ip string, dst_port int, protocol int, tcp_flags int, tcp_seq long, payload_length int")
    got = {r.host: tuple(round(x, 3) for x in tuple(r)[2:]) for r in P.session_ratios(df, 100).collect()}
    # Of a's four SYNs three are bare; the session with c and the second one with b are unanswered.
    assert got == {"a": (0, 0.0, 0.429, 0.25, 0.5, 0.25, 0.25), "b": (0, 0.0, 0.25, 0.5, 0.5, 0.0, 0.5), "c": (0, 0.0, 0.667, 0.0, 0.5, 0.5, 0.0)}


def test_header_of_a_short_record():
    from tidewire.sources.capture import HEAD, Format

    assert Format.of(b"", "x") is None and Format.of(struct.pack("<I20x", 0xA1B2C3D4), "x").order == "<" and HEAD == 24
