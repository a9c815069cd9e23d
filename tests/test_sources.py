"""File sources and packet operators on small cases."""

import struct

import pytest

from tidewire.functions import labels
from tidewire.operators import packets
from tidewire.sources import capture, flow_files


def test_capture_keeps_the_valid_prefix(spark, tmp_path):
    capture.register(spark)
    frame = bytes(12) + b"\x08\x00\x45" + bytes(7) + b"\x40\x11" + bytes(2) + bytes([10, 0, 0, 1, 10, 0, 0, 2]) + struct.pack("!HHHH", 53, 9999, 12, 0) + b"abcd"
    head = struct.pack(">IHHiIII", capture.NANO, 2, 4, 0, 0, 65535, 1)
    record = struct.pack(">IIII", 5, 500_000_000, len(frame), len(frame)) + frame
    other = bytes(12) + b"\x08\x06" + bytes(40)
    arp = struct.pack(">IIII", 6, 0, len(other), len(other)) + other
    six = bytes(12) + b"\x86\xdd\x60" + bytes(5) + b"\x3a\x07" + bytes(15) + b"\x01" + bytes(15) + b"\x02"
    v6 = struct.pack(">IIII", 7, 0, len(six), len(six)) + six
    (tmp_path / "UCAP10.1.2.3.pcap").write_bytes(head + record + arp + v6 + struct.pack(">IIII", 8, 0, 0, 0) + record)
    (tmp_path / "cut.pcap").write_bytes(head + record + record[:30])
    (tmp_path / "empty.pcap").write_bytes(b"")
    (tmp_path / "shortcut.lnk").write_bytes(b"junk")
    rows = spark.read.format("capture").load(str(tmp_path)).orderBy("capture", "timestamp").collect()
    assert [(r.timestamp, r.src_ip, r.dst_ip, r.src_port, r.dst_port, r.ttl, r.payload_length) for r in rows] == [
        (5.5, "10.0.0.1", "10.0.0.2", 53, 9999, 64, 4), (7.0, "::1", "::2", None, None, 7, 0), (5.5, "10.0.0.1", "10.0.0.2", 53, 9999, 64, 4),
    ]
    assert capture.capture_host("UCAP10.1.2.3.pcap") == "10.1.2.3"
    bad = tmp_path / "bad"
    bad.mkdir()
    (bad / "x.pcap").write_bytes(bytes(64))
    with pytest.raises(Exception, match="not a capture"):
        spark.read.format("capture").load(str(bad)).collect()


def test_sessions(spark):
    def p(k, a, b, flags, seq=0, size=0):
        return (k, float(k), a, 1 if a == "a" else 2, b, 1 if b == "a" else 2, 6, flags, seq, size)

    rows = [p(0, "a", "b", 2, 10), p(1, "b", "a", 18, 50), p(2, "a", "b", 16, 11), p(3, "a", "b", 24, 11, 5), p(4, "a", "b", 24, 11, 5), p(5, "a", "c", 2, 7, 3), p(6, "c", "a", 4), p(7, "c", "a", 20)]
    df = spark.createDataFrame(rows, "seq long, timestamp double, src_ip string, src_port int, dst_ip string, dst_port int, protocol int, tcp_flags int, tcp_seq long, payload_length int")
    got = {r.pair: [r[c] for c in ("tcp", "retransmitted", "syn", "syn_ack", "rst_after_syn", "attempts", "completed")] for r in packets.sessions(df, 100).collect()}
    # A SYN with a payload counts as retransmitted; a RST with ACK answers nothing.
    assert got == {"a:1|b:2": [5, 1, 1, 1, 0, 1, 1], "a:1|c:2": [3, 1, 1, 0, 1, 1, 0]}
    assert packets.sessions(df.limit(0), 100).count() == 0
    assert packets.flow_features(df.withColumn("packet_length", df.tcp_flags).limit(0), 100).count() == 0


def test_ssh_lines(spark):
    lines = ["Jan  5 03:04:05 h sshd[1]: Failed password for invalid user bob from 10.0.0.9 port 2", "Feb 10 13:04:05 h sshd[1]: Accepted password for al from 10.0.0.8 port 2", "Mar 1 00:00:00 h cron[1]: nothing", "", None]
    got = [(r.account, r.source, r.failed, r.t) for r in flow_files.ssh_logins(spark.createDataFrame([(x,) for x in lines], "value string"), "h", 2024).collect()]
    assert got == [("bob", "10.0.0.9", True, 1704423845.0), ("al", "10.0.0.8", False, 1707570245.0)]


def test_participants(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"mon": {"DoS": {"attackers": ["1.1.1.1"], "victims": ["2.2.2.2", "3.3.3.3"]}}, "tue": {}}')
    assert {tuple(r) for r in flow_files.participants(spark, str(tmp_path / "p.json")).collect()} == {("mon", "DoS", "attackers", "1.1.1.1"), ("mon", "DoS", "victims", "2.2.2.2"), ("mon", "DoS", "victims", "3.3.3.3")}


def test_labels_of_nothing(spark):
    df = spark.createDataFrame([(None,), ("",), ("T1046",), ("C2.T1071",), ("Benign.None",), ("odd.None",)], "x string")
    got = df.select(labels.guessed_label(df.x)["category"].alias("c"), labels.lane(df.x).alias("lane")).collect()
    assert [tuple(r) for r in got] == [("UNKNOWN", "Benign"), ("UNKNOWN", "Benign"), ("UNKNOWN", "Recon"), ("UNKNOWN", "C2"), ("Benign", "Benign"), ("UNKNOWN", "Benign")]


def test_bad_lines_of_json_are_left_out(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"a": 1}\nnot json\n{"a": 2}\n')
    assert sorted(r.a for r in flow_files.json_lines(spark, str(tmp_path / "a.json"), "a int").collect()) == [1, 2]
