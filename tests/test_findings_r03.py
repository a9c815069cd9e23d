"""What the third review found: intervals that overlap, addresses beyond four bytes, windows that look ahead, labels and ties."""

import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tidewire.common import components
from tidewire.functions import address as A
from tidewire.functions import labels
from tidewire.operators import hosts, labelling, selection, temporal
from tidewire.plans.catalog import ORACLE, QUERIES
from tidewire.sources import flow_files, tables
from tidewire.streaming import topology

DATA = "/root/testdata/sf0.001"


def test_first_of_many_overlapping_intervals(spark):
    rng = random.Random(4)
    spans = [(k, float(a), float(a + rng.choice((0, 3, 40, 900)))) for k, a in enumerate(rng.randrange(1000) for _ in range(150))] + [(150, None, 9.0), (151, 50.0, None), (152, 700.0, 600.0), (153, 2050.0, 1e13)]  # the last touches more slices than an array holds
    points = [(k, float(rng.randrange(-50, 2100))) for k in range(400)] + [(400, None), (401, spans[0][1]), (402, spans[0][2])]
    want = {}
    for k, t in points:
        held = [(a, i) for i, a, b in spans if None not in (t, a, b) and a <= t <= b]
        want[k] = min(held)[1] if held else None
    df = spark.createDataFrame(points, "id int, t double").repartition(3)
    found = A.first_containing(df, spark.createDataFrame(spans, "span int, start double, end double"), "t", 60.0)
    assert {r.id: r.span for r in found.collect()} == want


@pytest.fixture(scope="module")
def large_keys(spark, tmp_path_factory):
    """The smallest tables with customers beyond 64,000, whose hosts' third numbers are no bytes."""
    folder = tmp_path_factory.mktemp("large-keys")
    for name in ("lineitem", "orders"):
        rows = spark.read.parquet(f"{DATA}/{name}.parquet")
        if name == "orders":
            rows = rows.withColumn("o_custkey", F.col("o_custkey") * 9001)
        rows.coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["f04_address_features", "p15_sites", "s16_site_of_flows"])
def test_hosts_of_large_keys(spark, large_keys, name):
    con = duckdb.connect()
    for t in ("lineitem", "orders"):
        con.execute(f"create view {t} as select * from '{large_keys}/{t}.parquet/*.parquet'")
    cur = con.execute(ORACLE[name])
    names = [x[0] for x in cur.description]
    got = QUERIES[name](spark, large_keys).select(*names).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, cur.fetchall()))


def test_numbers_beyond_bytes(spark):
    texts = ["10.1.2.3", "10.1.300.7", "1.2.3", "1.2.3.x", None, "::1"]
    df = spark.createDataFrame([(t,) for t in texts], "ip string")
    ip = F.col("ip")
    rows = df.select(A.ipv4_number(ip).alias("n"), A.ipv4_number(ip, "carry").alias("carry"), A.ipv4_number(ip, "clip").alias("clip"), A.dotted_cohesion(ip, F.lit("10.1.299.7")).alias("same")).collect()
    low = (10 << 24) + (1 << 16)
    assert [tuple(r) for r in rows] == [(low + 515, low + 515, low + 515, 0.5), (None, low + 300 * 256 + 7, low + 255 * 256 + 7, 0.5), *[(None, None, None, 0.0)] * 4]


def test_windows_ahead_do_not_grow_with_the_square(spark):
    """Spark computes a frame up to the end of its partition anew for each row; one from its begin it extends. Overlapping spans need no sort by one task a key."""
    df = spark.createDataFrame([(k, "c", float(k % 37), k % 5 == 0) for k in range(90)], "id int, c string, t double, attack boolean")
    spans = spark.createDataFrame([("c", 3.0, 9.0), ("c", 1.0, 4.0), ("c", 8.0, 8.5), ("c", 30.0, 31.0), ("c", None, 50.0)], "capture string, start double, end double")
    found = temporal.censored_hazard(df, "c", "c", "t", "id", F.col("attack"), spans, 10.0, 2.0, width=6.0)
    plan = found._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "unboundedfollowing" not in plan
    waits = temporal.next_span_sliced(df, spans.withColumnRenamed("capture", "c"), ["c"], "t", 6.0).select("t", "wait").distinct().collect()
    assert {r.t: r.wait for r in waits} == {float(t): float(max(0, 1 - t) if t <= 9 else max(0, 30 - t)) if t <= 31 else None for t in range(37)}


@pytest.mark.parametrize("name", ["p10_label_coverage", "j02_resolved_labels"])
def test_labels_are_resolved_once_each(spark, name):
    """The words of a label are looked for after labels are made distinct, so no scan's rows meet a regular expression."""
    plan = QUERIES[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString().split("\n")
    judged = [k for k, line in enumerate(plan) if "patator" in line]
    counted = [k for k, line in enumerate(plan) if "Aggregate" in line and "raw_label" in line]
    assert judged and max(judged) <= max(counted)


def test_a_label_is_made_plain_once(spark):
    df = spark.createDataFrame([("DoS  Hulk",), ("web attack – Brute Force",), (None,), ("mystery",), ("flow=Background",)], "l string")
    found = df.select(labels.guessed_label(F.col("l"), botnet=True).alias("x")).select("x.category", "x.techniques", "x.is_attack")
    assert found._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") <= 6  # two a label and field
    assert [tuple(r) for r in found.collect()] == [("Impact", ["T1498"], True), ("InitialAccess", ["T1110"], True), ("UNKNOWN", [], False), ("UNKNOWN", [], False), ("Benign", [], False)]


def test_lives_are_shuffled_twice(spark):
    rows = [("a", "b", 6, 80, 10, 5, 2, 1, float(t), k) for k, t in enumerate((0, 5, 5, 29, 31, 90, 90, 200))] + [("a", "a", 6, 80, 0, 0, 0, 0, 95.0, 9)]
    df = spark.createDataFrame(rows, "src_ip string, dst_ip string, protocol int, dst_port int, fwd_bytes long, bwd_bytes long, fwd_packets long, bwd_packets long, end_time double, seq long")
    found = topology.lives(df, 30.0, 20.0, "seq", 30.0)
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2
    got = sorted((r.kind, r.a, r.first, r.last, r.bytes_out, r.packets) for r in found.collect())
    assert got == [
        ("edge", "a", 0.0, 5.0, 30, 9), ("edge", "a", 29.0, 31.0, 20, 6), ("edge", "a", 90.0, 90.0, 20, 6), ("edge", "a", 200.0, 200.0, 10, 3),
        ("node", "a", 0.0, 31.0, 50, 15), ("node", "a", 90.0, 95.0, 20, 6), ("node", "a", 200.0, 200.0, 10, 3), ("node", "b", 0.0, 31.0, 25, 15), ("node", "b", 90.0, 90.0, 10, 6), ("node", "b", 200.0, 200.0, 5, 3),
    ]


def test_window_attributes_expand_nothing(spark):
    """Attributes of hosts against counting by hand, with loops and ends or ports that are null; no plan expands rows for distinct counts, or shuffles an end's flows."""
    rng = random.Random(9)
    some = lambda *xs: rng.choice(xs)
    rows = [(some("a", "b", "c", None), some("a", "b", "c", "d", None), some(22, 53, 80, None), some(6, 17, 1, None), float(k % 7), k % 7 + some(0.0, 2.5), k, 2 * k, k % 5, k % 3, k % 2) for k in range(200)]
    df = spark.createDataFrame(rows, "src_ip string, dst_ip string, dst_port int, protocol int, start_time double, end_time double, fwd_bytes long, bwd_bytes long, fwd_packets long, bwd_packets long, window long")
    found = hosts.window_attributes(df, 10.0)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan and plan.count("Exchange hashpartitioning") == 2
    own = {}
    for a, b, port, protocol, s, e, fb, bb, fp, bp, w in rows:
        for host, peer, sent, received, psent, preceived in [(a, b, fb, bb, fp, bp)] + ([(b, a, bb, fb, bp, fp)] if a is None or a != b else []):
            own.setdefault((host, w), []).append((peer, port, protocol, e - s, sent, received, psent, preceived))
    want = {}
    for key, x in own.items():
        total = lambda k: sum(r[k] for r in x)  # noqa: E731, B023
        log = lambda v, d: min(1.0, math.log1p(v) / d)
        peers, ports, n = len({r[0] for r in x} - {None}), len({r[1] for r in x} - {None}), len(x)
        want[key] = (log(n, 10), log(total(4), 20), log(total(5), 20), log(total(4) + total(5), 20), log(total(6), 10), log(total(7), 10), log(total(6) + total(7), 10), log(peers, 10), log(ports, math.log(65536)), sum(r[2] == 6 for r in x) / n, sum(r[2] == 17 for r in x) / n, min(1.0, total(3) / n / 300), min(1.0, peers / n))
    names = ("flows", "sent", "received", "bytes", "psent", "preceived", "packets", "peers", "ports", "tcp", "udp", "duration", "peer_share")
    got = {(r.host, r.window): tuple(r[c] for c in names) for r in found.collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_clock_repair_reads_a_time_once_and_broadcasts_days(spark):
    df = spark.createDataFrame([(f"f{k % 3}", float(k) * 600.0 + 1.2e9) for k in range(900)], "file string, t double").withColumn("t", F.col("t") + F.length(F.sha2("file", 256)) * 0)
    plan = flow_files.clock_repair(df, "t", "file")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("sha2(") == 1 and "strategy=broadcast" in plan


def test_labels_without_a_scope_are_not_shuffled(spark):
    """Scopes are broadcast, and flows whose label has neither pairs nor participants meet no other join."""
    flows = spark.createDataFrame([(1, "a", "b", "Recon"), (2, "a", "c", "Recon"), (3, "c", "d", "C2"), (4, "x", "y", "C2"), (5, "a", "b", "Benign"), (6, "a", "b", None)], "seq int, src_ip string, dst_ip string, label string")
    pairs, members = spark.createDataFrame([("Recon", "b", "a")], "label string, a string, b string"), spark.createDataFrame([("C2", "d"), ("Recon", "c")], "label string, ip string")
    found = labelling.flow_hits(flows, "label", pairs, members)
    assert {r.seq: r.hit for r in found.collect()} == {1: True, 2: False, 3: True, 4: False, 5: None, 6: None}
    assert "strategy=broadcast" in found._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["p07_clock_repair", "m23_link_scores", "a16_median_resample", "d03_carved_calibration"])
def test_targets_are_not_looked_up_where_none_is_needed(spark, name, monkeypatch):
    read = []
    table = tables.table
    monkeypatch.setattr(tables, "table", lambda s, d, n: read.append(n) or table(s, d, n))
    QUERIES[name](spark, DATA)
    assert set(read) == {"lineitem"}


def test_nodes_of_campaigns_are_made_once(spark):
    plan = QUERIES["g11_campaign_details"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "events.parquet" not in plan and "user_id" not in plan


def test_an_address_is_read_once(spark):
    plan = QUERIES["f04_ipv6_features"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("conv(") == 2  # the halves of one address


def test_exposure_of_flows_that_share_time_and_number(spark):
    rows = [("h", "p", 0, 9.0, 3, False), ("h", "p", 0, 8.0, 2, False), ("h", "p", 0, 7.0, 1, False), ("h", "p", 0, 7.0, 1, True)]
    schema = "src_ip string, dst_ip string, window long, start_time double, seq long, is_attack boolean"
    for given in (rows, rows[::-1]):
        total = hosts.exposure(spark.createDataFrame(given, schema).coalesce(1), 3).first()
        assert (total.windows, total.cut, total.hidden, total.blind) == (2, 2, 2, 0)


def test_neighbours_by_slices_of_time(spark):
    rng = random.Random(5)
    edges = [(k, rng.choice(("hub", "x", None)), f"p{k}", float(rng.randrange(400))) for k in range(500)] + [(500, "hub", "late", None), (501, "x", "late", None)]
    asked = [(q, rng.choice(("hub", "x", "none", None)), float(rng.randrange(-20, 700))) for q in range(60)] + [(60, "hub", None), (61, "x", 10_000.0)]
    want = []
    for q, node, cut in asked:
        before = sorted((t, k, p) for k, n, p, t in edges if None not in (n, t, cut) and n == node and t < cut)
        drawn = sorted((*before[(q * 2654435761 + g * 40503 + 7) % len(before)], g) for g in (1, 2, 3)) if before else []
        want += [(q, i + 1, p, t) for i, (t, _, p, _) in enumerate(drawn)]
    df = spark.createDataFrame(edges, "id long, n string, peer string, t double").repartition(3)
    queries = spark.createDataFrame(asked, "query long, node string, cut double").repartition(2)
    got = selection.uniform_neighbours(df, queries, "n", "peer", "t", "id", 3, 7, width=10.0)
    assert sorted(map(tuple, got.collect())) == want


def test_rounds_of_few_edges_have_few_tasks(spark, monkeypatch):
    rng = random.Random(6)
    edges = [(k, k + 1) for k in range(0, 300) if k % 50] + [(rng.randrange(1000, 1400), rng.randrange(1000, 1400)) for _ in range(250)] + [(7, 7), (None, 3), (4, None)]
    parent = {x: x for e in edges if None not in e for x in e}
    for _ in parent:
        for a, b in edges:
            if None not in (a, b):
                parent[a] = parent[b] = min(parent[a], parent[b])
    df = spark.createDataFrame(edges, "a long, b long")
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = components.connected_components(df)
        assert len(found.inputFiles()) <= components.FEW_FILES
        assert {tuple(r) for r in found.collect()} == set(parent.items())
        monkeypatch.setattr(components, "FEW_ROWS", 0)
        assert {tuple(r) for r in components.connected_components(df).collect()} == set(parent.items())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
