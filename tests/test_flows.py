"""Streams, folds, samples and splits on small cases."""

import time

import pytest
from pyspark.sql import functions as F

from tidewire.functions import address
from tidewire.operators import forecast, graphs, metrics, splits, temporal
from tidewire.streaming.flow_table import flow_deltas, latest_per_kind

PACKET = "timestamp double, src_ip string, src_port int, dst_ip string, dst_port int, protocol int, packet_length int"


def test_flow_table_over_triggers(spark, tmp_path):
    batches = [[(1000.0, "b", 2, "a", 1, 6, 10), (1001.0, "a", 1, "b", 2, 6, 20)], [(1005.0, "b", 2, "a", 1, 6, 30), (1100.0, "a", 1, "b", 2, 6, 40)], [(1101.0, "c", None, "a", None, 1, 7)]]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, PACKET).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        time.sleep(1.1)
    stream = spark.readStream.schema(PACKET).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in").withColumn("ts", F.timestamp_seconds("timestamp"))
    query = flow_deltas(stream, "10 seconds").writeStream.format("memory").queryName("deltas").outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/cp").start()
    query.awaitTermination(120)
    got = sorted(map(tuple, spark.table("deltas").collect()), key=str)
    assert got == sorted([
        ("b:2", "a:1", 6, 1000.0, 1001.0, True, 1, 1, 10, 20), ("b:2", "a:1", 6, 1000.0, 1005.0, False, 1, 0, 30, 0), ("a:1", "b:2", 6, 1100.0, 1100.0, True, 1, 0, 40, 0), ("c:0", "a:0", 1, 1101.0, 1101.0, True, 1, 0, 7, 0),
    ], key=str)


def test_adaptive_intervals_fold_in_order(spark):
    rows = spark.createDataFrame([(k % 2, float(k), 0.0, (k % 7) / 10) for k in range(60)], "key int, t double, y double, p double")
    got = {(r.key, r.t): (r.alpha, r.width, r.covered) for r in metrics.adaptive_intervals(rows, "key", "t", 0.1).collect()}
    assert len(got) == 60
    import numpy as np

    for key in (0, 1):
        level, seen = 0.1, []
        for k in range(key, 60, 2):
            width = float(np.quantile(seen, 1 - level)) if seen else 1.0
            error = (k % 7) / 10
            assert got[(key, float(k))] == pytest.approx((level, width, error <= width))
            level = min(max(level + 0.01 * (0.1 - (error > width)), 0.001), 0.5)
            seen.append(error)
    assert metrics.adaptive_intervals(rows.limit(0), "key", "t", 0.1).count() == 0


def test_bootstrap_interval_holds_the_mean(spark):
    rows = spark.createDataFrame([(g, float(g % 5)) for g in range(50) for _ in range(3)], "g int, x double")
    r = metrics.group_bootstrap(rows, "g", "x", 200, 3).first()
    assert r.groups == 50 and r["mean"] == pytest.approx(2.0) and 1.4 < r.low < 2.0 < r.high < 2.6


def test_running_totals_equal_one_window(spark):
    rows = spark.createDataFrame([(k / 997, k) for k in range(998)], "p double, n long")
    got = metrics.running_totals(rows, "p", ["n"], descending=True).orderBy("p").collect()
    assert [r.upto_n for r in got] == [sum(range(k, 998)) for k in range(998)]


def test_numbered_and_merged(spark):
    df = spark.createDataFrame([(float(x), x) for x in (5, 1, 9, 3, 3)] + [(None, 0)], "t double, place int")
    out = temporal.numbered(df, F.floor(F.col("t") / 4).cast("int"), ["t"], "n")
    assert sorted((r.n, r.t if r.t is not None else -1) for r in out.collect()) == [(1, -1), (2, 1), (3, 3), (4, 3), (5, 5), (6, 9)]
    spans = spark.createDataFrame([("h", 0.0, 4.0, 1), ("h", 1.0, 2.0, 2), ("h", 5.0, 6.0, 3), ("h", 9.0, 9.5, 4)], "host string, start double, end double, id int")
    assert sorted((r.start, r.end, r.n) for r in temporal.merged_spans(spans, ["host"], "start", "end", "id", 1.0).collect()) == [(0.0, 6.0, 3), (9.0, 9.5, 1)]
    points = spark.createDataFrame([("h", 3.0), ("h", 7.0), ("h", 10.0), ("g", 1.0)], "host string, t double")
    got = {(r.host, r.t): r.wait for r in temporal.next_span(points, spans, ["host"], "t", "t").collect()}
    assert got == {("h", 3.0): 0.0, ("h", 7.0): 2.0, ("h", 10.0): None, ("g", 1.0): None}


def test_splits(spark):
    df = spark.createDataFrame([(g, g * 10 + k) for g in range(4) for k in range(3)], "g int, t int")
    assert {r.g: r.split for r in splits.chronological_groups(df, "g", "t").collect()} == dict(enumerate(splits.SPLITS))
    with pytest.raises(ValueError):
        splits.chronological_groups(df.where("g < 3"), "g", "t")
    rows = spark.createDataFrame([("a", k) for k in range(2)] + [("b", k) for k in range(5)] + [("c", k) for k in range(9)], "c string, id int")
    out = splits.to_median(rows, "c", F.col("id"), "id").groupBy("c", "id").count().collect()
    sizes = {c: [r["count"] for r in out if r.c == c] for c in "abc"}
    assert sorted(sizes["a"]) == [2, 3] and sizes["b"] == [1] * 5 and sizes["c"] == [1] * 5


def test_negative_is_never_the_edge_itself(spark):
    edges = spark.createDataFrame([(k, "x" if k < 8 else "y", f"t{k % 3}" if k < 8 else "only") for k in range(10)], "k long, capture string, dst string")
    got = graphs.negative_targets(edges, "capture", "dst", "k", 1).collect()
    assert len(got) == 8 and all(r.dst != r.negative and r.negative.startswith("t") for r in got)


def test_addresses(spark):
    df = spark.createDataFrame([("10.0.0.1",), ("256.1.1.1",), (None,), ("8.8.8.8",), ("224.0.0.1",)], "ip string")
    rows = df.withColumn("numbers", address.address_numbers(F.col("ip"))).select("ip", address.site(F.col("ip"), ("10.0.0.0/8",)).alias("s"), F.array(*address.address_features(F.col("numbers"))).alias("f")).collect()
    assert [r.s for r in rows] == ["internal", "unknown", "unknown", "external", "external"]
    assert [r.f[:7] for r in rows] == [[1, 1, 1, 0, 0, 0, 0], [0] * 7, [0] * 7, [1, 1, 0, 1, 0, 0, 0], [1, 1, 0, 1, 1, 0, 0]]
    assert [r.f[11] for r in rows] == [1.0] * 5


def test_forecast_samples_stay_inside_segments(spark):
    rows = [("h", s, float(k), k, k == 3, "Recon" if k == 3 else "Benign", 1.0) for s in (0, 1) for k in range(4)]
    df = spark.createDataFrame(rows, "host string, segment int, t double, id int, attack boolean, category string, value double")
    got = forecast.forecast_samples(df, ["host", "segment"], "t", "id", 2, 1, 2).collect()
    assert [(r.id, r.steps[0].attack, r.steps[0].categories) for r in got] == [(1, True, ["Recon"])] * 2
    assert forecast.forecast_samples(df, ["host", "segment"], "t", "id", 3, 1, 2).count() == 0


def test_latest_event_of_each_kind(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("b", 2, None)], "kind string, at int, body string")
    assert sorted(map(tuple, latest_per_kind(df, "kind", "at").collect())) == [("a", 3, "y"), ("b", 2, None)]


def test_ranged_places_and_slices(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    rows = [(k % 2, float(k * 37 % 101), k) for k in range(101)] + [(None, None, 200), (0, 5.0, 201), (0, 5.0, 202)]
    df = spark.createDataFrame(rows, "g int, t double, id int").repartition(5)
    key = lambda r: (r[1] is not None, r[1] or 0, r[2])
    assert [(r.t, r.id) for r in temporal.ranged(df, ["t", "id"], "n").orderBy("n").collect()] == [(t, i) for _, t, i in sorted(rows, key=key)]
    within = {(r.g, r.id): r.n for r in temporal.ranged_within(df, ["g"], ["t", "id"], "n").collect()}
    for g in (0, 1, None):
        assert [within[g, i] for _, _, i in sorted((r for r in rows if r[0] == g), key=key)] == list(range(1, 1 + sum(r[0] == g for r in rows)))
    import numpy as np

    cuts = {r.g: (r.a, r.b) for r in temporal.exact_quantiles(df, ["g"], "t", {"a": 0.7, "b": 0.25}).collect()}
    for g in (0, 1):
        assert cuts[g] == pytest.approx(tuple(np.quantile([t for x, t, _ in rows if x == g], q) for q in (0.7, 0.25)))
    full = df.where("t is not null")
    whole = {(r.g, r.id): r.segment for r in temporal.gap_segments(full, ["g"], "t", "id", 2.5).collect()}
    for width in (1.0, 7.0, 1000.0):
        assert {(r.g, r.id): r.segment for r in temporal.sliced_segments(full, ["g"], "t", "id", 2.5, width).collect()} == whole
    assert temporal.sliced_segments(full.limit(0), ["g"], "t", "id", 2.5, 7.0).count() == 0 and temporal.ranged(full.limit(0), ["t"], "n").count() == 0
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
