"""Capture stores and live operators on small cases."""

import time

import pytest
from pyspark.sql import functions as F

from tidewire.functions import address
from tidewire.operators import labelling, selection
from tidewire.sources import stores
from tidewire.streaming import live


def _flows(spark, n=20):
    return spark.createDataFrame([("d" + str(k % 2), f"c{k % 3}", float(-k), k, f"10.0.0.{k}") for k in range(n)], "dataset string, capture string, start_time double, seq int, src_ip string")


def test_columns_and_discovery(spark, tmp_path):
    root = f"file://{tmp_path}/cache"
    assert not stores.is_complete(spark, root)
    stores.write_columns(_flows(spark), root)
    assert stores.is_complete(spark, root)
    back = spark.read.parquet(root)
    assert sorted(map(tuple, back.select("dataset", "capture", "start_time", "seq", "src_ip").collect())) == sorted(map(tuple, _flows(spark).collect()))
    found = stores.discovered(spark, root, r"dataset=([^/]+)/capture=([^/]+)/[^/]+\.parquet$", ("d0",)).collect()
    assert {(r.dataset, r.capture) for r in found} == {(f"d{a}", f"c{b}") for a in range(2) for b in range(3)} and all(r.bytes > 0 for r in found)
    with pytest.raises(FileNotFoundError, match="d9"):
        stores.discovered(spark, root, r"dataset=([^/]+)/capture=([^/]+)/[^/]+\.parquet$", ("d0", "d9"))


def test_content_addressed_cache(spark, tmp_path):
    inputs = spark.createDataFrame([("a", 1, 5), ("b", 2, 6)], "path string, length long, modificationTime long")
    changed = spark.createDataFrame([("a", 1, 5), ("b", 2, 7)], "path string, length long, modificationTime long")
    root = f"file://{tmp_path}/parts"
    one = stores.cached(_flows(spark), root, inputs, width=2)
    again = stores.cached(_flows(spark, 5), root, inputs, width=2)
    assert one.count() == again.count() == 20
    assert stores.cached(_flows(spark, 5), root, inputs, width=3).count() == 5 and stores.cached(_flows(spark, 6), root, changed, width=2).count() == 6


def test_parts_follow_each_other(spark, tmp_path):
    path = f"file://{tmp_path}/trajectory"
    rows = lambda n: spark.range(n).select(F.col("id").alias("window"), F.lit("h").alias("host"))
    stores.append_part(rows(3), path, "b", "window")
    stores.append_part(rows(9), path, "a", "window")
    stores.append_part(rows(4), path, "a", "window")
    got = sorted((r.part, r.window) for r in stores.merged_parts(spark, path, "window").collect())
    assert got == [("a", k) for k in range(4)] + [("b", 4 + k) for k in range(3)]


def test_json_lines_out_and_in(spark, tmp_path):
    spark.range(5).selectExpr("id", "'x' as name").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("id long, name string").parquet(f"{tmp_path}/in")
    stores.json_sink(stream, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination(60)
    (tmp_path / "out" / "bad.txt").write_text("not json\n\n[1]\n")
    tail = stores.json_tail(spark, f"{tmp_path}/out", "id long, name string")
    query = tail.writeStream.format("memory").queryName("tail").outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/cp2").start()
    query.awaitTermination(60)
    assert {(r.id, r.name) for r in spark.table("tail").collect() if r.id is not None} == {(k, "x") for k in range(5)}


def test_state_endpoints_and_ports(spark):
    rows = stores.state_endpoints(spark.createDataFrame([("s1", "IRC bot"), ("s1", "x"), ("s2", "HTTPS")], "scenario string, family string"), "scenario").withColumn("port", stores.port_of_family(F.col("family"))).collect()
    assert rows[0].src_ip == rows[1].src_ip != rows[2].src_ip and [r.port for r in rows] == [6667, 80, 443]


def test_edges_and_observed_alerts_over_triggers(spark, tmp_path):
    batches = [[("a", 0.0, "Recon", 0.2), ("a", 50.0, "Benign", 0.9)], [("a", 170.0, "C2", 0.5), ("b", 5.0, "Recon", 0.1)], [("a", 240.0, "C2", 0.4)]]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, "host string, t double, category string, risk double").coalesce(1).write.mode("append").parquet(f"{tmp_path}/alerts")
        time.sleep(1.1)
    stream = spark.readStream.schema("host string, t double, category string, risk double").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/alerts")
    seen = []
    live.observed_alerts(stream, 180).writeStream.outputMode("update").foreachBatch(lambda df, i: seen.extend(map(tuple, df.collect()))).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination(90)
    assert sorted(seen) == [("a", 50.0, 1, 0.2, "Recon"), ("a", 170.0, 2, 0.5, "Recon,C2"), ("a", 240.0, 2, 0.5, "C2"), ("b", 5.0, 1, 0.1, "Recon")]
    counts = []
    live.replay(spark, f"{tmp_path}/alerts", "host string, t double, category string, risk double", lambda df, i: counts.append(df.count()), f"{tmp_path}/cp3").awaitTermination(60)
    assert sorted(counts) == [1, 2, 2]


def test_late_rows_are_left_out(spark, tmp_path):
    """A row behind the watermark of an earlier trigger is left out; one inside it that was seen before is no new edge."""
    day = lambda m: f"2024-01-01 00:{m:02d}:00"
    for rows in ([(day(0), "a", "b"), (day(30), "a", "b")], [(day(59), "a", "c")], [(day(1), "late", "x"), (day(58), "a", "b")]):
        df = spark.createDataFrame(rows, "ts string, src_ip string, dst_ip string").withColumn("ts", F.col("ts").cast("timestamp"))
        df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/flows")
        time.sleep(1.1)
    stream = spark.readStream.schema("ts timestamp, src_ip string, dst_ip string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/flows")
    query = live.first_seen_edges(stream, "ts", "10 minutes").writeStream.format("memory").queryName("edges").outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/cp").start()
    query.awaitTermination(90)
    assert {(r.src_ip, r.dst_ip) for r in spark.table("edges").collect()} == {("a", "b"), ("a", "c")}
    batch = live.first_seen_edges(spark.read.parquet(f"{tmp_path}/flows"), "ts").collect()
    assert len(batch) == 3


def test_guards_of_splits_profiles_and_masks(spark):
    lock = spark.createDataFrame([("d0", "c0", "train")], "dataset string, capture string, split string")
    with pytest.raises(Exception, match="not in the frozen split: d1/c"):
        selection.locked_split(_flows(spark), lock, ["dataset", "capture"]).collect()
    with pytest.raises(ValueError, match="no scheme"):
        selection.scheme_split(F.lit("d"), F.lit("train"), "other")
    with pytest.raises(ValueError, match="held out twice"):
        selection.held_out(lock, "capture", ["a"], ["a"], [])
    with pytest.raises(ValueError, match="unknown settings"):
        address.site_profile({"insid": []})
    with pytest.raises(ValueError, match="unknown features"):
        labelling.masked(F.array(), ["a"], ["b"])
    one = spark.createDataFrame([("g", "train", 1.0)], "group string, split string, t double")
    assert [r.split for r in selection.carved_calibration(one, "group", "t").collect()] == ["train"]
    values = spark.createDataFrame([(None,), (float("nan"),), (float("inf"),), (-1.0,), (127.5,), (999.0,)], "x double").select(labelling.normal_packet_feature("ttl_mean", F.col("x")).alias("x")).collect()
    assert [r.x for r in values] == [0.0, 0.0, 0.0, 0.0, 0.5, 1.0]


def test_scratch_is_freed(spark, tmp_path):
    import os

    from tidewire.common import components, store

    root = store.shared_root(spark).removeprefix("file://") + "/tidewire"
    there = lambda: set(os.listdir(root)) if os.path.isdir(root) else set()
    before = there()
    with store.scope(spark) as outer:
        first = store.written(spark.range(5), "first")
        with store.scope(spark) as inner:
            second = store.written(first.where("id > 1"), "second")
            store.written(spark.range(3), "third")
            inner.keep(second)
        assert len(there() - before) == 2 and second.count() == 3
        with pytest.raises(ValueError):
            outer.keep(spark.range(1))
        outer.keep(second)
    left = there() - before
    assert len(left) == 1 and second.count() == 3
    edges = spark.createDataFrame([(k, k + 1) for k in range(20)] + [(50, 51)], "a long, b long")
    labels = components.connected_components(edges)
    assert len(there() - before - left) == 1 and {r.component for r in labels.collect()} == {0, 50}
    with pytest.raises(ZeroDivisionError), store.scope(spark):
        store.written(spark.range(2), "lost")
        raise ZeroDivisionError
    assert len(there() - before - left) == 1
