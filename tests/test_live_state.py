"""Stateful operators over triggers: topology, correlation, the event board."""

import random

import pytest
from pyspark.sql import functions as F

from tidewire.streaming import board, correlation, topology

FLOW = "id long, src_ip string, dst_ip string, protocol int, dst_port int, end_time double, fwd_bytes long, bwd_bytes long, fwd_packets long, bwd_packets long"


def _run(query_of, table, triggers, path, ts):
    """The rows that a stream gives of ``table``, whose rows arrive in so many triggers in order of ``ts``."""
    spark = table.sparkSession
    rows = table.orderBy(ts).collect()
    size = -(-len(rows) // triggers)
    for k in range(0, len(rows), size):
        spark.createDataFrame(rows[k : k + size], table.schema).coalesce(1).write.mode("append").parquet(f"{path}/in")
    out = []
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    result = query_of(stream)
    query = result.writeStream.foreachBatch(lambda df, _: out.extend(df.collect())).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.createDataFrame(out, result.schema) if out else spark.createDataFrame([], result.schema)


def _flows(spark, n=160):
    rng, t, rows = random.Random(4), 1000.0, []
    for k in range(n):
        t += rng.choice((0.0, 1.0, 5.0, 20.0)) if k % 20 else 130.0
        a, b = rng.sample(["h1", "h2", "h3", "h4", "h5"], 2) if k % 3 else ("h1", "h2")
        rows.append((k, a, b, 6, rng.choice((80, 443)), t, rng.choice((0, 10)), 5 * (k % 2), k % 4, 0))
    rows += [(n, "h1", "h1", 17, 9, t, 1, 2, 3, 4), (n + 1, None, "h2", 6, 1, t, 1, 1, 1, 1)]
    return spark.createDataFrame(rows, FLOW).withColumn("ts", F.timestamp_seconds("end_time"))


def _touched(rows):
    """Brute force: (key, t, bytes in, bytes out, packets) of each touch."""
    for r in rows:
        if r.src_ip is None:
            continue
        p = r.fwd_packets + r.bwd_packets
        yield ("node", r.src_ip, "", 0, 0), r.end_time, r.bwd_bytes, r.fwd_bytes, p
        yield ("node", r.dst_ip, "", 0, 0), r.end_time, r.fwd_bytes, r.bwd_bytes, p
        if p or r.fwd_bytes + r.bwd_bytes:
            yield ("edge", r.src_ip, r.dst_ip, r.protocol, r.dst_port), r.end_time, r.bwd_bytes, r.fwd_bytes, p


@pytest.mark.parametrize("triggers", [9, 1])
def test_topology_appears_goes_stale_and_leaves(spark, tmp_path, triggers):
    flows, ttl = _flows(spark), {"node": 40.0, "edge": 20.0}
    changes = _run(lambda s: topology.live_topology(s, "ts", "0 seconds", 40.0, 20.0), flows, triggers, tmp_path, "end_time").cache()
    rows = flows.collect()
    end = max(r.end_time for r in rows)
    assert {r.event for r in changes.select("event").distinct().collect()} == {"appears", "stale", "fresh", "gone"}
    for now in [1000.0, *random.Random(1).sample([r.end_time for r in rows], 5), end - 21.5]:
        last = {}
        for key, t, *_ in _touched(rows):
            if t <= now:
                last[key] = max(t, last.get(key, t))
        want = {(key, now - t > 0.75 * ttl[key[0]]) for key, t in last.items() if now - t <= ttl[key[0]]}
        got = topology.alive(changes, now).collect()
        # After the end of the stream, timers later than the watermark have not fired.
        assert {(tuple(r)[:5], r.stale) for r in got} == want


def test_lives_equal_the_stream(spark, tmp_path):
    flows = _flows(spark)
    lives = topology.lives(flows.repartition(3), 40.0, 20.0, "id", 15.0).collect()
    want = {}
    for key, t, *sums in sorted(_touched(flows.collect()), key=lambda x: x[1]):
        mine = want.setdefault(key, [])
        if not mine or t - mine[-1][1] > (40.0 if key[0] == "node" else 20.0):
            mine.append([t, t, 0, 0, 0])
        mine[-1][1] = t
        mine[-1][2:] = [x + y for x, y in zip(mine[-1][2:], sums, strict=True)]
    assert sorted((tuple(r)[:5], r.first, r.last, r.bytes_in, r.bytes_out, r.packets) for r in lives) == sorted((k, *x) for k, v in want.items() for x in v)
    changes = _run(lambda s: topology.live_topology(s, "ts", "0 seconds", 40.0, 20.0), flows, 6, tmp_path, "end_time")
    gone = changes.where("event = 'gone'").collect()
    over = {(tuple(r)[:5], r.first, r.last, r.gone_after, r.bytes_in, r.bytes_out, r.packets) for r in lives}
    assert gone and {(tuple(r)[:5], r.first, r.last, r.at, r.bytes_in, r.bytes_out, r.packets) for r in gone} <= over
    with pytest.raises(ValueError):
        topology.lives(flows, 20.0, 40.0, "id", 15.0)


def _alerts(spark):
    rng, rows, names = random.Random(2), [], ["Benign", "Recon", "InitialAccess", "C2", "Impact"]
    for h in ("x", "y"):
        t = 500.0
        for k in range(60):
            t += rng.choice((1.0, 10.0, 60.0, 250.0))
            rows.append((h, f"{h}{k}", t, rng.choice(names), False, t))
            if k % 4 == 0:
                rows += [(h, f"{h}{k}f{j}", t + 30 * j, rng.choice(names), True, t) for j in (1, 2, 3)]
    return spark.createDataFrame(rows, "host string, id string, t double, category string, forecast boolean, issued double").withColumn("ts", F.timestamp_seconds("issued"))


@pytest.mark.parametrize("triggers", [1, 11])
def test_correlation_gives_each_pair_once(spark, tmp_path, triggers):
    alerts = _alerts(spark)
    again = alerts.union(alerts.where("id in ('x7', 'y9')"))  # delivered twice
    got = [tuple(r) for r in _run(lambda s: correlation.live_correlation(s, "ts", "0 seconds", 180.0, 0.2), again, triggers, tmp_path, "issued").collect()]
    pairs = [(h, u, v) for h, kind, u, v, *_ in got if kind == "pair"]
    assert len(pairs) == len(set(pairs)) > 50 and len(got) == len(set(got))
    want = {tuple(r) for r in correlation.correlated(alerts, 180.0, 0.2).collect()}
    plain = lambda rows: {(*r[:4], r[4] and round(r[4], 9), r[5]) for r in rows}
    assert plain(got) == plain(want)
    kinds = {(r[1], r[5]) for r in got}
    assert kinds == {("pair", False), ("pair", True), ("superseded", True)}


def test_forecast_is_replaced(spark):
    rows = [("h", "a", 0.0, "Recon", False, 0.0), ("h", "f", 60.0, "Impact", True, 0.0), ("h", "b", 30.0, "Benign", False, 30.0), ("h", "g", 90.0, "Impact", True, 30.0), ("h", "late", 300.0, "Impact", False, 300.0)]
    df = spark.createDataFrame(rows, "host string, id string, t double, category string, forecast boolean, issued double")
    got = {(r.kind, r.u, r.v) for r in correlation.correlated(df, 180.0, 0.0).collect()}
    assert got == {("pair", "a", "f"), ("pair", "a", "g"), ("superseded", "f", None), ("superseded", "g", None)}
    assert correlation.correlated(df.limit(0), 180.0, 0.0).count() == 0


def test_board_is_replayed_to_late_joiners(spark, tmp_path):
    rows = [(k, f"kind{k % 7}" if k % 50 else "rare", float(k // 3), f"body {k}") for k in range(1000)]
    events = spark.createDataFrame(rows, "id long, kind string, t double, body string")
    for part in range(5):
        events.where(F.floor(F.col("id") / 200) == part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    order = ["t", "id"]
    nothing = board.joined(spark, f"{tmp_path}/board", "kind", order, events.schema)
    assert nothing[0].count() == nothing[1].count() == 0
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    board.board(stream, "kind", order, f"{tmp_path}/board", f"{tmp_path}/state").awaitTermination()
    replayed, latest = board.joined(spark, f"{tmp_path}/board", "kind", order, events.schema)
    assert [r.id for r in replayed.collect()] == list(range(700, 1000))
    assert {r.kind: r.id for r in latest.collect()} == {**{f"kind{k % 7}": k for k in range(1000) if k % 50}, "rare": 950}
    board.post(events.where("id >= 800"), "kind", order, f"{tmp_path}/board", 4)  # the last micro-batch once more
    assert [r.id for r in board.joined(spark, f"{tmp_path}/board", "kind", order, events.schema)[0].collect()] == list(range(700, 1000))
