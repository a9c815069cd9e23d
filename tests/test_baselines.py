"""Linear baselines against direct computation, trajectories, unified reads."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewire.operators import linear, trajectories
from tidewire.sources import capture, datasets

_HOST = "host string, t double, id int, a double, b double, y int"


def _rows(n=400):
    rng = np.random.default_rng(3)
    out = []
    for k in range(n):
        a, b = rng.normal(1e6, 2.0), rng.normal(0, 3.0)  # a mean that sums of squares would drown in
        y = None if k % 7 == 0 else int(rng.random() < 1 / (1 + np.exp(-(0.8 * (a - 1e6) - 0.5 * b))))
        out.append((f"h{k % 5}", float(k // 5), k, float(a), float(b), y))
    return out


def _flat(rows, steps):
    out = {}
    for host in {r[0] for r in rows}:
        mine = sorted(r for r in rows if r[0] == host)
        for k, r in enumerate(mine):
            past = mine[max(0, k - steps + 1) : k + 1]
            lack = steps - len(past)
            ages = [-np.log1p(r[1] - p[1]) for p in past]
            out[r[2]] = [0.0] * (2 * lack) + [x for p in past for x in p[3:5]] + [ages[0]] * lack + ages
    return np.array([out[r[2]] for r in rows])


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(_rows(), _HOST).repartition(7)


def test_moments_equal_a_direct_computation(spark, table):
    x = _flat(_rows(), 3)
    n, mean, m2 = linear.moments(linear.flattened(table, ["host"], "t", "id", ["a", "b"], 3))
    assert n == len(x)
    np.testing.assert_allclose(mean, x.mean(axis=0), rtol=1e-12)
    np.testing.assert_allclose(m2, ((x - x.mean(axis=0)) ** 2).sum(axis=0), rtol=1e-9, atol=1e-9)
    assert linear.moments(table.limit(0).select(F.array("a").alias("features")))[0] == 0.0


def test_logistic_equals_a_small_solve(spark, table):
    rows = _rows()
    model = linear.fit_logistic(linear.flattened(table, ["host"], "t", "id", ["a", "b"], 1), "y", ridge=1e-3)
    x = np.array([[r[3], r[4], 0.0] for r in rows])
    z = np.hstack([(x - x.mean(axis=0)) / np.sqrt(np.maximum(x.var(axis=0), linear.FLAT)), np.ones((len(x), 1))])
    known = [k for k, r in enumerate(rows) if r[5] is not None]
    z, y, w = z[known], np.array([rows[k][5] for k in known], dtype=float), np.zeros(4)
    for _ in range(200_000):  # plain descent to the optimum
        slope = z.T @ (1 / (1 + np.exp(-z @ w)) - y) / len(y) + np.array([1e-3, 1e-3, 1e-3, 0]) * w
        if np.abs(slope).max() < 1e-9:
            break
        w -= slope
    np.testing.assert_allclose(model.weights, w, atol=1e-6)
    got = {r.id: r.p for r in linear.flattened(table, ["host"], "t", "id", ["a", "b"], 1).select("id", model.probability(F.col("features")).alias("p")).collect()}
    np.testing.assert_allclose([got[rows[k][2]] for k in known], 1 / (1 + np.exp(-z @ model.weights)), rtol=1e-6)
    again = linear.fit_logistic(linear.flattened(table.repartition(2), ["host"], "t", "id", ["a", "b"], 1), "y", ridge=1e-3)
    np.testing.assert_allclose(model.weights, again.weights, atol=1e-9)
    assert 1 < model.rounds < 25 and linear.fit_logistic(table.where("y is null").select(F.array("a").alias("features"), "y"), "y").rounds == 0


def test_separable_labels_do_not_diverge(spark):
    df = spark.createDataFrame([([float(k)], int(k > 3)) for k in range(8)], "features array<double>, y int")
    model = linear.fit_logistic(df, "y", ridge=1e-2)
    assert np.isfinite(model.weights).all() and [r.p > 0.5 for r in df.orderBy("features").select(model.probability(F.col("features")).alias("p")).collect()] == [False] * 4 + [True] * 4


def test_linear_equals_least_squares(spark, table):
    rows = _rows()
    model = linear.fit_linear(table.select(F.array("a", "b").alias("features"), (2 * F.col("b") - F.col("a") + F.when(F.col("id") % 2 == 0, 1.0).otherwise(-1.0)).alias("y")), "y")
    x = np.array([[r[3], r[4]] for r in rows])
    y = np.array([2 * r[4] - r[3] + (1 if r[2] % 2 == 0 else -1) for r in rows])
    z = np.hstack([(x - x.mean(axis=0)) / x.std(axis=0), np.ones((len(x), 1))])
    np.testing.assert_allclose(model.weights, np.linalg.lstsq(z, y, rcond=None)[0], rtol=1e-7, atol=1e-6)
    with pytest.raises(ValueError):
        linear.fit_linear(table.select(F.array_repeat("a", linear.MOST + 1).alias("features"), "y"), "y")


def test_trajectories(spark):
    observed = spark.createDataFrame([("x", 1, 10.0, "Recon", "T1", 0.2), ("x", 2, 12.0, "C2", None, 0.3), ("y", 5, 1.0, "Benign", None, 0.0)], "host string, window int, t double, category string, technique string, risk double")
    scored = spark.createDataFrame([("x", "T9", 0.6, 0.7, [("Impact", "T2", 0.5, 0.5), ("Impact", None, None, 0.2)])], "host string, technique string, confidence double, risk double, steps array<struct<category: string, technique: string, confidence: double, risk: double>>")
    got = [tuple(r) for r in trajectories.assembled(observed, scored, 30.0).orderBy("host", "window").collect()]
    assert [r[:8] for r in got] == [
        ("x", 1, 10.0, "OBSERVED", "Recon", "T1", 0.95, 0.2), ("x", 2, 12.0, "OBSERVED", "C2", "T9", 0.6, 0.7), ("x", 3, 42.0, "FORECAST", "Impact", "T2", 0.5, 0.5), ("x", 4, 72.0, "FORECAST", "Impact", "", 0.0, 0.2),
        ("y", 5, 1.0, "OBSERVED", "Benign", "Benign", 0.95, 0.0),
    ]
    assert [r[8] for r in got] == pytest.approx([0.6] * 4 + [0.0])
    assert {r.forecast_risk for r in trajectories.assembled(observed, scored, 30.0, "hazard").collect()} == {0.5, 0.0}
    with pytest.raises(ValueError):
        trajectories.assembled(observed, scored, 30.0, "peak")


def test_unified_read(spark, tmp_path):
    (tmp_path / "a.csv").write_text("StartTime,Dur,Proto,SrcAddr,Sport,DstAddr,Dport,TotPkts,TotBytes,SrcBytes,Label\n" + "".join(f"2011/08/10 09:46:53.047277,1.5,tcp,1.1.1.{k},5,2.2.2.2,80,4,400,100,{label}\n" for k, label in enumerate(("flow=From-Botnet-V42-TCP", "mystery", "flow=From-Normal-V42", "mystery"))))
    rows, coverage = datasets.read_flows(spark, "botnet", str(tmp_path / "a.csv"))
    assert rows.columns == list(datasets.FLOW) and rows.count() == 2
    assert tuple(coverage.first()) == ("botnet", 4, 2, 0.5, 1)
    record = datasets.as_records(rows).where("src_ip = '1.1.1.0'").first()
    assert (record.duration, record.total_bytes, record.byte_rate) == (1.5, 400, pytest.approx(400 / 1.5))
    with pytest.raises(ValueError):
        datasets.read_flows(spark, "other", "x")
    # A capture: one flow in a window of an attack, one in a later window.
    frame = bytes(12) + b"\x08\x00\x45" + bytes(7) + b"\x40\x11" + bytes(2) + bytes([10, 0, 0, 1, 10, 0, 0, 2]) + struct.pack("!HHHH", 53, 9999, 12, 0) + b"abcd"
    record = lambda t: struct.pack("<IIII", t, 0, len(frame), len(frame)) + frame
    (tmp_path / "x.pcap").write_bytes(struct.pack("<IHHiIII", capture.MICRO, 2, 4, 0, 0, 65535, 1) + record(100) + record(101) + record(200))
    spans = spark.createDataFrame([("scan", 90.0, 120.0, "Recon", ["T1046"]), ("later", 95.0, 300.0, "C2", ["T1071"])], "name string, start double, end double, category string, techniques array<string>")
    found, coverage = datasets.read_flows(spark, "capture", str(tmp_path / "x.pcap"), intervals=spans.where("name = 'scan'"))
    assert sorted((r.start_time, r.raw_label, r.coarse_category, r.attck_technique_ids, r.is_attack, r.fwd_packets) for r in found.collect()) == [(100.0, "scan", "Recon", ["T1046"], True, 2), (200.0, "Benign", "Benign", [], False, 1)]
    both = datasets.read_flows(spark, "capture", str(tmp_path / "x.pcap"), intervals=spans)[0]
    assert sorted(r.coarse_category for r in both.collect()) == ["C2", "Recon"]
    assert datasets.read_flows(spark, "capture", str(tmp_path / "x.pcap"))[0].count() == 2
