"""Reports on small cases."""

import pytest
from pyspark.sql import functions as F

from tidewire.operators import alerts, forecast, hosts, reports


def test_details_of_a_detection(spark):
    rows = spark.createDataFrame([(1, 0.9), (0, 0.8), (0, 0.1), (0, 0.2)], "y int, p double")
    r = reports.detection_details(rows, hours=2.0).first()
    assert (r.accuracy, r.base_rate, r.fpr, r.false_alarms_per_hour, r.pr_auc_lift) == (0.75, 0.25, pytest.approx(1 / 3), 0.5, None)
    assert r.balanced_accuracy == pytest.approx((1 + 2 / 3) / 2)
    one = reports.detection_details(spark.createDataFrame([(1, 0.9)] * 30, "y int, p double")).first()
    assert (one.balanced_accuracy, one.false_alarms_per_hour) == (1.0, None) and one.pr_auc_lift == pytest.approx(0.0)
    assert reports.detection_details(rows.limit(0)).first().n == 0


def test_operating_points(spark):
    rows = spark.createDataFrame([(1, 0.95), (1, 0.6), (0, 0.6), (0, 0.55), (0, 0.3), (1, 0.1)] + [(0, 0.0)] * 14, "y int, p double")
    got = {r.criterion: r for r in reports.operating_points(rows, budget=1.0).collect()}
    # Flagging all six rows above 0 is as good as flagging three; bins above 0.55 and up to 0.6 flag the same three. The lowest is taken.
    assert got["max_f1"].threshold == pytest.approx(0.01) and got["max_f1"].f1 == pytest.approx(6 / 9) and not got["max_f1"].within_budget
    assert got["budgeted_f1"].threshold == pytest.approx(0.56) and got["max_recall_at_budget"].recall == pytest.approx(2 / 3) and got["budgeted_f1"].within_budget
    tight = {r.criterion: r for r in reports.operating_points(rows, budget=0.4).collect()}
    assert tight["budgeted_f1"].threshold == pytest.approx(0.61) and tight["budgeted_f1"].within_budget
    none = {r.criterion: r for r in reports.operating_points(rows, budget=0.01).collect()}
    assert none["budgeted_f1"].threshold == none["max_f1"].threshold and not none["budgeted_f1"].within_budget
    assert reports.operating_points(rows.where("y = 1")).count() == reports.operating_points(spark.createDataFrame([(0, 0.5), (1, 0.5)], "y int, p double").limit(0)).count() == 0


def test_confusion_and_ranks(spark):
    s = reports.confusion_summary(spark.createDataFrame([(0, 0), (0, 0), (0, 1), (1, 1), (2, 0)], "y int, guess int")).first()
    # Class F1: 2/3, 2/3, 0; naming class 0 always scores 3/5, and 3/4 on that class.
    assert (s.accuracy, s.majority_baseline, s.classes_present, s.classes_predicted) == (0.6, 0.6, 3, 2)
    assert s.macro_f1 == pytest.approx(4 / 9) and s.macro_f1_baseline == pytest.approx(0.25)
    rows = spark.createDataFrame([(0, [0.9, 0.1, 0.0]), (1, [0.5, 0.5, 0.1]), (2, [0.5, 0.4, 0.1])], "y int, s array<double>")
    r = reports.class_ranks(rows, "s", "y", 3).first()
    assert (r.mrr, r.hits1, r.hits3) == (pytest.approx((1 + 1 + 1 / 3) / 3), pytest.approx(2 / 3), 1.0)
    assert (r.accuracy, r.fpr, r.tnr) == (pytest.approx(1 / 3), pytest.approx(2 / 6), pytest.approx(4 / 6))
    auc = {r["class"]: r.auc for r in reports.class_curves(rows, "s", "y").collect()}
    assert auc == {0: 1.0, 1: 1.0, 2: 0.75}
    assert reports.class_curves(rows.where("y = 0"), "s", "y").where("auc is not null").count() == 0


def test_covering_hosts_and_times(spark):
    rows = [("c", "h1")] * 80 + [("c", f"s{k}") for k in range(20)] + [("d", "h1")]
    got = {r.category: tuple(r)[1:] for r in reports.hosts_for_share(spark.createDataFrame(rows, "k string, h string"), "k", "h").collect()}
    assert got == {"c": (100, 21, 11), "d": (1, 1, 1)}
    r = reports.time_statistics(spark.createDataFrame([("a", 5.0, 1), ("b", 5.0, 2)], "n string, t double, id int"), "n", "t", "id").first()
    assert (r.n, r["mean"], r["std"]) == (2, 5.0, 1.0)
    runs = {r.m: (r["mean"], r.sd) for r in reports.seed_summary(spark.createDataFrame([("x", 1.0), ("x", 3.0), ("y", 2.0)], "m string, v double"), "m", "v").collect()}
    assert runs == {"x": (2.0, pytest.approx(2**0.5)), "y": (2.0, 0.0)}


def test_rollouts_end_with_their_segment(spark):
    rows = [("h", float(10 * k * k), k, float(k)) for k in range(5)]
    got = {r.id: r for r in forecast.rollout_samples(spark.createDataFrame(rows, "h string, t double, id int, v double"), ["h"], "t", "id", "v", 2, 3).collect()}
    assert sorted(got) == [1, 2, 3]
    assert (got[3].input, got[3].input_seconds, got[3].future, got[3].future_seconds, got[3].future_valid) == ([2.0, 3.0], [-50.0, 0.0], [4.0] * 3, [70.0] * 3, [True, False, False])
    assert got[1].future_valid == [True] * 3 and got[1].future_seconds == [30.0, 80.0, 150.0]


def test_entries_pruning_and_campaigns(spark):
    rows = [("h", 1, 0.0, "Recon", "T1", "OBSERVED", 0.1, 0.5), ("h", 2, 5.0, "Recon", "T1", "OBSERVED", 0.9, 0.7), ("h", 3, 6.0, "Recon", "T1", "FORECAST", 0.1, 0.5), ("h", 4, 7.0, "Recon", None, "FORECAST", 0.1, 0.5), ("h", 5, 8.0, "Recon", None, "FORECAST", 0.1, 0.5), ("h", 6, 500.0, "Benign", None, "OBSERVED", 0.1, 0.5), ("g", 7, 1.0, "Benign", None, "OBSERVED", 0.1, 0.5)]
    nodes = alerts.compact_alike(spark.createDataFrame(rows, "host string, event_id long, t double, category string, technique string, provenance string, risk double, confidence double"), 180.0)
    assert {r.node: (r.n, r.start, r.end, r.risk, r.attacks) for r in nodes.collect()} == {1: (2, 0.0, 5.0, 0.9, 2), 3: (1, 6.0, 6.0, 0.1, 1), 4: (2, 7.0, 8.0, 0.1, 2), 6: (1, 500.0, 500.0, 0.1, 0), 7: (1, 1.0, 1.0, 0.1, 0)}
    edges = spark.createDataFrame([(1, 3, 0.8), (3, 4, 0.3), (4, 6, 0.5)], "u long, v long, score double")
    kept, between, report = alerts.pruned_nodes(nodes, edges)
    assert sorted((r.id, r.node) for r in kept.collect()) == [(0, 1), (1, 3), (2, 4), (3, 6)]
    assert sorted(tuple(r) for r in between.collect()) == [(0, 1, 0.8), (2, 3, 0.5)]
    r = report.first()
    assert (r.attack_recall, r.false_pruning_rate) == (1.0, 0.0) and r.compaction_ratio == pytest.approx(1 - 6 / 8)
    got = {r.campaign: tuple(r)[1:] for r in alerts.campaign_details(nodes, edges).collect()}
    assert got == {1: (4, 1, 0.0, 500.0, 500.0, 0.9, 3, ["T1"], True), 7: (1, 1, 1.0, 1.0, 0.0, 0.1, 0, [], False)}


def test_techniques_of_a_window_in_order(spark):
    rows = [("a", "b", 2.0, 1, True, ["T2", "T1"], 0), ("b", "a", 1.0, 2, True, ["T3"], 0), ("a", "c", 3.0, 3, False, ["T9"], 0), ("a", "a", 4.0, 4, True, None, 0), ("c", "d", 1.0, 5, False, None, 0)]
    df = spark.createDataFrame(rows, "src_ip string, dst_ip string, t double, id int, is_attack boolean, techniques array<string>, window int").withColumn("coarse_category", F.when(F.col("is_attack"), "Recon").otherwise("Benign"))
    got = {r.host: (r.category, r.techniques) for r in hosts.labelled_windows(df, ["t", "id"]).collect()}
    assert got == {"a": ("Recon", ["T3", "T2", "T1"]), "b": ("Recon", ["T3", "T2", "T1"]), "c": ("Benign", []), "d": ("Benign", [])}
