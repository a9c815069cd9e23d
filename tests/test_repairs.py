"""Hold-outs that spare classes, censored hazards, and slices against plain windows."""

import math
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewire.operators import evaluation, graphs, labelling, metrics, selection, splits, temporal



def test_no_class_loses_all_of_its_edges(spark):
    rng = random.Random(6)
    edges = [(k, f"h{rng.randrange(40)}", f"h{rng.randrange(40)}", rng.choice(["common", "other"]), float(k)) for k in range(300)]
    edges += [(300 + k, "lone", f"h{k}", "rare", 5.0) for k in range(6)] + [(400, "x", "y", "late", 900.0), (401, "h1", "h2", None, 1.0), (402, "solo", "h3", "UNKNOWN", 1.0)]
    df = spark.createDataFrame(edges, "id int, a string, b string, k string, t double").repartition(4)
    names = sorted({x for e in edges for x in e[1:3]})
    for salt in ("s0", "s1", "s2", "s3"):
        held = {r.n for r in spark.createDataFrame([(n,) for n in names], "n string").where(graphs._held_out(F.col("n"), 0.6, salt)).collect()}
        train = [e for e in edges if e[4] < 500]
        kept = {e[3] for e in train if not {e[1], e[2]} & held}
        lost = {e[3] for e in edges} - kept - {"UNKNOWN", None}
        spared = {x for e in edges if e[3] in lost for x in e[1:3]}
        want = {e[0]: bool({e[1], e[2]} & (held - spared)) for e in edges}
        got = {r.id: r.inductive for r in graphs.repaired_hold_out(df, "a", "b", "k", 0.6, salt, F.col("t") < 500, ("UNKNOWN",)).collect()}
        assert got == want
        assert {e[3] for e in train if not got[e[0]]} >= {"common", "other", "rare"}
    few = {r.k: (r.carriers, r.main_carrier) for r in graphs.few_carriers(df, "a", "k", 1, ()).collect()}
    assert few["rare"] == (1, "lone") and few["late"] == (1, "x") and "common" not in few


def test_hosts_are_in_one_split(spark):
    df = spark.createDataFrame([(f"h{i % 30}", f"h{i % 17}") for i in range(200)], "a string, b string")
    rows = splits.host_disjoint(df, ["a", "b"], 0.4, "z").collect()
    sides = {s: {h for r in rows if r.split == s for h in (r.a, r.b)} for s in ("train", "test")}
    assert sides["train"] and sides["test"] and not sides["train"] & sides["test"]
    assert {r.split for r in rows} == {"train", "test", None}


def _series(spark):
    rng, t, rows = random.Random(8), 0.0, []
    for k in range(300):
        t += rng.choice((0.0, 1.0, 7.0, 90.0))
        rows.append((k, "hot" if k % 3 else f"h{k % 5}", t, k % 23 == 5))
    return spark.createDataFrame(rows, "id long, host string, t double, attack boolean").repartition(5)


def test_slices_equal_whole_windows(spark):
    df = _series(spark)
    spans = spark.createDataFrame([("hot", 100.0, 140.0), ("hot", 130.0, 150.0), ("hot", 900.0, 900.0), ("h0", 0.0, 5.0), ("none", 1.0, 2.0), ("hot", 1500.0, float("inf"))], "host string, start double, end double")
    whole = {r.id: r.wait for r in temporal.next_span(df, spans, ["host"], "t", "id").collect()}
    assert {r.id: r.wait for r in temporal.next_span_sliced(df, spans, ["host"], "t", 60.0).collect()} == whole and len(whole) == 300
    after = {r.id: r.n for r in temporal.next_time(df, ["host"], "t", "id", F.col("attack"), "n").collect()}
    assert {r.id: r.n for r in temporal.next_time_sliced(df, ["host"], "t", "id", F.col("attack"), 60.0, "n").collect()} == after


def test_hazard_is_censored(spark):
    rows = [(1, "a@c", "c", 0.0, False), (2, "a@c", "c", 100.0, True), (3, "a@c", "c", 200.0, False), (4, "b@c", "c", 50.0, False), (5, "b@c", "c", 900.0, False), (6, "z@d", "d", 0.0, False), (7, "z@d", "d", 5000.0, False), (8, "e@e", "e", 1.0, True)]
    df = spark.createDataFrame(rows, "id int, host string, capture string, t double, attack boolean")
    unknown = spark.createDataFrame([("c", 60.0, 70.0), ("c", 65.0, 100.0)], "capture string, start double, end double")
    got = {r.id: r.hazard for r in temporal.censored_hazard(df, "host", "capture", "t", "id", F.col("attack"), unknown, 150.0, 10.0, width=64.0).collect()}
    # 1: the span begins before the attack; 2: an attack; 3: the capture's end is 4.7 tau away, too far to matter; 4: a span is near;
    # 5 and 7: the capture ends; 6: its end is far.
    assert got == {1: None, 2: 1.0, 3: 0.0, 4: None, 5: None, 6: 0.0, 7: None, 8: 1.0}
    assert math.exp(-710 / 150) < 0.01


def test_spans_merge_in_slices(spark):
    rng = random.Random(5)
    rows = [(k, "hot" if k % 4 else "cold", t := float(rng.randrange(3000)), t + rng.choice((0.0, 5.0, 400.0))) for k in range(400)]
    df = spark.createDataFrame(rows, "id int, k string, a double, b double").repartition(5)
    plain = sorted(map(tuple, temporal.merged_spans(df, ["k"], "a", "b", "id", 3.0).collect()))
    assert sorted(map(tuple, temporal.merged_spans_sliced(df, ["k"], "a", "b", "id", 50.0, 3.0).collect())) == plain and len(plain) > 4


def test_totals_where_values_crowd(spark):
    """Scores of a rare event crowd at nought; one key holds most of them."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    rows = [("hot", k * 1e-9, k) for k in range(3000)] + [("b", 0.5, 7), ("b", -3.0, 1)]
    df = spark.createDataFrame(rows, "k string, p double, n long")
    got = {(r.k, r.p): r.upto_n for r in metrics.running_totals(df, "p", ["n"], descending=True, keys=("k",)).collect()}
    assert got["b", 0.5] == 7 and got["b", -3.0] == 8 and got["hot", 0.0] == sum(range(3000)) and got["hot", 2999e-9] == 2999
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_dictionaries_are_bounded(spark, monkeypatch):
    names = spark.createDataFrame([(f"n{k}",) for k in range(30)], "name string")
    monkeypatch.setattr(labelling, "LABELS", 10)
    with pytest.raises(ValueError):
        labelling.lenient_matches(names.withColumnRenamed("name", "label"), names, "label", "name")
    monkeypatch.setattr(evaluation, "VOCABULARY", 3)
    steps = spark.createDataFrame([(f"t{k}", "x", 1) for k in range(5)], "before string, category string, n int")
    with pytest.raises(ValueError):
        evaluation.token_scores(names.withColumn("t", F.lit(1)), ["name"], ["t"], "name", steps, 1)


def test_neighbours_of_a_hub(spark):
    edges = [(k, "hub" if k % 5 else "x", f"p{k}", float(k // 3)) for k in range(200)]
    df = spark.createDataFrame(edges, "id long, n string, peer string, t double")
    asked = spark.createDataFrame([(1, "hub", 10.0), (2, "hub", 0.0), (3, "x", 60.0), (4, "hub", 10.0)], "query long, node string, cut double")
    got = selection.uniform_neighbours(df, asked, "n", "peer", "t", "id", 4, 1).collect()
    assert {r["query"] for r in got} == {1, 3, 4} and len(got) == 12
    assert all(r.t < {1: 10.0, 3: 60.0, 4: 10.0}[r["query"]] for r in got)


def test_rows_before_and_runs_in_slices(spark):
    df = _series(spark).withColumn("host", F.when(F.col("host") != "h0", F.col("host")))  # a null key as well
    w = Window.partitionBy("host").orderBy("t", "id")
    plain = {r.id: (r.x, r.n) for r in temporal.islands(df.withColumn("x", F.lag("id").over(w)), ["host"], ["t", "id"], F.col("attack"), "n").collect()}
    was = temporal.previous_sliced(df, ["host"], "t", "id", ["id"], 40.0, "was")
    got = {r.id: (r.x, r.n) for r in temporal.islands_sliced(was, ["host"], "t", "id", F.col("attack"), 40.0, "n").select("id", F.col("was.id").alias("x"), "n").collect()}
    assert got == plain and len(got) == 300
