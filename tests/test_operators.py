"""Operators on empty tables, nulls and ties, and a stream against its batch."""

from tidewire.common.components import connected_components
from tidewire.operators import alerts, metrics, temporal
from tidewire.sources.tables import series
from tidewire.streaming.windows import windowed_totals


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (5, 4), (4, 4), (None, 9), (7, None), (1, 2)], "a long, b long")
    assert {tuple(r) for r in connected_components(edges).collect()} == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4)}
    assert connected_components(edges.limit(0)).count() == 0
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    assert {r.component for r in connected_components(chain).collect()} == {0}


def test_gap_segments_are_strict(spark):
    df = spark.createDataFrame([("h", float(t), t) for t in (0, 2, 4, 3600, 3602)], "host string, t double, id int")
    assert [r.segment for r in temporal.gap_segments(df, ["host"], "t", "id", 3596).orderBy("t").collect()] == [1] * 5
    assert [r.segment for r in temporal.gap_segments(df, ["host"], "t", "id", 3595).orderBy("t").collect()] == [1, 1, 1, 2, 2]


def test_conformal_order_statistic(spark):
    rows = spark.createDataFrame([(0, i / 100) for i in range(19)], "y int, p double")
    assert metrics.conformal_quantile(rows, 0.05).first().quantile == 0.18
    assert metrics.conformal_quantile(rows.where("p < 0.18"), 0.05).first().quantile is None


def test_metrics_with_one_class_and_none(spark):
    rows = spark.createDataFrame([(1, 0.4), (1, 0.4)], "y int, p double")
    assert metrics.detection_report(rows).first().roc_auc is None
    assert metrics.detection_report(rows.limit(0)).first().n == 0


def test_edges_are_bounded_by_the_horizon(spark):
    at = [(k, "h", float(t), "Recon" if k < 2 else "Impact", 0.5) for k, t in enumerate((0, 100, 170, 400))]
    df = spark.createDataFrame(at, "event_id long, host string, t double, category string, score double")
    assert {(r.u, r.v) for r in alerts.score_edges(df, 180, 0.0).collect()} == {(0, 1), (0, 2), (1, 2)}
    assert alerts.score_edges(df.limit(0), 180).count() == 0


def test_stream_equals_batch(spark, tmp_path):
    rows = series(spark, "/root/testdata/sf0.001").select("host", "ts", "is_attack")
    rows.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = windowed_totals(stream, "1 hour", "60 days").writeStream.format("memory").queryName("totals").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/cp").start()
    query.awaitTermination(120)
    assert sorted(map(tuple, spark.table("totals").collect())) == sorted(map(tuple, windowed_totals(rows, "1 hour").collect()))
