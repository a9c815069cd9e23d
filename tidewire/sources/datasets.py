"""One way to read flows, whichever data set they come from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import UNRESOLVED
from . import capture_ranges
from .flow_files import alert_flows, botnet_flows, daily_flows

#: Columns of a flow, whatever it was read from.
FLOW = ("src_ip", "dst_ip", "src_port", "dst_port", "protocol", "start_time", "end_time", "fwd_bytes", "bwd_bytes", "fwd_packets", "bwd_packets", "raw_label", "coarse_category", "attck_technique_ids", "is_attack")


def _captured(spark: SparkSession, path: str, window: float = 2.0, intervals: DataFrame | None = None) -> DataFrame:
    """Flows of the windows of a capture, labelled by the attack interval (``name``, ``start``, ``end``, ``category``, ``techniques``) that holds their window's middle; others are benign."""
    from ..operators.packets import packet_flows, windowed

    needed = ["timestamp", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "packet_length", "payload_length", "tcp_flags"]
    packets = capture_ranges.packets(spark, path, needed).withColumn("seq", F.monotonically_increasing_id())
    flows = packet_flows(windowed(packets, window), ["window"]).withColumns({"start_time": F.col("start"), "end_time": F.col("end"), "flow middle": (F.col("window") + 0.5) * window}).drop("start", "end")
    if intervals is None:
        none = F.array().cast("array<string>")
        return flows.withColumns({"raw_label": F.lit("Benign"), "coarse_category": F.lit("Benign"), "attck_technique_ids": none, "is_attack": F.lit(False)})
    middles = flows.select("flow middle").distinct()
    named = intervals.select("name", F.col("start").alias("from"), F.col("end").alias("until"), "category", "techniques")
    # Windows, not flows, meet the intervals; the first that holds a window is its label.
    held = middles.join(named, (F.col("flow middle") >= F.col("from")) & (F.col("flow middle") <= F.col("until"))).groupBy("flow middle").agg(F.min(F.struct("from", "name", "category", "techniques")).alias("held"))
    labelled = flows.join(held, "flow middle", "left")
    benign = F.col("held").isNull()
    return labelled.withColumns({"raw_label": F.coalesce("held.name", F.lit("Benign")), "coarse_category": F.coalesce("held.category", F.lit("Benign")), "attck_technique_ids": F.coalesce("held.techniques", F.array().cast("array<string>")), "is_attack": ~benign})


#: Readers by data set; further options go to them.
READERS: dict[str, Callable[..., DataFrame]] = {
    "daily-2017": lambda s, p, **o: daily_flows(s, p, "2017", **o), "daily-2018": lambda s, p, **o: daily_flows(s, p, "2018", **o), "botnet": botnet_flows, "alerts": alert_flows, "capture": _captured,
}


def read_flows(spark: SparkSession, dataset: str, path: str, **options) -> tuple[DataFrame, DataFrame]:
    """The flows of one capture of a data set, without those whose label nobody can resolve, and how many these are.

    The second table has one row: ``dataset``, ``total``, ``unresolved``, ``rate`` and how many different labels were ``unmapped``. Both come from the same plan, so
    neither passes through the driver. An unknown data set is an error.
    """
    if dataset not in READERS:
        raise ValueError(f"no data set {dataset}; there are {sorted(READERS)}")
    rows = READERS[dataset](spark, path, **options)
    flows = rows.select(*[F.col(c) if c in rows.columns else F.lit(None).alias(c) for c in FLOW])
    bad = F.coalesce(F.col("coarse_category"), F.lit(UNRESOLVED)) == UNRESOLVED
    coverage = flows.agg(F.count("*").alias("total"), F.count_if(bad).alias("unresolved"), F.count_distinct(F.when(bad, F.col("raw_label"))).alias("unmapped"))
    rate = F.when(F.col("total") > 0, F.col("unresolved") / F.col("total")).otherwise(0.0)
    return flows.where(~bad), coverage.select(F.lit(dataset).alias("dataset"), "total", "unresolved", rate.alias("rate"), "unmapped")


def as_records(flows: DataFrame) -> DataFrame:
    """Flows with what is derived from them: ``duration`` (at least 0), totals of both directions, rates, and the techniques as one text."""
    c = F.col
    duration = F.greatest(c("end_time") - c("start_time"), F.lit(0.0))
    total, packets = c("fwd_bytes") + c("bwd_bytes"), c("fwd_packets") + c("bwd_packets")
    rate = lambda x: F.when(duration > 0, x / duration).otherwise(x.cast("double"))
    return flows.withColumns({"duration": duration, "total_bytes": total, "total_packets": packets, "byte_rate": rate(total), "packet_rate": rate(packets), "attck_technique_ids_str": F.array_join("attck_technique_ids", ";")})
