"""A host's trajectory: what was observed, and the steps that a forecast adds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Confidence of an observed window that no scorer looked at.
UNSCORED = 0.95
TARGETS = ("severity", "hazard")


def assembled(observed: DataFrame, scored: DataFrame, step_seconds: float, target: str = "severity") -> DataFrame:
    """Observed windows and forecast steps of each host, told apart by ``provenance``, with the host's forecast risk.

    ``observed`` has ``host``, ``window``, ``t``, ``category``, ``technique``, ``risk``; ``scored`` one row for a host, what a scorer says of its last
    window: ``technique``, ``confidence``, ``risk`` of that window and ``steps``, an array of ``category``, ``technique``, ``confidence``, ``risk``. The
    last window takes the scorer's word; step k stands ``k * step_seconds`` after it. ``forecast_risk`` of steps that are severities is the risk that
    one of them comes true, 1 less the product of what remains; steps that are hazards restate one event, so their peak
    counts. Without a forecast it is 0.
    """
    if target not in TARGETS:
        raise ValueError(f"a target is one of {TARGETS}")
    c = F.col
    risks = F.transform("steps", lambda s: s["risk"])
    whole = F.coalesce(F.array_max(risks), F.lit(0.0)) if target == "hazard" else 1 - F.aggregate(risks, F.lit(1.0), lambda left, r: left * (1 - r))
    heads = scored.select(c("host").alias("scored host"), c("technique").alias("said technique"), c("confidence").alias("said confidence"), c("risk").alias("said risk"), "steps", F.coalesce(whole, F.lit(0.0)).alias("forecast_risk"))
    last = observed.groupBy("host").agg(F.max(F.struct("window", "t")).alias("last"))
    known = last.join(heads, c("host") == c("scored host"), "left").drop("scored host")
    rows = observed.join(known, "host")
    is_last = c("window") == c("last.window")
    said = lambda name, other: F.when(is_last & c("said risk").isNotNull(), c(f"said {name}")).otherwise(other)
    past = rows.select(
        "host", "window", "t", F.lit("OBSERVED").alias("provenance"), "category", said("technique", F.coalesce("technique", F.lit("Benign"))).alias("technique"), said("confidence", F.lit(UNSCORED)).alias("confidence"),
        said("risk", c("risk")).alias("risk"), F.coalesce("forecast_risk", F.lit(0.0)).alias("forecast_risk"),
    )
    ahead = known.select("host", "last", "forecast_risk", F.posexplode("steps").alias("k", "step"))
    future = ahead.select(
        "host", (c("last.window") + c("k") + 1).alias("window"), (c("last.t") + (c("k") + 1) * step_seconds).alias("t"), F.lit("FORECAST").alias("provenance"), "step.category", F.coalesce("step.technique", F.lit("")).alias("technique"),
        F.coalesce("step.confidence", F.lit(0.0)).alias("confidence"), "step.risk", "forecast_risk",
    )
    return past.unionByName(future)
