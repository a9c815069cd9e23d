"""Alert graphs: range self-join, scores, compaction, campaigns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..common.components import connected_components
from ..contract import EDGE_THRESHOLD
from ..functions.flow import plausibility, severity
from .temporal import islands_sliced, previous_sliced, ranged


def score_edges(alerts: DataFrame, horizon: float, least: float = EDGE_THRESHOLD) -> DataFrame:
    """Pairs of a host's alerts within the horizon, in time order, that score at least ``least``.

    A pair lies in one time bucket or in two neighbouring ones, so the join is on host and bucket; the later
    side is the one that comes twice. Hot hosts are spread over their buckets.
    """
    bucket = F.floor(F.col("t") / horizon).cast("long")
    early = alerts.select("host", F.col("event_id").alias("u"), F.col("t").alias("tu"), F.col("category").alias("cu"), bucket.alias("b"))
    late = alerts.select("host", F.col("event_id").alias("v"), F.col("t").alias("tv"), F.col("category").alias("cv"), F.explode(F.array(bucket, bucket - 1)).alias("b"))
    dt = F.col("tv") - F.col("tu")
    ordered = (dt > 0) | ((dt == 0) & (F.col("u") < F.col("v")))
    score = plausibility(F.col("cu"), F.col("cv")) * (1 - dt / horizon)
    pairs = early.join(late, ["host", "b"]).where(ordered & (dt <= horizon) & ~((F.col("cu") == "Benign") & (F.col("cv") == "Benign")))
    return pairs.select("host", "u", "v", score.alias("score")).where(F.col("score") >= least)


def compact(alerts: DataFrame, gap: float, width: float = 86_400.0) -> DataFrame:
    """Consecutive alerts of a host with one category and no longer pause become one node.

    Alerts are taken by slices of ``width`` seconds, so a host with most alerts is no one task's.
    """
    marked = previous_sliced(alerts, ["host"], "t", "event_id", ["category", "t"], width, "was")
    new = F.col("was").isNull() | (F.col("was.category") != F.col("category")) | (F.col("t") - F.col("was.t") > gap)
    runs = islands_sliced(marked, ["host"], "t", "event_id", new, width)
    return runs.groupBy("host", "run").agg(F.min("category").alias("category"), F.min("t").alias("start"), F.max("t").alias("end"), F.count("*").alias("n"), F.max("score").alias("score"))


def compact_alike(alerts: DataFrame, gap: float, alike: tuple[str, ...] = ("category", "technique", "provenance"), width: float = 86_400.0) -> DataFrame:
    """Consecutive entries of a host that agree in all of ``alike`` and lie no longer than ``gap`` apart, as one node.

    A node has its span, ``n`` entries, the highest ``risk`` and the mean ``confidence``. Null agrees with null. Entries are taken by slices of
    ``width`` seconds.
    """
    marked = previous_sliced(alerts, ["host"], "t", "event_id", ["t", *alike], width, "was")
    same = F.col("t") - F.col("was.t") <= gap
    for c in alike:
        same = same & F.col(c).eqNullSafe(F.col(f"was.{c}"))
    runs = islands_sliced(marked, ["host"], "t", "event_id", F.col("was").isNull() | ~same, width)
    kept = [F.first(c).alias(c) for c in alike]
    return runs.groupBy("host", "run").agg(*kept, F.min(F.struct("t", "event_id"))["event_id"].alias("node"), F.min("t").alias("start"), F.max("t").alias("end"), F.count("*").alias("n"), F.max("risk").alias("risk"), F.avg("confidence").alias("confidence"), F.count_if((F.col("category") != "Benign") | (F.col("risk") > 0.5)).alias("attacks"))


def pruned_nodes(nodes: DataFrame, edges: DataFrame, strong: float = 0.40, risky: float = 0.20) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes (``node``, ``category``, ``technique``, ``risk``, ``n``, ``attacks``) worth keeping, numbered anew from 0; the strong edges between them by these numbers; and a report.

    A node stays at an end of a strong edge, with evidence of an attack, or if risky. The report's one row has the ``compaction_ratio`` of nodes
    and edges, the share of attack entries that stay, and the share of entries pruned that were attacks.
    """
    c, none = F.col, F.array(F.lit("Benign"), F.lit("None"), F.lit("Unknown"))
    valid = edges.where(c("score") >= strong)
    linked = valid.select(F.explode(F.array("u", "v")).alias("node")).distinct().withColumn("linked", F.lit(True))
    technique = F.coalesce("technique", F.lit(""))
    evidence = ~F.array_contains(none, c("category")) | ~technique.isin("Benign", "None", "") | (c("risk") >= risky)
    marked = nodes.join(linked, "node", "left").withColumn("stays", F.coalesce("linked", F.lit(False)) | evidence).drop("linked")
    kept = ranged(marked.where("stays").drop("stays"), ["node"], "id").withColumn("id", c("id") - 1)
    ids = lambda end: kept.select(c("node").alias(end), c("id").alias(f"{end} id"))
    between = valid.join(ids("u"), "u").join(ids("v"), "v").select(c("u id").alias("u"), c("v id").alias("v"), "score")
    sums = marked.agg(
        F.count("*").alias("nodes"), F.count_if("stays").alias("kept"), F.coalesce(F.sum("n"), F.lit(0)).alias("entries"), F.coalesce(F.sum("attacks"), F.lit(0)).alias("attacks"),
        F.coalesce(F.sum(F.when(c("stays"), c("n"))), F.lit(0)).alias("entries_kept"), F.coalesce(F.sum(F.when(c("stays"), c("attacks"))), F.lit(0)).alias("attacks_kept"),
    ).crossJoin(edges.agg(F.count("*").alias("edges"))).crossJoin(between.agg(F.count("*").alias("edges_kept")))
    gone = c("entries") - c("entries_kept")
    ratio = F.greatest(F.lit(0.0), 1 - (c("kept") + c("edges_kept")) / F.greatest(c("nodes") + c("edges"), F.lit(1)))
    report = sums.select(
        "nodes", "kept", "edges", "edges_kept", ratio.alias("compaction_ratio"), F.when(c("attacks") > 0, c("attacks_kept") / c("attacks")).otherwise(1.0).alias("attack_recall"),
        F.when(gone > 0, (c("attacks") - c("attacks_kept")) / gone).otherwise(0.0).alias("false_pruning_rate"),
    )
    return kept, between, report


def campaign_details(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row per connected component of the nodes' graph (``node``, ``host``, ``start``, ``end``, ``risk``, ``technique``, ``provenance``; ``u``, ``v``): hosts, span, highest risk, edges inside, techniques in order of time, and whether a forecast is part of it.

    A node without an edge is a campaign of its own. Techniques are listed once each, so the list is no longer than the catalogue of techniques.
    """
    c = F.col
    ends = edges.select("u", "v").union(nodes.select(c("node").alias("u"), c("node").alias("v")))
    labels = connected_components(ends, "u", "v", "campaign")
    members = nodes.join(labels, "node")
    own = members.groupBy("campaign").agg(F.count("*").alias("n"), F.count_distinct("host").alias("hosts"), F.min("start").alias("start"), F.max("end").alias("end"), F.max("risk").alias("risk"), F.max(c("provenance") == "FORECAST").alias("has_forecast"))
    inside = edges.join(labels, edges["u"] == labels["node"]).groupBy("campaign").agg(F.count("*").alias("edges"))
    known = members.where(c("technique").isNotNull() & ~c("technique").isin("", "None"))
    first = known.groupBy("campaign", "technique").agg(F.min(F.struct("start", "node")).alias("at"))
    named = first.groupBy("campaign").agg(F.array_sort(F.collect_list(F.struct("at", "technique"))).alias("x")).select("campaign", F.transform("x", lambda x: x["technique"]).alias("techniques"))
    found = own.join(inside, "campaign", "left").join(named, "campaign", "left")
    return found.select("campaign", "n", "hosts", "start", "end", (c("end") - c("start")).alias("duration"), "risk", F.coalesce("edges", F.lit(0)).alias("edges"), F.coalesce("techniques", F.array().cast("array<string>")).alias("techniques"), "has_forecast")


def campaigns(alerts: DataFrame, edges: DataFrame) -> DataFrame:
    """One row per connected component of the alert graph."""
    labels = connected_components(edges, "u", "v", "campaign")
    found = alerts.join(labels, alerts["event_id"] == labels["node"])
    return found.groupBy("campaign").agg(F.count("*").alias("n"), F.min("t").alias("start"), F.max("t").alias("end"), F.max(severity(F.col("category"))).alias("severity"), F.count_distinct("host").alias("hosts"))


def recent_neighbours(alerts: DataFrame, k: int) -> DataFrame:
    """The ``k`` alerts of the same host that most recently precede each alert."""
    w = Window.partitionBy("host").orderBy("t", "event_id")
    back = alerts.select("event_id", *[F.lag("event_id", i).over(w).alias(f"back {i}") for i in range(1, k + 1)])
    each = F.array(*[F.struct(F.lit(i).alias("rank"), F.col(f"back {i}").alias("neighbour")) for i in range(1, k + 1)])
    return back.select("event_id", F.inline(each)).where("neighbour is not null")


def transitions(alerts: DataFrame, width: float = 86_400.0) -> DataFrame:
    """Smoothed probabilities of one category following another on a host."""
    placed = previous_sliced(alerts, ["host"], "t", "event_id", ["category"], width, "was")
    steps = placed.select("category", F.col("was.category").alias("before")).where("before is not null").groupBy("before", "category").agg(F.count("*").alias("n"))
    totals = steps.groupBy("before").agg(F.sum("n").alias("total"))
    return steps.join(totals, "before").select("before", "category", "n", ((F.col("n") + 1) / (F.col("total") + 5)).alias("p"))
