"""Graphs of flows and alerts: edges, samples, neighbours' features, topology, campaigns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..common.store import bounded_broadcast, written
from ..functions.flow import internal, plausibility
from .temporal import ranged, ranged_within


def both_ways(edges: DataFrame, a: str = "src_ip", b: str = "dst_ip") -> DataFrame:
    """Each edge once from each end (``node``, ``peer``); a loop once."""
    ends = F.array(F.struct(F.col(a).alias("node"), F.col(b).alias("peer")), F.struct(F.col(b).alias("node"), F.col(a).alias("peer")))
    return edges.select("*", F.inline(F.when(F.col(a) == F.col(b), F.slice(ends, 1, 1)).otherwise(ends)))


def bipartite(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Edges with separate numbers for sources (from 0) and targets (after the sources), in order of their names."""
    ids = lambda c, n: ranged(edges.select(F.col(c).alias("name")).distinct(), ["name"], n)
    left, right = ids(a, "u"), ids(b, "i")
    n = left.agg(F.count("*").alias("sources"))
    x = edges.join(left.select(F.col("name").alias(a), (F.col("u") - 1).alias("u")), a).join(right.select(F.col("name").alias(b), (F.col("i") - 1).alias("i")), b)
    return x.crossJoin(F.broadcast(n)).withColumn("i", F.col("i") + F.col("sources")).drop("sources")


def negative_targets(edges: DataFrame, capture: str, target: str, key: str, seed: int) -> DataFrame:
    """``edges`` with a ``negative``: a target of the same capture, never the edge's own, uniform by a seeded hash.

    Targets are numbered per capture; an edge draws a number below its own target's count less one and steps over its
    own. A capture with one target has no negatives.
    """
    place, size, pick = "target place", "target count", "target pick"
    ranked = ranged_within(edges.select(capture, target).distinct(), [capture], [target], place).withColumn(place, F.col(place) - 1)
    sizes = ranked.groupBy(capture).agg(F.count("*").alias(size))
    own = edges.join(ranked, [capture, target]).join(sizes, capture).where(F.col(size) > 1)
    drawn = F.pmod(F.col(key) * 2654435761 + seed, F.col(size) - 1)
    picked = own.withColumn(pick, drawn + F.when(drawn >= F.col(place), 1).otherwise(0))
    names = ranked.select(F.col(capture), F.col(place).cast("long").alias(pick), F.col(target).alias("negative"))
    return picked.join(names, [capture, pick]).drop(pick, place, size)


def held_out_edges(edges: DataFrame, a: str, b: str, share: float, salt: str) -> DataFrame:
    """``edges`` with ``inductive``: whether one of its ends is among the held-out ``share`` of nodes, picked by a hash of their name."""
    return edges.withColumn("inductive", _held_out(F.col(a), share, salt) | _held_out(F.col(b), share, salt))


def _held_out(node: Column, share: float, salt: str) -> Column:
    return F.conv(F.substring(F.sha2(F.concat(F.lit(salt), node), 256), 1, 8), 16, 10).cast("long") < int(share * 2**32)


def repaired_hold_out(edges: DataFrame, a: str, b: str, label: str, share: float, salt: str, train: Column | None = None, ignore: tuple[str, ...] = ()) -> DataFrame:
    """What :func:`held_out_edges` gives, but so that no class loses all of its training edges to the held-out nodes.

    A class of ``label`` that has edges and none left among those of ``train`` (all, if not given) is lost; ends of its edges are
    taken back from the held-out nodes. Its edges then touch none, so one round is enough; a class without training edges stays lost, whichever
    nodes are held out. Classes in ``ignore`` are not minded, and a null is no class. Only names of lost classes are broadcast, and only if they are few; nodes never leave the tasks.
    """
    usable = train if train is not None else F.lit(True)
    drawn = held_out_edges(edges, a, b, share, salt)
    minded = drawn.where(F.col(label).isNotNull() & ~F.col(label).isin(*ignore))
    lost = written(minded.groupBy(F.col(label).alias("lost class")).agg(F.max(usable & ~F.col("inductive")).alias("kept")).where("not kept").select("lost class"), "lost-classes")
    few = bounded_broadcast(lost, 100_000)
    carried = edges.join(few, F.col(label).eqNullSafe(F.col("lost class")), "left_semi")
    spared = written(carried.select(F.explode(F.array(a, b)).alias("spared")).distinct(), "spared")
    held = lambda c: _held_out(F.col(c), share, salt)
    near = bounded_broadcast(spared, 1_000_000)
    out = edges
    for c, name in ((a, "spared a"), (b, "spared b")):
        mark = near.select(F.col("spared").alias(name))
        # Only ends that would be held out are looked up.
        out = out.join(mark, held(c) & (F.col(c) == F.col(name)), "left")
    return out.withColumn("inductive", (held(a) & F.col("spared a").isNull()) | (held(b) & F.col("spared b").isNull())).drop("spared a", "spared b")


def few_carriers(edges: DataFrame, source: str, label: str, most: int = 2, ignore: tuple[str, ...] = ("Benign",)) -> DataFrame:
    """Classes that ``most`` sources or fewer carry, with their number: what a model scores on them is how well it knows these hosts."""
    seen = edges.where(F.col(label).isNotNull() & ~F.col(label).isin(*ignore))
    pairs = seen.groupBy(label, source).agg(F.count("*").alias("n"))
    return pairs.groupBy(label).agg(F.count("*").alias("carriers"), F.sum("n").alias("edges"), F.max_by(source, F.struct("n", source)).alias("main_carrier")).where(F.col("carriers") <= most)


def edge_scores(alerts: DataFrame, talks: DataFrame, horizon: float, least: float) -> DataFrame:
    """Scored pairs of alerts of any two hosts that talk, and of one host: plausibility, time, place and provenance.

    Pairs come from the talking pairs of hosts (``a``, ``b``), so no product of all alerts arises: hosts that neither
    are the same nor talk score nought and are never joined. ``forecast`` marks alerts that were only predicted.
    """
    c = F.col
    hosts = talks.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
    pairs = hosts.select("a", "b").union(hosts.select("b", "a")).withColumn("place", F.lit(0.8)).union(alerts.select(c("host").alias("a"), c("host").alias("b")).distinct().withColumn("place", F.lit(1.0)))
    bucket = F.floor(c("t") / horizon).cast("long")
    early = alerts.select(c("host").alias("a"), c("event_id").alias("u"), c("t").alias("tu"), c("category").alias("cu"), c("forecast").alias("fu"), bucket.alias("bucket"))
    late = alerts.select(c("host").alias("b"), c("event_id").alias("v"), c("t").alias("tv"), c("category").alias("cv"), c("forecast").alias("fv"), F.explode(F.array(bucket, bucket - 1)).alias("bucket"))
    dt = c("tv") - c("tu")
    # Hosts meet in buckets where both have alerts before the alerts themselves do.
    met = early.select("a", "bucket").distinct().join(pairs, "a").join(late.select("b", "bucket").distinct(), ["b", "bucket"])
    joined = early.join(met, ["a", "bucket"]).join(late, ["b", "bucket"]).where(((dt > 0) | ((dt == 0) & (c("u") < c("v")))) & (dt <= horizon) & ~((c("cu") == "Benign") & (c("cv") == "Benign")))
    seen = F.when(c("fu") & c("fv"), 0.5).when(c("fu") | c("fv"), 0.75).otherwise(1.0)
    return joined.select("u", "v", (plausibility(c("cu"), c("cv")) * (1 - dt / horizon) * c("place") * seen).alias("score")).where(c("score") >= least)


def pruned(alerts: DataFrame, edges: DataFrame, strong: float = 0.40, risky: float = 0.20) -> DataFrame:
    """Alerts worth keeping: at an end of a strong edge, or evidence of an attack, or risky."""
    linked = edges.where(F.col("score") >= strong).select(F.explode(F.array("u", "v")).alias("event_id")).distinct().withColumn("linked", F.lit(True))
    return alerts.join(linked, "event_id", "left").where(F.col("linked") | F.col("is_attack") | (F.col("score") >= risky)).drop("linked")


def roots(members: DataFrame, edges: DataFrame) -> DataFrame:
    """Members (``event_id``, ``campaign``, ``t``) that no edge leads to; the earliest of a campaign that has none such."""
    led = edges.select(F.col("v").alias("event_id")).distinct()
    free = members.join(led, "event_id", "left_anti").select("campaign", "event_id")
    earliest = members.groupBy("campaign").agg(F.min(F.struct("t", "event_id"))["event_id"].alias("event_id"))
    return free.union(earliest.join(free.select("campaign").distinct(), "campaign", "left_anti"))


def topology(flows: DataFrame, now: float, node_ttl: float, edge_ttl: float) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges still alive at ``now``: seen within their time to live, stale beyond three quarters of it.

    Edges need both of their ends.
    """
    c = F.col
    seen = both_ways(flows).groupBy("node").agg(F.max("end_time").alias("last"), F.count("*").alias("flows"))
    nodes = seen.where(now - c("last") <= node_ttl).select("node", "flows", "last", (now - c("last") > 0.75 * node_ttl).alias("stale"), internal(c("node")).alias("inside"))
    links = flows.groupBy("src_ip", "dst_ip").agg(F.max("end_time").alias("last"), F.count("*").alias("flows"), F.sum(c("fwd_bytes") + c("bwd_bytes")).alias("bytes")).where(now - c("last") <= edge_ttl)
    alive = nodes.select("node")
    for end in ("src_ip", "dst_ip"):
        links = links.join(alive.withColumnRenamed("node", end), end, "left_semi")
    return nodes, links.select("src_ip", "dst_ip", "flows", "bytes", "last", (now - c("last") > 0.75 * edge_ttl).alias("stale"))


def spread_once(edges: DataFrame, values: DataFrame, value: str) -> DataFrame:
    """One step over the graph with normalised adjacency and self-loops: sum of x_j / sqrt(d_i d_j)."""
    pairs = both_ways(edges).select("node", "peer").where("node <> peer").distinct()
    loops = values.select("node", F.col("node").alias("peer"))
    full = pairs.union(loops)
    degree = full.groupBy("node").agg(F.count("*").alias("degree"))
    far = values.join(degree, "node").select(F.col("node").alias("peer"), (F.col(value) / F.sqrt("degree")).alias("x"))
    return full.join(far, "peer").groupBy("node").agg(F.sum("x").alias("x")).join(degree, "node").select("node", (F.col("x") / F.sqrt("degree")).alias(value))


def new_targets(flows: DataFrame, known: Column) -> DataFrame:
    """Targets of flows outside ``known`` that no flow inside it has."""
    return flows.where(~known).select("dst_ip").distinct().join(flows.where(known).select("dst_ip").distinct(), "dst_ip", "left_anti")
