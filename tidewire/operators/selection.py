"""Choosing rows: frozen splits, tops, gathers, latest rows, neighbours, messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..common.store import written
from .temporal import merged_spans_sliced, ranged_within

#: Data sets that schemes across years train on, and the one they test on.
TRAIN_SETS, TEST_SET = {"cross_year": ("CIC2018", "PCAP2018"), "cross_year_ctu": ("CIC2018", "PCAP2018", "CTU13")}, "CIC2017"


def scheme_split(dataset: Column, locked: Column, scheme: str) -> Column:
    """The split of a capture under a scheme, from the one it is locked to; null where the scheme does not use it."""
    if scheme == "frozen":
        return locked
    if scheme not in TRAIN_SETS:
        raise ValueError(f"no scheme {scheme!r}")
    return F.when(dataset == TEST_SET, "test").when(dataset.isin(*TRAIN_SETS[scheme]), F.when(locked == "train", "train").otherwise("val"))


def locked_split(rows: DataFrame, lock: DataFrame, keys: list[str], scheme: str = "frozen") -> DataFrame:
    """``rows`` with their ``split`` by the lock (``keys`` and ``split``); a row that the lock does not name fails the job.

    The first of the ``keys`` is the data set. Rows that the scheme does not use are left out.
    """
    named = lock.select(*keys, F.col("split").alias("locked split"))
    missing = F.raise_error(F.concat(F.lit("not in the frozen split: "), F.concat_ws("/", *[F.col(k).cast("string") for k in keys])))
    split = F.when(F.col("locked split").isNull(), missing.cast("string")).otherwise(scheme_split(F.col(keys[0]), F.col("locked split"), scheme))
    return rows.join(named, keys, "left").withColumn("split", split).drop("locked split").where("split is not null")


def carved_calibration(groups: DataFrame, group: str, t: str, share: float = 0.15) -> DataFrame:
    """``groups`` with ``split``, the last ``share`` of the train groups in time (ties by name) set to calibration.

    At least one group, if the share is not 0, and never all: train keeps one. Halves round to even, as the share is defined.
    """
    if not 0 <= share < 1:
        raise ValueError("a share from 0 to below 1")
    train = ranged_within(groups.where("split = 'train'"), ["split"], [t, group], "place")
    n = train.groupBy("split").agg(F.count("*").alias("groups"))
    take = F.bround(F.lit(share) * F.col("groups"), 0)
    take = F.least(F.greatest(take, F.lit(1.0)) if share > 0 else take, F.col("groups") - 1)
    carved = train.join(F.broadcast(n), "split").withColumn("split", F.when(F.col("place") > F.col("groups") - take, "calibration").otherwise("train"))
    return carved.select(*groups.columns).unionByName(groups.where("split <> 'train'"))


def held_out(rows: DataFrame, group: str, test: list[str], calibration: list[str], validation: list[str]) -> DataFrame:
    """``rows`` with ``split``: named groups are held out whole, all others train; rows of no group are left out."""
    if len({*test, *calibration, *validation}) < len(test) + len(calibration) + len(validation):
        raise ValueError("a group is held out twice")
    split = F.when(F.col(group).isin(test), "test").when(F.col(group).isin(calibration), "calibration").when(F.col(group).isin(validation), "validation").otherwise("train")
    return rows.where(F.col(group).isNotNull()).withColumn("split", split)


def top_per_group(rows: DataFrame, keys: list[str], order: list[Column], n: int, name: str = "place") -> DataFrame:
    """The first ``n`` rows of each key; Spark cuts each partition to n a key before it shuffles."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= n)


def time_since_last(ends: DataFrame, node: str, t: str, tie: str) -> DataFrame:
    """``ends`` with ``since``: seconds since the node's row before; from 0 for its first."""
    before = F.lag(t, 1, 0.0).over(Window.partitionBy(node).orderBy(t, tie))
    return ends.withColumn("since", F.col(t) - before)


def ordered_sum(rows: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Sum of floats strictly from left to right by ``order``, so that its last bits are the same each time; for groups that fit a row."""
    items = F.array_sort(F.collect_list(F.struct(*order, F.col(value).cast("double").alias("x"))))
    return rows.groupBy(*keys).agg(F.aggregate(F.transform(items, lambda i: i["x"]), F.lit(0.0), lambda a, x: a + x).alias("total"))


def next_label_counts(rows: DataFrame, keys: list[str], order: list[str], label: str) -> DataFrame:
    """How often each label is a target, that is, stands on another row than its key's first: all rows less the first ones."""
    first = rows.groupBy(*keys).agg(F.min_by(label, F.struct(*order)).alias(label)).groupBy(label).agg(F.count("*").alias("firsts"))
    return rows.groupBy(label).agg(F.count("*").alias("rows")).join(first, label, "left").select(label, (F.col("rows") - F.coalesce("firsts", F.lit(0))).alias("n"))


def describe_targets(samples: DataFrame, host: str, now: str, future: str) -> DataFrame:
    """Class balance of forecast samples: rows, hosts, attack rate now and at each step, shares with an onset ahead and already attacked."""
    steps = F.posexplode(F.transform(future, lambda x: x.cast("int")))
    rates = samples.select(steps.alias("step", "x")).groupBy("step").agg(F.avg("x").alias("rate"))
    rates = rates.agg(F.transform(F.array_sort(F.collect_list(F.struct("step", "rate"))), lambda r: r["rate"]).alias("rates"))  # one value a step
    ahead = F.exists(future, lambda x: x) & ~F.col(now)
    one = samples.agg(F.count("*").alias("n"), F.count_distinct(host).alias("hosts"), F.avg(F.col(now).cast("int")).alias("now"), F.avg(ahead.cast("int")).alias("onset"), F.avg(F.col(now).cast("int")).alias("censored"))
    return one.crossJoin(rates)


def last_messages(messages: DataFrame, node: str, t: str, tie: str, value: str) -> DataFrame:
    """Per node its latest message and the mean of all, element by element, from arrays of one size."""
    last = messages.groupBy(node).agg(F.max_by(value, F.struct(t, tie)).alias("last"))
    parts = messages.select(node, F.posexplode(value).alias("place", "x")).groupBy(node, "place").agg(F.avg(F.col("x").cast("double")).alias("x"))
    mean = parts.groupBy(node).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "x"))), lambda p: p["x"]).alias("mean"))
    return last.join(mean, node)


def recent_per_edge(messages: DataFrame, node: str, peer: str, t: str, tie: str, n: int, value: str) -> DataFrame:
    """Per pair of node and peer the mean of its last ``n`` messages and how many there are."""
    late = top_per_group(messages, [node, peer], [F.desc(t), F.desc(tie)], n)
    return late.groupBy(node, peer).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))


def latest_in_bucket(streams: list[DataFrame], bucket: str, host: str, order: str) -> DataFrame:
    """Window streams of several readers as one: of a host's rows of a bucket the last one wins, a later stream over an earlier."""
    both = None
    for k, stream in enumerate(streams):
        one = stream.withColumn("stream", F.lit(k))
        both = one if both is None else both.unionByName(one)
    columns = [c for c in both.columns if c not in (bucket, host)]
    own = both.groupBy(bucket, host).agg(F.max_by(F.struct(*columns), F.struct("stream", order)).alias("own"))
    return own.select(bucket, host, *[f"own.{c}" for c in columns if c != "stream"])


def uniform_neighbours(edges: DataFrame, queries: DataFrame, node: str, peer: str, t: str, tie: str, k: int, seed: int, width: float = 7_776_000.0) -> DataFrame:
    """``k`` neighbours of each query (``query``, ``node``, ``cut``) before its time, drawn with replacement by a seeded hash, by time.

    Edges of a node are numbered in time; a query's earlier ones are the first so many, so each draw is a number and a lookup, and no
    query meets all edges of its node. A node's time is cut into slices of ``width`` seconds, so a node is no one task's: edges and queries of
    a slice are numbered in one window, and how many edges precede a slice comes from a row a node. Edges without a time are before nothing.
    """
    c = F.col
    slice_ = F.floor(c("at") / width).cast("long").alias("slice")
    kept = edges.where(c(t).isNotNull()).select(c(node).alias("node"), c(t).alias("at"), F.lit(1).alias("edge"), c(tie).alias("tie"), c(peer).alias("peer"))
    asked = queries.select("node", c("cut").alias("at"), F.lit(0).alias("edge"), "query")
    both = kept.unionByName(asked, allowMissingColumns=True).select("*", slice_)
    # At equal times queries come first: the edges up to a query are those before it, those up to an edge give its place.
    inside = Window.partitionBy("node", "slice").orderBy("at", "edge", "tie").rowsBetween(Window.unboundedPreceding, 0)
    rows = written(both.select("*", F.sum("edge").over(inside).alias("place")), "neighbours")
    sizes = rows.groupBy("node", "slice").agg(F.sum("edge").alias("rows"))
    before = sizes.select("node", "slice", (F.sum("rows").over(Window.partitionBy("node").orderBy("slice")) - c("rows")).alias("before"))
    parts = before.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("before", "slice"))).alias("parts"))
    own = F.get(F.filter("parts", lambda x: x["slice"] == F.col("slice")), 0)["before"]
    sized = rows.where("edge = 0").join(parts, "node").select("query", "node", "parts", (c("place") + own).alias("size")).where("size > 0")
    draws = sized.select("*", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("draw"))
    draws = draws.withColumn("drawn", F.pmod(c("query") * 2654435761 + c("draw") * 40503 + seed, c("size")) + 1)
    # The last slice that begins before the drawn edge holds it; empty ones begin where the next does.
    draws = draws.withColumn("part", F.element_at(F.filter("parts", lambda x: x["before"] < F.col("drawn")), -1))
    drawn = draws.select("query", "node", "draw", c("part.slice").alias("slice"), (c("drawn") - c("part.before")).alias("place"))
    found = drawn.join(rows.where("edge = 1").select("node", "slice", "place", "at", "tie", "peer"), ["node", "slice", "place"])
    return found.select("query", F.row_number().over(Window.partitionBy("query").orderBy("at", "tie", "draw")).alias("place"), c("peer").alias(peer), c("at").alias(t))


def split_in_time(members: DataFrame, component: str, start: str, end: str, tie: str, gap: float, width: float = 86_400.0) -> DataFrame:
    """Parts of components whose members' spans lie more than ``gap`` apart: component, run, start, end, n.

    A component may hold most members, so its spans go by slices of ``width`` seconds.
    """
    return merged_spans_sliced(members, [component], start, end, tie, width, gap)


def chosen_campaign(members: DataFrame, host: str, campaign: str, end: str) -> DataFrame:
    """Per host the campaign with its latest observed activity there, ties by the lower campaign."""
    own = members.where("observed").groupBy(host, campaign).agg(F.max(end).alias("latest"))
    return own.groupBy(host).agg(F.max(F.struct("latest", (-F.col(campaign)).alias("low"))).alias("best")).select(host, (-F.col("best.low")).alias(campaign), "best.latest")


def focus(flows: DataFrame, targets: DataFrame, order: list[str], peers: int = 12, edges: int = 24) -> tuple[DataFrame, DataFrame]:
    """For each target the first peers it was seen with (the target is the first of ``peers``) and its first edges, in order of appearance."""
    near = flows.select(*order, "src_ip", "dst_ip", F.explode(F.array_distinct(F.array("src_ip", "dst_ip"))).alias("target")).join(targets, "target")
    peer = F.when(F.col("src_ip") == F.col("target"), F.col("dst_ip")).otherwise(F.col("src_ip"))
    seen = near.groupBy("target", peer.alias("peer")).agg(F.min(F.struct(*order)).alias("first")).where("peer <> target")
    pairs = near.groupBy("target", "src_ip", "dst_ip").agg(F.min(F.struct(*order)).alias("first"))
    return top_per_group(seen, ["target"], [F.col("first"), F.col("peer")], peers - 1).drop("first"), top_per_group(pairs, ["target"], [F.col("first"), F.col("src_ip"), F.col("dst_ip")], edges).drop("first")


def visible_from_next(rows: DataFrame, keys: list[str], window: str, value: str) -> DataFrame:
    """Per key and window the total of ``value`` over earlier windows only: what a window adds is seen from the next one on, once."""
    own = rows.groupBy(*keys, window).agg(F.sum(value).alias("own"))
    before = Window.partitionBy(*keys).orderBy(window).rowsBetween(Window.unboundedPreceding, -1)
    return own.select(*keys, window, "own", F.coalesce(F.sum("own").over(before), F.lit(0)).alias("memory"))
