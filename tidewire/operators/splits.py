"""Splits and samples of groups and rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..common.store import bounded_broadcast, written
from .temporal import ranged

SPLITS = ("train", "validation", "calibration", "test")


def chronological_groups(df: DataFrame, group: str, t: str, shares: tuple[float, ...] = (0.60, 0.75, 0.85)) -> DataFrame:
    """Each group with its split: groups in order of their first time, cut where the rows so far reach each share.

    Cuts are moved so that each split has a group; fewer than four groups are an error. One window orders the groups,
    which a corpus has few of (captures); rows are never ordered.
    """
    sizes = df.groupBy(group).agg(F.min(t).alias("first"), F.count("*").alias("n"))
    w = Window.orderBy("first", group)
    placed = sizes.select("*", F.row_number().over(w).alias("place"), F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("so far"))
    total = sizes.agg(F.sum("n").alias("total"), F.count("*").alias("groups"))
    reached = placed.crossJoin(F.broadcast(total))
    row = reached.agg(F.max("groups").alias("groups"), *[F.min(F.when(F.col("so far") >= share * F.col("total"), F.col("place"))).alias(f"c{k}") for k, share in enumerate(shares)]).first()
    if (row["groups"] or 0) < len(SPLITS):
        raise ValueError("a chronological split needs at least four groups")
    cuts = []
    for k in range(len(shares)):
        cuts.append(max(min(row[f"c{k}"], row["groups"] - len(shares) + k), k + 1, *[c + 1 for c in cuts[-1:]]))
    split = F.lit(SPLITS[-1])
    for name, cut in reversed(list(zip(SPLITS, cuts))):
        split = F.when(F.col("place") <= cut, name).otherwise(split)
    return placed.select(group, "n", split.alias("split"))


def rotated(groups: DataFrame, value: str, tie: str) -> DataFrame:
    """Groups in order of ``value``, dealt in turn: four to train, one to validation, one to test."""
    placed = ranged(groups, [value, tie], "place")
    k = (F.col("place") - 1) % 6
    return placed.withColumn("split", F.when(k < 4, "train").when(k == 4, "validation").otherwise("test")).drop("place")


def shared_groups(df: DataFrame, group: str) -> DataFrame:
    """Groups that stand in more than one split."""
    return df.groupBy(group).agg(F.count_distinct("split").alias("splits")).where("splits > 1")


def permuted(hosts: DataFrame, host: str, step: int) -> DataFrame:
    """Each host and the one it is written ``as``: the ``step``-th after it in its /24 network, round."""
    net = F.regexp_extract(host, r"^(.*)\.\d+$", 1)
    w = Window.partitionBy("net")
    ranked = hosts.select(F.col(host), net.alias("net")).select("*", (F.row_number().over(w.orderBy(host)) - 1).alias("k"), F.count("*").over(w).alias("n"))
    other = ranked.select("net", F.col("k").cast("long").alias("at"), F.col(host).alias("as"))
    return ranked.withColumn("at", (F.col("k") + step) % F.col("n")).join(other, ["net", "at"]).select(host, "as")


def host_disjoint(df: DataFrame, hosts: list[str], share: float, salt: str) -> DataFrame:
    """``df`` with ``split``: ``test`` if all hosts of a row are held out, ``train`` if none is, null for rows that would tie the two.

    Whether a host is held out comes from a hash of its name, so no host is in both, and the same hosts are held out of any table.
    """
    out = [F.conv(F.substring(F.sha2(F.concat(F.lit(salt), F.col(h)), 256), 1, 8), 16, 10).cast("long") < int(share * 2**32) for h in hosts]
    every, some = out[0], out[0]
    for x in out[1:]:
        every, some = every & x, some | x
    return df.withColumn("split", F.when(every, "test").when(~some, "train"))


def to_median(df: DataFrame, label: str, draw: Column, tie: str) -> DataFrame:
    """Every class at the median class size: larger ones cut by the order of ``draw``, smaller ones repeated in turn.

    Places come from counts per slice of the draw, so no task orders a whole class.
    """
    sizes = df.groupBy(label).agg(F.count("*").alias("n"))
    target = sizes.agg(F.floor(F.percentile("n", F.lit(0.5))).cast("long").alias("target"))
    ranked = df.withColumn("draw", draw).withColumn("slice", F.pmod(F.xxhash64("draw"), F.lit(256)))
    counts = ranked.groupBy(label, "slice").agg(F.count("*").alias("rows"))
    before = counts.select(label, "slice", (F.sum("rows").over(Window.partitionBy(label).orderBy("slice")) - F.col("rows")).alias("before"))
    place = F.col("before") + F.row_number().over(Window.partitionBy(label, "slice").orderBy("draw", tie))
    placed = ranked.join(before, [label, "slice"]).withColumn("place", place).join(bounded_broadcast(written(sizes, "sizes"), 100_000), label).crossJoin(F.broadcast(target))
    times = F.floor((F.col("target") - F.col("place")) / F.col("n")) + 1
    copies = placed.where(F.col("place") <= F.col("target")).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), times)))
    return copies.select(*df.columns)
