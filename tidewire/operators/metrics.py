"""Metrics over rows of a label ``y`` and a probability ``p``."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..common.store import written


def _div(a, b):
    return F.when(b > 0, a / b)


def detection_report(rows: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Counts, precision, recall, F1, Brier score, ROC-AUC and average precision in one row.

    Curves come from counts per distinct score, cumulated range by range of the scores (``running_totals``).
    AUC and precision are null where one class is missing.
    """
    by_score = rows.groupBy("p").agg(F.sum("y").alias("pos"), F.count("*").alias("n"))
    curve = running_totals(by_score, "p", ["pos", "n"], descending=True).select("p", "pos", "n", F.col("upto_pos").alias("tp"), F.col("upto_n").alias("all"))
    neg, fp = F.col("n") - F.col("pos"), F.col("all") - F.col("tp")
    area = curve.agg(F.sum(neg * (F.col("tp") - F.col("pos")) + neg * F.col("pos") / 2).alias("won"), F.sum(F.col("pos") * F.col("tp") / F.col("all")).alias("ap"), F.max(fp).alias("negatives"), F.max("tp").alias("positives"))
    hit = F.col("p") >= threshold
    counts = rows.agg(
        F.count("*").alias("n"), F.count_if(hit & (F.col("y") == 1)).alias("tp"), F.count_if(hit & (F.col("y") == 0)).alias("fp"), F.count_if(~hit & (F.col("y") == 1)).alias("fn"), F.count_if(~hit & (F.col("y") == 0)).alias("tn"),
        F.avg((F.col("p") - F.col("y")) * (F.col("p") - F.col("y"))).alias("brier"),
    )
    c = F.col
    return counts.crossJoin(area).select(
        "n", "tp", "fp", "fn", "tn", "brier", _div(c("tp"), c("tp") + c("fp")).alias("precision"), _div(c("tp"), c("tp") + c("fn")).alias("recall"), _div(2 * c("tp"), 2 * c("tp") + c("fp") + c("fn")).alias("f1"),
        _div(c("won"), c("positives") * c("negatives")).alias("roc_auc"), _div(c("ap"), c("positives")).alias("average_precision"),
    )


def reliability(rows: DataFrame, bins: int = 15) -> DataFrame:
    """Bins of equal width, closed on the left: size, mean probability, share of positives."""
    b = F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).cast("long").alias("bin")
    return rows.groupBy(b).agg(F.count("*").alias("n"), F.avg("p").alias("mean_p"), F.avg("y").alias("share"))


def calibration_error(rows: DataFrame, bins: int = 15) -> DataFrame:
    r = reliability(rows, bins)
    return r.agg((F.sum(F.col("n") * F.abs(F.col("mean_p") - F.col("share"))) / F.sum("n")).alias("ece"), F.max(F.abs(F.col("mean_p") - F.col("share"))).alias("mce"))


def conformal_quantile(rows: DataFrame, alpha: float) -> DataFrame:
    """The k-th smallest absolute residual, k = ceil((n + 1)(1 - alpha)); null if there are too few.

    Counts per distinct residual are cumulated, so ties cost one row.
    """
    counts = rows.groupBy(F.abs(F.col("y") - F.col("p")).alias("r")).agg(F.count("*").alias("c"))
    n = rows.agg(F.count("*").alias("n"))
    cumulated = running_totals(counts, "r", ["c"]).select("r", F.col("upto_c").alias("upto")).crossJoin(F.broadcast(n))
    k = F.ceil((F.col("n") + 1) * (1 - alpha))
    return cumulated.agg(F.max("n").alias("n"), F.min(F.when(F.col("upto") >= k, F.col("r"))).alias("quantile"))


def operating_point(rows: DataFrame, bins: int = 101) -> DataFrame:
    """The threshold with the best F1 over a histogram of scores; the lowest of equal ones."""
    hist = rows.groupBy(F.floor(F.col("p") * (bins - 1)).cast("long").alias("b")).agg(F.sum("y").alias("pos"), F.count("*").alias("n"))
    w = Window.orderBy(F.desc("b")).rowsBetween(Window.unboundedPreceding, 0)
    total = rows.agg(F.sum("y").alias("all_pos"), F.count("*").alias("all"))
    curve = hist.select("b", F.sum("pos").over(w).alias("tp"), F.sum("n").over(w).alias("flagged")).crossJoin(F.broadcast(total)).where("flagged < all")
    scored = curve.withColumn("f1", 2 * F.col("tp") / (F.col("flagged") + F.col("all_pos")))
    best = scored.agg(F.max(F.struct("f1", (-F.col("b")).alias("nb"), "tp", "flagged")).alias("x"))
    return best.select((-F.col("x.nb") / (bins - 1)).alias("threshold"), "x.f1", "x.tp", "x.flagged")


def per_class(rows: DataFrame, y: str = "y", guess: str = "guess") -> DataFrame:
    """Support, precision, recall and F1 of each class that occurs as a label or a guess."""
    cells = rows.groupBy(y, guess).agg(F.count("*").alias("n"))
    ends = cells.select(F.explode(F.array(F.struct(F.col(y).alias("c"), F.col("n").alias("support"), F.lit(0).cast("long").alias("guessed"), F.lit(0).cast("long").alias("hit")), F.struct(F.col(guess).alias("c"), F.lit(0).cast("long").alias("support"), F.col("n").alias("guessed"), F.when(F.col(y) == F.col(guess), F.col("n")).otherwise(0).cast("long").alias("hit")))).alias("x"))
    sums = ends.groupBy("x.c").agg(F.sum("x.support").alias("support"), F.sum("x.guessed").alias("guessed"), F.sum("x.hit").alias("hit"))
    return sums.select(F.col("c").alias("class"), "support", _div(F.col("hit"), F.col("guessed")).alias("precision"), _div(F.col("hit"), F.col("support")).alias("recall"), _div(2 * F.col("hit"), F.col("guessed") + F.col("support")).alias("f1"))


def running_totals(df: DataFrame, by: str, sums: list[str], descending: bool = False, keys: tuple[str, ...] = ()) -> DataFrame:
    """``df`` (one row per key and value of ``by``) with ``upto_<sum>``: totals of the key's rows up to and with this one.

    Rows are partitioned by ranges of the values as they lie, and written, so that partitions are final; a window runs inside each
    of a key's partitions, and one over their totals carries these on. So no task orders all values, wherever they crowd.
    """
    order, part = (F.desc if descending else F.asc), "running part"
    ranged = df.repartitionByRange(*keys, by)
    placed = written(ranged.select("*", F.spark_partition_id().alias(part)), "running")
    totals = placed.groupBy(*keys, part).agg(*[F.sum(c).alias(c) for c in sums])
    over = Window.partitionBy(*keys).orderBy(order(part))
    carried = totals.select(*keys, part, *[(F.sum(c).over(over) - F.col(c)).alias(f"before {c}") for c in sums])
    inside = Window.partitionBy(*keys, part).orderBy(order(by)).rowsBetween(Window.unboundedPreceding, 0)
    summed = placed.select("*", *[F.sum(c).over(inside).alias(f"upto_{c}") for c in sums])
    joined = summed.join(F.broadcast(carried) if not keys else carried, [*keys, part])
    return joined.select(*df.columns, *[(F.col(f"upto_{c}") + F.col(f"before {c}")).alias(f"upto_{c}") for c in sums])


def right_closed_error(rows: DataFrame, bins: int = 10) -> DataFrame:
    """Calibration errors over bins closed on the right; rows with probability 0 are in none."""
    b = F.ceil(F.col("p") * bins)
    r = rows.where("p > 0").groupBy(b.alias("b")).agg(F.count("*").alias("n"), F.avg("p").alias("m"), F.avg("y").alias("s"))
    n = rows.agg(F.count("*").alias("all"), F.avg((F.col("p") - F.col("y")) ** 2).alias("brier"))
    return r.agg(F.sum(F.col("n") * F.abs(F.col("m") - F.col("s"))).alias("e"), F.max(F.abs(F.col("m") - F.col("s"))).alias("mce")).crossJoin(n).select((F.col("e") / F.col("all")).alias("ece"), "mce", "brier")


def best_temperature(rows: DataFrame, grid: list[float]) -> DataFrame:
    """The temperature of a grid with the least log loss, the first of equal ones. The grid is a constant of the query."""
    from .forecast import with_temperature

    each = F.posexplode(F.array(*[F.lit(t) for t in grid])).alias("place", "temperature")
    loss = lambda q: -(F.col("y") * F.ln(q) + (1 - F.col("y")) * F.ln(1 - q))
    losses = rows.select("y", "p", each).groupBy("place", "temperature").agg(F.avg(loss(with_temperature(F.col("p"), F.col("temperature")))).alias("nll"))
    return losses.agg(F.min(F.struct(F.round("nll", 9).alias("nll"), "place", "temperature")).alias("x")).select("x.temperature", "x.nll")


def histogram_auc(rows: DataFrame, bins: int = 101) -> DataFrame:
    """ROC-AUC from a histogram of scores, ties counted half."""
    h = rows.groupBy(F.floor(F.col("p") * (bins - 1)).cast("long").alias("b")).agg(F.sum("y").alias("pos"), F.count("*").alias("n"))
    w = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
    neg = F.col("n") - F.col("pos")
    c = h.select("pos", neg.alias("neg"), F.sum(neg).over(w).alias("below"))
    won = F.sum(F.col("pos") * (F.col("below") - F.col("neg") / 2))
    return c.agg(_div(won, F.sum("pos") * F.sum("neg")).alias("auc"))


def split_intervals(calibration: DataFrame, test: DataFrame, alpha: float, group: str) -> DataFrame:
    """Coverage and width of intervals of half-width ``conformal_quantile`` around predictions, per group."""
    q = conformal_quantile(calibration, alpha).select("quantile")
    hit = F.abs(F.col("y") - F.col("p")) <= F.col("quantile")
    return test.crossJoin(F.broadcast(q)).groupBy(group).agg(F.count("*").alias("n"), F.avg(hit.cast("int")).alias("coverage"), F.max(2 * F.col("quantile")).alias("width"))


def label_sets(calibration: DataFrame, test: DataFrame, alpha: float) -> DataFrame:
    """Label-conditional sets of a binary score: how many hold their label, hold both labels, hold none.

    Each class has its own order statistic of 1 - its probability; a class with too few rows is in every set.
    """
    own = F.when(F.col("y") == 1, 1 - F.col("p")).otherwise(F.col("p"))
    counts = calibration.groupBy("y", own.alias("r")).agg(F.count("*").alias("c"))
    upto = running_totals(counts.where("y = 1"), "r", ["c"]).unionByName(running_totals(counts.where("y = 0"), "r", ["c"]))
    n = calibration.groupBy("y").agg(F.count("*").alias("n"))
    k = F.ceil((F.col("n") + 1) * (1 - alpha))
    cut = upto.select("y", "r", F.col("upto_c").alias("upto")).join(F.broadcast(n), "y").groupBy("y").agg(F.min(F.when(F.col("upto") >= k, F.col("r"))).alias("q"))
    cuts = cut.agg(F.max(F.when(F.col("y") == 1, F.col("q"))).alias("q1"), F.max(F.when(F.col("y") == 0, F.col("q"))).alias("q0"))
    one, nought = F.coalesce(1 - F.col("p") <= F.col("q1"), F.lit(True)), F.coalesce(F.col("p") <= F.col("q0"), F.lit(True))
    sets = test.crossJoin(F.broadcast(cuts)).select("y", one.alias("one"), nought.alias("nought"))
    held = F.when(F.col("y") == 1, F.col("one")).otherwise(F.col("nought"))
    return sets.groupBy("y").agg(F.count("*").alias("n"), F.count_if(held).alias("held"), F.count_if(F.col("one") & F.col("nought")).alias("both"), F.count_if(~F.col("one") & ~F.col("nought")).alias("none"))


def group_bootstrap(rows: DataFrame, group: str, value: str, resamples: int, seed: int) -> DataFrame:
    """Mean of ``value`` with a 95 % interval from resampling groups.

    A group is drawn as often as a seeded hash of it and the resample says (Poisson with mean 1), so a resample needs
    only the groups' sums and no draw from a list of all groups.
    """
    sums = rows.groupBy(group).agg(F.sum(value).alias("total"), F.count(value).alias("n"))
    each = sums.withColumn("resample", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))))
    u = F.pmod(F.xxhash64(F.col(group), F.col("resample"), F.lit(seed)), F.lit(1_000_003)) / 1_000_003.0
    steps, total, weight = [], 0.0, 0.36787944117144233
    for k in range(8):
        total += weight
        steps.append(total)
        weight /= k + 1
    times = sum(((u >= s).cast("int") for s in steps), F.lit(0))
    means = each.withColumn("times", times).groupBy("resample").agg((F.sum(F.col("total") * F.col("times")) / F.sum(F.col("n") * F.col("times"))).alias("mean"))
    whole = sums.agg((F.sum("total") / F.sum("n")).alias("mean"), F.count("*").alias("groups"))
    ci = means.agg(F.percentile("mean", F.lit(0.025)).alias("low"), F.percentile("mean", F.lit(0.975)).alias("high"))
    return whole.crossJoin(ci)


def adaptive_half_width(rows: Iterator[pd.DataFrame], alpha: float, gamma: float, keep: int) -> Iterator[pd.DataFrame]:
    """Fold of one ordered series (columns ``key``, ``t``, ``y``, ``p``): the working alpha and half-width before each row."""
    level, seen = alpha, deque(maxlen=keep)
    for batch in rows:
        out = []
        for key, t, y, p in zip(batch["key"], batch["t"], batch["y"], batch["p"]):
            width = float(np.quantile(seen, min(max(1 - level, 0.0), 1.0))) if seen else 1.0
            error = abs(y - p)
            out.append((key, t, level, width, error <= width))
            level = min(max(level + gamma * (alpha - (error > width)), 0.001), 0.5)
            seen.append(error)
        yield pd.DataFrame(out, columns=["key", "t", "alpha", "width", "covered"])


def adaptive_intervals(rows: DataFrame, key: str, t: str, alpha: float, gamma: float = 0.01, keep: int = 500) -> DataFrame:
    """Adaptive intervals of each key, in the order of its rows; a key's state is the last ``keep`` errors.

    The order is the meaning here, so a key is one task's, read as a stream of batches and never held whole.
    """
    fold = lambda batches: _per_key(batches, lambda b: adaptive_half_width(b, alpha, gamma, keep))
    ordered = rows.select(F.col(key).alias("key"), F.col(t).cast("double").alias("t"), F.col("y").cast("double").alias("y"), "p").repartition("key").sortWithinPartitions("key", "t", "y", "p")
    return ordered.mapInPandas(fold, ordered.select("key", "t").schema.simpleString()[7:-1].replace(":", " ") + ", alpha double, width double, covered boolean")


def _per_key(batches: Iterator[pd.DataFrame], fold) -> Iterator[pd.DataFrame]:
    """``fold`` applied to the runs of equal keys in sorted batches, one run after another."""

    def pieces():
        for batch in batches:
            change = batch["key"].ne(batch["key"].shift()).cumsum()
            for _, piece in batch.groupby(change, sort=False):
                yield piece

    source = pieces()
    ahead = next(source, None)
    while ahead is not None:
        current = ahead["key"].iat[0]

        def run():
            nonlocal ahead
            while ahead is not None and ahead["key"].iat[0] == current:
                piece, ahead = ahead, next(source, None)
                yield piece

        yield from fold(run())


def covered_onsets(alerts: DataFrame, onsets: DataFrame, ahead: float) -> DataFrame:
    """Onsets (``host``, ``onset``) with the earliest alert (``host``, ``t``) less than or ``ahead`` before them; null if none.

    Alerts and onsets meet in time buckets of width ``ahead``, of which an onset looks at its own and the one before.
    """
    a = alerts.select("host", "t", F.floor(F.col("t") / ahead).cast("long").alias("bucket"))
    o = onsets.select("host", "onset", F.explode(F.array(F.floor(F.col("onset") / ahead).cast("long"), F.floor(F.col("onset") / ahead).cast("long") - 1)).alias("bucket"))
    early = F.when((F.col("t") < F.col("onset")) & (F.col("onset") <= F.col("t") + ahead), F.col("t"))
    return o.join(a, ["host", "bucket"], "left").groupBy("host", "onset").agg(F.min(early).alias("alert"))
