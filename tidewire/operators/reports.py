"""Reports on detections, classes and links that go beyond one figure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .metrics import detection_report, running_totals
from .temporal import previous_sliced

#: Base rates beyond which average precision says little without them.
EXTREME = (0.05, 0.95)
CRITERIA = ("max_f1", "budgeted_f1", "max_recall_at_budget")


def _share(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def detection_details(rows: DataFrame, threshold: float = 0.5, hours: float | None = None) -> DataFrame:
    """:func:`detection_report` with accuracy, balanced accuracy (over the classes that occur), base rate, false positive rate and, for an
    observation of ``hours``, false alarms an hour. Where the base rate is extreme, ``pr_auc_lift`` is what average precision adds to it, else null."""
    c = F.col
    positives, negatives = c("tp") + c("fn"), c("tn") + c("fp")
    classes = (positives > 0).cast("int") + (negatives > 0).cast("int")
    base = _share(positives, c("n"))
    extreme = (base < EXTREME[0]) | (base > EXTREME[1])
    alarms = c("fp") / F.lit(float(hours)) if hours else F.lit(None).cast("double")
    return detection_report(rows, threshold).select(
        "*", base.alias("base_rate"), _share(c("tp") + c("tn"), c("n")).alias("accuracy"), F.when(classes > 0, (_share(c("tp"), positives) + _share(c("tn"), negatives)) / classes).alias("balanced_accuracy"),
        _share(c("fp"), negatives).alias("fpr"), alarms.alias("false_alarms_per_hour"), F.when(extreme, c("average_precision") - base).alias("pr_auc_lift"),
    )


def score_curve(rows: DataFrame, bins: int = 101) -> DataFrame:
    """Counts at and above every threshold ``b / (bins - 1)`` of a grid, also where no score falls: a table of ``bins`` rows."""
    spark = rows.sparkSession
    hist = rows.groupBy(F.least(F.floor(F.col("p") * (bins - 1)), F.lit(bins - 1)).cast("long").alias("b")).agg(F.sum("y").alias("pos"), F.count("*").alias("n"))
    grid = spark.range(bins).select(F.col("id").alias("b")).join(F.broadcast(hist), "b", "left").na.fill(0, ["pos", "n"])
    above, all_ = Window.orderBy(F.desc("b")).rowsBetween(Window.unboundedPreceding, 0), Window.orderBy(F.desc("b")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    c = F.col
    sums = grid.select("b", F.sum("pos").over(above).alias("tp"), F.sum("n").over(above).alias("flagged"), F.sum("pos").over(all_).alias("positives"), F.sum("n").over(all_).alias("all"))
    fp, fn = c("flagged") - c("tp"), c("positives") - c("tp")
    return sums.select(
        "b", (c("b") / (bins - 1)).alias("threshold"), "tp", fp.alias("fp"), fn.alias("fn"), (c("all") - c("flagged") - fn).alias("tn"), F.when(c("flagged") > 0, c("tp") / c("flagged")).otherwise(1.0).alias("precision"), _share(c("tp"), c("positives")).alias("recall"),
        _share(2 * c("tp"), c("flagged") + c("positives")).alias("f1"), _share(fp, c("all") - c("positives")).alias("fpr"), _share(c("flagged"), c("all")).alias("alert_rate"), _share(c("positives"), c("all")).alias("base_rate"),
    )


def operating_points(rows: DataFrame, budget: float = 2.0, bins: int = 101) -> DataFrame:
    """The threshold that each of CRITERIA picks: the best F1; the best F1, and the highest recall, of those that flag at most ``budget`` times the base rate.

    Thresholds that flag all or nothing do not count; of equal ones the lowest is taken. Where none keeps to the budget, the best F1 of all
    stands in, and ``within_budget`` is false. No rows if a class is missing or no threshold is usable.
    """
    c = F.col
    curve = score_curve(rows, bins).where((c("base_rate") > 0) & (c("base_rate") < 1) & (c("alert_rate") > 0) & (c("alert_rate") < 1))
    fits = c("alert_rate") <= budget * c("base_rate")
    point = F.struct(*[x for x in curve.columns if x != "b"])
    best = lambda value: F.max_by(point, F.struct(value, -c("b")))
    # Where none fits, both budgeted criteria fall back on the best F1.
    picked = curve.agg(best(c("f1")).alias("max_f1"), F.max_by(F.when(fits, point), F.when(fits, F.struct("f1", -c("b")))).alias("budgeted_f1"), F.max_by(F.when(fits, point), F.when(fits, F.struct("recall", -c("b")))).alias("max_recall_at_budget")).where("max_f1 is not null")
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("criterion"), F.coalesce(name, "max_f1").alias("point")) for name in CRITERIA])).alias("x")
    found = picked.select(each).select("x.criterion", "x.point.*")
    return found.withColumn("within_budget", c("alert_rate") <= budget * c("base_rate"))


def confusion_summary(rows: DataFrame, y: str = "y", guess: str = "guess") -> DataFrame:
    """One row on a classifier: accuracy and macro F1 over the classes that occur, what naming the commonest class always would give, and the lift of either."""
    c = F.col
    cells = rows.groupBy(F.col(y).alias("y"), F.col(guess).alias("g")).agg(F.count("*").alias("n"))
    ends = F.explode(F.array(F.struct(c("y").alias("c"), c("n").alias("support"), F.lit(0).cast("long").alias("guessed"), F.when(c("y") == c("g"), c("n")).otherwise(0).alias("hit")), F.struct(c("g").alias("c"), F.lit(0).cast("long").alias("support"), c("n").alias("guessed"), F.lit(0).cast("long").alias("hit")))).alias("x")
    classes = cells.select(ends).groupBy("x.c").agg(F.sum("x.support").alias("support"), F.sum("x.guessed").alias("guessed"), F.sum("x.hit").alias("hit"))
    f1 = _share(2 * c("hit"), c("support") + c("guessed"))
    sums = classes.agg(F.sum("support").alias("n"), F.sum("hit").alias("hits"), F.max("support").alias("most"), F.avg(F.when(c("support") > 0, f1)).alias("macro_f1"), F.count_if(c("support") > 0).alias("classes_present"), F.count_if(c("guessed") > 0).alias("classes_predicted"))
    accuracy, majority = _share(c("hits"), c("n")), _share(c("most"), c("n"))
    lazy = _share(2 * majority / (majority + 1), c("classes_present"))
    macro = F.coalesce("macro_f1", F.lit(0.0))
    return sums.select(F.coalesce("n", F.lit(0)).alias("n"), accuracy.alias("accuracy"), macro.alias("macro_f1"), majority.alias("majority_baseline"), (accuracy - majority).alias("lift"), lazy.alias("macro_f1_baseline"), (macro - lazy).alias("macro_f1_lift"), "classes_present", "classes_predicted")


def class_ranks(rows: DataFrame, scores: str, y: str, classes: int) -> DataFrame:
    """One row on scores over ``classes`` classes (an array, ``y`` the index of the true one): MRR, hits at 1, 3 and 5, and rates over all (row, class) pairs.

    The rank of the true class is one more than the classes that score higher; the guess is the first of the highest.
    """
    c = F.col
    own = F.get(c(scores), c(y).cast("int"))
    rank = 1 + F.size(F.filter(c(scores), lambda s: s > own))
    hit = (F.array_position(c(scores), F.array_max(scores)) - 1 == c(y)).cast("int")
    sums = rows.select(rank.alias("rank"), hit.alias("hit")).agg(F.count("*").alias("n"), F.avg(1 / c("rank")).alias("mrr"), *[F.avg((c("rank") <= k).cast("int")).alias(f"hits{k}") for k in (1, 3, 5)], F.sum("hit").alias("tp"))
    wrong = c("n") - c("tp")
    tn = (classes - 1) * c("n") - wrong
    return sums.select("n", "mrr", "hits1", "hits3", "hits5", _share(c("tp"), c("n")).alias("accuracy"), _share(wrong, wrong + tn).alias("fpr"), _share(wrong, c("n")).alias("fnr"), _share(c("tp"), c("n")).alias("tpr"), _share(tn, wrong + tn).alias("tnr"))


def class_curves(rows: DataFrame, scores: str, y: str) -> DataFrame:
    """For each class of an array of scores: support and ROC-AUC of the class against all others, null where one side is missing.

    Rows are counted by class and score; counts are cumulated range by range of the scores (:func:`running_totals`).
    """
    c = F.col
    each = rows.select(F.col(y).alias("y"), F.posexplode(scores).alias("class", "p"))
    counted = each.groupBy("class", "p").agg(F.count_if(c("y") == c("class")).alias("pos"), F.count("*").alias("n"))
    curve = running_totals(counted, "p", ["pos", "n"], keys=("class",))
    below = c("upto_n") - c("upto_pos") - (c("n") - c("pos"))
    sums = curve.groupBy("class").agg(F.sum(c("pos") * (below + (c("n") - c("pos")) / 2)).alias("won"), F.sum("pos").alias("support"), F.sum("n").alias("n"))
    others = c("n") - c("support")
    return sums.select("class", "support", F.when((c("support") > 0) & (others > 0), c("won") / (c("support") * others)).alias("auc"))


def log_loss(rows: DataFrame, least: float = 1e-7) -> DataFrame:
    """Mean negative log likelihood of a 0/1 label under a probability, which is kept ``least`` away from 0 and 1."""
    p = F.least(F.greatest(F.col("p"), F.lit(least)), F.lit(1 - least))
    return rows.agg(F.count("*").alias("n"), F.avg(-(F.col("y") * F.ln(p) + (1 - F.col("y")) * F.ln(1 - p))).alias("nll"))


def seed_summary(runs: DataFrame, metric: str, value: str) -> DataFrame:
    """Mean and sample standard deviation of each metric over runs of different seeds; 0 for a single run."""
    return runs.groupBy(metric).agg(F.count(value).alias("runs"), F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("sd"))


def hosts_for_share(flows: DataFrame, category: str, host: str, share: float = 0.9) -> DataFrame:
    """Per category how many of its busiest hosts hold ``share`` of its records.

    Hosts are counted by how many records they have, and these counts are cumulated, so a category with most hosts is no one task's list of hosts.
    """
    c = F.col
    sizes = flows.groupBy(F.col(category).alias("category"), host).agg(F.count("*").alias("n")).groupBy("category", "n").agg(F.count("*").alias("hosts"))
    total = sizes.groupBy("category").agg(F.sum(c("n") * c("hosts")).alias("records"), F.sum("hosts").alias("all_hosts"))
    w = Window.partitionBy("category").orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)
    line = sizes.select("category", "n", "hosts", F.coalesce(F.sum(c("n") * c("hosts")).over(w), F.lit(0)).alias("held"), F.coalesce(F.sum("hosts").over(w), F.lit(0)).alias("before")).join(total, "category")
    wanted = share * c("records")
    reached = line.where((c("held") < wanted) & (c("held") + c("n") * c("hosts") >= wanted))
    return reached.select("category", "records", c("all_hosts").alias("hosts"), (c("before") + F.ceil((wanted - c("held")) / c("n"))).alias("covering"))


def time_statistics(edges: DataFrame, node: str, t: str, tie: str, width: float = 30 * 86_400.0) -> DataFrame:
    """Mean and deviation of the time since a node's previous edge, since 0 for its first; a deviation of 0 counts as 1, so that it can divide.

    Edges are taken by slices of ``width`` seconds, so a hub is no one task's.
    """
    placed = previous_sliced(edges, [node], t, tie, [t], width, "was")
    sd = F.stddev_pop("dt")
    dt = F.col(t) - F.coalesce(F.col(f"was.{t}"), F.lit(0.0))
    return placed.select(dt.alias("dt")).agg(F.count("*").alias("n"), F.avg("dt").alias("mean"), F.when(sd > 0, sd).otherwise(1.0).alias("std"))
