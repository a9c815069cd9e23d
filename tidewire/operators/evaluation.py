"""Reports on predictions: several labels, lead times, unseen classes, tokens, dynamics, thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .metrics import running_totals
from .temporal import exact_quantiles


def _ratio(a: Column, b: Column) -> Column:
    """a / b; 0 where b is 0."""
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def _f1_sums(hit: Column) -> list[Column]:
    y = F.col("y") == 1
    return [F.count_if(hit & y).alias("tp"), F.count_if(hit & ~y).alias("fp"), F.count_if(~hit & y).alias("fn")]


def _f1() -> Column:
    return _ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))


def score_curve(rows: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """A row per key and distinct score ``p``: positives and rows at it (``pos``, ``n``) and at or above it (``tp``, ``all``)."""
    by_score = rows.groupBy(*keys, "p").agg(F.sum(F.col("y").cast("long")).alias("pos"), F.count("*").alias("n"))
    curve = running_totals(by_score, "p", ["pos", "n"], descending=True, keys=keys)
    return curve.select(*keys, "p", "pos", "n", F.col("upto_pos").alias("tp"), F.col("upto_n").alias("all"))


def top_labels(rows: DataFrame, key: str, label: str, k: int) -> DataFrame:
    """The ``k`` labels of each row with the highest ``p``, ties by label, with their ``place``."""
    best = Window.partitionBy(key).orderBy(F.desc("p"), label)
    return rows.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k)


def multilabel_report(rows: DataFrame, key: str, label: str, threshold: float = 0.5, tops: tuple[int, ...] = (1, 3)) -> DataFrame:
    """Micro, macro and per-row F1, mean average precision over labels that occur, precision and recall among the top labels.

    ``rows`` has a row per ``key`` and ``label`` with ``y`` and ``p``; a key has as many rows as there are labels. One row; nulls
    where there are no rows.
    """
    hit = F.col("p") >= threshold
    by_label = rows.groupBy(label).agg(*_f1_sums(hit))
    micro = by_label.agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")]).select(_f1().alias("micro_f1"))
    macro = by_label.agg(F.avg(_f1()).alias("macro_f1"))
    samples = rows.groupBy(key).agg(*_f1_sums(hit)).agg(F.avg(_f1()).alias("samples_f1"))
    precision = score_curve(rows, (label,)).groupBy(label).agg((F.sum(F.col("pos") * F.col("tp") / F.col("all")) / F.nullif(F.sum("pos"), F.lit(0))).alias("ap")).agg(F.avg("ap").alias("mean_ap"))
    out = micro.crossJoin(macro).crossJoin(samples).crossJoin(precision)
    positives = rows.groupBy(key).agg(F.sum("y").alias("positives"))
    for k in tops:
        hits = top_labels(rows, key, label, k).groupBy(key).agg(F.sum("y").alias("hits")).join(positives, key)
        out = out.crossJoin(hits.agg((F.avg("hits") / k).alias(f"precision_at_{k}"), F.avg(F.col("hits") / F.greatest("positives", F.lit(1))).alias(f"recall_at_{k}")))
    return out


def lead_time_report(covered: DataFrame, at_least: dict[str, float]) -> DataFrame:
    """How long before their onsets episodes were warned of: one row from (``onset``, ``alert``), ``alert`` null where missed.

    Recall at a lead counts over all episodes, missed ones too.
    """
    leads = covered.select(F.lit(0).alias("all"), (F.col("onset") - F.col("alert")).alias("lead"))
    cuts = exact_quantiles(leads, ["all"], "lead", {"p10": 0.1, "median": 0.5, "p90": 0.9}).drop("all")
    counts = leads.agg(
        F.count("*").alias("episodes"), F.count("lead").alias("detected"), F.count_if(F.col("lead").isNull()).alias("missed"), F.avg("lead").alias("mean"), F.min("lead").alias("least"), F.max("lead").alias("most"),
        *[(F.count_if(F.col("lead") >= s) / F.count("*")).alias(name) for name, s in at_least.items()],
    )
    return counts.join(cuts, F.lit(True), "left")


def half_width(rows: DataFrame, alpha: float, bins: int) -> DataFrame:
    """Half-width of a split-conformal interval from a histogram of residuals, with the coverage it has; nulls if rows are too few."""
    bin_ = F.floor(F.abs(F.col("y") - F.col("p")) * (bins - 1)).cast("int").alias("bin")
    upto = F.sum("c").over(Window.orderBy("bin"))
    h = rows.groupBy(bin_).agg(F.count("*").alias("c"))  # at most ``bins`` rows
    n = h.agg(F.sum("c").alias("n"))
    cut = h.select("bin", upto.alias("upto")).crossJoin(F.broadcast(n)).where(F.col("upto") >= F.ceil((F.col("n") + 1) * (1 - alpha))).agg(F.min(F.struct("bin", "upto")).alias("at"))
    return n.crossJoin(cut).select("n", F.least((F.col("at.bin") + 1) / (bins - 1), F.lit(1.0)).alias("half_width"), (F.col("at.upto") / F.col("n")).alias("coverage"))


def classes(pairs: DataFrame, train: DataFrame) -> DataFrame:
    """Per class of (``truth``, ``predicted``): support, precision, recall, F1 and how often training had it (``label`` in ``train``)."""
    support = pairs.groupBy(F.col("truth").alias("class")).agg(F.count("*").alias("support"), F.count_if(F.col("truth") == F.col("predicted")).alias("tp"))
    predicted = pairs.groupBy(F.col("predicted").alias("class")).agg(F.count("*").alias("predicted"))
    seen = train.groupBy(F.col("label").alias("class")).agg(F.count("*").alias("trained"))
    x = support.join(predicted, "class", "full").join(seen, "class", "left").na.fill(0)
    precision, recall = _ratio(F.col("tp"), F.col("predicted")), _ratio(F.col("tp"), F.col("support"))
    return x.select("class", "support", "predicted", "tp", "trained", precision.alias("precision"), recall.alias("recall"), _ratio(2 * F.col("tp"), F.col("support") + F.col("predicted")).alias("f1"))


def unseen_summary(per_class: DataFrame) -> DataFrame:
    """Quality on classes that training had and on all, and the share of rows of classes it had not."""
    there, seen = F.col("support") > 0, F.col("trained") > 0
    of = lambda what, where: F.sum(F.when(where, F.col(what)))
    return per_class.agg(
        F.avg(F.when(there & seen, F.col("f1"))).alias("macro_f1_seen"), F.avg(F.when(there, F.col("f1"))).alias("macro_f1_all"), (of("tp", there & seen) / of("support", there & seen)).alias("accuracy_seen"),
        (of("tp", there) / of("support", there)).alias("accuracy_all"), (F.coalesce(of("support", there & ~seen), F.lit(0)) / of("support", there)).alias("unseen_share"),
    )


#: Tokens whose successors go into an expression.
VOCABULARY = 1_000


def likely_next(transitions: DataFrame) -> DataFrame:
    """The most frequent successor of each category (``before``, ``category``, ``n``), ties by name: ``before``, ``next``."""
    best = Window.partitionBy("before").orderBy(F.desc("n"), "category")
    return transitions.withColumn("place", F.row_number().over(best)).where("place = 1").select("before", F.col("category").alias("next"))


def token_scores(df: DataFrame, keys: list[str], order: list[str], token: str, transitions: DataFrame, steps: int) -> DataFrame:
    """Accuracy of forecasts of each of some steps: running on from the last token, from the true one before, staying, the majority.

    ``on_change`` is the accuracy of running on where the truth differs from the last token; null if it never does. The
    successors of at most VOCABULARY tokens are collected into expressions; more are refused.
    """
    successor = {r["before"]: r["next"] for r in likely_next(transitions).limit(VOCABULARY + 1).collect()}
    if len(successor) > VOCABULARY:
        raise ValueError(f"more than {VOCABULARY} tokens")
    after = lambda c: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in successor.items() for x in kv]), c), c) if successor else c
    w = Window.partitionBy(*keys).orderBy(*order)
    majority = df.groupBy(token).agg(F.count("*").alias("n")).orderBy(F.desc("n"), token).limit(1).select(F.col(token).alias("majority"))
    truth = [F.lead(token, k).over(w) for k in range(1, steps + 1)]
    rows, free = [], F.col(token)
    for k in range(1, steps + 1):
        free = after(free)
        rows.append(F.struct(F.lit(k).alias("step"), F.col(token).alias("last"), F.col(f"t{k}").alias("truth"), free.alias("free"), after(F.col(f"t{k - 1}")).alias("forced")))
    ahead = df.select(token, F.col(token).alias("t0"), *[t.alias(f"t{k}") for k, t in enumerate(truth, 1)])
    long = ahead.select(F.inline(F.array(*rows))).where("truth is not null").crossJoin(F.broadcast(majority))
    right = lambda c: F.avg((F.col("truth") == F.col(c)).cast("int"))
    changed = F.avg(F.when(F.col("truth") != F.col("last"), (F.col("truth") == F.col("free")).cast("int")))
    return long.groupBy("step").agg(F.count("*").alias("n"), right("free").alias("free"), right("forced").alias("forced"), right("last").alias("persistence"), right("majority").alias("majority"), changed.alias("on_change"))


def dynamics(rows: DataFrame, step: str, predicted: str, target: str) -> DataFrame:
    """Per step errors of predicted vectors: MSE, MAE, cosine similarity, relative Frobenius error, growth against the first step."""
    diff = F.zip_with(predicted, target, lambda a, b: a.cast("double") - b.cast("double"))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)
    square = lambda c: total(F.transform(c, lambda x: x.cast("double") * x.cast("double")))
    each = rows.select(step, diff.alias("d"), square(F.col(predicted)).alias("pp"), square(F.col(target)).alias("tt"), total(F.zip_with(predicted, target, lambda a, b: a.cast("double") * b.cast("double"))).alias("pt"))
    each = each.select(step, F.size("d").alias("size"), square(F.col("d")).alias("dd"), total(F.transform("d", F.abs)).alias("ad"), (F.col("pt") / F.sqrt(F.greatest(F.col("pp") * F.col("tt"), F.lit(1e-16)))).alias("cosine"), "tt")
    by_step = each.groupBy(step).agg(
        (F.sum("dd") / F.sum("size")).alias("mse"), (F.sum("ad") / F.sum("size")).alias("mae"), F.avg("cosine").alias("cosine"), (F.sqrt(F.sum("dd")) / F.greatest(F.sqrt(F.sum("tt")), F.lit(1e-7))).alias("relative")
    )
    first = by_step.agg(F.min(F.struct(step, "mse"))["mse"].alias("first"))
    return by_step.crossJoin(F.broadcast(first)).select(step, "mse", "mae", "cosine", "relative", (F.col("mse") / F.greatest("first", F.lit(1e-8))).alias("growth"))


def false_positives_at(rows: DataFrame, recall: float) -> DataFrame:
    """The false-positive rate at the highest score from which ``recall`` of the positives are found; 1 without positives."""
    curve = score_curve(rows)
    totals = rows.agg(F.sum(F.col("y").cast("long")).alias("positives"), F.count("*").alias("rows"))
    x = curve.crossJoin(F.broadcast(totals)).where(F.col("tp") >= recall * F.col("positives"))
    return x.agg(F.coalesce(F.min(_ratio(F.col("all") - F.col("tp"), F.col("rows") - F.col("positives"))), F.lit(1.0)).alias("fpr"))


def selection_score(ap: Column, f1: Column) -> Column:
    """Harmonic mean of two scores; the other one where one is unknown (null or not a number), 0 if both are not positive."""
    a, b = F.nanvl(ap, F.lit(None).cast("double")), F.nanvl(f1, F.lit(None).cast("double"))
    return F.when(b.isNull(), a).when(a.isNull(), b).when(a + b <= 0, 0.0).otherwise(2 * a * b / (a + b))


def best_threshold(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """The score from which F1 is highest, per key, with that F1; of equal ones the lowest."""
    totals = rows.groupBy(*keys).agg(F.sum(F.col("y").cast("long")).alias("positives"))
    f1 = _ratio(2.0 * F.col("tp"), F.col("all") + F.col("positives"))
    curve = score_curve(rows, keys).join(totals, list(keys)).withColumn("f1", f1)
    return curve.groupBy(*keys).agg(F.max(F.struct("f1", (-F.col("p")).alias("low"))).alias("best")).select(*keys, (-F.col("best.low")).alias("threshold"), "best.f1")


def benchmark(rows: DataFrame, predictions: dict[str, Column], scopes: dict[str, Column]) -> DataFrame:
    """A row per model and scope: rows, accuracy, F1 of 0/1 predictions of ``y``; one pass over the rows."""
    each = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(sc).alias("scope"), p.cast("int").alias("guess"), w.alias("within")) for m, p in predictions.items() for sc, w in scopes.items()])
    long = rows.select("y", F.inline(each)).where("within")
    g = long.groupBy("model", "scope").agg(F.count("*").alias("n"), F.avg((F.col("y") == F.col("guess")).cast("int")).alias("accuracy"), *_f1_sums(F.col("guess") == 1))
    return g.select("model", "scope", "n", "accuracy", _f1().alias("f1"))
