"""Samples, targets and baselines for forecasting on host series.

Frames of a bounded number of rows keep windows small; all of them are partitioned by host and segment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .temporal import previous_sliced


def forecast_samples(df: DataFrame, keys: list[str], t: str, tie: str, past: int, steps: int, size: int) -> DataFrame:
    """One row per position with ``past`` rows up to it and ``steps`` buckets of ``size`` rows after it, inside its ``keys``.

    ``df`` has ``attack`` (boolean), ``category`` (string) and ``value`` (double). A bucket is attacked if one of its
    rows is; its categories are the distinct ones other than Benign, sorted; its value is the mean. Shorter runs give no row.
    """
    w = Window.partitionBy(*keys).orderBy(t, tie)
    ahead = w.rowsBetween(1, steps * size)
    row = F.struct("attack", "category", "value")
    framed = df.select(*keys, tie, t, F.collect_list("value").over(w.rowsBetween(1 - past, 0)).alias("input"), F.collect_list(row).over(ahead).alias("future"))
    full = framed.where((F.size("input") == past) & (F.size("future") == steps * size))
    bucket = lambda b: F.slice(F.col("future"), b * size + 1, size)
    each = F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda b: F.struct(
        F.exists(bucket(b), lambda r: r["attack"]).alias("attack"), F.array_sort(F.array_distinct(F.transform(F.filter(bucket(b), lambda r: r["category"] != "Benign"), lambda r: r["category"]))).alias("categories"),
        (F.aggregate(bucket(b), F.lit(0.0), lambda a, r: a + r["value"]) / size).alias("value"),
    ))
    return full.select(*keys, tie, t, "input", each.alias("steps"))


def hazard_targets(attack_now: Column, steps: Column) -> Column:
    """First attacked step (from 0, null if none), which steps are at risk, and whether the row is attacked already."""
    first = F.array_position(steps, True)
    onset = F.when(first > 0, first - 1).cast("int")
    at_risk = F.transform(steps, lambda x, i: ~attack_now & (onset.isNull() | (i <= onset)))
    return F.struct(F.when(~attack_now, onset).alias("onset"), at_risk.alias("at_risk"), attack_now.alias("censored"))


def padded_history(df: DataFrame, keys: list[str], t: str, tie: str, value: str, length: int, pad: str = "zero", name: str = "history") -> DataFrame:
    """``df`` with the last ``length`` values up to each row; shorter histories are led by zeros, or by their first value (``edge``)."""
    w = Window.partitionBy(*keys).orderBy(t, tie).rowsBetween(1 - length, 0)
    seen = F.collect_list(value).over(w)
    lead = F.lit(0.0) if pad == "zero" else F.get(F.col(name), F.lit(0))
    return df.withColumn(name, seen).withColumn(name, F.concat(F.array_repeat(lead, F.lit(length) - F.size(name)), F.col(name)))


def rollout_samples(df: DataFrame, keys: list[str], t: str, tie: str, value: str, past: int, steps: int) -> DataFrame:
    """One row per position with ``past`` rows up to it and a next one: ``input``, the next ``steps`` values as ``future`` and how many seconds each lies from it.

    A future that the segment ends in repeats its last value and time; ``future_valid`` says which are real. ``input_seconds`` are at most 0.
    """
    w = Window.partitionBy(*keys).orderBy(t, tie)
    row = F.struct(F.col(value).alias("v"), F.col(t).alias("t"))
    framed = df.select(*keys, tie, t, F.collect_list(row).over(w.rowsBetween(1 - past, 0)).alias("seen"), F.collect_list(row).over(w.rowsBetween(1, steps)).alias("next"))
    full = framed.where((F.size("seen") == past) & (F.size("next") > 0))
    lack = F.lit(steps) - F.size("next")
    ahead = F.concat("next", F.array_repeat(F.element_at("next", -1), lack))
    seconds = lambda rows: F.transform(rows, lambda r: r["t"] - F.col(t))
    values = lambda rows: F.transform(rows, lambda r: r["v"])
    valid = F.concat(F.array_repeat(F.lit(True), F.size("next")), F.array_repeat(F.lit(False), lack))
    return full.select(*keys, tie, values("seen").alias("input"), seconds("seen").alias("input_seconds"), values(ahead).alias("future"), seconds(ahead).alias("future_seconds"), valid.alias("future_valid"))


def next_row_samples(df: DataFrame, keys: list[str], t: str, tie: str, value: str, length: int, need: int) -> DataFrame:
    """Padded histories with the next row's value as target, for rows with at least ``need`` real values and a next row."""
    w = Window.partitionBy(*keys).orderBy(t, tie)
    marked = df.select(*keys, tie, t, value, F.lead(value).over(w).alias("target"), F.row_number().over(w).alias("position"))
    padded = padded_history(marked, keys, t, tie, value, length)
    return padded.where((F.col("position") >= need) & F.col("target").isNotNull()).select(*keys, tie, "history", "target")


def token_history(df: DataFrame, keys: list[str], t: str, tie: str, token: str, length: int, pad: int, begin: int) -> DataFrame:
    """Token sequences: padding, a begin token, then at most ``length`` - 1 tokens up to the row."""
    w = Window.partitionBy(*keys).orderBy(t, tie).rowsBetween(2 - length, 0)
    framed = df.select(*keys, tie, F.collect_list(token).over(w).alias("seen"))
    lead = F.array_repeat(F.lit(pad), F.lit(length - 1) - F.size("seen"))
    return framed.select(*keys, tie, F.concat(lead, F.array(F.lit(begin)), F.col("seen")).alias("tokens"))


def cumulative_hazard(hazards: Column) -> Column:
    """Chance of at least one event in any step: 1 - prod(1 - h)."""
    return 1 - F.aggregate(hazards, F.lit(1.0), lambda a, h: a * (1 - h))


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def logit(p: Column, least: float = 1e-6) -> Column:
    q = F.least(F.greatest(p, F.lit(least)), F.lit(1 - least))
    return F.ln(q / (1 - q))


def with_temperature(p: Column, temperature: float | Column) -> Column:
    return sigmoid(logit(p) / temperature)


def time_encoding(t: Column, size: int, base: float = 10_000.0) -> Column:
    """Cosines of time at ``size`` frequencies that fall geometrically from 1 to 1 / ``base``."""
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: F.cos(t * F.pow(F.lit(base), -k / F.lit(float(max(size - 1, 1))))))


def normal_step(dt: Column, width: float) -> Column:
    """A time step in windows, from 0 to 300."""
    return F.least(F.greatest(dt / max(0.1, width), F.lit(0.0)), F.lit(300.0))


def alert_band(p: Column, threshold: float) -> Column:
    room = 1 - threshold
    return F.when(p >= threshold + 0.6 * room, "CRITICAL").when(p >= threshold + 0.25 * room, "ELEVATED").when(p >= threshold, "WARNING").otherwise("NOMINAL")


def forecast_band(risk: Column, half_width: Column) -> Column:
    clip = lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
    return F.struct(clip(risk - half_width).alias("low"), clip(risk + half_width).alias("high"))


def lead_seconds(path: Column, now: Column, threshold: float, step: float) -> Column:
    """Seconds until a forecast first reaches the threshold; 0 if it is reached now, null if it never is."""
    at = F.array_position(F.transform(path, lambda p: p >= threshold), True)
    return F.when(now >= threshold, 0.0).when(at > 0, at * step)


def persistence_error(df: DataFrame, keys: list[str], t: str, tie: str, value: str, width: float = 86_400.0) -> DataFrame:
    """Mean squared error of repeating the last value, and the variance a forecast has to beat; rows are taken by slices of ``width`` seconds."""
    placed = previous_sliced(df, keys, t, tie, [value], width, "was")
    steps = placed.select(F.col(value).alias("x"), F.col(f"was.{value}").alias("b")).where("b is not null")
    return steps.agg(F.count("*").alias("n"), F.avg((F.col("x") - F.col("b")) ** 2).alias("mse"), F.var_pop("x").alias("variance"))


def transition_power(steps: DataFrame, power: int) -> DataFrame:
    """Probabilities (``before``, ``category``, ``p``) after ``power`` steps. The state space is the few categories."""
    out = steps.select("before", "category", "p")
    for _ in range(power - 1):
        out = out.select("before", F.col("category").alias("via"), F.col("p").alias("p1")).join(steps.select(F.col("before").alias("via"), "category", "p"), "via").groupBy("before", "category").agg(F.sum(F.col("p1") * F.col("p")).alias("p"))
    return out


def forecast_branches(steps: DataFrame, n: int = 3) -> DataFrame:
    """The ``n`` likeliest next categories of each, what most likely follows them, and the kind of turn it is."""
    from ..functions.labels import lane_rank

    rank = Window.partitionBy("before").orderBy(F.desc("p"), "category")
    ranked = steps.select("before", "category", "p", F.row_number().over(rank).alias("rank"))
    follow = ranked.where("rank = 1").select(F.col("before").alias("category"), F.col("category").alias("then"))
    a, b = lane_rank(F.col("before")), lane_rank(F.col("category"))
    kind = F.when(b > a, "escalation").when(b < a, "backoff").otherwise("pivot")
    return ranked.where(F.col("rank") <= n).join(follow, "category", "left").select("before", "rank", "category", "p", "then", kind.alias("kind"))
