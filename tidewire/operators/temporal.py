"""Operators on time: grids, islands, look-ahead, sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..common.store import bounded_broadcast, written


def on_grid(df: DataFrame, t: str, width: float, name: str = "window", times: DataFrame | None = None) -> DataFrame:
    """``df`` with the number of its window on a grid anchored at the first row; the anchor is one broadcast row.

    ``times``, if given, has the same times in ``t`` and is cheaper to read for their minimum than ``df`` is: what ``df`` was joined from.
    """
    first = (df if times is None else times).agg(F.min(t).alias("first row"))
    return df.crossJoin(F.broadcast(first)).withColumn(name, F.floor((F.col(t) - F.col("first row")) / width).cast("long")).drop("first row")


def islands(df: DataFrame, keys: list[str], order: list[str], starts: Column, name: str = "run") -> DataFrame:
    """``df`` with the number of its run: each row for which ``starts`` holds, over its key's order, begins one."""
    w = Window.partitionBy(*keys).orderBy(*order)
    flagged = df.withColumn("run starts", F.when(starts, 1).otherwise(0))
    return flagged.withColumn(name, F.sum("run starts").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("run starts")


def gap_segments(df: DataFrame, keys: list[str], t: str, tie: str, gap: float, name: str = "segment") -> DataFrame:
    """Runs that a pause longer than ``gap`` ends."""
    w = Window.partitionBy(*keys).orderBy(t, tie)
    marked = df.withColumn("pause", F.col(t) - F.lag(t).over(w))
    return islands(marked, keys, [t, tie], F.coalesce(F.col("pause") > gap, F.lit(True)), name).drop("pause")


def _back(keys: list[str], *order: str, last: int = 0) -> WindowSpec:
    """All rows from this one on, by a window that runs backwards: Spark extends a frame from its begin row by row, but computes one to its end anew for each row."""
    return Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order]).rowsBetween(Window.unboundedPreceding, last)


def next_time(df: DataFrame, keys: list[str], t: str, tie: str, when: Column, name: str) -> DataFrame:
    """``df`` with the time of the first row, from this one on, for which ``when`` holds."""
    w = _back(keys, t, tie)
    return df.withColumn(name, F.min(F.when(when, F.col(t))).over(w))


def hazard(wait: Column, tau: float) -> Column:
    """exp(-wait / tau); 0 where nothing follows."""
    return F.coalesce(F.exp(-wait / tau), F.lit(0.0))


def sessions(df: DataFrame, key: str, ts: str, gap: str) -> DataFrame:
    """Session windows per key; the same plan serves a stream once it has a watermark."""
    return df.groupBy(key, F.session_window(ts, gap).alias("session"))


def merged_spans(spans: DataFrame, keys: list[str], start: str, end: str, tie: str, gap: float = 0.0) -> DataFrame:
    """Spans of a key that overlap or lie at most ``gap`` apart as one row: start, end, how many."""
    before = Window.partitionBy(*keys).orderBy(start, tie).rowsBetween(Window.unboundedPreceding, -1)
    reach = spans.withColumn("reach", F.max(end).over(before))
    runs = islands(reach, keys, [start, tie], F.coalesce(F.col(start) - F.col("reach") > gap, F.lit(True)))
    return runs.groupBy(*keys, "run").agg(F.min(start).alias("start"), F.max(end).alias("end"), F.count("*").alias("n"))


def merged_spans_sliced(spans: DataFrame, keys: list[str], start: str, end: str, tie: str, width: float, gap: float = 0.0) -> DataFrame:
    """What :func:`merged_spans` gives, for keys that hold a large share of all spans.

    Spans are cut into slices by their start. How far earlier slices reach, and how many runs they begin, is one row a slice.
    """
    cut = "span slice"
    sliced = spans.withColumn(cut, F.floor(F.col(start) / width))
    earlier = Window.partitionBy(*keys).orderBy(cut).rowsBetween(Window.unboundedPreceding, -1)
    reaches = sliced.groupBy(*keys, cut).agg(F.max(end).alias("slice reach")).withColumn("reach before", F.max("slice reach").over(earlier)).drop("slice reach")
    inside = Window.partitionBy(*keys, cut).orderBy(start, tie)
    own = F.max(end).over(inside.rowsBetween(Window.unboundedPreceding, -1))
    reach = F.greatest(own, F.col("reach before"))  # greatest leaves nulls out
    marked = sliced.join(reaches, [*keys, cut]).withColumn("span begins", F.coalesce(F.col(start) - reach > gap, F.lit(True)).cast("int"))
    counts = marked.groupBy(*keys, cut).agg(F.sum("span begins").alias("slice begins")).withColumn("begun before", F.coalesce(F.sum("slice begins").over(earlier), F.lit(0))).drop("slice begins")
    running = F.sum("span begins").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    runs = marked.withColumn("run", running).join(counts, [*keys, cut]).withColumn("run", (F.col("run") + F.col("begun before")).cast("long"))
    return runs.groupBy(*keys, "run").agg(F.min(start).alias("start"), F.max(end).alias("end"), F.count("*").alias("n"))


def next_span(df: DataFrame, spans: DataFrame, keys: list[str], t: str, tie: str) -> DataFrame:
    """``df`` with the ``wait`` until the first span (start, end) that does not end before its time; 0 inside one, null if none follows.

    Of the spans that end no earlier than a row, the one that starts first is the row's. One window over the union of both, no join
    of pairs; spans may overlap.
    """
    points = df.select(*keys, F.col(t).alias("at"), F.lit(0).alias("kind"), F.struct(*df.columns).alias("row"), F.lit(None).cast("double").alias("start"))
    ends = spans.select(*keys, F.col("end").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast(points.schema["row"].dataType).alias("row"), "start")
    ahead = _back(keys, "at", "kind")
    line = points.union(ends).withColumn("next", F.min("start").over(ahead))
    return line.where("kind = 0").select("row.*", F.when(F.col("next").isNotNull(), F.greatest(F.col("next") - F.col("at"), F.lit(0.0))).alias("wait"))


def next_span_sliced(df: DataFrame, spans: DataFrame, keys: list[str], t: str, width: float) -> DataFrame:
    """What :func:`next_span` gives, for keys that hold a large share of all rows; a span's ``end`` may be infinite.

    Time is cut into slices. The first start of the spans that end in a row's own slice is found by a window over the slice, that of those which
    end in later ones is one row a slice.
    """
    cut = lambda c: F.least(F.floor(c / width), F.lit(float(1 << 53)))
    points = df.select(*keys, F.col(t).alias("at"), F.lit(0).alias("kind"), F.struct(*df.columns).alias("row"), F.lit(None).cast("double").alias("start"))
    ends = spans.select(*keys, F.col("end").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast(points.schema["row"].dataType).alias("row"), "start")
    line = points.union(ends).withColumn("span slice", cut(F.col("at")))
    firsts = line.groupBy(*keys, "span slice").agg(F.min("start").alias("first start"))
    later = _back(keys, "span slice", last=-1)
    carried = firsts.withColumn("later start", F.min("first start").over(later)).drop("first start")
    ahead = _back([*keys, "span slice"], "at", "kind")
    found = line.withColumn("next", F.min("start").over(ahead)).where("kind = 0").join(carried, [*keys, "span slice"])
    start = F.least("next", "later start")  # least leaves nulls out
    return found.select("row.*", F.when(start.isNotNull(), F.greatest(start - F.col("at"), F.lit(0.0))).alias("wait"))


def next_time_sliced(df: DataFrame, keys: list[str], t: str, tie: str, when: Column, width: float, name: str) -> DataFrame:
    """What :func:`next_time` gives, for keys that hold a large share of all rows: windows over slices of time, and one row a slice for what follows it."""
    cut = df.withColumn("time slice", F.floor(F.col(t) / width)).withColumn("time met", F.when(when, F.col(t)))
    firsts = cut.groupBy(*keys, "time slice").agg(F.min("time met").alias("first met"))
    later = _back(keys, "time slice", last=-1)
    carried = firsts.withColumn("later met", F.min("first met").over(later)).drop("first met")
    inside = _back([*keys, "time slice"], t, tie)
    met = cut.withColumn("next met", F.min("time met").over(inside)).join(carried, [*keys, "time slice"])
    return met.select(*df.columns, F.coalesce("next met", "later met").alias(name))


def _alike(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """``left`` with the other columns of ``right``, which has one row a key; null keys are alike."""
    named = right.select(*[F.col(k).alias(f"{k} alike") for k in keys], *[c for c in right.columns if c not in keys])
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"{k} alike"))
    return left.join(named, same).drop(*[f"{k} alike" for k in keys])


def previous_sliced(df: DataFrame, keys: list[str], t: str, tie: str, columns: list[str], width: float, name: str) -> DataFrame:
    """``df`` with ``columns`` of the key's row before, as a struct, null for its first: a lag for keys that hold a large share of all rows.

    Windows run over slices of time; the last row of an earlier slice comes from one row a slice.
    """
    cut = "time slice"
    sliced = df.withColumn(cut, F.floor(F.col(t) / width))
    lasts = sliced.groupBy(*keys, cut).agg(F.max_by(F.struct(*columns), F.struct(t, tie)).alias("slice last"))
    carried = lasts.withColumn("slice before", F.lag("slice last").over(Window.partitionBy(*keys).orderBy(cut))).drop("slice last")
    inside = Window.partitionBy(*keys, cut).orderBy(t, tie)
    return _alike(sliced.withColumn(name, F.lag(F.struct(*columns)).over(inside)), carried, [*keys, cut]).withColumn(name, F.coalesce(name, "slice before")).drop(cut, "slice before")


def islands_sliced(df: DataFrame, keys: list[str], t: str, tie: str, starts: Column, width: float, name: str = "run") -> DataFrame:
    """What :func:`islands` gives, for keys that hold a large share of all rows: how many runs earlier slices of time begin is one row a slice."""
    cut, begins = "time slice", "run begins"
    sliced = df.withColumn(cut, F.floor(F.col(t) / width)).withColumn(begins, F.when(starts, 1).otherwise(0))
    counts = sliced.groupBy(*keys, cut).agg(F.sum(begins).alias("slice begins"))
    carried = counts.withColumn("begun before", F.sum("slice begins").over(Window.partitionBy(*keys).orderBy(cut)) - F.col("slice begins")).drop("slice begins")
    inside = Window.partitionBy(*keys, cut).orderBy(t, tie).rowsBetween(Window.unboundedPreceding, 0)
    found = _alike(sliced.withColumn(name, F.sum(begins).over(inside)), carried, [*keys, cut])
    return found.withColumn(name, (F.col(name) + F.col("begun before")).cast("long")).drop(cut, begins, "begun before")


def censored_hazard(df: DataFrame, host: str, capture: str, t: str, tie: str, attack: Column, unknown: DataFrame, tau: float, window: float, least: float = 0.01, width: float = 86_400.0) -> DataFrame:
    """``df`` with ``hazard``, exp(-wait / tau) until the host's next attack, 0 if none follows, null where the wait depends on what nobody knows.

    Unknown are the spans of ``unknown`` (``capture``, ``start``, ``end``) and, in each capture, all that follows its last row by more than ``window``. A row is
    censored if such a span begins no later than the host's next attack, and soon enough to matter (exp(-wait / tau) at
    least ``least``); a row that is itself an attack is known. Null, and not NaN: Spark's aggregates leave nulls out.

    ``width`` is the width of the slices of time that windows run over, so neither a host nor a capture is one task's.
    """
    last = df.groupBy(capture).agg((F.max(t) + window).alias("start")).select(F.col(capture), "start", F.lit(float("inf")).alias("end"))
    spans = unknown.select(F.col("capture").alias(capture), F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end")).unionByName(last)
    ahead = next_time_sliced(df, [host], t, tie, attack, width, "next attack")
    seen = next_span_sliced(ahead, spans, [capture], t, width)
    wait = F.col("next attack") - F.col(t)
    unsure = F.coalesce((F.col("wait") <= F.coalesce(wait, F.lit(float("inf")))) & (F.exp(-F.col("wait") / tau) >= least) & (F.coalesce(wait, F.lit(float("inf"))) != 0), F.lit(False))
    return seen.select(*df.columns, F.when(~unsure, hazard(wait, tau)).alias("hazard"))


def numbered(df: DataFrame, bucket: Column, order: list[str], name: str) -> DataFrame:
    """``df`` with each row's place from 1 in the whole order, without one task that sorts it all.

    ``bucket`` is an integer that never falls along the order. Rows are numbered inside their bucket; the counts of
    the buckets, of which there are few, say how many rows precede it.
    """
    b, own = "numbered bucket", "numbered place"
    placed = df.withColumn(b, bucket)
    counts = placed.groupBy(b).agg(F.count("*").alias("rows"))
    before = counts.select(F.col(b).alias("other bucket"), (F.sum("rows").over(Window.orderBy(b)) - F.col("rows")).alias("rows before"))
    inside = placed.withColumn(own, F.row_number().over(Window.partitionBy(b).orderBy(*order)))
    return inside.join(before, F.col(b).eqNullSafe(F.col("other bucket"))).withColumn(name, F.coalesce("rows before", F.lit(0)) + F.col(own)).drop(b, own, "other bucket", "rows before")


def ranged(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` with each row's place from 1 in the whole order of any columns, without one task that sorts it all.

    The table is range-partitioned, sorted in its partitions and written once, so that places are final; the partitions' counts
    say how many rows precede each.
    """
    part, own, rows = "ranged part", "ranged place", "ranged rows"
    sorted_ = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = written(sorted_.select("*", F.spark_partition_id().alias(part), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias(own)), "ranged")
    counts = placed.groupBy(part).agg(F.count("*").alias(rows))
    before = counts.select(part, (F.sum(rows).over(Window.orderBy(part)) - F.col(rows)).alias(rows))  # a row a partition
    return placed.join(F.broadcast(before), part).withColumn(name, F.col(rows) + F.col(own) + 1).drop(part, own, rows)


def ranged_within(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """``df`` with each row's place from 1 among the rows of its key, also where few keys hold all rows."""
    placed = ranged(df, [*keys, *order], name)
    firsts = placed.groupBy(*[F.col(k).alias(f"{k} of first") for k in keys]).agg(F.min(name).alias("first place"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"{k} of first"))
    return placed.join(firsts, same).select(*df.columns, (F.col(name) - F.col("first place") + 1).alias(name))


def exact_quantiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Quantiles by linear interpolation between order statistics, one row per key; null values do not count."""
    placed = ranged_within(df.select(*keys, value).where(F.col(value).isNotNull()), keys, [value], "place")
    sizes = placed.groupBy(*keys).agg(F.count("*").alias("size"))
    at = {name: (F.col("size") - 1) * share + 1 for name, share in shares.items()}
    wanted = placed.join(bounded_broadcast(written(sizes, "sizes"), 100_000), keys)
    near = F.lit(False)
    for x in at.values():
        near = near | F.col("place").isin(F.floor(x), F.ceil(x))
    # Each order statistic counts by how near its place is.
    return wanted.where(near).groupBy(*keys).agg(*[F.sum(F.when(F.abs(F.col("place") - x) < 1, F.col(value) * (1 - F.abs(F.col("place") - x)))).alias(name) for name, x in at.items()])


def sliced_segments(df: DataFrame, keys: list[str], t: str, tie: str, gap: float, width: float, name: str = "segment") -> DataFrame:
    """What :func:`gap_segments` gives, for keys that hold a large share of all rows.

    Time is cut into slices; windows run inside a key's slice, and what a slice has to know of the earlier ones (their last time, how
    many segments began) comes from one row a slice.
    """
    cut, begins = "slice", "segment begins"
    sliced = df.withColumn(cut, F.floor(F.col(t) / width))
    over = Window.partitionBy(*keys).orderBy(cut)
    lasts = sliced.groupBy(*keys, cut).agg(F.max(t).alias("slice last")).withColumn("slice before", F.lag("slice last").over(over)).drop("slice last")
    inside = Window.partitionBy(*keys, cut).orderBy(t, tie)
    pause = F.col(t) - F.coalesce(F.lag(t).over(inside), F.col("slice before"))
    marked = sliced.join(lasts, [*keys, cut]).withColumn(begins, F.coalesce(pause > gap, F.lit(True)).cast("int"))
    counts = marked.groupBy(*keys, cut).agg(F.sum(begins).alias("slice begins")).withColumn("begun before", F.sum("slice begins").over(over) - F.col("slice begins")).drop("slice begins")
    running = F.sum(begins).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn(name, running).join(counts, [*keys, cut]).withColumn(name, (F.col(name) + F.col("begun before")).cast("long")).select(*df.columns, name)
