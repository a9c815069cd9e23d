"""Live correlation of a host's alerts: what was observed within a horizon, and the newest forecast, which an observation replaces."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.flow import plausibility
from .state import with_timers

BENIGN = "Benign"
#: What a pair counts with none, one or both of its alerts forecast.
PROVENANCE = (1.0, 0.75, 0.5)
_RAW = "host string, kind string, u string, v string, before string, after string, wait double, forecasts int"


def _scored(raw: DataFrame, horizon: float, least: float) -> DataFrame:
    """Raw pairs with their score, weak ones left out; rows of superseded forecasts as they are."""
    seen = F.get(F.array(*map(F.lit, PROVENANCE)), F.col("forecasts"))
    score = F.when(F.col("kind") == "pair", plausibility(F.col("before"), F.col("after")) * (1 - F.col("wait") / horizon) * seen)
    return raw.select("host", "kind", "u", "v", score.alias("score"), (F.col("forecasts") > 0).alias("forecast")).where((F.col("kind") != "pair") | (F.col("score") >= least))


def correlated(alerts: DataFrame, horizon: float, least: float) -> DataFrame:
    """Scored pairs of a table of alerts, and forecasts that a later observation replaces: what :func:`live_correlation` gives of a stream.

    ``alerts`` has ``host``, ``id``, ``t``, ``category``, ``forecast`` and ``issued``, the time of the window that made a forecast (for an observed alert
    its own). Pairs are of one host: observed alerts within the horizon of each other; an observed alert and a forecast issued while it
    was within the horizon; two forecasts of one issue. Hosts meet in buckets of the horizon's width, so an alert meets those
    of two buckets.
    """
    c = F.col
    bucket = lambda x: F.floor(c(x) / horizon).cast("long")
    named = alerts.select("host", c("id").cast("string").alias("id"), "t", "category", "forecast", "issued").dropDuplicates(["host", "id"])
    real, told = named.where(~c("forecast") & (c("category") != BENIGN)), named.where(c("forecast") & (c("category") != BENIGN))
    early = real.select("host", c("id").alias("u"), c("t").alias("tu"), c("category").alias("before"), F.explode(F.array(bucket("t"), bucket("t") + 1)).alias("bucket"))

    def paired(late: DataFrame, at: str, forecasts: int, keep) -> DataFrame:
        other = late.select("host", c("id").alias("v"), c("t").alias("tv"), c("category").alias("after"), "issued", bucket(at).alias("bucket"))
        wait = c("tv") - c("tu")
        met = early.join(other, ["host", "bucket"]).where(keep & (wait <= horizon))
        return met.select("host", F.lit("pair").alias("kind"), "u", "v", "before", "after", wait.alias("wait"), F.lit(forecasts).alias("forecasts"))

    in_order = (c("tu") < c("tv")) | ((c("tu") == c("tv")) & (c("u") < c("v")))
    observed = paired(real, "t", 0, in_order)
    foretold = paired(told, "issued", 1, (c("tu") <= c("issued")) & (c("tu") >= c("issued") - horizon) & (c("tu") <= c("tv")))
    a = told.select("host", "issued", c("id").alias("u"), c("t").alias("tu"), c("category").alias("before"))
    b = told.select("host", "issued", c("id").alias("v"), c("t").alias("tv"), c("category").alias("after"))
    both = a.join(b, ["host", "issued"]).where(in_order & (c("tv") - c("tu") <= horizon)).select("host", F.lit("pair").alias("kind"), "u", "v", "before", "after", (c("tv") - c("tu")).alias("wait"), F.lit(2).alias("forecasts"))
    latest = named.where(~c("forecast")).groupBy("host").agg(F.max("t").alias("latest"))
    gone = told.join(latest, "host").where(c("latest") > c("issued")).select("host", F.lit("superseded").alias("kind"), c("id").alias("u"), *[F.lit(None).cast("string").alias(x) for x in ("v", "before", "after")], F.lit(None).cast("double").alias("wait"), F.lit(1).alias("forecasts"))
    return _scored(observed.union(foretold).union(both).union(gone), horizon, least)


class _Correlation(StatefulProcessor):
    """A host's observed alerts within the horizon, by id, and its newest forecast."""

    def __init__(self, horizon: float):
        self.horizon = horizon

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.observed = handle.getMapState("observed", "id string", "t double, category string")
        self.told = handle.getMapState("told", "id string", "t double, category string")
        self.now = handle.getValueState("now", "latest double, issued double, due long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        new = pd.concat(list(rows)).sort_values(["issued", "forecast", "t", "id"], kind="stable")
        # A host's alerts of a horizon are read once a trigger.
        observed = {k[0]: tuple(v) for k, v in self.observed.iterator()}
        told = {k[0]: tuple(v) for k, v in self.told.iterator()}
        kept = set(observed), set(told)
        latest, issued, due = self.now.get() if self.now.exists() else (float("-inf"), float("-inf"), None)
        out = []
        for name, t, category, forecast, of in new[["id", "t", "category", "forecast", "issued"]].itertuples(index=False, name=None):
            if not forecast:
                if t < latest - self.horizon or name in observed:
                    continue  # too late, or given before
                latest = max(latest, t)
                if told and latest > issued:
                    out += [(key[0], "superseded", f, None, None, None, None, 1) for f in told]
                    told = {}
                for stale in [k for k, (at, _) in observed.items() if at < latest - self.horizon]:
                    del observed[stale]
                if category == BENIGN:
                    continue
                out += [self._pair(key[0], *sorted([(at, k, c), (t, name, category)]), 0) for k, (at, c) in observed.items() if abs(t - at) <= self.horizon]
                observed[name] = (t, category)
            elif of >= max(latest, issued) and name not in told and category != BENIGN:
                if of > issued:
                    out += [(key[0], "superseded", f, None, None, None, None, 1) for f in told]
                    told, issued = {}, of
                out += [self._pair(key[0], (at, k, c), (t, name, category), 1) for k, (at, c) in observed.items() if of - self.horizon <= at <= min(of, t) and t - at <= self.horizon]
                out += [self._pair(key[0], *sorted([(at, k, c), (t, name, category)]), 2) for k, (at, c) in told.items() if abs(t - at) <= self.horizon]
                told[name] = (t, category)
        for state, now, before in ((self.observed, observed, kept[0]), (self.told, told, kept[1])):
            for gone in before - set(now):
                state.removeKey((gone,))
            for fresh in set(now) - before:
                state.updateValue((fresh,), now[fresh])
        # A host that is silent for a horizon after its last alert or forecast is forgotten.
        then = int((max([latest, issued, *[at for at, _ in told.values()]]) + self.horizon) * 1000) + 1
        if due != then:
            if due is not None:
                self.handle.deleteTimer(due)
            self.handle.registerTimer(then)
        self.now.update((latest, issued, then))
        if out:
            yield pd.DataFrame(out, columns=[f.split()[0] for f in _RAW.split(", ")])

    @staticmethod
    def _pair(host: str, early: tuple, late: tuple, forecasts: int) -> tuple:
        return (host, "pair", early[1], late[1], early[2], late[2], late[0] - early[0], forecasts)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.now.exists() and self.now.get()[2] == expiredTimerInfo.getExpiryTimeInMs():
            self.observed.clear()
            self.told.clear()
            self.now.clear()
        return iter(())

    def close(self) -> None:
        pass


def live_correlation(alerts: DataFrame, ts: str, delay: str, horizon: float = 180.0, least: float = 0.35) -> DataFrame:
    """A stream of alerts and forecasts as scored pairs, each given once, and rows of forecasts that are superseded.

    Columns of ``alerts`` are those of :func:`correlated`, and ``ts`` their time of arrival (``issued`` as a timestamp). An alert that comes again is
    known by its id and pairs with nothing a second time; one older than the horizon before the host's latest is left out. An observation
    later than a forecast's issue replaces the whole forecast, as a newer issue does. The size of triggers does not matter as
    long as alerts come in the order of ``issued``.
    """
    with_timers(alerts.sparkSession)
    rows = alerts.withWatermark(ts, delay).select(F.col("host").cast("string").alias("host"), F.col("id").cast("string").alias("id"), "t", "category", "forecast", "issued", ts)
    return _scored(rows.groupBy("host").transformWithStateInPandas(_Correlation(horizon), _RAW, "append", "eventTime"), horizon, least)
