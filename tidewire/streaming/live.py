"""Live operators over micro-batches: edges ever seen, observed alerts within a horizon, replay of files."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType


def first_seen_edges(flows: DataFrame, ts: str, delay: str | None = None) -> DataFrame:
    """Each edge once, when it first appears.

    Of a table: its earliest time. Of a stream: the first row of an edge, state for which is kept for ``delay`` after it.
    """
    if flows.isStreaming:
        return flows.withWatermark(ts, delay or "1 hour").select("src_ip", "dst_ip", ts).dropDuplicatesWithinWatermark(["src_ip", "dst_ip"])
    return flows.groupBy("src_ip", "dst_ip").agg(F.min(ts).alias(ts))


def observed_alerts(alerts: DataFrame, horizon: float) -> DataFrame:
    """A stream of (``host``, ``t``, ``category``, ``risk``) as, for each host and trigger, what its observed alerts within the horizon say.

    A host's state is its alerts not older than ``horizon`` seconds before its latest one; benign ones are not kept. Gives
    ``host``, ``t`` (the latest), ``n``, ``risk`` (the highest) and ``categories`` in order of time.
    """
    result = "host string, t double, n long, risk double, categories string"

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = list(zip(*state.get, strict=True)) if state.exists else []
        new = [row for b in batches for row in b[["t", "category", "risk"]].itertuples(index=False, name=None)]
        latest = max([t for t, *_ in kept + new])
        kept = sorted(row for row in kept + [r for r in new if r[1] != "Benign"] if row[0] >= latest - horizon)
        state.update(tuple(list(c) for c in zip(*kept, strict=True)) if kept else ([], [], []))
        yield pd.DataFrame([(key[0], latest, len(kept), max([r for *_, r in kept], default=0.0), ",".join(dict.fromkeys(c for _, c, _ in kept)))], columns=[f.split()[0] for f in result.split(", ")])

    return alerts.groupBy("host").applyInPandasWithState(step, result, "t array<double>, category array<string>, risk array<double>", "update", GroupStateTimeout.NoTimeout)


def replay(spark: SparkSession, path: str, schema: str | StructType, each: Callable[[DataFrame, int], None], checkpoint: str, files: int = 1) -> StreamingQuery:
    """Run ``each`` over the Parquet files at ``path`` in triggers of ``files`` files, as a live source would give them.

    The checkpoint remembers what was replayed, so a run that stops goes on where it was; the rate is bounded by files and
    nothing is dropped.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
