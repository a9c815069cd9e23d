"""A table of live flows over a stream of packets: what each trigger adds to each flow, idle flows forgotten."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "src string, dst string, protocol int, first double, last double, new_flow boolean, fwd_packets long, bwd_packets long, fwd_bytes long, bwd_bytes long"
STATE = "up boolean, first double, last double"


def flow_deltas(packets: DataFrame, delay: str, idle: float = 30.0) -> DataFrame:
    """Rows added by each trigger, one for each flow and start: its first packet says which end is the source.

    A flow ends after ``idle`` seconds without a packet; a later packet of the same ends begins a new one. State is
    three values a flow, kept under its pair of ends, so it spreads over the cluster like the flows do; the watermark
    (``delay``) drops it. Packets need ``ts`` (timestamp), ``timestamp``, ``src_ip``, ``src_port``, ``dst_ip``,
    ``dst_port``, ``protocol`` and ``packet_length``; missing ports count as 0.
    """
    end = lambda ip, port: F.concat_ws(":", F.col(ip), F.coalesce(F.col(port), F.lit(0)))
    a, b = end("src_ip", "src_port"), end("dst_ip", "dst_port")
    keyed = packets.withWatermark("ts", delay).select("ts", "timestamp", "packet_length", "protocol", F.least(a, b).alias("low"), F.greatest(a, b).alias("high"), (a <= b).alias("up"))

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        protocol, low, high = key
        rows = pd.concat(list(batches)).sort_values("timestamp", kind="stable")
        live = state.get if state.exists else None
        out = []
        # A pause longer than the idle time, or the first packet of all, begins a flow.
        last = live[2] if live else None
        pause = rows["timestamp"].diff()
        pause.iloc[0] = rows["timestamp"].iloc[0] - last if live else float("inf")
        for part, piece in rows.groupby((pause > idle).cumsum(), sort=True):
            fresh = part > 0
            up, first = (bool(piece["up"].iloc[0]), float(piece["timestamp"].iloc[0])) if fresh else (live[0], live[1])
            forward = piece["up"] == up
            size = piece["packet_length"]
            last = max(float(piece["timestamp"].iloc[-1]), last if not fresh else float("-inf"))
            live = (up, first, last)
            ends = (low, high) if up else (high, low)
            out.append((*ends, protocol, first, last, bool(fresh), int(forward.sum()), int((~forward).sum()), int(size[forward].sum()), int(size[~forward].sum())))
        state.update(live)
        state.setTimeoutTimestamp(max(int((last + idle) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=[c.strip().split(" ")[0] for c in OUTPUT.split(",")])

    return keyed.groupBy("protocol", "low", "high").applyInPandasWithState(step, OUTPUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def latest_per_kind(events: DataFrame, kind: str, order: str) -> DataFrame:
    """The last event of each kind, as a board that late joiners read; on a stream, in update mode."""
    return events.groupBy(kind).agg(F.max_by(F.struct(*events.columns), F.col(order)).alias("event")).select("event.*")
