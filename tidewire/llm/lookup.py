"""Joins of many rows with one row a key, whatever share of the rows a key holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..common.store import bounded_broadcast

#: Rows up to which a counted table is broadcast. Beyond it, a key is hot that holds at least one row in HOT; there are HOT such keys at most.
BROADCAST_ROWS, HOT = 200_000, 4_096


def looked_up(rows: DataFrame, table: DataFrame, key: str, count: str, how: str = "inner", max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``rows`` with the columns of ``table``, which has one row for a ``key``; a null key meets a null key.

    ``table`` is written and cheap to read; its column ``count`` says how many rows have the key. A table of at most
    ``max_rows`` rows is broadcast. A larger one is cut: keys that hold a large share of all rows go by broadcast, for there
    can be few of them, and only the others shuffle. ``how`` is inner or left.
    """
    other = f"{key} of table"
    named = table.withColumnRenamed(key, other)
    same = F.col(key).eqNullSafe(F.col(other))
    few = bounded_broadcast(named, max_rows)
    if few is not named:
        return rows.join(few, same, how).drop(other)
    total = table.agg(F.sum(count)).first()[0] or 0
    is_hot = F.col(count) * HOT >= total
    hot = F.broadcast(named.where(is_hot))
    found = rows.join(hot, same, "inner").drop(other)
    rest = rows.join(hot.select(other), same, "left_anti")
    return found.unionByName(rest.join(named.where(~is_hot), same, how).drop(other))
