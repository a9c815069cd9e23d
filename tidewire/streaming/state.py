"""What stateful operators share."""

from __future__ import annotations

from pyspark.sql import SparkSession

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def with_timers(spark: SparkSession) -> None:
    """State with timers needs the RocksDB store; a session that has another store of its own is left as it is."""
    if spark.conf.get(_PROVIDER, "").rsplit(".", 1)[-1] in ("", "HDFSBackedStateStoreProvider"):
        spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
