"""An event board that late joiners read: the last events in order, and the latest of each kind."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: Events that are replayed to a late joiner.
RING = 300


def ring(events: DataFrame, order: list[str], size: int = RING) -> DataFrame:
    """The last ``size`` events; tasks sort no more than that many each."""
    return events.orderBy(*[F.desc(c) for c in order]).limit(size)


def _version(path: str, batch: int) -> str:
    return f"{path}/version={batch}"


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the boards that were written whole, in order."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(folder):
        return []
    found = [f.getPath() for f in system.listStatus(folder)]
    return sorted(int(p.getName().split("=")[1]) for p in found if p.getName().startswith("version=") and system.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def post(events: DataFrame, kind: str, order: list[str], path: str, batch: int, size: int = RING) -> None:
    """Add a micro-batch to the board at ``path``, as version ``batch``; a batch that is posted again replaces itself.

    The board before it is the version before, at most ``size`` events and one a kind, so a post costs the micro-batch and no more.
    """
    spark = events.sparkSession
    events = events.select(*events.columns)
    before = [v for v in _versions(spark, path) if v < batch]
    if before:
        events = events.unionByName(spark.read.schema(events.schema).parquet(_version(path, before[-1])).select(*events.columns))
    place = F.struct(*order)
    latest = events.groupBy(kind).agg(F.max_by(F.struct(*events.columns), place).alias("e")).select("e.*")
    ring(events, order, size).union(latest).distinct().write.mode("overwrite").parquet(_version(path, batch))


def board(events: DataFrame, kind: str, order: list[str], path: str, checkpoint: str, size: int = RING) -> StreamingQuery:
    """Keep the board at ``path`` up to date with a stream of events, for as long as it has any."""
    return events.writeStream.foreachBatch(lambda df, n: post(df, kind, order, path, n, size)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def joined(spark: SparkSession, path: str, kind: str, order: list[str], schema, size: int = RING) -> tuple[DataFrame, DataFrame]:
    """What a late joiner reads: the last events in order, and the latest of each kind; both empty before the first post."""
    versions = _versions(spark, path)
    events = spark.read.schema(schema).parquet(_version(path, versions[-1])) if versions else spark.createDataFrame([], schema)
    latest = events.groupBy(kind).agg(F.max_by(F.struct(*events.columns), F.struct(*order)).alias("e")).select("e.*")
    return ring(events, order, size).orderBy(*order), latest
