"""Capture stores: discovery, columnar caches, content-addressed parts, JSON-lines sinks and tails, aggregated states."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def discovered(spark: SparkSession, root: str, layout: str = r"([^/]+)/([^/]+)/[^/]+$", required: tuple[str, ...] = ()) -> DataFrame:
    """Captures below ``root`` as ``dataset``, ``capture``, ``files``, ``bytes``, from file names alone; contents are not read.

    ``layout`` picks data set and capture out of a file's path. Data sets of ``required`` that have no capture fail the
    call; others that are absent are just not listed.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")
    found = files.select(F.regexp_extract("path", layout, 1).alias("dataset"), F.regexp_extract("path", layout, 2).alias("capture"), "length")
    out = found.where("capture <> ''").groupBy("dataset", "capture").agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))
    if required:
        missing = set(required) - {r["dataset"] for r in out.where(F.col("dataset").isin(*required)).select("dataset").distinct().collect()}
        if missing:
            raise FileNotFoundError(f"no captures of {sorted(missing)} below {root}")
    return out


def write_columns(flows: DataFrame, path: str, keys: tuple[str, ...] = ("dataset", "capture"), order: tuple[str, ...] = ("start_time", "seq")) -> None:
    """A columnar cache: a folder per capture, rows in stable time order; Spark's commit marks it complete."""
    flows.repartition(*keys).sortWithinPartitions(*keys, *order).write.partitionBy(*keys).option("compression", "zstd").parquet(path)


def is_complete(spark: SparkSession, path: str) -> bool:
    """Whether a table at ``path`` was committed."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def cached(df: DataFrame, root: str, inputs: DataFrame, **parameters) -> DataFrame:
    """``df`` from a cache named by its inputs (``path``, ``length``, ``modificationTime``) and parameters; made if it is not there.

    The name is a hash of one row per input file, folded in order-free sums, so a changed file or parameter gives another
    place and nothing stale is read.
    """
    spark = df.sparkSession
    h = F.xxhash64("path", "length", "modificationTime")
    row = inputs.agg(F.count("*").alias("n"), F.bit_xor(h).alias("a"), F.sum(F.pmod(h, F.lit(2**31))).alias("b")).first()
    key = hashlib.sha256(json.dumps([row["n"], row["a"], row["b"], df.schema.json(), parameters], sort_keys=True).encode()).hexdigest()[:32]
    path = f"{root}/{key}"
    if not is_complete(spark, path):
        df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def append_part(df: DataFrame, path: str, part: str, window: str) -> None:
    """Add one part of a trajectory table, replacing the same part of an earlier run; windows stay as the part numbers them."""
    df.withColumn("part", F.lit(part)).withColumn(window, F.col(window).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)


def merged_parts(spark: SparkSession, path: str, window: str) -> DataFrame:
    """All parts in the order of their names as one table, each part's windows after those of the parts before it."""
    from pyspark.sql import Window

    table = spark.read.parquet(path).withColumn("part", F.col("part").cast("string"))
    sizes = table.groupBy("part").agg((F.max(window) + 1).alias("windows"))  # a row a part
    before = sizes.select("part", (F.sum("windows").over(Window.orderBy("part")) - F.col("windows")).alias("offset"))
    return table.join(F.broadcast(before), "part").withColumn(window, F.col(window) + F.col("offset")).drop("offset")


def json_sink(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write a stream's rows as JSON lines below ``path``, each trigger's files committed whole."""
    return stream.select(F.to_json(F.struct("*")).alias("value")).writeStream.format("text").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def json_tail(spark: SparkSession, path: str, schema: str | StructType, files: int = 64) -> DataFrame:
    """A stream of the JSON lines of files as they appear, at most ``files`` a trigger; lines that are no JSON object are left out."""
    lines = spark.readStream.option("maxFilesPerTrigger", files).text(path)
    parsed = lines.select(F.from_json("value", schema).alias("row"), F.get_json_object("value", "$").alias("whole"))
    return parsed.where(F.col("whole").isNotNull() & F.col("row").isNotNull()).select("row.*")


def port_of_family(family: Column) -> Column:
    """The port that stands for a family of traffic by its name; 80 for others."""
    # Parts of a family's name and their ports, in the order they are looked for.
    ports = (("irc", 6667), ("spam", 25), ("dns", 53), ("p2p", 6881), ("https", 443))
    out = F.lit(80)
    for part, port in reversed(ports):
        out = F.when(F.lower(family).contains(part), port).otherwise(out)
    return out


def state_endpoints(states: DataFrame, scenario: str) -> DataFrame:
    """``states`` of aggregated windows with source and target addresses that follow from a hash of their scenario, never from a label."""
    digest = F.sha2(F.col(scenario).cast("string"), 256)
    byte = lambda k: F.conv(F.substring(digest, k, 2), 16, 10)
    near = F.concat_ws(".", F.lit("10"), byte(1), byte(3), (F.conv(F.substring(digest, 5, 2), 16, 10).cast("int") % 254 + 1).cast("string"))
    far = F.concat_ws(".", F.lit("172.16"), byte(7), (F.conv(F.substring(digest, 9, 2), 16, 10).cast("int") % 254 + 1).cast("string"))
    return states.withColumn("src_ip", near).withColumn("dst_ip", far)
