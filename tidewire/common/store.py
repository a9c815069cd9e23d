"""Shared scratch storage: tables and files that every executor can see.

Intermediate results go below ``spark.checkpoint.dir``; a folder of our own is used only where that
setting is absent, as in local tests; a cluster without it is refused.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own: list[str] = []


def _clean() -> None:
    for path in _own:
        shutil.rmtree(path, ignore_errors=True)


atexit.register(_clean)


def shared_root(spark: SparkSession) -> str:
    """URI of the folder all executors share."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="tidewire-"))
        spark.sparkContext.setCheckpointDir(f"file://{_own[0]}/rdd")
    return f"file://{_own[0]}"


#: Bytes of a batch that goes to a Python worker.
BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session by bytes, so that batches of long texts stay small.

    Leaves a session that has a bound of its own as it is.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key, str(2**31 - 1))) > 256 << 20:
        spark.conf.set(key, str(BATCH_BYTES))


class Scope:
    """Paths that were named while it was the innermost scope, with the table that each holds."""

    def __init__(self) -> None:
        self.tables: list[tuple[str, DataFrame | None]] = []
        self.kept: list[tuple[str, DataFrame | None]] = []

    def keep(self, table: DataFrame) -> DataFrame:
        """Let a table that :func:`written` gave outlive the scope."""
        mine = [t for t in self.tables if t[1] is table]
        if not mine:
            raise ValueError("not a table of this scope")
        self.kept += mine
        return table


_scopes: list[Scope] = []


@contextmanager
def scope(spark: SparkSession) -> Iterator[Scope]:
    """Scratch tables that are written inside are deleted at the end, but for those that the scope keeps.

    Whatever is used afterwards has to be a kept table or come from kept tables alone: write it inside, since frames are read late.
    """
    own = Scope()
    _scopes.append(own)
    try:
        yield own
    finally:
        _scopes.remove(own)
        if _scopes:
            _scopes[-1].tables += own.kept
        kept = {path for path, _ in own.kept}
        for path, _ in own.tables:
            if path not in kept:
                delete(spark, path)


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing else uses."""
    path = f"{shared_root(spark)}/tidewire/{label}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].tables.append((path, None))
    return path


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back.

    Cuts the lineage without tying the data to the executors that made it, so a lost executor costs no
    recomputation, and makes values of non-deterministic expressions final.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    for own in _scopes[-1:]:
        own.tables = [(p, table if p == path else t) for p, t in own.tables]
    return table


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns that are computed once a row, however often they are used.

    Spark may write a column out again at each use, and does so for filters, which it moves before the column. A generated one it leaves as it is.
    """
    rest = [F.col(c) for c in df.columns if c not in columns]
    return df.select(*rest, F.inline(F.array(F.struct(*[v.alias(c) for c, v in columns.items()]))))


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder that :func:`new_path` named, on whatever file system it is."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def bounded_broadcast(df: DataFrame, max_rows: int, row_bytes: Column | None = None, max_bytes: int = 64 << 20) -> DataFrame:
    """``df`` with a broadcast hint if a count proves that it has at most ``max_rows`` rows, else ``df``.

    Where rows differ in size, ``row_bytes`` is about how many bytes one has, and their sum has to be within ``max_bytes``
    as well. ``df`` should be cheap to count: a written table. Beyond the bound the join that uses it shuffles.
    """
    size = F.sum(row_bytes if row_bytes is not None else F.lit(0)).alias("bytes")
    found = df.agg(F.count("*").alias("rows"), size).first()
    if found["rows"] <= max_rows and (found["bytes"] or 0) <= max_bytes:
        return F.broadcast(df)
    return df
