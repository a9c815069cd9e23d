"""Captures of any size, cut into byte ranges that tasks read independently.

A capture has no index: each record's length says where the next begins. A task that walks a range looks for the first place from
which a chain of plausible record headers leads on, and reports where its records begin and where the record after them does.
Ranges agree if each begins where the one before ended; one that does not is walked again from there. So the ranges give the
rows of a whole read whatever their size, also where a file is broken: its ranges end there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..common.store import written
from .capture import CHUNK, COLUMNS, HEAD, HOST_IN_NAME, LONGEST, RECORD, SCHEMA, Format, filesystem, listing, read_range

#: Bytes of a range, records that follow one another where a chain is believed, and the most tasks of one read.
RANGE_BYTES, CHAIN, TASKS = 64 << 20, 8, 100_000
#: Bytes that are searched at once for the first record of a range, and bytes beyond them that are read for the chain: where these are too few, as many as a chain can have.
STEP, NEAR = 1 << 16, 1 << 16
_WALKED = "path string, part long, low long, high long, start long, stop long, broken boolean, records long"


def captures(spark: SparkSession, folder: str) -> DataFrame:
    """The captures of a folder: ``path``, ``capture`` (its name), ``capture_host`` (the address in its name, if there is one) and ``bytes``."""
    system, files = listing(folder)
    scheme = folder.split("://", 1)[0] + "://" if "://" in folder else "file://"
    authority = folder.split("://", 1)[1].split("/", 1)[0] if "://" in folder and system.type_name == "hdfs" else ""
    rows = spark.createDataFrame([(f"{scheme}{authority}{f.path}" if system.type_name in ("local", "hdfs") else f"{scheme}{f.path}", f.base_name, f.size) for f in files], "path string, capture string, bytes long")
    host = F.regexp_extract("capture", HOST_IN_NAME, 1)
    return rows.withColumn("capture_host", F.when(host != "", host))


def _plausible(form: Format, block: bytes) -> np.ndarray:
    """Places of a block at which a record may begin: its two lengths and the part of a second are in their range."""
    data = np.frombuffer(block, np.uint8).astype(np.uint32)
    n = len(data) - RECORD + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    four = (lambda k: data[k : k + n] | data[k + 1 : k + 1 + n] << 8 | data[k + 2 : k + 2 + n] << 16 | data[k + 3 : k + 3 + n] << 24) if form.order == "<" else (lambda k: data[k : k + n] << 24 | data[k + 1 : k + 1 + n] << 16 | data[k + 2 : k + 2 + n] << 8 | data[k + 3 : k + 3 + n])
    kept, sent = four(8), four(12)
    return np.flatnonzero((kept > 0) & (kept <= LONGEST) & (sent >= kept) & (sent <= LONGEST) & (four(4) < form.unit))


def first_record(source, form: Format, low: int, high: int, size: int) -> int | None:
    """The first place from ``low`` and before ``high`` from which CHAIN plausible records follow one another, or records up to the file's end."""
    at = low
    while at < high:
        span = min(STEP, high - at)
        place, cut = _chain_start(form, source.read_at(span + NEAR, at), span, size - at)
        if cut:
            place, _ = _chain_start(form, source.read_at(span + CHAIN * (RECORD + LONGEST), at), span, size - at)
        if place is not None:
            return at + place
        at += STEP
    return None


def _chain_start(form: Format, block: bytes, span: int, left: int) -> tuple[int | None, bool]:
    """The first place of a block's ``span`` from which a chain leads on, up to the file's end ``left`` bytes away; and whether the block ended before that could be told."""
    places = _plausible(form, block)
    known = set(places.tolist())
    for place in places[places < span].tolist():
        then, n = place, 0
        while n < CHAIN and then in known:
            then, n = then + RECORD + form.kept.unpack_from(block, then)[0], n + 1
        if n == CHAIN or (n and then == left):
            return place, False
        if len(block) - RECORD < then and len(block) < left:
            return None, True
    return None, False


def _walk(rows: DataFrame, given: bool) -> DataFrame:
    """Where the records of each range begin and end; ``given`` says that ``start`` holds where its first record begins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                system, path = filesystem(row["path"])
                with system.open_input_file(path) as source:
                    size, form = source.size(), Format.of(source.read_at(HEAD, 0), path.rsplit("/", 1)[-1])
                    at, broken, n = row["start"], False, 0
                    if not given:
                        at = None if form is None else HEAD if row["low"] == HEAD else first_record(source, form, row["low"], row["high"], size)
                    start = at
                    while at is not None and at < row["high"] and not broken:
                        part = min(CHUNK, row["high"] - at)
                        found, then, broken = form.records(source.read_at(part + RECORD + LONGEST, at), 0, part)
                        broken = broken or then < part and at + then < row["high"]  # a cut record is the last
                        at, n = at + then, n + len(found)
                out.append(row | {"start": start, "stop": at, "broken": broken, "records": n})
            yield pa.RecordBatch.from_pylist(out, schema=_arrow())

    return rows.select(*[f.split()[0] for f in _WALKED.split(", ")]).mapInArrow(run, _WALKED)


def _arrow() -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
    return pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in _WALKED.split(", ")])


def _spread(rows: DataFrame, size: Column) -> DataFrame:
    """Ranges of about ``size`` bytes each over tasks of RANGE_BYTES, but enough of them for all cores: a task costs more than a small range."""
    found = rows.agg(F.count("*").alias("n"), F.sum(size).alias("bytes")).first()
    wanted = max(2 * rows.sparkSession.sparkContext.defaultParallelism, -(-(found["bytes"] or 0) // RANGE_BYTES))
    return rows.repartition(max(1, min(TASKS, found["n"], wanted)))


def record_ranges(spark: SparkSession, folder: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Ranges of the captures of a folder, of about ``range_bytes`` each, in which records begin: ``path``, ``part``, ``start``, ``stop``, ``records``.

    Files too short for a header have none; a file that is no capture is an error. Rounds end when each range begins where the one before
    it ended; as a rule the first is enough, and each further one puts at least one range of a file right.
    """
    files = captures(spark, folder).where(F.col("bytes") > HEAD)
    parts = files.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("bytes") - 1) / range_bytes))))
    none = F.lit(None).cast("long")
    cut = parts.select("path", "part", F.greatest(F.lit(HEAD), F.col("part") * range_bytes).cast("long").alias("low"), F.least(F.col("bytes"), (F.col("part") + 1) * range_bytes).alias("high"), none.alias("start"), none.alias("stop"), F.lit(False).alias("broken"), none.alias("records")).where("low < high")
    walked = written(_walk(_spread(written(cut, "cut"), F.col("high") - F.col("low")), given=False), "walked")
    earlier = Window.partitionBy("path").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    while True:
        due = F.coalesce(F.max("stop").over(earlier), F.lit(HEAD).cast("long"))
        seen = walked.withColumn("due", due).withColumn("over", F.coalesce(F.max("broken").over(earlier), F.lit(False)))
        begins = F.when(F.col("due") < F.col("high"), F.col("due"))
        wrong = written(seen.where(~F.col("over") & ~begins.eqNullSafe(F.col("start"))), "wrong")
        # Ranges up to which the one before was walked; a file's first wrong range is one of them, and what it is due to begin with is right.
        first = wrong.where("due >= low").select("path", "part", "low", "high", begins.alias("start"), none.alias("stop"), F.lit(False).alias("broken"), none.alias("records"))
        if not first.limit(1).count():
            if wrong.limit(1).count():
                raise RuntimeError("a range was not walked to its end")
            return written(seen.where(~F.col("over") & (F.col("records") > 0)).select("path", "part", "start", "stop", "records"), "ranges")
        again = _walk(_spread(first, F.col("high") - F.col("low")), given=True)
        walked = written(walked.join(first.select("path", "part"), ["path", "part"], "left_anti").unionByName(again), "walked")


def packets(spark: SparkSession, folder: str, columns: list[str] | None = None, range_bytes: int = RANGE_BYTES, ranges: DataFrame | None = None) -> DataFrame:
    """Packets of the captures of a folder, or of one capture, read range by range: the rows that ``format("capture")`` gives.

    Only the fields that ``columns`` names are decoded; ``payload`` and ``capture_host`` have to be named. ``ranges`` (of
    :func:`record_ranges`) spares the walk where it was done before.
    """
    columns = columns or [f.split()[0] for f in SCHEMA.split(", ")]
    if unknown := set(columns) - set(COLUMNS):
        raise ValueError(f"captures have no {sorted(unknown)}")
    rows = ranges if ranges is not None else record_ranges(spark, folder, range_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                system, path = filesystem(row["path"])
                with system.open_input_file(path) as source:
                    yield from read_range(source, path.rsplit("/", 1)[-1], row["start"], row["stop"], columns)

    return _spread(rows.select("path", "start", "stop"), F.col("stop") - F.col("start")).mapInArrow(run, ", ".join(f"{c} {COLUMNS[c]}" for c in columns))
