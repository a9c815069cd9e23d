"""What filters do to a corpus in every order, by part: a first-failure lookup.

Which of the five filters a document fails is a mask of five bits, so 32 masks and 120 orders are all that can be met: a table of
32 by 120 says at which step an order removes a mask. Tasks index it with the masks of their rows, count removals by part, order, step
and label with ``np.bincount``, and these partial arrays are summed.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..common.store import small_batches, written
from .lookup import BROADCAST_ROWS, looked_up
from .textbatch import slices, utf8

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
STEPS = len(FILTERS)
#: Filters as places in FILTERS by order and step; the step, from 0, at which an order removes a mask, STEPS if it keeps it.
FILTER_AT = np.array([[FILTERS.index(f) for f in order] for order in ORDERS])
_FAILS = (np.arange(1 << STEPS)[:, None, None] >> FILTER_AT) & 1
FIRST_FAILURE = np.where(_FAILS.any(axis=2), _FAILS.argmax(axis=2), STEPS)

# Filter A's words, B's share of distinct words, C's share of capitals, D's characters.
LEAST_WORDS, DISTINCT_SHARE, CAPITAL_SHARE, SYMBOLS = 100, 80, 10, re.compile(rb"[#$%&*|]")
_CAPITALS, _CONTINUED = bytes(range(0x41, 0x5B)), bytes(range(0x80, 0xC0))
_GAP = re.compile(rb"[\x20\x09-\x0D]")
#: Bytes of a text whose words are held at once, and parts whose counts a task holds.
PIECE, PARTS = 1 << 20, 1_000
COUNTS = ("docs", "removed", "fails", "unique_fails", "good_lost", "toxic_lost")


def words_and_distinct(text: bytes) -> tuple[int, int]:
    """Number of words ``[^\\x20\\x09-\\x0D]+`` and of different ones; beyond these, a piece of the text is held at a time."""
    n, seen, at = 0, set(), 0
    while at < len(text):
        gap = _GAP.search(text, at + PIECE)
        end = gap.end() if gap else len(text)
        words = text[at:end].split()
        n, at = n + len(words), end
        seen.update(words)
    return n, len(seen)


def own_failures(text: bytes) -> int:
    """Bits of the filters A to D that a text fails by itself."""
    n, distinct = words_and_distinct(text)
    capitals = len(text) - len(text.translate(None, _CAPITALS))
    points = len(text.translate(None, _CONTINUED))
    return (n < LEAST_WORDS) | (100 * distinct < DISTINCT_SHARE * n) << 1 | (100 * capitals > CAPITAL_SHARE * points) << 2 | (SYMBOLS.search(text) is not None) << 3


def failures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``part`` and ``mask``, bit k for the k-th of FILTERS that it fails.

    A null text is empty, a null part the empty string. E, a text that a smaller id has as well, goes by SHA-256 over the whole table;
    a row without id neither fails it nor makes others fail it, nor do rows of one id and text.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                data, offsets = utf8(part.column("text"))
                masks, digests = [], []
                for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    text = data[a:b].tobytes()
                    masks.append(own_failures(text))
                    digests.append(hashlib.sha256(text).digest())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("part"), pa.array(masks, pa.int32()), pa.array(digests, pa.binary())], ["doc_id", "part", "mask", "digest"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    own = written(rows.mapInArrow(run, f"doc_id {kind}, part string, mask int, digest binary"), "masks")
    repeated = written(own.groupBy("digest").agg(F.count("*").alias("n"), F.min("doc_id").alias("least")).where("n > 1"), "repeated")
    is_repeat = F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False))
    found = looked_up(own, repeated, "digest", "n", "left", max_rows)
    return found.select("doc_id", "part", (F.col("mask") + F.when(is_repeat, 1 << FILTERS.index("E")).otherwise(0)).alias("mask"))


def labelled(rows: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``rows`` with ``good`` and ``toxic``, 0 or 1; an id with several labels has each that one of them gives, one without any has none."""
    own = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg(F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    # Rows without id meet no label, and would all go to one task.
    known, unknown = rows.where("doc_id is not null").join(own, "doc_id", "left"), rows.where("doc_id is null")
    return known.unionByName(unknown, allowMissingColumns=True).fillna(0, ["good", "toxic"])


def removals(rows: DataFrame) -> DataFrame:
    """Sums of COUNTS for every part of ``rows`` (``part``, ``mask``, ``good``, ``toxic``), order (its number) and step (from 0)."""
    orders = np.arange(len(ORDERS))[:, None]
    cells = len(ORDERS) * (STEPS + 1)

    def dense(parts: dict[str, np.ndarray]) -> pa.RecordBatch:
        """The partial arrays, a row for each cell; ``docs``, ``fails`` and ``unique_fails`` do not depend on the order."""
        n = len(parts)
        order, step = np.repeat(np.arange(len(ORDERS)), STEPS), np.tile(np.arange(STEPS), len(ORDERS))
        sums = np.stack(list(parts.values()))
        columns = [pa.array(np.repeat(np.array(list(parts), dtype=object), len(order)), pa.string()), pa.array(np.tile(order, n).astype(np.int32)), pa.array(np.tile(step, n).astype(np.int32))]
        return pa.RecordBatch.from_arrays(columns + [pa.array(sums[:, k].reshape(-1)) for k in range(len(COUNTS))], ["part", "order", "step", *COUNTS])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            coded = batch.column("part").dictionary_encode()
            names, code = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            mask, good, toxic = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("mask", "good", "toxic"))
            # Rows alike in part, mask and labels are indexed once, with their number as weight.
            alike, weight = np.unique((code * 32 + mask) * 4 + good * 2 + toxic, return_counts=True)
            for k in range(len(names)):
                mine = (alike >> 7) == k
                masks, n, label = (alike[mine] >> 2) & 31, weight[mine], alike[mine] & 3
                at = (orders * (STEPS + 1) + FIRST_FAILURE[masks].T).reshape(-1)
                removed = [np.bincount(at, np.tile(w, len(ORDERS)), cells).reshape(len(ORDERS), -1)[:, :STEPS] for w in (n, n * (label >> 1), n * (label & 1))]
                bits = [np.bincount(np.repeat(np.arange(STEPS), len(masks)), np.concatenate([n * test(masks, f) for f in range(STEPS)]), STEPS)[FILTER_AT] for test in (lambda m, f: (m >> f) & 1, lambda m, f: m == 1 << f)]
                sums = np.stack([np.full(FILTER_AT.shape, n.sum()), removed[0], *bits, *removed[1:]]).astype(np.int64)
                held[names[k]] = held[names[k]] + sums if names[k] in held else sums
            if len(held) > PARTS:
                yield dense(held)
                held = {}
        if held:
            yield dense(held)

    partial = rows.select("part", "mask", "good", "toxic").mapInArrow(count, "part string, order int, step int, " + ", ".join(f"{c} long" for c in COUNTS))
    return partial.groupBy("part", "order", "step").agg(*[F.sum(c).alias(c) for c in COUNTS])


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row for each part of ``docs``, ``filter_order`` and ``step`` (from 1), also where nothing is removed.

    Filters, over whole texts: A under 100 words; B 100 * distinct words < 80 * words; C 100 * capitals A-Z > 10 * code points;
    D any of ``#$%&*|``; E the text of a smaller id. ``kept`` documents are left after the step, ``removed`` go here, ``redundant`` fail its
    filter but went before, ``unique_fails`` fail no other; ``good_lost`` and ``toxic_lost`` are those of ``removed`` with quality 1 and
    toxic 1; ``shapley`` is what the step's filter removes in all orders together.

    A null or empty text fails A alone, and E if a smaller id's is null or empty too; a null part is the empty string; repeated rows
    count each; an empty table gives no rows; an id without labels is neither good nor toxic. Other columns are not read.
    """
    sums = removals(labelled(failures(docs, id_col, text_col, part_col, max_rows), labels, id_col))
    order, names = F.get(F.array(*map(F.lit, ORDERS)), F.col("order")), Window.partitionBy("part", "filter")
    upto = Window.partitionBy("part", "order").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    rows = sums.withColumn("filter_order", order).withColumn("filter", F.substring("filter_order", F.col("step") + 1, F.lit(1)))
    return rows.select(
        "part", "filter_order", (F.col("step") + 1).alias("step"), (F.col("docs") - F.sum("removed").over(upto)).alias("kept"), "removed", (F.col("fails") - F.col("removed")).alias("redundant"),
        "unique_fails", "good_lost", "toxic_lost", F.sum("removed").over(names).alias("shapley"),
    )
