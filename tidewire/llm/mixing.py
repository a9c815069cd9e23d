"""Mixing sources to target weights by capped water-filling, in DataFrame functions only.

A source's target is its weight's share of all words, but no more than so many times its own words: sources above that are
clamped there, and what they leave over is shared among the others by weight, until none is above. A source then gives whole
repetitions of every document and, of one more repetition, the documents that come first by a seeded draw; the document
on the edge gives a part of its words. Where the edge lies is found digit by digit of the draw from sums of words, so no task sorts or
holds a source.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..common.store import written
from ..operators.temporal import ranged
from .lookup import BROADCAST_ROWS, looked_up

#: Bits of a draw (the first hexadecimal digits of an MD5) and of the cells that one round looks at.
DRAW_BITS, CELL_BITS = 60, 12
_SPACES = " \t\n\x0b\f\r"


def word_count(text: Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+`` of a text, 0 for null; no array of words is made."""
    marks = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++", "w")
    return F.length(F.rtrim(marks, F.lit(_SPACES))).cast("long")


def draw(key: Column, seed: int) -> Column:
    """A number below 2 ** DRAW_BITS that depends on ``seed`` and the key alone."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))), 1, DRAW_BITS // 4), 16, 10).cast("long")


def water_level(sources: DataFrame, size: str, weight: str, epochs: int) -> float:
    """Words that a weight of 1 gets once sources above ``epochs`` times their size are clamped and the excess is shared anew.

    Each round clamps the sources that the level of the round before lifts above their cap; one row a round reaches the driver.
    """
    total = sources.agg(F.sum(size)).first()[0] or 0
    level, clamped = 0.0, -1
    while True:
        above = F.col(size) * epochs < F.lit(level) * F.col(weight)
        row = sources.agg(F.count_if(above).alias("n"), F.sum(F.when(above, F.col(size) * epochs)).alias("caps"), F.sum(F.when(~above, F.col(weight))).alias("weights")).first()
        if row["n"] == clamped or not row["weights"]:
            return level
        clamped, level = row["n"], (total - (row["caps"] or 0)) / row["weights"]


def source_targets(sized: DataFrame, weights: Sequence[float], epochs: int) -> DataFrame:
    """One row for each ``source`` of ``sized`` (``source``, ``size``): ``source_size``, ``n_docs``, ``weight``, ``target``, ``whole``, ``quota``.

    ``whole`` is how often all of the source is taken, ``quota`` how many words are taken once more.
    """
    found = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    placed = ranged(found.withColumn("unnamed", F.col("source").isNull()), ["unnamed", "source"], "place")
    weight = F.get(F.array(*[F.lit(w) for w in weights]), ((F.col("place") - 1) % len(weights)).cast("int"))
    sources = written(placed.select("source", "source_size", "n_docs", weight.alias("weight")), "sources")
    level = water_level(sources, "source_size", "weight", epochs)
    target = F.least((F.col("source_size") * epochs).cast("double"), F.lit(level) * F.col("weight"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    quota = F.least(F.col("source_size"), F.greatest(F.lit(0).cast("long"), F.floor(F.col("target") + 0.5).cast("long") - F.col("whole") * F.col("source_size")))
    return written(sources.withColumn("target", target).withColumn("whole", whole).withColumn("quota", quota), "targets")


def edges(sized: DataFrame, targets: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Where each source's further repetition ends: ``targets`` with ``low``, ``high``, ``rest`` and ``words``.

    Documents whose draw is below ``low`` are taken whole, those up to ``high``, which have ``words`` words, give ``rest`` of them. A round
    cuts the cell that holds the edge into 2 ** CELL_BITS cells and adds up their words; rounds end when each such cell has one draw, which
    takes as many rounds as the logarithm of the documents to that base.
    """
    edge = targets.select("source", "n_docs", "quota", F.lit(0).cast("long").alias("cell"), F.lit(0).cast("long").alias("before")).where("quota > 0")
    for shift in range(DRAW_BITS - CELL_BITS, -1, -CELL_BITS):
        inside = looked_up(sized, edge, "source", "n_docs", max_rows=max_rows).where(F.shiftright("draw", shift + CELL_BITS) == F.col("cell"))
        kept = ["source", "n_docs", "quota", "before"]
        cells = inside.groupBy(*kept, F.shiftright("draw", shift).alias("cell")).agg(F.sum("size").alias("words"), F.min("draw").alias("least"), F.max("draw").alias("most"))
        upto = F.col("before") + F.sum("words").over(Window.partitionBy("source").orderBy("cell"))
        reached = cells.withColumn("upto", upto).where("upto >= quota").groupBy("source").agg(F.min_by(F.struct("n_docs", "quota", "cell", "words", "upto", "least", "most"), "cell").alias("e")).select("source", "e.*")
        edge = written(reached.withColumn("before", F.col("upto") - F.col("words")), "edge")
        if not edge.where("least < most").limit(1).count():
            break
    ends = edge.select(F.col("source").alias("edge source"), F.shiftleft("cell", shift).alias("low"), (F.shiftleft(F.col("cell") + 1, shift) - 1).alias("high"), (F.col("quota") - F.col("before")).alias("rest"), "words")
    same = F.col("source").eqNullSafe(F.col("edge source"))
    return written(targets.join(ends, same, "left").drop("edge source"), "edges")


def taken(size: Column) -> Column:
    """Words that the mix takes of a document that was joined with its source's :func:`edges`."""
    whole_numbers = "decimal(19,0)"  # a product of two longs
    part = F.floor(size.cast(whole_numbers) * F.col("rest").cast(whole_numbers) / F.col("words").cast(whole_numbers)).cast("long")
    more = F.when(F.col("draw") < F.col("low"), size).when(F.col("draw") <= F.col("high"), F.least(size, part)).otherwise(0)
    return F.col("whole") * size + F.coalesce(more, F.lit(0).cast("long"))


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), draw(F.col(id_col), seed).alias("draw"))


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), epochs: int = 3, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row per row of ``docs``: its id, ``size``, ``source_size``, ``target`` and ``taken``.

    Sources in order of code points, null last, weigh ``weights`` in turn. ``size`` counts words, 0 for a null or empty text;
    ``target`` is the words that the document's source is to give, at most ``epochs`` times its own; ``taken`` the words that the mix
    takes of the document, repetitions counted, at most ``epochs`` times ``size``. A source's ``taken`` add up to its target, rounded, if ids differ. The
    draw depends on the id alone: documents of one id, or without id, that lie on the edge share what is left by size, rounded
    down. Repeated rows give repeated rows, an empty table none; a table without words has targets of 0. Other columns are not
    read. Reruns give the same, however the rows are partitioned.
    """
    sized = written(_sized(docs, id_col, text_col, source_col, seed), "sized")
    ends = edges(sized, source_targets(sized, weights, epochs), max_rows)
    return looked_up(sized, ends, "source", "n_docs", max_rows=max_rows).select("doc_id", "size", "source_size", "target", taken(F.col("size")).alias("taken"))


def mixed(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), epochs: int = 3, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", copy_col: str = "copy") -> DataFrame:
    """The mix itself: a row of ``docs`` for each repetition, numbered from 1 in ``copy_col``, all other columns as they are.

    A repetition that is taken in part has the first words of the text. Documents that are not taken, and those without words, have no
    row. ``docs`` must not have a column ``copy_col``.
    """
    if copy_col in docs.columns:
        raise ValueError(f"docs has a column {copy_col}; name another")
    sized = written(_sized(docs, id_col, text_col, source_col, seed), "sized")
    ends = edges(sized, source_targets(sized, weights, epochs))
    own = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    rows = docs.select(*[docs[c].alias(n) for c, n in own.items()]).withColumn("source", F.col(own[source_col])).withColumn("draw", draw(F.col(own[id_col]), seed)).withColumn("size", word_count(F.col(own[text_col])))
    found = looked_up(rows, ends, "source", "n_docs").withColumn("taken", taken(F.col("size"))).where("taken > 0")
    copies = found.withColumn("copy", F.explode(F.sequence(F.lit(1), F.ceil(F.col("taken") / F.col("size")).cast("int"))))
    left = F.col("taken") - (F.col("copy") - 1) * F.col("size")
    # Only the last copy of a document on the edge is cut: after as many words as are left.
    text = F.col(own[text_col])
    cut = F.array_join(F.slice(F.split(F.regexp_replace(text, r"^[\x20\x09-\x0D]+", ""), r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])"), F.lit(1), left.cast("int")), "")
    copies = copies.withColumn(own[text_col], F.when(left < F.col("size"), F.rtrim(cut, F.lit(_SPACES))).otherwise(text))
    return copies.select(*[F.col(n).alias(c) for c, n in own.items()], F.col("copy").alias(copy_col))
