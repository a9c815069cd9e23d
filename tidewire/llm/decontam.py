"""Benchmark decontamination: size-partitioned MinHash containment search, in DataFrame functions only.

A test item is short and a document long, so their Jaccard similarity says little; what counts is the share
of the item's shingles that the document has. An item's sketch is its smallest shingle hashes, its bottom-k
MinHash. If an item may lack ``m`` shingles, any ``m + 1`` of them include one that a containing document has, so
k is ``m + 1`` and no pair is missed. Items are partitioned by size (powers of two), and a table of bounded size says for each
cell of the hash space which is the smallest partition with a sketch hash in it. A document shows those of its hashes
whose cell holds a partition that it is large enough for; of these, the ones that are sketch hashes make candidates, and
exact containment on all shingles decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..common.store import bounded_broadcast, written

SHINGLE, CONTAINMENT = 5, 80
#: Rows up to which a counted sketch table or candidate table is broadcast, and bytes up to which items with their shingles are.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 32 << 20
#: Cells of the table of sketch hashes; a power of two. A byte each travels with the plan, however many items there are.
CELLS = 1 << 17
_EMPTY_CELL = 255


def shingle_hashes(text: Column, n: int = SHINGLE) -> Column:
    """Hashes of a text's n-word shingles in order, as an array; words end at white space, in lower case.

    A text of fewer words has one shingle, all its words; one without words has none.
    """
    words = F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def of(h: Column) -> Column:
        many = F.slice(F.transform(h, lambda first, i: F.xxhash64(first, *(F.get(h, i + k) for k in range(1, n)))), F.lit(1), F.size(h) - (n - 1))
        few = F.when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<long>"))
        return F.when(F.size(h) >= n, many).otherwise(few)

    # A one-element transform names the words' hashes, so that they are made once.
    return F.flatten(F.transform(F.array(F.transform(words, lambda w: F.xxhash64(w))), of))


def _unsigned(h: Column) -> Column:
    """A shingle hash's rank among all: shifted, so that ranks are positive."""
    return F.shiftrightunsigned(h, 1)


def item_sketches(items: DataFrame, id_col: str, text_col: str, shingle: int, containment: int) -> DataFrame:
    """Distinct shingles, sketch and size partition of each item; items without words are left out."""
    sets = items.select(F.col(id_col).alias("item_id"), F.array_distinct(shingle_hashes(F.coalesce(F.col(text_col), F.lit("")), shingle)).alias("item_shingles"))
    sets = sets.where(F.size("item_shingles") > 0).dropDuplicates(["item_id", "item_shingles"]).withColumn("n_item", F.size("item_shingles"))
    lacking = F.floor(F.col("n_item") * (100 - containment) / 100).cast("int")
    sketch = F.slice(F.sort_array(F.transform("item_shingles", _unsigned)), F.lit(1), lacking + 1)
    return sets.withColumn("part", F.floor(F.log2("n_item")).cast("int")).withColumn("item_sketch", sketch)


def sketch_table(entries: DataFrame) -> bytes:
    """For each cell of the hash space the smallest size partition that has a sketch hash there, else 255; CELLS bytes."""
    cells = entries.groupBy(F.col("rank").bitwiseAND(CELLS - 1).alias("cell")).agg(F.min("part").alias("part")).collect()  # at most CELLS rows
    table = bytearray([_EMPTY_CELL]) * CELLS
    for row in cells:
        table[row["cell"]] = row["part"]
    return bytes(table)


def shown_hashes(shingles: Column, table: bytes, containment: int) -> Column:
    """Those of a text's hashes that may be sketch hashes of an item that the text can contain, as structs of the hash's
    ``rank`` and the number ``n`` of the text's shingles."""

    def of(s: Column) -> Column:
        largest = F.floor(F.log2(100.0 * F.size(s) / containment)).cast("int")
        known = F.unhex(F.lpad(F.hex(F.greatest(largest, F.lit(0))), 2, "0"))
        ranks = F.transform(s, _unsigned)

        def fits(own: Column) -> Column:
            return F.filter(own["ranks"], lambda r: F.substring(F.lit(table), (r.bitwiseAND(CELLS - 1) + 1).cast("int"), F.lit(1)) <= own["known"])

        found = F.flatten(F.transform(F.array(F.struct(ranks.alias("ranks"), known.alias("known"))), fits))
        return F.transform(found, lambda r: F.struct(r.alias("rank"), F.size(s).alias("n")))

    return F.flatten(F.transform(F.array(shingles), of))


def contamination(docs: DataFrame, items: DataFrame, containment: int = CONTAINMENT, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Pairs of a document and an item that it contains: ``doc_id``, ``text_hash``, ``item_id``, ``n_item``, ``n_shared``.

    A document contains an item if it has at least ``containment`` percent of the item's distinct
    ``shingle``-word shingles. Each pair comes once; rows that repeat a document or an item add none, and of
    texts that share an id, ``text_hash`` (xxhash64) says which one. Null ids stay null. Null, empty and
    wordless texts and items match nothing. An item of fewer words than a shingle matches the documents that are
    these words and no more. Empty tables give an empty result; other columns are not read.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash")).where("text is not null")
    items = written(item_sketches(items, item_id_col, item_text_col, shingle, containment), "items")
    entries = items.withColumn("item_key", F.xxhash64("item_shingles")).select("item_id", "item_key", "part", F.explode("item_sketch").alias("rank"))
    ranks = bounded_broadcast(written(entries.groupBy("rank").agg(F.min("part").alias("part")), "ranks"), BROADCAST_ROWS)
    own = shown_hashes(shingle_hashes(F.col("text"), shingle), sketch_table(entries), containment)
    # The outer form: a plain explode has Spark filter on the array first and so make it twice.
    shown = docs.select("doc_id", "text_hash", F.explode_outer(own).alias("own")).select("doc_id", "text_hash", "own.n", "own.rank")
    fits = 100 * F.col("n") >= containment * F.pow(F.lit(2), F.col("part"))
    hits = shown.join(ranks, "rank").where(fits).select("doc_id", "text_hash", "n", "rank").distinct()
    pairs = written(hits.join(entries, "rank").where(fits).select("doc_id", "text_hash", "item_id", "item_key").distinct(), "pairs")

    wanted = bounded_broadcast(written(pairs.select("text_hash").distinct(), "wanted"), BROADCAST_ROWS)
    texts = docs.select("text_hash", "text").join(wanted, "text_hash", "left_semi").dropDuplicates(["text_hash"])
    sets = texts.select("text_hash", F.array_distinct(shingle_hashes(F.col("text"), shingle)).alias("shingles"))
    full = items.withColumn("item_key", F.xxhash64("item_shingles")).select("item_id", "item_key", "item_shingles", "n_item")
    tested = pairs.join(sets, "text_hash")
    same_item = full["item_id"].eqNullSafe(tested["item_id"]) & (full["item_key"] == tested["item_key"])
    tested = tested.join(bounded_broadcast(full, BROADCAST_ROWS, 8 * F.size("item_shingles") + 64, BROADCAST_BYTES), same_item).select(
        "doc_id", "text_hash", full["item_id"], "n_item", F.size(F.array_intersect("item_shingles", "shingles")).cast("long").alias("n_shared")
    )
    found = tested.where(100 * F.col("n_shared") >= containment * F.col("n_item"))
    # Two texts of one item id: the fuller match counts.
    return found.groupBy("doc_id", "text_hash", "item_id").agg(F.max_by("n_item", "n_shared").cast("long").alias("n_item"), F.max("n_shared").alias("n_shared"))


def without_contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that contain no item, with all their columns."""
    pairs = contamination(docs, items, id_col=id_col, text_col=text_col, **options)
    found = written(pairs.select(F.col("doc_id").alias("found: id"), F.col("text_hash").alias("found: hash")).distinct(), "found")
    few = bounded_broadcast(found, BROADCAST_ROWS)
    return docs.join(few, (F.xxhash64(docs[text_col]) == few["found: hash"]) & docs[id_col].eqNullSafe(few["found: id"]), "left_anti")
