"""Ranked lexical search with block-max pruning.

One pass over the texts makes a forward index for a stated set of queries: blocks of consecutive documents with their
lengths and, of the queries' terms, how often each document has them. With the corpus's counts these become impacts, and each
block holds the largest of every term. A query's bound on a block is the weighted sum of these maxima. The blocks with
the highest bounds of all are scored first and give each query a threshold; then every task sorts its blocks by a query's bound and
scores them until the bound drops below the threshold, which rises as documents are found. Only what may be among a
query's best leaves a task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..common.store import delete, new_path, small_batches, written
from .textbatch import ALNUM_WORD, slices, word_hash, words_of

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Documents of a block, blocks that a task sorts at once, blocks of a query that are scored first, (query, term) pairs of one pass over the corpus.
BLOCK, SORTED, FIRST, ENTRIES = 16, 256, 8, 100_000
_LISTS = {"lengths": "long", "first": "int", "terms": "int", "tfs": "long", "block_terms": "int", "block_dfs": "long"}


def query_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(``item_id``, ``query``, ``term``, ``n``) of the different items; ``query`` tells texts of one id apart."""
    found = items.select(F.col(id_col).alias("item_id"), F.col(text_col).alias("text")).where("text is not null").distinct()
    terms = F.regexp_extract_all(F.translate("text", _UPPER, _UPPER.lower()), F.lit(f"({TERM})"))
    return found.select("item_id", F.sha2("text", 256).alias("query"), F.explode(terms).alias("term")).groupBy("item_id", "query", "term").agg(F.count("*").alias("n"))


def _lists(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32), pa.array(np.concatenate(values) if values else [], kind))


def forward_blocks(docs: DataFrame, vocabulary: list[str], block: int = BLOCK) -> DataFrame:
    """Blocks of at most ``block`` documents that stand together: number of documents and of terms, and the postings of ``vocabulary``.

    ``docs`` has ``doc_id`` and ``text``. Documents without a term of the vocabulary are counted but not listed. A term is told by a hash of 64
    bits: another word passes for one of v terms with a chance of v in 2 ** 64.
    """
    hashes = np.array([word_hash(t) for t in vocabulary], dtype=np.uint64)
    order = np.argsort(hashes)
    ranked = hashes[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices(batch, "text"):
                words = words_of(part.column("text"), ALNUM_WORD, fold=True)
                n = np.diff(words.first)
                at = np.minimum(np.searchsorted(ranked, words.hash), len(ranked) - 1)
                hit = np.flatnonzero(ranked[at] == words.hash)
                pairs, tf = np.unique(words.doc()[hit] * len(ranked) + order[at[hit]], return_counts=True)
                doc, term = pairs // len(ranked), pairs % len(ranked)
                listed = np.unique(doc)
                ids, out = part.column("doc_id"), {c: [] for c in ("doc_ids", *_LISTS)}
                for a in range(0, max(len(listed), 1), block):
                    mine = listed[a : a + block]
                    lo, hi = (np.searchsorted(doc, mine[0]), np.searchsorted(doc, mine[-1], "right")) if len(mine) else (0, 0)
                    in_block, dfs = np.unique(term[lo:hi], return_counts=True)
                    own = (mine, n[mine], np.append(np.searchsorted(doc[lo:hi], mine), hi - lo), term[lo:hi], tf[lo:hi], in_block, dfs)
                    for c, v in zip(out, own, strict=True):
                        out[c].append(v)
                rows = len(out["doc_ids"])
                # The slice's first block carries its counts.
                counts = [pa.array([int(x), *[0] * (rows - 1)], pa.int64()) for x in ((n > 0).sum(), n.sum())]
                numbers = pa.array(range(number, number + rows), pa.int64())
                number += rows
                picked = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum([len(v) for v in out["doc_ids"]])]).astype(np.int32), ids.take(pa.array(np.concatenate(out["doc_ids"]))))
                kinds = {"int": pa.int32(), "long": pa.int64()}
                yield pa.RecordBatch.from_arrays([numbers, *counts, picked, *[_lists(out[c], kinds[t]) for c, t in _LISTS.items()]], ["block", "n_docs", "n_terms", "doc_ids", *_LISTS])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"block long, n_docs long, n_terms long, doc_ids array<{kind}>, " + ", ".join(f"{c} array<{t}>" for c, t in _LISTS.items()))


def impacts(tf: np.ndarray, length: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What a term's occurrences count in documents of these lengths, per unit of the term's weight; whole numbers."""
    big = 25 * int(length.max(initial=0)) * n_docs >= 1 << 63
    long = length.astype(object) if big else length
    m = 75 + (25 * long * n_docs) // n_terms
    return ((1_000_000_000 * tf) // (1000 * tf + 12 * m)).astype(np.int64)


@dataclass
class Index:
    """Blocks with impacts and maxima at ``path``, and what weighs the vocabulary's terms."""

    table: DataFrame
    path: str
    vocabulary: dict[str, int]
    weight: np.ndarray

    def drop(self) -> None:
        delete(self.table.sparkSession, self.path)


def build(docs: DataFrame, vocabulary: list[str], block: int = BLOCK) -> Index | None:
    """The index of ``docs`` (``doc_id``, ``text``) for queries of these terms; None if no document has any term at all."""
    spark = docs.sparkSession
    small_batches(spark)
    draft_path, path = new_path(spark, "postings"), new_path(spark, "index")
    draft = forward_blocks(docs, vocabulary, block)
    draft.write.option("compression", "zstd").parquet(draft_path)
    draft = spark.read.schema(draft.schema).parquet(draft_path)
    size = draft.agg(F.sum("n_docs").alias("d"), F.sum("n_terms").alias("t")).first()
    n_docs, n_terms = size["d"] or 0, size["t"] or 0
    if not n_docs:
        delete(spark, draft_path)
        return None
    dfs = draft.select(F.explode(F.arrays_zip("block_terms", "block_dfs")).alias("x")).groupBy("x.block_terms").agg(F.sum("x.block_dfs").alias("df")).collect()  # a row a term
    weight = np.zeros(len(vocabulary), dtype=np.int64)
    for row in dfs:
        weight[row["block_terms"]] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * row["df"] + 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got, most = [], []
            for k in range(batch.num_rows):
                lengths, first, terms, tfs, in_block = (_values(batch, c, k) for c in ("lengths", "first", "terms", "tfs", "block_terms"))
                got.append(impacts(tfs, np.repeat(lengths, np.diff(first)), n_docs, n_terms))
                peak = np.zeros(len(in_block), dtype=np.int64)
                np.maximum.at(peak, np.searchsorted(in_block, terms), got[-1])
                most.append(peak)
            kept = ["block", "doc_ids", "first", "terms", "block_terms"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], _lists(got, pa.int32()), _lists(most, pa.int32())], [*kept, "impacts", "block_most"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"block long, doc_ids array<{kind}>, first array<int>, terms array<int>, block_terms array<int>, impacts array<int>, block_most array<int>"
    index = draft.select("block", "doc_ids", "lengths", "first", "terms", "tfs", "block_terms").where(F.size("doc_ids") > 0).mapInArrow(run, schema)
    index.write.option("compression", "zstd").parquet(path)
    delete(spark, draft_path)
    return Index(spark.read.schema(index.schema).parquet(path), path, {t: i for i, t in enumerate(vocabulary)}, weight)


def _values(batch: pa.RecordBatch, column: str, k: int) -> np.ndarray:
    return batch.column(column)[k].values.to_numpy(zero_copy_only=False)


class _Best:
    """The best documents of each query that a task has met, and the threshold that a further one has to reach."""

    def __init__(self, k: int, least: np.ndarray):
        self.k, self.least, self.held = k, least.astype(np.float64), [[] for _ in least]

    def offer(self, query: int, scores: np.ndarray, ids: list) -> None:
        """Scores that reach the threshold; equal ones go by id, null last."""
        held = self.held[query]
        held += [(-int(s), i is None, i) for s, i in zip(scores, ids, strict=True)]
        if len(held) >= self.k:
            held.sort()
            del held[self.k :]
            self.least[query] = max(self.least[query], -held[-1][0])

    def rows(self) -> Iterator[tuple[int, object, int]]:
        for q, held in enumerate(self.held):
            for s, _, i in held:
                if -s >= self.least[q]:
                    yield q, i, -s


def _score(batch: pa.RecordBatch, weights: np.ndarray, best: _Best) -> int:
    """Score the blocks of a batch for all queries by falling bound; how many (block, query) pairs were scored."""
    n, scored, dense = batch.num_rows, 0, {}
    bounds = np.stack([weights[:, _values(batch, "block_terms", k)] @ _values(batch, "block_most", k).astype(weights.dtype) for k in range(n)])
    order, queries = np.argsort(-bounds, axis=0, kind="stable"), np.arange(len(weights))
    for row in order:
        open_ = queries[(bounds[row, queries] >= best.least) & (bounds[row, queries] > 0)]
        if not len(open_):
            break
        for k in np.unique(row[open_]):
            if k not in dense:
                in_block, first = _values(batch, "block_terms", k), _values(batch, "first", k)
                table = np.zeros((len(in_block), len(first) - 1), dtype=weights.dtype)
                table[np.searchsorted(in_block, _values(batch, "terms", k)), np.repeat(np.arange(len(first) - 1), np.diff(first))] = _values(batch, "impacts", k)
                dense[k] = in_block, table, batch.column("doc_ids")[k].as_py()
            in_block, table, ids = dense[k]
            mine = open_[row[open_] == k]
            scored += len(mine)
            for q, scores in zip(mine, weights[np.ix_(mine, in_block)] @ table, strict=True):
                found = np.flatnonzero((scores >= best.least[q]) & (scores > 0))
                if len(found):
                    best.offer(q, scores[found], [ids[d] for d in found])
    return scored


def _search(blocks: DataFrame, weights: np.ndarray, k: int, least: np.ndarray) -> DataFrame:
    """(``q``, ``doc_id``, ``score``) of a task's best documents for each query, and how many pairs it scored of how many (``q`` null)."""
    kind = blocks.schema["doc_ids"].dataType.elementType
    arrow = {"q": pa.int32(), "score": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(k, least)
        id_type = None
        for batch in batches:
            id_type = batch.schema.field("doc_ids").type.value_type
            for a in range(0, batch.num_rows, SORTED):
                _score(batch.slice(a, SORTED), weights, best)
        if id_type is not None:
            q, ids, scores = zip(*best.rows(), strict=True) if any(best.held) else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(q, arrow["q"]), pa.array(ids, id_type), pa.array(scores, arrow["score"])], ["q", "doc_id", "score"])

    return blocks.mapInArrow(run, f"q int, doc_id {kind.simpleString()}, score long")


def _top(rows: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def first_blocks(index: Index, weights: np.ndarray, n: int = FIRST) -> list[int]:
    """Blocks that are among the ``n`` with the highest bounds of all for some query; at most ``n`` a query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = np.full((len(weights), 0), 0.0), np.zeros((len(weights), 0), dtype=np.int64)
        for batch in batches:
            for k in range(batch.num_rows):
                bound = weights[:, _values(batch, "block_terms", k)] @ _values(batch, "block_most", k).astype(weights.dtype)
                block = np.full((len(weights), 1), batch.column("block")[k].as_py(), dtype=np.int64)
                top = np.hstack([top[0], bound[:, None]]), np.hstack([top[1], block])
                if top[0].shape[1] > 8 * n or k == batch.num_rows - 1:
                    best = np.argsort(-top[0], axis=1, kind="stable")[:, :n]
                    top = np.take_along_axis(top[0], best, 1), np.take_along_axis(top[1], best, 1)
        q, at = np.nonzero(top[0] > 0)
        yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int32)), pa.array(top[1][q, at]), pa.array(top[0][q, at].astype(np.float64))], ["q", "block", "bound"])

    bounds = index.table.select("block", "block_terms", "block_most").mapInArrow(run, "q int, block long, bound double")
    ranked = bounds.withColumn("place", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("bound"), "block")))
    return [r["block"] for r in ranked.where(F.col("place") <= n).select("block").distinct().collect()]


def _weights(index: Index, entries: list) -> np.ndarray:
    """Weight of each term (column) for each query (row) as whole numbers; as doubles, which multiply faster, if no score leaves their range."""
    weights = np.zeros((max((e["q"] for e in entries), default=-1) + 1, len(index.vocabulary)), dtype=np.int64)
    for e in entries:
        term = index.vocabulary[e["term"]]
        weights[e["q"], term] += e["n"] * index.weight[term]
    exact = weights.sum(axis=1).max(initial=0) < (1 << 53) // 1_000_000
    return weights.astype(np.float64) if exact else weights


def search(docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", block: int = BLOCK, entries: int = ENTRIES) -> DataFrame:
    """The ``k`` best documents for each item: ``item_id``, ``rank`` from 1, ``doc_id``, ``score``; fewer if fewer score above 0.

    Terms are ``[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+`` of the whole text, A-Z in lower case. With N documents that have a term, L
    terms in all, n in the document, df documents with a term and tf of it in this one, a term counts
    ``w * ((1000000000 * tf) div (1000 * tf + 12 * m))`` with ``w = floor(1000 * ln((2 * N + 2) / (2 * df + 1)))`` and
    ``m = 75 + (25 * n * N) div L``, as often as the item has it. Equal scores go by id, null last. Nothing that could be among the best is left out.

    Items of one id and different texts are ranked each on its own; equal ones count once; items without terms, and empty tables,
    give no rows. Each row of ``docs`` is a document, repeated rows too; null and empty texts have no terms. Other columns are not
    read. Items with more than ``entries`` different terms in all are searched in several passes, each with an index of its own.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    terms = written(query_terms(items, item_id_col, item_text_col), "query-terms")
    passes = -(-terms.count() // entries)
    kind = items.schema[item_id_col].dataType
    result = []
    for p in range(passes):
        asked = terms.where(F.pmod(F.xxhash64("query", "item_id"), F.lit(passes)) == p).collect()  # about ``entries`` rows
        names = sorted({(r["query"], r["item_id"] is None, r["item_id"]) for r in asked})
        number = {(q, i): at for at, (q, _, i) in enumerate(names)}
        index = build(docs, sorted({r["term"] for r in asked}), block) if asked else None
        if index is None:
            continue
        weights = _weights(index, [{"q": number[r["query"], r["item_id"]], "term": r["term"], "n": r["n"]} for r in asked])
        none = np.zeros(len(names))
        start = _top(_search(index.table.where(F.col("block").isin(first_blocks(index, weights))), weights, k, none), k)
        least = none.copy()
        for r in start.where(F.col("rank") == k).collect():  # at most one a query
            least[r["q"]] = r["score"]
        found = _top(_search(index.table, weights, k, least), k)
        ids = spark.createDataFrame([(at, i) for at, (_, _, i) in enumerate(names)], StructType([StructField("item", LongType()), StructField("item_id", kind)]))
        result.append(found.join(F.broadcast(ids), F.col("q") == F.col("item")).select("item_id", "rank", "doc_id", "score"))
    if not result:
        schema = StructType([StructField("item_id", kind), *spark.range(0).selectExpr("cast(id as int) rank").schema.fields, docs.schema["doc_id"], StructField("score", LongType())])
        return spark.createDataFrame([], schema)
    out = result[0]
    for more in result[1:]:
        out = out.unionByName(more)
    return out
