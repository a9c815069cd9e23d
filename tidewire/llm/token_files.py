"""Token-id files compressed by Re-Pair, with random access.

A shard holds the ids of consecutive documents. Re-Pair replaces its most frequent pairs of
neighbouring symbols by nonterminals until no pair is left that occurs often enough to gain a byte; no pair spans two
documents. The file stores the rules, each
nonterminal's expansion length and the symbols of each document, so any range of a document is decoded from the
symbols that cover it.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..common.store import bounded_broadcast, new_path, small_batches
from .byte_bpe import encoder
from .files import create, open_for_reading
from .textbatch import slices

END = 2
#: Stretches that a worker keeps the ids of.
CACHE = 700_000
#: Ids from which a shard is closed, and occurrences that a rule needs: it takes 12 bytes, an occurrence saves a symbol of up to 3.
SHARD_IDS, LEAST = 1 << 20, 5
MAGIC, HEADER = b"RPT1", "<4sBIQQQI"
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def frequent_pairs(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that occur LEAST times, in order, and how often each does."""
    pairs = np.sort(pairs)
    ends = np.flatnonzero(np.append(pairs[1:] != pairs[:-1], True)) if len(pairs) else np.zeros(0, np.int64)
    counts = np.diff(ends, prepend=-1)
    often = counts >= LEAST
    return pairs[ends[often]], counts[often]


def places_among(pairs: np.ndarray, known: np.ndarray) -> np.ndarray:
    """The place of each pair in the ordered ``known`` ones, -1 if it is none; a hash table first, a search where it collides."""
    shift = np.uint64(64 - max(8, len(known).bit_length() + 4))
    table = np.full(1 << (64 - int(shift)), -1, np.int32)
    table[(known * _SPREAD >> shift).view(np.int64)] = np.arange(len(known), dtype=np.int32)
    found = table[(pairs * _SPREAD >> shift).view(np.int64)]
    wrong = np.flatnonzero((found >= 0) & (known[found] != pairs))
    if len(wrong):
        at = np.minimum(np.searchsorted(known, pairs[wrong]), len(known) - 1)
        found[wrong] = np.where(known[at] == pairs[wrong], at, -1)
    return found


def _chosen(at: np.ndarray, rank: np.ndarray, n: int) -> np.ndarray:
    """Which occurrences, given by place and their pair's rank, are replaced: those that outrank both that overlap them.

    Of overlapping occurrences of one pair (a run of one symbol) every other one is taken.
    """
    ranks = np.zeros(n + 1, np.int64)  # of the pair that begins one place before
    ranks[at + 1] = rank
    left, right = ranks[at], ranks[at + 2]
    chosen = (left < rank) & (right <= rank)
    run = np.flatnonzero(left == rank)
    if len(run):
        places = at[run]
        begins = np.flatnonzero(np.append(True, np.diff(places) != 1))
        start = np.repeat(places[begins] - 1, np.diff(np.append(begins, len(places))))
        offset = places - start - (ranks[start] > rank[run])  # where a better pair takes the run's first symbol, it begins one later
        chosen[run] = (offset & 1 == 0) & (right[run] <= rank[run])
    return chosen


def re_pair(symbols: np.ndarray, last: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Compressed symbols, which of them end a document, and the rules (pairs), numbered from ``base``.

    Each round counts pairs exactly and replaces, of all that occur LEAST times, the occurrences that no more frequent pair overlaps;
    rounds end when no such pair is left. After the first, only places next to a new nonterminal and those that
    lost to an overlapping pair can hold one, so a round costs what the last one changed.
    """
    rules: list[np.ndarray] = []
    known = 0
    open_ = np.flatnonzero(~last[:-1])  # no pair spans documents
    while len(open_):
        pairs = (symbols[open_].astype(np.uint64) << np.uint64(32)) | symbols[open_ + 1]
        often, counts = frequent_pairs(pairs)
        if not len(often):
            break
        of = places_among(pairs, often)
        at, of = open_[of >= 0], of[of >= 0]
        rank = (counts.astype(np.int64) << 32) + np.arange(1, len(often) + 1)
        chosen = _chosen(at, rank[of], len(symbols))
        replaced = np.bincount(of[chosen], minlength=len(often))
        used = np.flatnonzero(replaced >= LEAST)
        if not len(used):  # the most frequent pair overlaps itself and occurs too rarely beside itself
            open_ = at[of != np.argmax(rank)]
            continue
        chosen &= (replaced >= LEAST)[of]
        rule = np.zeros(len(often), np.uint32)
        rule[used] = base + known + np.arange(len(used), dtype=np.uint32)
        where = at[chosen]
        symbols, last = symbols.copy(), last.copy()
        symbols[where] = rule[of[chosen]]
        last[where] = last[where + 1]
        stay = np.ones(len(symbols), dtype=bool)
        stay[where + 1] = False
        place = np.cumsum(stay, dtype=np.int32) - 1
        symbols, last = symbols[stay], last[stay]
        may = np.zeros(len(symbols), dtype=bool)
        may[place[at[~chosen]]] = True
        may[place[where]] = True
        may[np.maximum(place[where] - 1, 0)] = True
        open_ = np.flatnonzero((may & ~last)[:-1])
        rules.append(np.stack([often[used] >> np.uint64(32), often[used] & np.uint64(0xFFFFFFFF)], axis=1).astype(np.uint32))
        known += len(used)
    return symbols, last, np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32)


def expansion_lengths(rules: np.ndarray, base: int) -> np.ndarray:
    """How many ids each nonterminal stands for."""
    lengths = np.ones(len(rules), dtype=np.uint32)
    while True:
        own = np.concatenate([np.ones(1, np.uint32), lengths])
        new = own[np.maximum(rules[:, 0].astype(np.int64) - base + 1, 0)] + own[np.maximum(rules[:, 1].astype(np.int64) - base + 1, 0)]
        if np.array_equal(new, lengths):
            return lengths
        lengths = new


def expand(symbols: np.ndarray, rules: np.ndarray, base: int) -> np.ndarray:
    """The ids that symbols stand for."""
    while True:
        inner = symbols >= base
        if not inner.any():
            return symbols
        at = np.cumsum(1 + inner) - 1 - inner
        out = np.repeat(symbols, 1 + inner)
        pair = rules[symbols[inner].astype(np.int64) - base]
        out[at[inner]], out[at[inner] + 1] = pair[:, 0], pair[:, 1]
        symbols = out


@dataclass
class Shard:
    """An open shard: documents' ids and symbols, rules and lengths; :meth:`decode` gives any range of a document."""

    part: int
    start: int
    ids: list[str | None]
    base: int
    rules: np.ndarray
    lengths: np.ndarray
    offsets: np.ndarray
    symbols: np.ndarray

    def sizes(self, symbols: np.ndarray) -> np.ndarray:
        own = np.concatenate([np.ones(1, np.uint32), self.lengths])
        return own[np.maximum(symbols.astype(np.int64) - self.base + 1, 0)]

    def decode(self, doc: int, a: int = 0, b: int | None = None) -> np.ndarray:
        """Ids ``a`` to ``b`` of a document, from the symbols that cover them."""
        symbols = self.symbols[self.offsets[doc] : self.offsets[doc + 1]]
        ends = np.cumsum(self.sizes(symbols), dtype=np.int64)
        b = int(ends[-1]) if b is None else min(b, int(ends[-1]))
        if a >= b:
            return np.zeros(0, np.uint32)
        first, stop = np.searchsorted(ends, a, "right"), np.searchsorted(ends, b, "left") + 1
        skipped = int(ends[first - 1]) if first else 0
        return expand(symbols[first:stop], self.rules, self.base)[a - skipped : b - skipped]

    def decode_all(self) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the shard, and the offsets of its documents among them."""
        flat = expand(np.arange(self.base, self.base + len(self.rules), dtype=np.uint32), self.rules, self.base)
        table = np.concatenate([np.arange(self.base, dtype=np.uint32), flat])  # what each symbol stands for, one after the other
        lengths = np.concatenate([np.ones(self.base, np.int32), self.lengths.astype(np.int32)])
        place = np.cumsum(lengths, dtype=np.int32) - lengths
        symbols = self.symbols.astype(np.intp)
        sizes = lengths[symbols]
        ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        at = np.repeat(place[symbols] - ends[:-1], sizes)
        at += np.arange(len(at))
        return table[at], ends[self.offsets]


def dump(part: int, start: int, doc_ids: list[str | None], ids: list[bytes], base: int) -> bytes:
    """A shard's bytes: header, rules, expansion lengths, documents' names and offsets, symbols of fixed width."""
    symbols = np.frombuffer(b"".join(ids), "<u4")
    counts = np.array([len(x) // 4 for x in ids], dtype=np.int64)
    last = np.zeros(len(symbols), dtype=bool)
    last[np.cumsum(counts) - 1] = True  # every document has an end id, so none is empty
    packed, ends, rules = re_pair(symbols, last, base)
    offsets = np.concatenate([[0], np.flatnonzero(ends) + 1]).astype("<u8")
    width = next(w for w in (2, 3, 4) if w == 4 or (not len(packed) or int(packed.max()) < 1 << (8 * w)))
    body = np.ascontiguousarray(packed.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :width]).tobytes()
    names = [None if d is None else d.encode() for d in doc_ids]
    sizes = np.array([-1 if d is None else len(d) for d in names], "<i4").tobytes()
    text = b"".join(d for d in names if d is not None)
    head = struct.pack(HEADER, MAGIC, width, part, start, len(ids), len(packed), len(rules)) + struct.pack("<IQ", base, len(text))
    return head + rules.astype("<u4").tobytes() + expansion_lengths(rules, base).astype("<u4").tobytes() + sizes + text + offsets.tobytes() + body


def load(data: bytes) -> Shard:
    magic, width, part, start, n, length, n_rules = struct.unpack_from(HEADER, data)
    if magic != MAGIC:
        raise ValueError("not a token shard")
    at = struct.calcsize(HEADER)
    base, n_text = struct.unpack_from("<IQ", data, at)
    at += 12
    rules = np.frombuffer(data, "<u4", 2 * n_rules, at).reshape(-1, 2)
    at += 8 * n_rules
    lengths = np.frombuffer(data, "<u4", n_rules, at)
    at += 4 * n_rules
    sizes = np.frombuffer(data, "<i4", n, at)
    at += 4 * n
    names, a = [], at
    for size in sizes.tolist():
        names.append(None if size < 0 else data[a : a + size].decode())
        a += max(size, 0)
    at += n_text
    offsets = np.frombuffer(data, "<u8", n + 1, at).astype(np.int64)
    at += 8 * (n + 1)
    symbols = np.zeros((length, 4), np.uint8)
    symbols[:, :width] = np.frombuffer(data, np.uint8, length * width, at).reshape(-1, width)
    return Shard(part, start, names, base, rules, lengths, offsets, symbols.view("<u4").ravel())


SHARDS = "part int, shard string, n_docs long, n_ids long"


def write_shards(docs: DataFrame, root: str, tokenizer: str, end: int = END, id_col: str = "doc_id", text_col: str = "text", shard_ids: int = SHARD_IDS) -> None:
    """Write the ids of all texts in ascending order of their document ids into shards below ``root``.

    The table is range-partitioned by id, then by a hash of the text, so an id that many rows repeat is spread as well. A list of the
    shards, written by Spark's commit, names the files that count.
    """
    tail = end.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer, CACHE)
        part, base = TaskContext.get().partitionId(), own.library.get_vocab_size()
        names: list[str | None] = []
        ids: list[bytes] = []
        held = start = 0

        def flush() -> pa.RecordBatch:
            stream, uri = create(f"{root}/shards", ".rpt")
            stream.write(dump(part, start, names, ids, base))
            stream.close()
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "shard": [uri], "n_docs": [len(ids)], "n_ids": [held]})

        for batch in batches:
            for piece in slices(batch, "text"):
                for name, text in zip(piece.column("name").to_pylist(), piece.column("text").to_pylist(), strict=True):
                    names.append(name)
                    ids.append(own.encode(text) + tail)
                    held += len(ids[-1]) // 4
                    if held >= shard_ids:
                        yield flush()
                        start += held
                        names, ids, held = [], [], 0
        if ids:
            yield flush()

    dealt = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("h", F.xxhash64("text"))
    dealt = dealt.repartitionByRange("id", "h").sortWithinPartitions("id", "h").select(F.col("id").cast("string").alias("name"), "text")
    dealt.mapInArrow(run, SHARDS).write.parquet(f"{root}/list")


def read_shards(spark: SparkSession, root: str) -> DataFrame:
    """A row per document of the shards: ``name``, ``start`` (ids before it), ``n_tokens`` and ``ids_crc32``, all from the files."""
    shards = spark.read.schema(SHARDS).parquet(f"{root}/list")
    n = shards.count()
    sums = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))  # a row per partition that was written
    bases = sums.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                with open_for_reading(uri) as stream:
                    shard = load(stream.read())
                ids, at = shard.decode_all()
                data = memoryview(ids.astype("<u4").tobytes())
                sums = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard.ids, pa.string()), pa.array([shard.part] * len(sums), pa.int32()), pa.array(shard.start + at[:-1]), pa.array(np.diff(at)), pa.array(sums, pa.int64())],
                    ["name", "part", "start", "n_tokens", "ids_crc32"],
                )

    tasks = max(1, -(-n // 8), min(n, spark.sparkContext.defaultParallelism))  # about eight shards each
    rows = shards.select("shard").repartition(tasks, "shard").mapInArrow(run, "name string, part int, start long, n_tokens long, ids_crc32 long")
    return rows.join(bounded_broadcast(bases, 100_000), "part").select("name", (F.col("start") + F.col("base")).alias("start"), "n_tokens", "ids_crc32")


def tokenized(docs: DataFrame, tokenizer: str, end: int = END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write all documents' ids to new shards in shared storage and read them back: ``doc_id``, ``start``, ``n_tokens``, ``ids_crc32``.

    A null or empty text is its end id alone. Null ids come first; rows that repeat an id follow each other in the order of
    their texts' hashes. An empty table gives no shards and an empty result. Other columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    root = new_path(spark, "tokens")
    write_shards(docs, root, tokenizer, end, id_col, text_col)
    kind = docs.schema[id_col].dataType
    return read_shards(spark, root).select(F.col("name").cast(kind).alias("doc_id"), "start", "n_tokens", "ids_crc32")
