"""Best-fit packing by a grouping genetic algorithm on islands.

Texts become token pieces of at most ``capacity`` tokens; pieces go into sequences of that capacity, as few
as possible. Pieces that fill a sequence need no search. The others are dealt at random over islands of
bounded size. On each island a population of packings evolves: a crossover injects whole well-filled
sequences of one packing into another, removes what is then there twice, lets the displaced pieces change places with
smaller ones where that fills a sequence better, and best-fits the rest. Between epochs an island's fullest sequences migrate to
the next island as patterns of lengths, which it fills with its own pieces. Epochs go on until no island gets along
with fewer sequences; one that meets its lower bound is done.
"""

from __future__ import annotations

import random
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..common.store import small_batches, written
from .byte_bpe import encoder
from .textbatch import mix, slices

CAPACITY, END = 1024, 2
#: Stretches of text whose ids a worker keeps: some 250 MB.
STRETCHES = 1_000_000
#: Pieces of an island, packings of its population, patterns that migrate.
ISLAND, POPULATION, ELITE = 8_192, 6, 64
#: Crossovers of an epoch: as many as handle this number of pieces, and at least the second number.
HANDLED, CROSSOVERS = 100_000, 12

Bins = list[list[int]]


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document: only the first may be short."""
    if length <= capacity:
        return [(0, length)]
    first = length % capacity or capacity
    return [(0, first)] + [(a, capacity) for a in range(first, length, capacity)]


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int, end: int) -> DataFrame:
    """Pieces of every document's ids with the end id, with their checksums and a number to deal them by."""
    tail = end.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, STRETCHES).encode
        base, done = TaskContext.get().partitionId() << 40, 0
        for batch in batches:
            for part in slices(batch, "text"):
                rows, piece, start, length, crc = [], [], [], [], []
                for i, text in enumerate(part.column("text").to_pylist()):
                    ids = encode(text) + tail
                    for k, (a, n) in enumerate(cut(len(ids) // 4, capacity)):
                        rows.append(i)
                        piece.append(k)
                        start.append(a)
                        length.append(n)
                        crc.append(zlib.crc32(ids[4 * a : 4 * (a + n)]))
                slot = mix(np.arange(base + done, base + done + len(rows), dtype=np.uint64)).view(np.int64)
                done += len(rows)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(slot)],
                    ["doc_id", "piece", "start", "length", "ids_crc32", "slot"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, slot long")


def best_fit(order: list[int], sizes: list[int], bins: Bins, fills: list[int], capacity: int) -> None:
    """Put pieces, in order, each into the bin that it leaves with least room, or into a new one."""
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for b, fill in enumerate(fills):
        if fill < capacity:
            room[capacity - fill].append(b)
            mask |= 1 << (capacity - fill)
    for i in order:
        size = sizes[i]
        fitting = mask >> size
        if fitting:
            r = size + (fitting & -fitting).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                mask ^= 1 << r
            bins[b].append(i)
            fills[b] += size
        else:
            r, b = capacity, len(bins)
            bins.append([i])
            fills.append(size)
        if r > size:
            room[r - size].append(b)
            mask |= 1 << (r - size)


def _fitness(packing: tuple[Bins, list[int]]) -> tuple[int, int]:
    return -len(packing[0]), sum(f * f for f in packing[1])


def lower_bound(sizes: list[int], capacity: int) -> int:
    """Sequences that any packing needs: pieces over half the capacity each take one, and for each threshold no
    piece of at least that size fits to those that leave less room."""
    ordered = sorted(sizes, reverse=True)
    sums = [0]
    for size in ordered:
        sums.append(sums[-1] + size)
    best = -(-sums[-1] // capacity)
    descending = [-s for s in ordered]
    half = bisect_left(descending, -(capacity // 2))  # pieces larger than half
    for k in sorted({s for s in ordered if 2 * s <= capacity}):
        alone = bisect_left(descending, -(capacity - k))  # larger than capacity - k: nothing of size k or more joins them
        rest = sums[bisect_right(descending, -k)] - sums[alone]
        best = max(best, alone + max(half - alone, -(-rest // capacity)))
    return max(best, half)


def dominate(bins: Bins, fills: list[int], displaced: list[int], sizes: list[int], capacity: int) -> list[int]:
    """Let displaced pieces take the place of one or two smaller pieces of a bin where that fills it better.

    Changes ``bins`` and ``fills``; returns what is displaced then.
    """
    free = sorted((sizes[i], i) for i in displaced)
    for b, own in enumerate(bins):
        room = capacity - fills[b]
        if not room or not free:
            continue
        best, swap = 0, None
        for k, i in enumerate(own):
            for j in (-1, *range(k + 1, min(len(own), 8))):
                out = sizes[i] + (sizes[own[j]] if j >= 0 else 0)
                at = bisect_right(free, (out + room, len(sizes))) - 1
                if at >= 0 and free[at][0] - out > best:
                    best, swap = free[at][0] - out, (at, k, j)
                    if best == room:
                        break
            if best == room:
                break
        if swap:
            at, k, j = swap
            new = free.pop(at)[1]
            for i in (own[k], own[j]) if j >= 0 else (own[k],):
                insort(free, (sizes[i], i))
            bins[b] = [i for n, i in enumerate(own) if n != k and n != j] + [new]
            fills[b] += best
    return [i for _, i in free]


def inject(base: tuple[Bins, list[int]], bins: Bins, sizes: list[int], capacity: int, loose: int = 0) -> tuple[Bins, list[int]]:
    """A packing with the given bins whole; what ``base`` had with them is displaced, exchanged and best-fitted.

    So are the pieces of the ``loose`` least full of the bins that stay.
    """
    taken = {i for b in bins for i in b}
    stay, displaced = [], []
    for b, fill in zip(*base, strict=True):
        if taken.isdisjoint(b):
            stay.append((fill, b))
        else:
            displaced += [i for i in b if i not in taken]
    stay.sort(key=lambda x: -x[0])
    for _, b in stay[len(stay) - loose :] if loose else []:
        displaced += b
    stay = stay[: len(stay) - loose] if loose else stay
    child = [list(b) for b in bins] + [list(b) for _, b in stay]
    fills = [sum(sizes[i] for i in b) for b in bins] + [f for f, _ in stay]
    displaced = dominate(child, fills, displaced, sizes, capacity)
    displaced.sort(key=lambda i: -sizes[i])
    best_fit(displaced, sizes, child, fills, capacity)
    return child, fills


def from_patterns(patterns: list[list[int]], sizes: list[int]) -> Bins:
    """Bins that follow migrated patterns of lengths, as far as there are pieces of those lengths."""
    free: dict[int, list[int]] = {}
    for i, size in enumerate(sizes):
        free.setdefault(size, []).append(i)
    out = []
    for pattern in patterns:
        used: list[int] = []
        for size in pattern:
            if not free.get(size):
                break
            used.append(free[size].pop())
        if len(used) == len(pattern):
            out.append(used)
        else:
            for i in used:
                free[sizes[i]].append(i)
    return out


def evolve(sizes: list[int], population: list[tuple[Bins, list[int]]], patterns: list[list[int]], capacity: int, seed: int) -> list[tuple[Bins, list[int]]]:
    """One epoch of an island; the population, best first.

    An empty one is seeded by best fit: of pieces in falling size, and in random orders.
    """
    rng = random.Random(seed)
    bound = lower_bound(sizes, capacity)
    if not population:
        for k in range(POPULATION):
            order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
            if k:
                rng.shuffle(order)
            packing: tuple[Bins, list[int]] = ([], [])
            best_fit(order, sizes, *packing, capacity)
            population.append(packing)
            if len(packing[0]) == bound:
                break
    if patterns:
        population.append(inject(population[0], from_patterns(patterns, sizes), sizes, capacity))
    population.sort(key=_fitness, reverse=True)
    for _ in range(max(CROSSOVERS, HANDLED // max(1, len(sizes)))):
        if len(population[0][0]) == bound or len(population) < 2:
            break
        base, other = rng.sample(population, 2)
        full = sorted(range(len(other[0])), key=lambda b: -other[1][b])[: max(1, len(other[0]) // 2)]
        chosen = [other[0][b] for b in rng.sample(full, max(1, len(full) * rng.randint(1, 5) // 10))]
        child = inject(base, chosen, sizes, capacity, loose=rng.randint(1, min(5, len(base[0]))))
        if all(_fitness(child) != _fitness(p) for p in population):
            population.append(child)
        population.sort(key=_fitness, reverse=True)
        del population[POPULATION:]
    return population


STATE = "island long, sizes array<int>, population array<binary>, elite array<array<int>>, bins long, bound long"


def _ordered(frame: pd.DataFrame) -> pd.DataFrame:
    return frame.sort_values(["length", "slot"], ascending=[False, True], kind="stable", ignore_index=True)


def _packing(assigned: bytes, sizes: list[int]) -> tuple[Bins, list[int]]:
    places = np.frombuffer(assigned, "<i4")
    bins: Bins = [[] for _ in range(int(places.max()) + 1)] if len(places) else []
    fills = [0] * len(bins)
    for i, b in enumerate(places.tolist()):
        bins[b].append(i)
        fills[b] += sizes[i]
    return bins, fills


def _assigned(packing: tuple[Bins, list[int]], n: int) -> bytes:
    places = np.zeros(n, "<i4")
    for b, items in enumerate(packing[0]):
        places[items] = b
    return places.tobytes()


def _row(island: int, sizes: list[int], population: list, patterns: list[list[int]], capacity: int, epoch: int) -> pd.DataFrame:
    """One epoch of one island, whose pieces have these lengths in order, with the patterns that came to it."""
    found = evolve(sizes, population, patterns, capacity, island * 1_000 + epoch)
    bins, fills = found[0]
    best = sorted(range(len(bins)), key=lambda b: -fills[b])[:ELITE]
    elite = [[sizes[i] for i in bins[b]] for b in best]
    row = (island, sizes, [_assigned(p, len(sizes)) for p in found], elite, len(bins), lower_bound(sizes, capacity))
    return pd.DataFrame([row], columns=[f.split()[0] for f in STATE.split(", ")])


def _first(capacity: int):
    return lambda key, rows: _row(int(key[0]), _ordered(rows)["length"].tolist(), [], [], capacity, 0)


def _later(capacity: int, epoch: int):
    def step(key, rows: pd.DataFrame) -> pd.DataFrame:
        before = rows.iloc[0]
        sizes = list(map(int, before["sizes"]))
        return _row(int(key[0]), sizes, [_packing(x, sizes) for x in before["population"]], [list(map(int, p)) for p in before["guests"]], capacity, epoch)

    return step


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: ``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id``, ``offset``.

    A document is its ids (no special tokens added; null text: none) and the end id. Documents longer than
    ``capacity`` are cut into pieces of that length, of which the first may be shorter. ``sequence_id`` and ``offset``
    place a piece; a sequence's pieces follow each other without gaps from 0. Each row is a document of its own,
    also if it repeats another's id or has a null id. An empty table gives an empty result; other columns are not read.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    pieces = written(token_pieces(docs, tokenizer, capacity, end), "pieces")
    n = pieces.agg(F.count(F.when(F.col("length") < capacity, 1)).alias("short"), F.count("*").alias("all")).first()
    islands = max(1, -(-n["short"] // ISLAND), -(-(n["all"] - n["short"]) // (8 * ISLAND)))
    pieces = pieces.withColumn("island", F.pmod("slot", F.lit(islands)))
    items = pieces.where(F.col("length") < capacity).select("island", "slot", "length")
    state = written(items.groupBy("island").applyInPandas(_first(capacity), STATE), "islands")
    epoch, fewest = 0, None
    while True:
        found = state.agg(F.sum("bins").alias("bins"), F.sum("bound").alias("bound")).first()
        if not found["bins"] or found["bins"] == found["bound"] or found["bins"] == fewest:
            break
        fewest, todo = found["bins"], state.where("bins > bound")
        guests = state.select(F.pmod(F.col("island") + 1, F.lit(islands)).alias("island"), F.col("elite").alias("guests"))
        # An island's row has the lengths of its pieces, so an epoch reads no pieces.
        mine = todo.select("island", "sizes", "population").join(guests, "island")
        epoch += 1
        later = mine.groupBy("island").applyInPandas(_later(capacity, epoch), STATE)
        state = written(later.unionByName(state.where("bins <= bound")), "islands")

    def place(key, rows, state):
        short = _ordered(rows[rows["length"] < capacity])
        full = rows[rows["length"] >= capacity]
        bins = np.frombuffer(state["population"].iloc[0][0], "<i4").astype(np.int64) if len(short) else np.zeros(0, np.int64)
        short = short.assign(bin=bins).sort_values("bin", kind="stable")
        short["offset"] = short.groupby("bin")["length"].cumsum() - short["length"]
        base = int(bins.max()) + 1 if len(bins) else 0
        full = full.assign(bin=np.arange(base, base + len(full), dtype=np.int64), offset=0)
        out = pd.concat([short, full], ignore_index=True)
        out["sequence_id"] = (int(key[0]) << 32) + out["bin"]
        return out[["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]]

    kind = pieces.schema["doc_id"].dataType.simpleString()
    best = state.select("island", F.slice("population", 1, 1).alias("population"))
    placed = pieces.groupBy("island").cogroup(best.groupBy("island"))
    return placed.applyInPandas(place, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
