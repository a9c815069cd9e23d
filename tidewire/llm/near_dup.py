"""MinHash near-duplicates: a chosen-path set similarity join.

A text is the set of its word shingles. Equal sets become one node of the search at once. Then, in each of
several independent trees, texts branch by the minwise tokens at positions that the tree chooses; texts in
the same branch may be similar. A branch with many texts branches again; a small one is compared
exhaustively, by sketches, and what may be similar is confirmed on the full sets.

Nothing here depends on a group fitting into a task: large branches are split by joins. The texts of branches that do
not get smaller (a passage that thousands of texts share, thousands of variants of one text) are joined by their
rarest shingles, which leaves out no pair. Variants that even share those are dealt out in blocks with some leaders, and
what that does not connect is compared block by block.
A branch gives a bounded number of pairs per text, those that connect it first. Where that left candidates out,
what confirmed links do not connect yet is compared again on full sets, block by block, and only links leave the tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..common.components import connected_components
from ..common.store import bounded_broadcast, scope, small_batches, written
from .textbatch import SPACED_WORD, constants, distinct, mix, shingles, slices, words_of

#: Positions of a sketch, 16 bits each; positions that a large branch branches by; levels of branching.
SKETCH, BRANCH, LEVELS = 128, 2, 4
#: Share of pairs at the threshold that all trees together may miss, if their branches are large on every level.
MISSED = 4e-7
#: Texts of a branch that are compared exhaustively.
SMALL = 1024
#: Texts that share a rare shingle and are still compared on their own; where more do, groups that overlap are one.
FEW = 128
#: Texts of a block where unconnected texts are compared on full sets.
CELL = 2048
#: Candidate pairs that a branch may give, times its texts; what it leaves out is settled block by block.
PER_TEXT = 1
#: Standard deviations of a sketch's estimate below which a pair is no candidate: one pair in 50 million.
SIGMAS = 5.5
#: Rows up to which a counted table of candidates is broadcast.
BROADCAST_ROWS = 200_000

_XOR32 = constants(SKETCH, 101).astype(np.uint32)
_MUL32 = constants(SKETCH, 202).astype(np.uint32) | np.uint32(1)
_KEYS = constants(2, 505)


def set_key(values: np.ndarray) -> bytes:
    """128 bits that two sets share if and, but for chance, only if they are equal."""
    n = np.uint64(len(values))
    return b"".join((mix(values ^ k).sum(dtype=np.uint64) + n).tobytes() for k in _KEYS)


def _minima(values: np.ndarray, xor: np.ndarray, mul: np.ndarray) -> np.ndarray:
    best = None
    for a in range(0, len(values), 512):
        block = values[a : a + 512, None] ^ xor[None, :]
        block *= mul[None, :]
        low = block.min(axis=0)
        best = low if best is None else np.minimum(best, low)
    return best


def trees(threshold: int) -> int:
    """The trees that miss at most ``MISSED`` of the pairs at the threshold."""
    share = threshold / 100
    met = share * (1 - (1 - share) ** BRANCH) ** LEVELS
    return 1 if met == 1 else math.ceil(math.log(MISSED) / math.log1p(-met))


def sketch(values: np.ndarray, xor: np.ndarray, mul: np.ndarray) -> tuple[np.ndarray, bytes]:
    """The root branches of a set in each tree, and its sketch; a tree has a constant in ``xor`` and ``mul`` each."""
    roots = mix(_minima(values, xor, mul) ^ xor).view(np.int64)
    low = _minima((values >> np.uint64(32)).astype(np.uint32), _XOR32, _MUL32)
    return roots, ((low * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype("<u2").tobytes()


def _sketches(threshold: int, shingle: int):
    xor, mul = constants(trees(threshold), 303), constants(trees(threshold), 404)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                values, offsets = shingles(words_of(part.column("text"), SPACED_WORD, fold=True), shingle)
                n, keys, roots, sketches = [], [], [], []
                for a, b in zip(offsets[:-1], offsets[1:], strict=True):
                    own = distinct(values[a:b])
                    n.append(len(own))
                    if len(own):
                        root, low = sketch(own, xor, mul)
                        keys.append(set_key(own))
                        roots.append(root)
                        sketches.append(low)
                    else:
                        keys.append(None)
                        roots.append(None)
                        sketches.append(None)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("text_hash"), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(roots, pa.list_(pa.int64())), pa.array(sketches, pa.binary())],
                    ["doc_id", "text_hash", "n_shingles", "set_key", "roots", "sketch"],
                )

    return run


def _least(threshold: int) -> float:
    """The estimate from which a pair is a candidate."""
    share = threshold / 100
    return share - SIGMAS * (share * (1 - share) / SKETCH) ** 0.5


def _root(parent: list[int], x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def _compare(threshold: int):
    """Candidate pairs of the texts of each branch; rows come sorted by branch.

    Out: pairs, and for each text with a candidate that its branch left out, a row without a partner.
    """
    least = _least(threshold)

    def pairs_of(keys: list[bytes], sizes: np.ndarray, sketches: np.ndarray) -> list[tuple[bytes, bytes | None]]:
        m, found = len(keys), []
        for i in range(m - 1):
            same = (sketches[i + 1 :] == sketches[i]).mean(axis=1)
            low, high = np.minimum(sizes[i + 1 :], sizes[i]), np.maximum(sizes[i + 1 :], sizes[i])
            j = np.flatnonzero((same >= least) & (100 * low >= threshold * high))
            if len(j):
                found.append(np.stack([np.full(len(j), i), j + i + 1, -same[j] * SKETCH]))
        if not found:
            return []
        a, b, order = np.concatenate(found, axis=1)
        a, b, order = a.astype(int).tolist(), b.astype(int).tolist(), np.argsort(order, kind="stable").tolist()
        left_out: list[int] = []
        if len(order) > PER_TEXT * m:  # the likeliest pairs that connect, then the likeliest others
            parent, tree, rest = list(range(m)), [], []
            for k in order:
                x, y = _root(parent, a[k]), _root(parent, b[k])
                (rest if x == y else tree).append(k)
                parent[x] = y
            room = PER_TEXT * m - len(tree)
            order, left_out = tree + rest[:room], rest[room:]
        out: list[tuple[bytes, bytes | None]] = [(min(keys[a[k]], keys[b[k]]), max(keys[a[k]], keys[b[k]])) for k in order]
        return out + [(keys[i], None) for i in {i for k in left_out for i in (a[k], b[k])}]

    def flush(table: pa.Table) -> pa.RecordBatch:
        nodes = table.column("node").to_numpy()
        sizes = table.column("n_shingles").to_numpy()
        keys = table.column("set_key").to_pylist()
        sketches = np.frombuffer(b"".join(table.column("sketch").to_pylist()), "<u2").reshape(len(keys), SKETCH)
        edges = np.flatnonzero(np.diff(nodes)) + 1
        first, last = np.concatenate([[0], edges]), np.concatenate([edges, [len(nodes)]])
        out: list[tuple[bytes, bytes | None]] = []
        twos = first[last - first == 2]
        if len(twos):  # most branches: two texts
            same = (sketches[twos] == sketches[twos + 1]).mean(axis=1)
            low, high = np.minimum(sizes[twos], sizes[twos + 1]), np.maximum(sizes[twos], sizes[twos + 1])
            for i in twos[(same >= least) & (100 * low >= threshold * high)].tolist():
                out.append((min(keys[i], keys[i + 1]), max(keys[i], keys[i + 1])))
        for f, g in zip(first.tolist(), last.tolist(), strict=True):
            if g - f > 2:
                out += pairs_of(keys[f:g], sizes[f:g], sketches[f:g])
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.binary()), pa.array([y for _, y in out], pa.binary())], ["a", "b"])

    return _by_node(flush)


def _by_node(flush):
    """``flush`` on tables of whole branches, from rows that come sorted by ``node``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            nodes = batch.column(batch.schema.get_field_index("node")).to_numpy(zero_copy_only=False)
            if nodes[0] == nodes[-1]:
                continue
            cut = int(np.flatnonzero(nodes != nodes[-1])[-1]) + 1  # the last branch may go on
            whole = held[:-1] + [batch.slice(0, cut)]
            held = [batch.slice(cut)]
            yield flush(pa.Table.from_batches(whole).combine_chunks())
        if held:
            yield flush(pa.Table.from_batches(held).combine_chunks())

    return run


PAIRS = "a binary, b binary"


def _candidates(rows: DataFrame, threshold: int) -> DataFrame:
    dealt = rows.select("node", "set_key", "n_shingles", "sketch").repartition("node").sortWithinPartitions("node")
    return dealt.mapInArrow(_compare(threshold), PAIRS)


def _shared(rows: DataFrame) -> DataFrame:
    """The rows of branches in which at least two sets meet."""
    rows = rows.withColumn("tag", F.xxhash64("set_key"))
    nodes = rows.groupBy("node").agg(F.min("tag").alias("lo"), F.max("tag").alias("hi")).where("lo < hi").select("node")
    return rows.drop("tag").join(nodes, "node", "left_semi")


def _branches(base: DataFrame) -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """Leaves of all trees with their sketches; the sets of branches that do not get small; one row per set."""
    roots = base.where("n_shingles > 0").select("set_key", F.explode("roots").alias("node"))
    members = written(_shared(roots).dropDuplicates(["node", "set_key"]), "members")
    wanted = members.select("set_key").distinct()
    sets = base.where("n_shingles > 0").groupBy("set_key").agg(F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"), F.min("text_hash").alias("text_hash"))
    sets = written(sets.join(wanted, "set_key", "left_semi"), "sets")
    rows = written(members.join(sets.drop("text_hash"), "set_key"), "branches")

    leaves, hard = [], []
    for level in range(LEVELS + 1):
        sizes = rows.groupBy("node").agg(F.count("*").alias("n"))
        large = written(sizes.where(F.col("n") > SMALL), "large")
        if not large.count():
            leaves.append(rows)
            break
        few = bounded_broadcast(large, BROADCAST_ROWS)
        leaves.append(rows.join(few, "node", "left_anti"))
        rows = written(rows.join(few, "node"), "large-rows")  # read several times below
        if level == LEVELS:
            hard.append(rows)
            break
        position = F.pmod(F.xxhash64("node", F.lit(level), F.col("step")), F.lit(SKETCH)).cast("int") * 2 + 1
        branched = (
            rows.withColumn("step", F.explode(F.array(*[F.lit(i) for i in range(BRANCH)])))
            .withColumn("child", F.xxhash64("node", "step", F.substring(F.col("sketch"), position, F.lit(2))))
        )
        child_sizes = branched.groupBy("node", "child").agg(F.count("*").alias("m"), F.first("n").alias("n"))
        # A child with most of its parent's texts will not get small by branching: such a parent's texts are joined by rare shingles.
        stuck = written(child_sizes.where(F.col("m") * 2 > F.col("n")).where(F.col("m") > SMALL).select("node").distinct(), "stuck")
        hold = bounded_broadcast(stuck, BROADCAST_ROWS)
        hard.append(rows.join(hold, "node", "left_semi"))
        rest = branched.join(hold, "node", "left_anti").select("set_key", F.col("child").alias("node"), "n_shingles", "sketch")
        rows = written(_shared(rest).dropDuplicates(["node", "set_key"]).select("set_key", "node", "n_shingles", "sketch"), "branches")
    leaf = leaves[0].select("set_key", "node", "n_shingles", "sketch")
    for other in leaves[1:]:
        leaf = leaf.unionByName(other.select("set_key", "node", "n_shingles", "sketch"))
    keys = None
    for other in hard:
        keys = other.select("set_key") if keys is None else keys.union(other.select("set_key"))
    if keys is not None:
        keys = written(keys.distinct(), "hard")
        keys = keys if keys.limit(1).count() else None
    return leaf, keys, sets


LEADERS = 16


def _in_blocks(big: DataFrame) -> DataFrame:
    """Large groups dealt out in blocks; every block also gets the group's leaders."""
    sizes = big.groupBy("node").agg(F.ceil(F.count("*") / SMALL).cast("int").alias("blocks"))
    rows = big.join(bounded_broadcast(written(sizes, "sizes"), BROADCAST_ROWS), "node").withColumn("block", F.pmod(F.xxhash64("set_key"), F.col("blocks")).cast("int"))
    lead = (
        rows.groupBy("node", "blocks", F.pmod(F.xxhash64("set_key", F.lit(1)), F.lit(LEADERS)).alias("seat"))
        .agg(F.min(F.struct(F.xxhash64("set_key", F.lit(2)).alias("o"), "set_key", "n_shingles", "sketch")).alias("x"))
        .select("node", "x.set_key", "x.n_shingles", "x.sketch", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    )
    columns = ["set_key", F.xxhash64("node", "block").alias("node"), "n_shingles", "sketch"]
    return rows.select(*columns).unionByName(lead.select(*columns)).dropDuplicates(["node", "set_key"])


def _sets_of(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """(set_key, values) of the wanted sets, made again from the texts."""
    hashes = bounded_broadcast(wanted.select("text_hash"), BROADCAST_ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                values, offsets = shingles(words_of(part.column("text"), SPACED_WORD, fold=True), shingle)
                keys, sets = [], []
                for a, b in zip(offsets[:-1], offsets[1:], strict=True):
                    own = distinct(values[a:b])
                    keys.append(set_key(own))
                    sets.append(own.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(sets, pa.binary())], ["set_key", "shingles"])

    texts = docs.select("text_hash", "text").join(hashes, "text_hash", "left_semi").dropDuplicates(["text_hash"]).select("text")
    return texts.mapInArrow(run, "set_key binary, shingles binary").dropDuplicates(["set_key"])


def _each_shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each shingle of each set."""
    for batch in batches:
        for part in slices(batch, "shingles"):
            sets = part.column("shingles").to_pylist()
            of = np.repeat(np.arange(len(sets)), [len(x) // 8 for x in sets])
            yield pa.RecordBatch.from_arrays([part.column("set_key").take(pa.array(of)), pa.array(np.frombuffer(b"".join(sets), np.int64))], ["set_key", "shingle"])


def _by_rare_shingles(docs: DataFrame, sets: DataFrame, hard: DataFrame, threshold: int, shingle: int) -> tuple[DataFrame, DataFrame | None]:
    """Groups of sets (``node``) in which each pair of ``hard`` sets that is a link meets: a prefix filter.

    With shingles in one order, here by how few sets hold them, two sets that are a link share one of the first
    ``n - ceil(threshold % of n) + 1`` shingles of each. The second table, if any, has the groups of more than ``FEW`` sets,
    those that share a set as one.
    """
    own = written(sets.join(hard, "set_key", "left_semi"), "hard-sets")
    each = written(_sets_of(docs, own, shingle).mapInArrow(_each_shingle, "set_key binary, shingle long"), "each")
    holders = written(each.groupBy("shingle").agg(F.count("*").alias("held")).where("held > 1"), "held")
    common = each.join(bounded_broadcast(holders, BROADCAST_ROWS), "shingle").groupBy("set_key").agg(F.sort_array(F.collect_list(F.struct("held", "shingle"))).alias("common"))
    n = F.col("n_shingles")
    first = F.floor(n * (100 - threshold) / 100) + 1 - (n - F.size("common"))  # shingles of one set come before these
    first = F.slice("common", F.lit(1), F.greatest(first, F.lit(0)).cast("int"))
    rows = written(common.join(own.select("set_key", "n_shingles"), "set_key").select("set_key", F.explode(first).alias("x")).select("set_key", F.col("x.shingle").alias("node")), "prefixes")
    # Shingles that the same sets show are one group.
    tags = [F.bit_xor(F.xxhash64("set_key", F.lit(i))).alias(f"tag{i}") for i in (4, 5)]
    groups = rows.groupBy("node").agg(F.count("*").alias("m"), *tags).where("m > 1").groupBy("m", "tag4", "tag5").agg(F.min("node").alias("node"))
    groups = written(groups.select("node", "m"), "groups")
    most = min(FEW, SMALL)
    few = groups.where(F.col("m") <= most).select("node")
    sketched = own.select("set_key", "n_shingles", "sketch")
    small = rows.join(bounded_broadcast(few, BROADCAST_ROWS), "node", "left_semi").join(sketched, "set_key")
    many = written(rows.join(bounded_broadcast(groups.where(F.col("m") > most).select("node"), BROADCAST_ROWS), "node", "left_semi"), "many")
    if not many.limit(1).count():
        return small, None
    centres = written(many.groupBy("node").agg(F.min("set_key").alias("b")), "centres")
    stars = many.join(bounded_broadcast(centres, BROADCAST_ROWS), "node").select(F.col("set_key").alias("a"), "b").distinct()
    masses = connected_components(stars, label="mass").select(F.col("node").alias("set_key"), F.col("mass").alias("least"), F.xxhash64("mass").alias("node"))
    return small, written(masses.join(sketched, "set_key"), "masses")


def _linked(x: np.ndarray, y: np.ndarray, threshold: int) -> bool:
    both = np.concatenate([x, y])
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= threshold * (len(both) - shared)


def _confirm(threshold: int):
    """Which pairs are links, on full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist(), strict=True)
            linked = [_linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), threshold) for x, y in sets]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(linked, pa.bool_())], ["a", "b", "linked"])

    return run


class Postings:
    """Which of some sets hold each shingle: intersections of one set with all of them at once."""

    def __init__(self, sets: list[np.ndarray]):
        of = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        values = np.concatenate(sets)
        order = np.argsort(values, kind="stable")
        self.sizes, self.of, values = np.array([len(s) for s in sets]), of[order], values[order]
        self.first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
        self.values, self.last = values[self.first], np.append(self.first[1:], len(values))

    def shared(self, own: np.ndarray) -> np.ndarray:
        """Sizes of the intersections of ``own`` with each set."""
        at = np.minimum(np.searchsorted(self.values, own), len(self.values) - 1)
        at = at[self.values[at] == own]
        if not len(at):
            return np.zeros(len(self.sizes), dtype=np.int64)
        hits = np.concatenate([self.of[a:b] for a, b in zip(self.first[at].tolist(), self.last[at].tolist(), strict=True)])
        return np.bincount(hits, minlength=len(self.sizes))


def _settle(threshold: int):
    """Links between texts of a cell that nothing connects yet: rows of kind 1 against those of the block.

    Rows of the block that come as kind 1 elsewhere as well are of kind 2, and such a pair counts in one of its two cells.
    Candidates by sketch are confirmed at once on full sets; what a link has connected is not compared again.
    """
    least = _least(threshold)

    def flush(table: pa.Table) -> pa.RecordBatch:
        nodes = table.column("node").to_numpy()
        all_sizes, all_kinds = table.column("n_shingles").to_numpy(), table.column("kind").to_numpy()
        all_keys, labels, all_sets = (table.column(c).to_pylist() for c in ("set_key", "component", "shingles"))
        all_sketches = np.frombuffer(b"".join(table.column("sketch").to_pylist()), "<u2").reshape(len(nodes), SKETCH)
        edges = np.flatnonzero(np.diff(nodes)) + 1
        out = []
        for f, g in zip(np.concatenate([[0], edges]).tolist(), np.concatenate([edges, [len(nodes)]]).tolist(), strict=True):
            number: dict[bytes, int] = {}
            comps = np.array([number.setdefault(c, len(number)) for c in labels[f:g]])
            parent = list(range(len(number)))
            kinds, keys = all_kinds[f:g], np.array(all_keys[f:g], dtype=object)
            sets = [np.frombuffer(x, np.uint64) for x in all_sets[f:g]]
            block = np.flatnonzero(kinds != 1)
            sketches, sizes, comp, again = all_sketches[f:g][block], all_sizes[f:g][block], comps[block], kinds[block] == 2
            postings = None
            for i in np.flatnonzero(kinds == 1).tolist():
                size = len(sets[i])
                same = (sketches == all_sketches[f + i]).mean(axis=1)
                near = (same >= least) & (100 * np.minimum(sizes, size) >= threshold * np.maximum(sizes, size)) & (comp != comps[i])
                near = np.flatnonzero(near & (~again | (keys[block] > keys[i])))
                if not len(near):
                    continue
                if len(near) <= 8:
                    linked = [j for j in near.tolist() if _linked(sets[i], sets[block[j]], threshold)]
                else:
                    postings = postings or Postings([sets[j] for j in block])
                    shared = postings.shared(sets[i])[near]
                    linked = near[100 * shared >= threshold * (size + sizes[near] - shared)].tolist()
                for j in linked:
                    x, y = _root(parent, int(comps[i])), _root(parent, int(comp[j]))
                    if x != y:
                        parent[x] = y
                        out.append((keys[i], keys[block[j]]))
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.binary()), pa.array([y for _, y in out], pa.binary())], ["a", "b"])

    return _by_node(flush)


def near_duplicates(docs: DataFrame, threshold: int = 85, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``text_hash``, ``n_shingles``, ``component_id``, ``kept``, ``component_key``.

    Two texts are linked if ``100 * intersection >= threshold * union`` of their sets of ``shingle``-word
    shingles (A-Z lower-cased; a shorter text is one shingle of all its words). ``component_id`` is the
    smallest id that links reach from a row, and ``kept`` says whether the row has it.

    A null or wordless text has no shingles, is linked with nothing and kept. Rows with a null id take part in
    links; they are kept only if their component has no other id. Rows that repeat an id and a text get equal rows.
    ``text_hash`` (xxhash64 of the text) tells rows apart that share an id only, ``component_key`` (null without shingles)
    components that do. An empty table gives an empty result. Other columns of ``docs``, whatever their names, are not read.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = docs.mapInArrow(_sketches(threshold, shingle), f"doc_id {kind}, text_hash long, n_shingles long, set_key binary, roots array<long>, sketch binary")
    with scope(docs.sparkSession) as tables:
        base = tables.keep(written(found, "sketches"))
        links = _links(docs, base, threshold, shingle)
        labels = connected_components(links, label="label") if links is not None else None
        sizes = base.where("n_shingles > 0").groupBy("set_key").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows"))
        if labels is not None:
            groups = sizes.join(labels.withColumnRenamed("node", "set_key"), "set_key", "left").where("rows > 1 or label is not null")
            groups = written(groups.select("set_key", "least", F.coalesce("label", "set_key").alias("label")), "groups")
            smallest = groups.groupBy("label").agg(F.min("least").alias("smallest"))
            groups = written(groups.join(smallest, "label").select("set_key", "label", "smallest"), "groups")
        else:
            groups = written(sizes.where("rows > 1").select("set_key", F.col("set_key").alias("label"), F.col("least").alias("smallest")), "groups")
        tables.keep(groups)
    rows = base.select("doc_id", "text_hash", "n_shingles", "set_key").join(bounded_broadcast(groups, BROADCAST_ROWS), "set_key", "left")
    component = F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("smallest"))
    rows = rows.withColumn("component_id", component)
    return rows.select(
        "doc_id", "text_hash", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), F.coalesce("label", "set_key").alias("component_key")
    )


def deduplicate(docs: DataFrame, threshold: int = 80, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, one of each component of near-duplicates, with all their columns.

    It is the row with the smallest id; of rows that share it, one with the smallest hash of its text. Texts
    without words are no near-duplicates and all stay.
    """
    found = written(near_duplicates(docs, threshold, shingle, id_col, text_col), "near")
    same = found.where("kept and component_key is not null").groupBy("component_key", "doc_id", "text_hash").agg(F.count("*").alias("rows"))
    one = same.groupBy("component_key").agg(F.min(F.struct("text_hash", "doc_id", "rows")).alias("k")).select("k.*")
    none = found.where("component_key is null").select("text_hash", "doc_id", F.lit(1).cast("long").alias("rows")).distinct()
    keys = written(one.unionByName(none), "kept").select(F.col("text_hash").alias(KEY_HASH), F.col("doc_id").alias(KEY_ID), F.col("rows").alias(KEY_ROWS))
    few = bounded_broadcast(keys, BROADCAST_ROWS)
    rows = docs.join(few, (F.xxhash64(docs[text_col]) == few[KEY_HASH]) & docs[id_col].eqNullSafe(few[KEY_ID]))
    kept = rows.where(F.col(KEY_ROWS) == 1).select(docs["*"])
    if keys.where(F.col(KEY_ROWS) > 1).limit(1).count():  # rows that repeat an id and a text
        kept = kept.unionByName(rows.where(F.col(KEY_ROWS) > 1).dropDuplicates([KEY_ID, KEY_HASH]).select(docs["*"]))
    return kept


#: Names that no column of an input is expected to have.
KEY_HASH, KEY_ID, KEY_ROWS = "near dup: hash", "near dup: id", "near dup: rows"


def _links(docs: DataFrame, base: DataFrame, threshold: int, shingle: int) -> DataFrame | None:
    """Confirmed links between different sets; enough of them to connect whatever links connect."""
    leaf, hard, sets = _branches(base)
    found, masses = _candidates(leaf, threshold), None
    if hard is not None:
        rare, masses = _by_rare_shingles(docs, sets, hard, threshold, shingle)
        found = found.unionByName(_candidates(rare, threshold))
    if masses is not None:
        found = found.unionByName(_candidates(_in_blocks(masses), threshold))
    found = written(found, "candidates")
    pairs = written(found.where("b is not null").distinct(), "pairs")
    if masses is None and not pairs.count():
        return None
    ends = pairs.select(F.col("a").alias("set_key")).union(pairs.select("b"))
    ends = (ends if masses is None else ends.union(masses.select("set_key"))).distinct()
    wanted = written(sets.join(ends, "set_key", "left_semi"), "wanted")
    full = written(_sets_of(docs, wanted, shingle), "shingles")
    with_sets = pairs.join(full.select(F.col("set_key").alias("a"), F.col("shingles").alias("sa")), "a")
    with_sets = with_sets.join(full.select(F.col("set_key").alias("b"), F.col("shingles").alias("sb")), "b")
    tested = with_sets.select("a", "b", "sa", "sb").mapInArrow(_confirm(threshold), "a binary, b binary, linked boolean")
    links = written(tested.where("linked").select("a", "b"), "links")

    marked = found.where("b is null").select(F.col("a").alias("set_key"))
    if masses is not None:  # the sets of a mass are one clump, connected or not
        marked = marked.union(masses.select("set_key"))
        pairs = pairs.union(masses.select("least", "set_key"))
    marked = written(marked.distinct(), "marked")
    if marked.count():
        links = links.unionByName(_rest(pairs, links, marked, wanted, full, threshold))
    return links


def _rest(pairs: DataFrame, links: DataFrame, marked: DataFrame, wanted: DataFrame, full: DataFrame, threshold: int) -> DataFrame:
    """Links that are missing where branches left candidates out.

    Candidate pairs, confirmed or not, and masses connect texts to clumps, and a text is in one clump. In each clump with a marked text
    all texts but those of its largest component (the rest) meet every block of the clump, so each pair that
    could still matter is compared, in tasks of bounded size.
    """
    clumps = connected_components(pairs, label="clump")
    open_ = clumps.join(bounded_broadcast(marked.withColumnRenamed("set_key", "node"), BROADCAST_ROWS), "node", "left_semi").select("clump").distinct()
    labels = connected_components(links, label="label")
    rows = clumps.join(bounded_broadcast(written(open_, "open"), BROADCAST_ROWS), "clump", "left_semi").join(labels, "node", "left")
    rows = written(rows.select(F.col("node").alias("set_key"), F.col("clump").alias("of"), F.coalesce("label", "node").alias("component")), "clumps")
    sizes = rows.groupBy("of", "component").agg(F.count("*").alias("m"))
    top = sizes.groupBy("of").agg(F.max_by("component", F.struct("m", "component")).alias("top"), F.sum("m").alias("n"), F.max("m").alias("m")).where("m < n")
    blocks, rests = F.ceil(F.col("n") / CELL).cast("int"), F.ceil((F.col("n") - F.col("m")) / CELL).cast("int")
    top = written(top.select("of", "top", blocks.alias("blocks"), rests.alias("rests")), "tops")
    rows = rows.join(bounded_broadcast(top, BROADCAST_ROWS), "of").withColumn("rest", F.col("component") != F.col("top"))
    own, each = F.pmod(F.xxhash64("set_key"), F.col("blocks")), F.sequence(F.lit(0), F.col("rests") - 1)
    block = rows.select("set_key", "of", "component", F.when(F.col("rest"), 2).otherwise(0).alias("kind"), own.cast("int").alias("i"), F.explode(each).alias("j"))
    own, each = F.pmod(F.xxhash64("set_key", F.lit(3)), F.col("rests")), F.sequence(F.lit(0), F.col("blocks") - 1)
    rest = rows.where("rest").select("set_key", "of", "component", F.lit(1).alias("kind"), F.explode(each).alias("i"), own.cast("int").alias("j"))
    cells = block.unionByName(rest).select("set_key", "component", "kind", F.xxhash64("of", "i", "j").alias("node"))
    with_sets = cells.join(wanted.select("set_key", "n_shingles", "sketch").join(full, "set_key"), "set_key")
    dealt = with_sets.select("node", "set_key", "component", "kind", "n_shingles", "sketch", "shingles").repartition("node").sortWithinPartitions("node")
    return written(dealt.mapInArrow(_settle(threshold), PAIRS), "links")
