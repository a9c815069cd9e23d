"""Quality rules: fixed counts, and a linear-chain CRF over a text's lines.

The CRF labels each line that has a word as content or boilerplate; Viterbi decoding finds the best
labelling of the whole text, and the share of words in content lines decides whether a text is kept.
The weights are fitted on a bounded sample of labelled documents, in Spark tasks that start from common weights, go some steps on
their own documents and have their weights averaged. Labels are of documents, so those of lines are inferred: chains run
on over the lines of document after document, which shows the CRF where content and boilerplate meet, and each round
decodes the lines anew under the constraint that a good document is mostly content and a bad one mostly not. Everything else
reads every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..common.store import small_batches, written
from .textbatch import SPACED_WORD, Words, byte_table, constants, mix, slices, utf8, windows, words_of

#: Labelled documents that the weights are fitted on (all lines of each), and tasks that fit.
SAMPLE, TASKS = 2_000, 8
#: Rounds of averaging, steps of a task in a round, lines of a chain.
ROUNDS, STEPS, CHAIN = 4, 40, 64
#: What a document's label adds to the scores of its lines when they are decoded for the fit.
LEANING = 2.0
#: Share of words in content lines from which a text is kept.
CONTENT_SHARE = 0.5
MIN_WORDS, MAX_REPEATED = 50, 50

FEATURES = ("bias", "symbols", "upper", "exclamations", "bars", "digits", "words", "word_length", "stops", "repeated")
_K = len(FEATURES)


@dataclass(frozen=True)
class Crf:
    """Weights for content against boilerplate, and scores of a step from one label to the next (0: boilerplate)."""

    emission: tuple[float, ...]
    step: tuple[tuple[float, float], tuple[float, float]]


#: What holds where no labels of both kinds exist.
PRIOR = Crf((2.0, -25.0, -6.0, -4.0, -4.0, -4.0, 0.5, 0.0, 0.5, -1.0), ((1.0, -1.0), (-1.0, 1.0)))

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_CLASSES = {  # features that are shares of a line's bytes or words
    "symbols": _SYMBOL,
    "upper": byte_table((0x41, 0x5A)),
    "lower": byte_table((0x61, 0x7A)),
    "exclamations": byte_table((0x21, 0x21)),
    "bars": byte_table((0x7C, 0x7C)),
    "digits": byte_table((0x30, 0x39)),
}
_STOP = byte_table((0x21, 0x21), (0x2E, 0x2E), (0x3A, 0x3B), (0x3F, 0x3F))
_SALT = constants(4, 77)


def segment_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of the stretches between consecutive offsets; empty ones give 0."""
    out = np.zeros(len(offsets) - 1, dtype=np.int64)
    full = np.flatnonzero(offsets[1:] > offsets[:-1])
    if len(full):
        out[full] = np.add.reduceat(values[: offsets[-1]], offsets[full], dtype=np.int64)
    return out


@dataclass
class Lines:
    """Lines of a batch: byte places, the text of each, words from ``word`` to ``word + n_words``."""

    first: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    word: np.ndarray
    n_words: np.ndarray


def lines_of(data: np.ndarray, offsets: np.ndarray, words: Words) -> Lines:
    """Split all texts of a batch at line feeds."""
    feeds = np.flatnonzero(data == 10)
    counts = 1 + np.diff(np.searchsorted(feeds, offsets))
    first = np.concatenate([[0], np.cumsum(counts)])
    start = np.empty(int(first[-1]), dtype=np.int64)
    end = np.empty_like(start)
    later, earlier = np.ones(len(start), bool), np.ones(len(start), bool)
    later[first[:-1]] = False
    earlier[first[1:] - 1] = False
    start[first[:-1]], start[later] = offsets[:-1], feeds + 1
    end[first[1:] - 1], end[earlier] = offsets[1:], feeds
    word = np.searchsorted(words.start, start)
    return Lines(first, start, end, np.repeat(np.arange(len(counts)), counts), word, np.searchsorted(words.start, end) - word)


def repeated_lines(data: np.ndarray, lines: Lines, words: Words) -> np.ndarray:
    """Which lines with a word equal an earlier line of their text."""
    out = np.zeros(len(lines.start), dtype=bool)
    some = np.flatnonzero(lines.n_words)
    if len(some) < 2:
        return out
    near = np.add.reduceat(words.hash, lines.word[some]) ^ (lines.end - lines.start)[some].astype(np.uint64)
    near = mix(near ^ lines.doc[some].astype(np.uint64) * _SALT[0])
    order = np.argsort(near, kind="stable")
    same = near[order][1:] == near[order][:-1]
    for doc in np.unique(lines.doc[some[order[1:][same]]]):  # texts in which lines may be equal: compare their bytes
        seen: set[bytes] = set()
        for i in range(lines.first[doc], lines.first[doc + 1]):
            if lines.n_words[i]:
                line = data[lines.start[i] : lines.end[i]].tobytes()
                out[i] = line in seen
                seen.add(line)
    return out


def line_features(data: np.ndarray, lines: Lines, words: Words, repeated: np.ndarray) -> np.ndarray:
    """One row of :data:`FEATURES` per line."""
    bounds = np.append(lines.start, len(data))
    size = np.maximum(lines.end - lines.start, 1)
    count = {k: segment_sums(table[data], bounds) for k, table in _CLASSES.items()}
    n = np.maximum(lines.n_words, 1)
    spelled = np.concatenate([[0], np.cumsum(words.end - words.start)])
    letters = spelled[lines.word + lines.n_words] - spelled[lines.word]
    stop = np.zeros(len(size))
    some = np.flatnonzero(lines.n_words)
    stop[some] = _STOP[data[words.end[lines.word[some] + lines.n_words[some] - 1] - 1]]
    cased = np.maximum(count["upper"] + count["lower"], 1)
    columns = (
        np.ones(len(size)), count["symbols"] / size, count["upper"] / cased, np.minimum(count["exclamations"] / n, 2), np.minimum(count["bars"] / n, 2),
        count["digits"] / size, np.log1p(lines.n_words) / 5, np.minimum(letters / n / 10, 3), stop, repeated.astype(float),
    )
    return np.stack(columns, axis=1)


def viterbi(emission: list[float], step) -> list[int]:
    """The best labelling of a line sequence; of equal ones, that with boilerplate later."""
    (s00, s01), (s10, s11) = step
    v0, v1, back = 0.0, emission[0], []
    for e in emission[1:]:
        a, b = v0 + s00, v1 + s10
        c, d = v0 + s01, v1 + s11
        back.append((b >= a, d >= c))
        v0, v1 = (b if b >= a else a), (d if d >= c else c) + e
    label = int(v1 >= v0)
    out = [label]
    for from0, from1 in reversed(back):
        label = int(from1 if label else from0)
        out.append(label)
    return out[::-1]


def _batch(column: pa.Array, crf: Crf | None):
    """Counts of each text, and the share of its words in content lines (or its lines' features)."""
    data, offsets = utf8(column)
    words = words_of((data, offsets), SPACED_WORD, fold=False)
    n_words = np.diff(words.first)
    starts_point = (data & 0xC0) != 0x80
    starts_point &= SPACED_WORD[data]
    word_chars = segment_sums(starts_point, offsets)
    n_symbols = segment_sums(_SYMBOL[data], offsets)
    lines = lines_of(data, offsets, words)
    repeated = repeated_lines(data, lines, words)
    n_dup_lines = segment_sums(repeated, lines.first)
    h, at = windows(words, 3)
    covered = np.zeros(len(words.hash), dtype=bool)
    if len(h) > 1:
        own = mix(h ^ (words.doc()[at].astype(np.uint64) * _SALT[1]))
        order = np.argsort(own)
        same = own[order][1:] == own[order][:-1]
        hit = at[np.unique(np.concatenate([order[1:][same], order[:-1][same]]))]
        for k in range(3):
            covered[hit + k] = True
    n_repeat = segment_sums(covered, words.first)
    features = line_features(data, lines, words, repeated)
    if crf is None:
        return lines, features
    emission = features @ np.array(crf.emission)
    share = np.zeros(len(n_words))
    some = np.flatnonzero(lines.n_words)
    e, w = emission[some].tolist(), lines.n_words[some]
    bounds = np.searchsorted(lines.doc[some], np.arange(len(n_words) + 1))
    for d in np.flatnonzero(n_words):
        a, b = bounds[d], bounds[d + 1]
        labels = viterbi(e[a:b], crf.step)
        share[d] = np.dot(labels, w[a:b]) / n_words[d]
    return n_words, word_chars, n_symbols, n_dup_lines, n_repeat, share


def likelihood(x: np.ndarray, there: np.ndarray, y: np.ndarray, w: np.ndarray, s: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Log-likelihood of labelled chains and its gradients by emission weights and steps.

    ``x`` are features (chain, line, feature), ``there`` says which lines of the padded chains exist, ``y`` are labels. Forward and
    backward sums run over all chains at once.
    """
    n, longest = there.shape
    e = np.zeros((n, longest, 2))
    e[:, :, 1] = np.where(there, x @ w, 0)
    alpha, beta = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
    alpha[:, 0] = e[:, 0]
    for t in range(1, longest):
        a = np.logaddexp(alpha[:, t - 1, 0, None] + s[0], alpha[:, t - 1, 1, None] + s[1]) + e[:, t]
        alpha[:, t] = np.where(there[:, t, None], a, alpha[:, t - 1])
    for t in range(longest - 2, -1, -1):
        m = e[:, t + 1] + beta[:, t + 1]
        beta[:, t] = np.where(there[:, t + 1, None], np.logaddexp(s[:, 0] + m[:, 0, None], s[:, 1] + m[:, 1, None]), 0)
    z = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
    p = np.exp(alpha + beta - z[:, None, None])[:, :, 1] * there
    pair = np.exp(alpha[:, :-1, :, None] + s + (e + beta)[:, 1:, None, :] - z[:, None, None, None]) * there[:, 1:, None, None]
    truth = np.zeros((2, 2))
    np.add.at(truth, (y[:, :-1][there[:, 1:]], y[:, 1:][there[:, 1:]]), 1)
    score = float((e[:, :, 1] * y).sum() + (truth * s).sum() - z.sum())
    return score, np.einsum("nt,ntk->k", y * there - p, x), truth - pair.sum(axis=(0, 1))


def line_labels(features: np.ndarray, words: np.ndarray, label: int, crf: Crf) -> np.ndarray:
    """The best labelling of a training text's lines under which its label holds: mostly content (1) or mostly not (0)."""
    e = features @ np.array(crf.emission) + (LEANING if label else -LEANING)
    found = np.array(viterbi(e.tolist(), crf.step))
    need = CONTENT_SHARE * words.sum()
    for i in np.argsort(-e if label else e, kind="stable"):  # lines nearest to the text's label turn first
        if (found @ words >= need) == bool(label):
            break
        found[i] = label
    return found


def fit_steps(texts: list[tuple[np.ndarray, np.ndarray, int]], crf: Crf, first: bool, steps: int = STEPS, rate: float = 1.0, decay: float = 1e-3) -> Crf:
    """Weights after some steps of gradient ascent with momentum on texts (features, words, label) that follow each other.

    In the ``first`` round every line has its text's label.
    """
    y = np.concatenate([np.full(len(w), label) if first else line_labels(f, w, label, crf) for f, w, label in texts])
    n = -(-len(y) // CHAIN)
    pad = n * CHAIN - len(y)
    x = np.concatenate([f for f, _, _ in texts] + [np.zeros((pad, _K))]).reshape(n, CHAIN, _K)
    there = (np.arange(n * CHAIN) < len(y)).reshape(n, CHAIN)
    y = np.concatenate([y, np.zeros(pad, dtype=y.dtype)]).reshape(n, CHAIN)
    w, s = np.array(crf.emission), np.array(crf.step)
    dw, ds = np.zeros_like(w), np.zeros_like(s)
    total = there.sum()
    for _ in range(steps):
        _, gw, gs = likelihood(x, there, y, w, s)
        dw, ds = 0.9 * dw + gw / total - decay * w, 0.9 * ds + gs / total - decay * s
        w, s = w + rate * dw, s + rate * ds
    return Crf(tuple(w.tolist()), (tuple(s[0].tolist()), tuple(s[1].tolist())))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Crf:
    """Weights fitted on the ``sample`` labelled documents whose hashed ids are smallest, all lines of each.

    A document with several labels counts with the smallest, an id with several texts with the smallest of their lines; null labels
    and ids are skipped. Without documents of both labels: :data:`PRIOR`.
    """
    chosen = labels.select(F.col("doc_id").alias("id"), F.col("quality").cast("int").alias("label")).where("id is not null and label in (0, 1)")
    chosen = chosen.groupBy("id").agg(F.min("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                lines, features = _batch(part.column("text"), None)
                out, words = [], []
                for a, b in zip(lines.first[:-1], lines.first[1:], strict=True):
                    rows = np.flatnonzero(lines.n_words[a:b]) + a
                    out.append(features[rows].ravel())
                    words.append(lines.n_words[rows])
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("label"), pa.array(out, pa.list_(pa.float64())), pa.array(words, pa.list_(pa.int64()))], ["id", "label", "lines", "words"])

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")
    kind = texts.schema["id"].dataType.simpleString()
    rows = texts.select("id", "label", "text").mapInArrow(run, f"id {kind}, label int, lines array<double>, words array<long>").where(F.size("lines") > 0)
    rows = rows.groupBy("id").agg(F.min(F.struct("label", "lines", "words")).alias("own")).select("id", "own.*")
    rows = written(rows.repartition(TASKS, F.xxhash64("id")).sortWithinPartitions(F.xxhash64("id", F.lit(1)), "id").select(F.spark_partition_id().alias("task"), "label", "lines", "words"), "lines")
    if rows.select("label").distinct().count() < 2:
        return PRIOR

    def round_(crf: Crf, first: bool):
        def fit(task: pa.Table) -> pa.Table:
            columns = (task.column(c).to_pylist() for c in ("label", "lines", "words"))
            own = [(np.array(f).reshape(-1, _K), np.array(w), y) for y, f, w in zip(*columns, strict=True)]
            new = fit_steps(own, crf, first) if len({y for *_, y in own}) > 1 else crf
            n = sum(len(w) for _, w, _ in own) if new is not crf else 0
            return pa.table({"n": pa.array([n], pa.int64()), "weights": pa.array([[*new.emission, *new.step[0], *new.step[1]]], pa.list_(pa.float64()))})

        return fit

    crf = Crf((0.0,) * _K, ((0.0, 0.0), (0.0, 0.0)))
    for k in range(ROUNDS):
        found = rows.groupBy("task").applyInArrow(round_(crf, k == 0), "n long, weights array<double>").where("n > 0").collect()  # a row for each of TASKS
        if not found:
            return PRIOR
        mean = np.average([r["weights"] for r in sorted(found, key=lambda r: r["weights"])], axis=0, weights=[r["n"] for r in sorted(found, key=lambda r: r["weights"])]).tolist()
        crf = Crf(tuple(mean[:_K]), (tuple(mean[_K : _K + 2]), tuple(mean[_K + 2 :])))
    return crf


RESULT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, content_share double"


def with_quality(docs: DataFrame, crf: Crf, text_col: str = "text", content_share: float = CONTENT_SHARE) -> DataFrame:
    """``docs`` with a struct column ``quality``: the counts, ``content_share``, ``base_failed`` and ``kept``.

    Counts are over the whole text; words are ``[^\\x20\\x09-\\x0D]+``. A null, empty or wordless text has
    zero counts, a content share of 0 and fails. Every row of ``docs`` gives one row with all its columns;
    a column named ``quality`` is replaced.
    """
    small_batches(docs.sparkSession)
    names = [c for c in docs.columns if c != "quality"]
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(f"`{text_col}`").alias("text"))
    fields = [f.split()[0] for f in RESULT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column("row"), *map(pa.array, _batch(part.column("text"), crf))], ["row", *fields])

    schema = packed.select("row").schema
    for field in RESULT.split(", "):
        schema = schema.add(*field.split())
    done = packed.mapInArrow(run, schema)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    kept = ~failed & (F.col("content_share") >= content_share)
    return done.select("row.*", F.struct(*fields, failed.alias("base_failed"), kept.alias("kept")).alias("quality"))


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs`` with its id and the fields of :func:`with_quality`; weights from ``labels``."""
    crf = train(docs, labels, id_col=id_col, text_col=text_col)
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return with_quality(plain, crf).select("doc_id", "quality.*")
