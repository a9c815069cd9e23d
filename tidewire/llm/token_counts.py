"""Token counts by a map-side two-tier lookup.

Tier one is a broadcast table of the corpus's most frequent pre-tokens and their lengths in tokens. A
pre-token that it lacks goes to the worker's own cache, and only what neither holds is encoded. No
pre-token is ever shuffled: each task reports its most frequent ones as a bounded summary, and those
summaries alone are added up.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import islice, repeat

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..common.store import small_batches
from .textbatch import slices

#: Entries of the broadcast table, entries of a worker's cache, and pre-tokens that one task reports.
TABLE, CACHE, REPORTED = 32_768, 400_000, 4_096
#: Characters of the longest pre-token that is kept or counted, so that entries bound bytes: text without spaces is one pre-token.
LONGEST = 64

_loaded: dict[str, object] = {}


def load_sentencepiece(path: str):
    """The library's model at ``path``, loaded once per worker."""
    if path not in _loaded:
        import sentencepiece

        _loaded[path] = sentencepiece.SentencePieceProcessor(model_file=path)
    return _loaded[path]


def splits_at_spaces(path: str) -> bool:
    """Whether encoding a text word by word gives the same tokens as encoding it whole.

    So it is if the model leaves texts as they are and no piece has a space after another character: no
    merge can then reach across the start of a run of spaces.
    """
    key = f"{path}#splits"
    if key not in _loaded:
        model = load_sentencepiece(path)
        plain = model.normalize("ﬁ  x ") == "▁ﬁ▁▁x▁"
        pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()))
        _loaded[key] = plain and not any(re.search("[^▁]▁", p) for p in pieces)
    return _loaded[key]


def pre_tokens(text: str) -> list[str] | None:
    """Stretches of ``text`` that the model encodes independently, each without its first space.

    None if the text has to be encoded whole.
    """
    if "▁" in text or text[-1:] == " ":
        return None
    if "  " in text or text[:1] == " ":
        return [piece[1:] for piece in re.findall(" +[^ ]*", " " + text)]
    return text.split(" ")


class Lengths(dict):
    """A worker's cache of lengths; pre-tokens beyond its bound, and those longer than LONGEST, are encoded each time."""

    def __init__(self, path: str, bound: int):
        super().__init__()
        self.model, self.bound = load_sentencepiece(path), bound

    def add(self, missing: list[str]) -> dict[str, int]:
        """Encode pre-tokens in one call and keep as many as the bound allows."""
        new = dict(zip(missing, map(len, self.model.encode(missing, num_threads=1)), strict=True))
        room = self.bound - len(self)
        if room > 0:
            short = ((w, n) for w, n in new.items() if len(w) <= LONGEST)
            self.update(islice(short, room))
        return new


def frequent(docs: DataFrame, text_col: str, n: int = TABLE, reported: int = REPORTED) -> list[str]:
    """About the ``n`` most frequent pre-tokens of all texts, most frequent first; at most ``n`` strings.

    Every text is counted where it lies. A task keeps a bounded counter of pre-tokens of at most LONGEST characters (rare
    entries go whenever it grows beyond 50 times ``reported``), so memory and what is shuffled do not follow the corpus. The list only
    decides what is fast, never a count.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter: Counter = Counter()
        for batch in batches:
            for part in slices(batch, "text"):
                own: Counter = Counter()  # of one slice, whose bytes are bounded
                for text in part.column(0).to_pylist():
                    own.update((text or "").split(" "))
                counter.update({w: c for w, c in own.items() if 0 < len(w) <= LONGEST})
                if len(counter) > 50 * reported:
                    counter = Counter(dict(counter.most_common(10 * reported)))
        top = counter.most_common(reported)
        yield pa.RecordBatch.from_pydict({"word": pa.array([w for w, _ in top], pa.string()), "n": pa.array([c for _, c in top], pa.int64())})

    rows = (
        docs.select(F.col(text_col).alias("text"))
        .mapInArrow(count, "word string, n long")
        .groupBy("word")
        .agg(F.sum("n").alias("n"))
        .orderBy(F.desc("n"), "word")
        .limit(n)
        .collect()
    )
    return [r["word"] for r in rows]


def count_tokens(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096, table: int = TABLE, cache: int = CACHE) -> DataFrame:
    """One row per row of ``docs``: its id, ``n_bytes``, ``n_tokens`` and ``over_limit``.

    ``model`` is a path to a sentencepiece model, the same on every machine. Counts are those of the
    library for the whole text, with no begin, end or other added tokens; strings of special tokens inside
    a text are ordinary text, the library's default. A null text counts as empty: 0 bytes, 0 tokens, not over the
    limit. A null id stays null; repeated rows give repeated rows; an empty table gives an empty result.
    Other columns of ``docs``, whatever their names, are not read.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    words = frequent(docs, "text", table) if splits_at_spaces(model) else []
    lengths = dict(zip(words, map(len, load_sentencepiece(model).encode(words, num_threads=1)), strict=True)) if words else {}
    shared = docs.sparkSession.sparkContext.broadcast(lengths)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length = _text_length(model, shared.value, cache)
        for batch in batches:
            for part in slices(batch, "text"):
                counts = length(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_bytes"), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    sized = docs.withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    counted = sized.mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def _text_length(path: str, table: dict[str, int], cache: int) -> Callable[[list], list[int]]:
    model = load_sentencepiece(path)
    by_word = splits_at_spaces(path)
    key = f"{path}#lengths"
    if key not in _loaded:
        _loaded[key] = Lengths(path, cache)
    own: Lengths = _loaded[key]

    def lengths(texts: list) -> list[int]:
        if not by_word:
            return [len(x) for x in model.encode([t or "" for t in texts], num_threads=1)]
        out, waiting, open_texts = [], {}, []
        for i, text in enumerate(texts):
            pieces = pre_tokens(text) if text else []
            if pieces is None:
                out.append(len(model.encode(text)))
                continue
            known = list(map(table.get, pieces, repeat(-1)))
            total = sum(known)
            if -1 in known:
                rest = [p for p, k in zip(pieces, known, strict=True) if k < 0]
                total += len(rest)
                found = list(map(own.get, rest, repeat(-1)))
                total += sum(found)
                if -1 in found:
                    lost = [p for p, k in zip(rest, found, strict=True) if k < 0]
                    total += len(lost)
                    waiting.update(zip(lost, repeat(0)))
                    open_texts.append((i, lost))
            out.append(total)
        if waiting:
            new = own.add(list(waiting))
            for i, lost in open_texts:
                out[i] += sum(map(new.__getitem__, lost))
        return out

    return lengths
