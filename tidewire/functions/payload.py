"""What payloads say, as columns: targets of web requests, names that are asked for."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Ports of the web, verbs of requests, characters that are special in a target, the least payload of a request and of a question.
WEB_PORTS = (80, 8080, 8000)
VERBS = ("GET", "POST", "HEAD", "PUT")
SPECIAL = " '\"=<>():;%&/\\#+?*!{}[]|`^~$,"
LEAST_REQUEST, LEAST_QUESTION, NAME_PORT = 11, 12, 53
#: Bytes before the first question, the longest label, and the most labels of a name.
QUESTION_AT, LABEL, LABELS = 12, 63, 128


def web_request(payload: Column) -> Column:
    """The first line of a web request without what is not ASCII; null for any other payload."""
    text = F.regexp_replace(F.decode(payload, "ISO-8859-1"), r"[^\x00-\x7F]", "")
    line = F.substring_index(text, "\r\n", 1)
    return F.when(line.rlike(f"^(?:{'|'.join(VERBS)}) "), line)


def target(request: Column) -> Column:
    """The target of a request line; null if it names none."""
    found = F.regexp_extract(request, r"^\S+\s+(\S+)", 1)
    return F.when(found != "", found)


def special_ratio(text: Column) -> Column:
    """Share of SPECIAL characters."""
    return 1 - F.length(F.translate(text, SPECIAL, "")) / F.greatest(F.length(text), F.lit(1))


def question_names(payload: pa.Array) -> pa.Array:
    """The name of the first question of each message, in lower case; null where its labels do not end inside the message or are not ASCII.

    All messages of a batch go label by label together: a label's length says where the next begins.
    """
    payload = payload.cast(pa.large_binary())
    offsets = np.frombuffer(payload.buffers()[1], np.int64)[payload.offset : payload.offset + len(payload) + 1]
    data = np.frombuffer(payload.buffers()[2], np.uint8)[: offsets[-1]].copy() if len(payload) and offsets[-1] else np.zeros(0, np.uint8)
    first, end = offsets[:-1] + QUESTION_AT, offsets[1:]
    at, ended = first.copy(), np.zeros(len(payload), dtype=bool)
    open_ = np.flatnonzero(at < end)
    for _ in range(LABELS):
        if not len(open_):
            break
        size = data[at[open_]].astype(np.int64)
        ended[open_[size == 0]] = True
        open_, size = open_[size > 0], size[size > 0]
        fits = (size <= LABEL) & (at[open_] + 1 + size < end[open_])
        open_, size = open_[fits], size[fits]
        data[at[open_]] = ord(".")
        at[open_] += 1 + size
    named = ended & (at > first)
    size = np.where(named, at - first - 1, 0)
    starts = np.concatenate([[0], np.cumsum(size)])
    name = data[np.repeat(first + 1 - starts[:-1], size) + np.arange(starts[-1])]
    foreign = np.zeros(len(payload), dtype=bool)
    foreign[np.searchsorted(starts, np.flatnonzero(name > 127), "right") - 1] = True
    upper = (name >= 65) & (name <= 90)
    name = np.where(name > 127, ord("?"), name + 32 * upper).astype(np.uint8)
    text = pa.Array.from_buffers(pa.large_string(), len(payload), [None, pa.py_buffer(starts.astype(np.int64).tobytes()), pa.py_buffer(name.tobytes())])
    return pa.array(np.where(named & ~foreign, text.to_numpy(zero_copy_only=False), None), pa.string())


def question_name(payload: Column) -> Column:
    """:func:`question_names` as a column; null payloads have none."""

    @F.arrow_udf("string")
    def names(column: pa.Array) -> pa.Array:
        return question_names(column.fill_null(b""))

    return names(payload)
