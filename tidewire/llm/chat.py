"""Chat formatting by relational expressions only.

A conversation's turns are collected as structs and sorted; adjacent turns of one role share a block; blocks are concatenated
with the template's marks. Control strings inside texts are broken by a backslash after their first
character (backslashes are doubled), so marks are found by plain search and texts come back unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Marks around a block of each role, between the turns of a block, and of blocks of any other role, which name it.
MARKS = {"user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>"), "system": ("<<SYS>>", "<</SYS>>")}
NEXT, ROLE, TEXT, END_ROLE = "[NEXT]", "[ROLE]", "[TEXT]", "[/ROLE]"

_AFTER_FIRST = r"/?INST\]|/?s>|</?SYS>>|/?ROLE\]|TEXT\]|NEXT\]"
_BLOCK = r"(?s)(?:\[INST\]|<s>|<<SYS>>|\[ROLE\]).*?(?:\[/INST\]|</s>|<</SYS>>|\[/ROLE\])"


def escape(text: Column) -> Column:
    """``text`` without control strings; :func:`unescape` undoes it."""
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), rf"(\[|<)(?={_AFTER_FIRST})", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _opening(role: Column) -> Column:
    out = F.concat(F.lit(ROLE), escape(role), F.lit(TEXT))
    for name, (mark, _) in MARKS.items():
        out = F.when(role == name, F.lit(mark)).otherwise(out)
    return out


def _closing(role: Column) -> Column:
    out = F.lit(END_ROLE)
    for name, (_, mark) in MARKS.items():
        out = F.when(role == name, F.lit(mark)).otherwise(out)
    return out


def _blocks(turns: Column) -> Column:
    """Sorted turns as an array of arrays: adjacent turns of one role together."""

    def of(t: Column) -> Column:
        changes = F.filter(F.sequence(F.lit(1), F.size(t)), lambda i: (i == 1) | (F.element_at(t, i)["role"] != F.get(t, i - 2)["role"]))

        def cut(s: Column) -> Column:
            return F.transform(s, lambda first, k: F.slice(t, first, F.coalesce(F.get(s, k + 1), F.size(t) + 1) - first))

        return F.element_at(F.transform(F.array(changes), cut), 1)

    return F.element_at(F.transform(F.array(turns), of), 1)


def _parts(blocks: Column) -> Column:
    """The pieces of the formatted text with whether each is under the loss mask."""

    def piece(text: Column, loss: Column) -> Column:
        return F.struct(text.alias("s"), loss.alias("loss"))

    def of(block: Column) -> Column:
        role = F.element_at(block, 1)["role"]
        texts = F.flatten(
            F.transform(
                block,
                lambda turn, i: F.array(
                    piece(F.when(i == 0, _opening(role)).otherwise(F.lit(NEXT)), F.lit(False)),
                    piece(escape(turn["text"]), role == "assistant"),
                ),
            )
        )
        return F.concat(texts, F.array(piece(_closing(role), F.lit(False))))

    return F.flatten(F.transform(blocks, of))


def _let(value: Column, of) -> Column:
    """``of`` applied to a value that is computed once."""
    return F.element_at(F.transform(F.array(value), of), 1)


def _running(lengths: Column, start: Column) -> Column:
    """What precedes each of some lengths, from ``start`` on; for arrays of moderate size, since it grows an array."""
    empty = F.struct(start.alias("at"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(lengths, empty, lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])


def _starts(lengths: Column) -> Column:
    """What precedes each of any number of lengths: sums over stretches of about the square root of their number, then within each."""

    def of(all_: Column) -> Column:
        k = F.greatest(F.ceil(F.sqrt(F.size(all_))).cast("int"), F.lit(1))
        stretches = F.when(F.size(all_) > 0, F.transform(F.sequence(F.lit(1), F.size(all_), k), lambda first: F.slice(all_, first, k)))
        stretches = F.coalesce(stretches, F.array().cast("array<array<int>>"))

        def within(s: Column) -> Column:
            sums = F.transform(s, lambda x: F.aggregate(x, F.lit(0), lambda acc, n: acc + n))
            return _let(_running(sums, F.lit(0)), lambda bases: F.flatten(F.transform(s, lambda x, i: _running(x, F.get(bases, i)))))

        return _let(stretches, within)

    return _let(lengths, of)


def _spans(parts: Column) -> Column:
    """Code-point spans (start, end) of the pieces under the loss mask."""

    def of(p: Column) -> Column:
        lengths = F.transform(p, lambda part: F.length(part["s"]))

        def cut(both: Column) -> Column:
            spans = F.transform(p, lambda part, i: F.struct(part["loss"].alias("loss"), F.get(both["starts"], i).alias("start"), (F.get(both["starts"], i) + F.get(both["lengths"], i)).alias("end")))
            return F.transform(F.filter(spans, lambda x: x["loss"]), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))

        return _let(lengths, lambda n: _let(F.struct(n.alias("lengths"), _starts(n).alias("starts")), cut))

    return _let(parts, of)


#: Code points of the stretches that a text is cut into to read spans of it.
STRETCH = 4_096


def masked(text: Column, spans: Column) -> Column:
    """The texts of code-point spans, as an array; each reads the stretches of the text that it lies in and no more."""
    stretches = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{STRETCH}}}"), F.lit(0))

    def read(cut: Column) -> Column:
        def one(span: Column) -> Column:
            first, last = F.floor(span["start"] / STRETCH).cast("int"), F.floor((span["end"] - 1) / STRETCH).cast("int")
            own = F.array_join(F.slice(cut, first + 1, last - first + 1), "")
            return F.when(span["end"] > span["start"], F.substring(own, span["start"] % STRETCH + 1, span["end"] - span["start"])).otherwise("")

        return F.transform(spans, one)

    return _let(stretches, read)


def format_chats(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: ``conv_id``, ``formatted`` and ``loss_spans``.

    Rows are taken by turn, ties by role and text; a null turn comes first, a null text or role is empty, rows with a null id
    are one conversation. The spans are the code points of ``formatted`` under the loss mask: each
    assistant text, escaped as it stands there, without marks. A conversation is one row of the result, so it has
    to fit into one (2 GB). An empty table gives an empty result; other columns are not read.
    """
    turn = F.struct(F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"))
    turns = conversations.groupBy(F.col(id_col).alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    parts = turns.select("conv_id", _parts(_blocks(F.col("turns"))).alias("parts"))
    return parts.select("conv_id", F.array_join(F.transform("parts", lambda p: p["s"]), "").alias("formatted"), _spans(F.col("parts")).alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """The turns that a formatted text holds, as an array of (role, text)."""

    def inside(block: Column, opening: str, closing: str) -> Column:
        return F.substring(block, F.lit(len(opening) + 1), F.length(block) - len(opening) - len(closing))

    def of(block: Column) -> Column:
        other = inside(block, ROLE, END_ROLE)
        role, body = unescape(F.substring_index(other, TEXT, 1)), F.substring(other, F.length(F.substring_index(other, TEXT, 1)) + len(TEXT) + 1, F.length(other))
        for name, (opening, closing) in MARKS.items():
            is_own = F.startswith(block, F.lit(opening))
            role = F.when(is_own, F.lit(name)).otherwise(role)
            body = F.when(is_own, inside(block, opening, closing)).otherwise(body)
        texts = F.split(body, r"\[NEXT\]", -1)
        return F.transform(F.array(F.struct(role.alias("role"), texts.alias("texts"))), lambda b: F.transform(b["texts"], lambda t: F.struct(b["role"].alias("role"), unescape(t).alias("text"))))[0]

    return F.flatten(F.transform(F.regexp_extract_all(formatted, F.lit(_BLOCK), F.lit(0)), of))


def read_back(chats: DataFrame) -> DataFrame:
    """What the output of :func:`format_chats` holds: counts and digests of its turns and of what is under its loss mask."""
    turns = F.transform(read_turns(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    loss = F.transform(masked(F.col("formatted"), F.col("loss_spans")), unescape)
    read = chats.select("conv_id", "formatted", turns.alias("turns"), F.array_join(loss, "").alias("loss"))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join("turns", ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
