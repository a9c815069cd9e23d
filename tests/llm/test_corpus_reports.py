"""Mixing, the filter audit and lexical search against brute force, on awkward tables."""

import math
import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from tidewire.llm import filter_audit, lookup, mixing, search

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(search.TERM)
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def docs(spark):
    """Texts of all kinds; clashing extra columns; a source, a text and an id that hold a third of the rows each."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)] + ["É", "ß,", "漢字", "A.B-c", "SHOUT", "#", "x\x85y", "k\xa0l", "&", "2nd"]
    texts = [None, "", " \n ", "one", "x" * 300_000, "ABC DEF", "tab\tand\x0bmore\x0c" * 40, " ".join(f"d{i}" for i in range(150)), " ".join(f"long{i % 997}" for i in range(20_000)), "$ " * 120]
    texts += [" ".join(rng.choice(words) for _ in range(rng.randint(1, 260))) for _ in range(60)] + ["the same page again " * 30] * 40
    rows = [(i, t, rng.choice(["a", "b", "é", "", None, "B", "𝄞", "hot", "hot", "hot"]), rng.choice(["en", "de", "", None]), "x", 7, "y") for i, t in enumerate(texts)]
    rows += [(5, "again ten words " * 3, "hot", "en", "x", 7, "y")] * 30 + [(None, f"no id {i}", "hot", "en", None, 1, "z") for i in range(20)] + rows[12:14] * 2 + [(901, None, "only nulls", "fr", None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, size string, copy int, rank string").repartition(5)


def _size(text):
    return len(WORD.findall(text or ""))


def test_word_count(docs):
    got = docs.select("text", mixing.word_count(F.col("text")).alias("n")).collect()
    assert all(r.n == _size(r.text) for r in got)


@pytest.mark.parametrize("max_rows", [1000, 0])
def test_mix(docs, monkeypatch, max_rows):
    monkeypatch.setattr(lookup, "HOT", 4)
    rows = docs.collect()
    sizes = defaultdict(int)
    for r in rows:
        sizes[r.source] += _size(r.text)
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, clamped, total = {}, set(), sum(sizes.values())
    while True:
        left, open_ = total - sum(3 * sizes[s] for s in clamped), sum(weight[s] for s in order if s not in clamped)
        target = {s: 3 * sizes[s] if s in clamped else left * weight[s] / open_ for s in order}
        above = {s for s in order if target[s] > 3 * sizes[s]}
        if not above:
            break
        clamped |= above
    assert len(clamped) > 1
    got = mixing.mix(docs, max_rows=max_rows).collect()
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter((r.doc_id, _size(r.text)) for r in rows)
    by_size = {}
    for s in order:
        by_size.setdefault(sizes[s], []).append(target[s])
    assert all(any(r.target == pytest.approx(t) for t in by_size[r.source_size]) for r in got)
    assert all(0 <= r.taken <= 3 * r["size"] for r in got)
    taken = Counter()
    for r in got:
        taken[r.source_size, round(r.target, 6)] += r.taken
    for (size, t), words in taken.items():
        alike = sum(1 for s in order if sizes[s] == size and round(target[s], 6) == t)
        assert abs(words - alike * t) <= 1 + 60 * alike  # rows of one draw lose less than a word each
    again = mixing.mix(docs.repartition(2), max_rows=max_rows).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))
    assert Counter(r.taken for r in mixing.mix(docs, seed=1).collect()) != Counter(r.taken for r in got)


def test_mix_of_nothing(spark, docs):
    assert mixing.mix(docs.limit(0)).count() == 0
    empty = mixing.mix(docs.where("text is null or text in ('', ' \n ')")).collect()
    assert empty and all((r.target, r.taken) == (0.0, 0) for r in empty)
    one = mixing.mix(spark.createDataFrame([(1, "a b c", "s")], "doc_id int, text string, source string")).first()
    assert (one.target, one.taken) == (3.0, 3)


def test_mix_with_equal_ratios(spark):
    rows = [(i, "w " * n, s) for i, (s, n) in enumerate([("a", 5), ("b", 2), ("c", 1), ("d", 5), ("e", 2), ("f", 1000)])]
    got = {r.doc_id: r for r in mixing.mix(spark.createDataFrame(rows, "doc_id int, text string, source string")).collect()}
    assert [got[i].target for i in range(5)] == [15.0, 6.0, 3.0, 15.0, 6.0] and got[5].target == 970.0
    assert all(got[i].taken == got[i].target for i in range(6))


def test_mixed_texts(docs):
    plain = docs.drop("copy")
    rows = mixing.mixed(plain).collect()
    want = Counter()
    for r in mixing.mix(plain).collect():
        want[r.doc_id] += r.taken
    got = Counter()
    texts = defaultdict(set)
    for r in plain.collect():
        texts[r.doc_id].add(r.text)
    for r in rows:
        got[r.doc_id] += _size(r.text)
        assert any(t is not None and t.strip(" \t\n\x0b\f\r").startswith(r.text.strip(" \t\n\x0b\f\r")) for t in texts[r.doc_id])
    assert got == +want and rows[0].asDict().keys() == {*plain.columns, "copy"}
    with pytest.raises(ValueError):
        mixing.mixed(docs)


def _audit(rows, labels):
    least = {}
    for r in rows:
        if r.doc_id is not None:
            least[r.text or ""] = min(r.doc_id, least.get(r.text or "", r.doc_id))
    tally = Counter()
    for r in rows:
        t = r.text or ""
        w = WORD.findall(t)
        fails = "".join(
            f
            for f, bad in zip("ABCDE", (len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t), any(c in "#$%&*|" for c in t), r.doc_id is not None and r.doc_id > least[t]), strict=True)
            if bad
        )
        mine = [x for x in labels if x[0] is not None and x[0] == r.doc_id]
        tally[r.lang or "", fails, any(x[1] == 1 for x in mine), any(x[2] == 1 for x in mine)] += 1
    out = set()
    for part in {k[0] for k in tally}:
        mine = [(k, n) for k, n in tally.items() if k[0] == part]
        removed = defaultdict(Counter)
        for order in map("".join, permutations("ABCDE")):
            for (_, fails, good, toxic), n in mine:
                first = next((s for s, f in enumerate(order, 1) if f in fails), 6)
                for step, f in enumerate(order, 1):
                    c = removed[order, step]
                    c["kept"] += n * (first > step)
                    c["removed"] += n * (first == step)
                    c["redundant"] += n * (f in fails and first < step)
                    c["unique"] += n * (fails == f)
                    c["good"] += n * (first == step and good)
                    c["toxic"] += n * (first == step and toxic)
        shapley = Counter()
        for (order, step), c in removed.items():
            shapley[order[step - 1]] += c["removed"]
        out |= {(part, o, s, c["kept"], c["removed"], c["redundant"], c["unique"], c["good"], c["toxic"], shapley[o[s - 1]]) for (o, s), c in removed.items()}
    return out


@pytest.mark.parametrize("max_rows", [1000, 0])
def test_filter_audit(spark, docs, monkeypatch, max_rows):
    monkeypatch.setattr(lookup, "HOT", 4)
    monkeypatch.setattr(filter_audit, "PIECE", 50)
    monkeypatch.setattr(filter_audit, "PARTS", 1)
    labels = [(i, i % 2, int(i % 3 == 0)) for i in range(60)] + [(7, 0, 1), (7, 1, None), (None, 1, 1)]
    table = spark.createDataFrame([(*x, "en") for x in labels], "doc_id long, quality int, toxic int, lang string")
    got = filter_audit.audit(docs, table, max_rows=max_rows)
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == _audit(docs.collect(), labels)
    assert filter_audit.audit(docs.limit(0), table).count() == 0
    assert all(r.good_lost == r.toxic_lost == 0 for r in filter_audit.audit(docs, table.limit(0)).collect())


def _ranked(rows, text, k):
    terms = [Counter(TERM.findall((r.text or "").translate(LOWER))) for r in rows]
    n_docs, total = sum(1 for t in terms if t), sum(sum(t.values()) for t in terms)
    df = Counter(w for t in terms for w in t)
    found = []
    for r, t in zip(rows, terms, strict=True):
        m = 75 + (25 * sum(t.values()) * n_docs) // total
        score = sum(c * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((10**9 * t[w]) // (1000 * t[w] + 12 * m)) for w, c in Counter(TERM.findall(text.translate(LOWER))).items() if w in t)
        if score > 0:
            found.append((-score, r.doc_id is None, r.doc_id or 0))
    return [(i, None if null else d, -s) for i, (s, null, d) in enumerate(sorted(found)[:k], 1)]


@pytest.mark.parametrize(("block", "entries"), [(64, 100_000), (3, 20)])
def test_search(spark, docs, monkeypatch, block, entries):
    monkeypatch.setattr(search, "FIRST", 2)
    monkeypatch.setattr(search, "SORTED", 4)
    texts = ["w1 w2 w2 É shout a.b", "the same page again", "W3 w3 no id 7", "long5 d7 unheard-of", "", None, "?!", "ß 漢字 2nd x\x85y", "again ten words", " ".join(f"w{i}" for i in range(60)), "é"]
    items = [(i, t, "q", 1) for i, t in enumerate(texts)] + [(0, texts[0], "other", 2), (None, "w9 w8", "q", 3)]
    table = spark.createDataFrame(items, "item_id int, text string, doc_id string, rank int")
    got = defaultdict(list)
    for r in search.search(docs, table, k=7, block=block, entries=entries).collect():
        got[r.item_id].append((r["rank"], r.doc_id, r.score))
    rows = docs.collect()
    want = {i: _ranked(rows, t, 7) for i, t, *_ in items if t}
    assert {i: sorted(v) for i, v in got.items()} == {i: v for i, v in want.items() if v}
    same = search.search(docs, table.where("item_id = 1"), k=7).select("doc_id").collect()
    assert len(same) == 7  # forty equal texts: the smallest ids


def test_search_prunes(spark):
    """Blocks whose bound is below the threshold are not scored."""
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice([f"c{k}" for k in range(400)]) for _ in range(60)) + (" rare thing here" if i % 500 == 3 else ""), "s") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, s string").repartition(2)
    index = search.build(docs, ["c1", "here", "rare", "thing"])
    weights = search._weights(index, [{"q": 0, "term": t, "n": 1} for t in ("rare", "thing", "here")])
    table = index.table.toArrow().combine_chunks().to_batches()[0]
    best = search._Best(8, weights.sum(axis=1) * 0)
    assert search._score(table, weights, best) <= 8 < table.num_rows and len(best.held[0]) == 8
    index.drop()


def test_search_of_nothing(spark, docs):
    items = spark.createDataFrame([(1, "w1")], "item_id int, text string")
    assert search.search(docs.limit(0), items).count() == 0
    assert search.search(docs, items.limit(0)).columns == ["item_id", "rank", "doc_id", "score"]
    assert search.search(docs.where("text is null"), items).count() == 0
    named = spark.createDataFrame([("b", "w1 w2"), ("a", "w1 w2"), (None, "w1 w2")], "doc_id string, text string")
    assert [r.doc_id for r in search.search(named, spark.createDataFrame([(1, "w2")], "item_id int, text string"), k=2).orderBy("rank").collect()] == ["a", "b"]
