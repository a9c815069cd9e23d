"""The training-data operators against brute force, on texts chosen to be awkward."""

import hashlib
import os.path
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidewire.llm import byte_bpe, chat, decontam, licenses, main_text, near_dup, packing, quality, token_counts, token_files, warc

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
WORD, LOWER = re.compile(r"[^\x20\x09-\x0D]+"), str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _texts():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)] + ["é", "ß,", "漢字", "***", "<s>", "</s>", "<|endoftext|>", "▁x", "A.B", "MIT", "License"]
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(60, 120))) for _ in range(12)]
    out = ["", " ", "one", "a b c d", "A b C d", "a\tb c\nd e", "x" * 400_000, "  two  spaces \n\n end ", "Released under the MIT License.", "Licensed under CC BY-NC 4.0, mit license apache license"]
    for text in base:
        out += [text, text.upper() if rng.random() < 0.3 else text + "\n"]
        for _ in range(8):
            own = text.split(" ")
            for _ in range(rng.randint(1, 4)):
                own[rng.randrange(len(own))] = rng.choice(words)
            out.append(" ".join(own))
    return out + [" ".join(f"long{i % 997}" for i in range(20_000)), "same line\nsame line\nother " + "again and again " * 20]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, f"host{i}", 1, "q") for i, t in enumerate(_texts())]
    rows += [(900, None, None, 2, None), (901, None, "h", 3, "x"), (3, rows[20][1], "h", 4, "x"), (20, rows[20][1], "h", 5, "x"), (20, rows[20][1], "h", 5, "x"), (None, rows[30][1], "h", 6, "x"), (None, "alone and without any id here", "h", 7, "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, host string, n_tokens int, set_key string").repartition(3)


def _set(text, lower=True):
    w = WORD.findall((text or "").translate(LOWER) if lower else (text or "").lower())
    return frozenset(zip(*[w[i:] for i in range(5)], strict=False)) if len(w) >= 5 else frozenset({tuple(w)} if w else ())


def test_token_counts(docs):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    want = Counter((r.doc_id, len((r.text or "").encode()), len(model.encode(r.text or ""))) for r in docs.collect())
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in token_counts.count_tokens(docs, PIECES, table=50, cache=100).collect()) == want
    assert token_counts.count_tokens(docs.limit(0), PIECES).count() == 0


def test_caches_hold_no_long_pre_tokens(spark):
    """Texts without spaces are one pre-token each: 100,000 of them leave nothing in a worker's cache."""
    texts = spark.range(100_000).select(F.col("id").alias("doc_id"), F.concat(F.repeat(F.lit("漢字"), 60), F.col("id").cast("string")).alias("text"))
    assert token_counts.frequent(texts, "text") == []
    own = token_counts.Lengths(PIECES, 50)
    missing = [f"w{k}" for k in range(40)] + ["漢" * 70 + str(k) for k in range(1000)] + [f"v{k}" for k in range(40)]
    assert len(own.add(missing)) == len(missing) and len(own) == 50 and max(map(len, own)) <= token_counts.LONGEST
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    some = texts.where("doc_id % 9973 = 0")
    assert {r.doc_id: r.n_tokens for r in token_counts.count_tokens(some, PIECES).collect()} == {r.doc_id: len(model.encode(r.text)) for r in some.collect()}


def test_encoder_equals_library():
    own, rng = byte_bpe.Encoder(BPE, bound=500), random.Random(1)
    parts = [" ", "  ", "\n", "\t", "a", "é", "B", "1", "'s", "'", ",", "!!", " \n", "\x1c", "\x85", "\xa0", "<|endoftext|>", "\0", "漢", "\r\n", "😀"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert np.frombuffer(own.encode(text), "<u4").tolist() == own.library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("small", [1024, 6])
def test_near_duplicates(docs, monkeypatch, small):
    monkeypatch.setattr(near_dup, "SMALL", small)
    monkeypatch.setattr(near_dup, "CELL", small)
    rows = docs.collect()
    sets = [_set(r.text) for r in rows]
    parent = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            k = len(sets[i] & sets[j])
            if k and 100 * k >= 85 * (len(sets[i]) + len(sets[j]) - k):
                parent[near_dup._root(parent, i)] = near_dup._root(parent, j)
    ids = defaultdict(list)
    for i, r in enumerate(rows):
        ids[near_dup._root(parent, i)].append(r.doc_id)
    least = {k: min((x for x in v if x is not None), default=None) for k, v in ids.items()}
    want = Counter((r.doc_id, len(sets[i]), least[near_dup._root(parent, i)], r.doc_id == least[near_dup._root(parent, i)]) for i, r in enumerate(rows))
    got = near_dup.near_duplicates(docs).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == want
    assert any(not r.kept for r in got)


def test_near_duplicates_with_a_shared_passage(spark, monkeypatch):
    """Pairs at the threshold among more than ``SMALL`` texts that have 60 % of their shingles in common."""
    monkeypatch.setattr(near_dup, "SMALL", 32)
    rng = random.Random(11)
    passage, rows = [f"p{i}" for i in range(64)], []
    for i in range(250):
        own = [f"w{rng.randrange(10**6)}" for _ in range(40)]
        other = own[:20] + ["x", *own[21:23], "y"] + own[24:]
        rows += [(2 * i, " ".join(passage + own)), (2 * i + 1, " ".join(passage + other))]
    a, b, c = (_set(rows[i][1]) for i in (0, 1, 2))
    assert 100 * len(a & b) >= 85 * len(a | b) and 2 * len(a & c) < len(a | c)
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: i - i % 2 for i, _ in rows}


def test_trees_follow_the_threshold():
    def missed(threshold, n):
        share = threshold / 100
        return (1 - share * (1 - (1 - share) ** near_dup.BRANCH) ** near_dup.LEVELS) ** n

    for threshold in (60, 80, 85, 95):
        n = near_dup.trees(threshold)
        assert missed(threshold, n) <= near_dup.MISSED < missed(threshold, n - 1)
    assert (near_dup.trees(85), near_dup.trees(80), near_dup.trees(100)) == (10, 13, 1)


def test_deduplicate_keeps_one_of_each(docs):
    kept = near_dup.deduplicate(docs, 80)
    assert kept.columns == docs.columns
    sets = [_set(r.text) for r in kept.collect()]
    for i, a in enumerate(sets):
        assert all(10 * len(a & b) < 8 * len(a | b) for b in sets[:i] if a and b)
    assert near_dup.deduplicate(docs.limit(0)).count() == 0


def _page(body):
    return f"<html><head><title>t</title></head><body>{body}</body></html>"


def test_main_text():
    shared = "<p>Site line</p>"
    lines, kinds = main_text.page_lines(_page("<nav><a href='x>y'>menu</a></nav><article><h1>T &amp; U</h1><p>one<br>two  <b>x</b><p>three</article><div class=\"ad\">buy</div>"))
    assert main_text.main_text(lines, kinds, None) == "T & U\n\none two x\n\nthree"
    a, b = main_text.page_lines(_page(shared + "<p>own</p>")), main_text.page_lines(_page(shared + "<p>other</p>"))
    assert main_text.main_text(*a, b[0]) == "own"
    assert main_text.page_lines(None) == ([], []) and main_text.page_lines("<p>x<div class=\"open")[0] == ["x"]
    one, two = (main_text.page_lines(_page(f"<main><p>menu</p><p>{x}</p></main>")) for x in ("first text", "second text"))
    assert main_text.main_text(*one, two[0]) == "first text" and main_text.main_text(*one, two[0], ["else"]) == "menu\n\nfirst text"
    for body in ('<article class="post share-enabled"><p>x</p></article>', "<form><div><article><p>x</p></article></div><input></form>", "<form><p>x</p></form>", '<article><h2>c</h2></article><div><p>x y z</p></div><footer>f</footer><article class="comment">no</article>'):
        assert main_text.main_text(*main_text.page_lines(_page(body)), None).endswith(("x", "x y z"))


def test_article_keeps_text_whose_class_has_a_name_in_it():
    cases = {
        '<article><p>x</p><section class="share-price"><p>The price rose.</p></section></article>': "x\n\nThe price rose.",
        '<article><div class="related-work"><p>Others have shown it.</p></div></article>': "Others have shown it.",
        '<article><div class="notice-of-motion"><p>That this house agrees.</p></div></article>': "That this house agrees.",
        '<article><p>x</p><div class="modal widget" id="notice"><p>The modal verbs.</p></div></article>': "x\n\nThe modal verbs.",
        '<article><p>x</p><div class="ad wide">buy</div><ul id="comments"><li>first!</li></ul><aside>else</aside><nav>up</nav></article><div class="share">it</div>': "x",
        '<div class="menu">a</div><div class="menu-of-the-day"><p>Soup, then fish.</p></div>': "Soup, then fish.",
    }
    for body, text in cases.items():
        assert main_text.main_text(*main_text.page_lines(_page(body)), None) == text


def test_common_lines_are_longest():
    rng = random.Random(2)
    for _ in range(600):
        x, y = ([rng.choice("abcdefg"[: rng.randint(1, 7)]) for _ in range(rng.randint(0, 12))] for _ in range(2))
        table = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i in range(len(x)):
            for j in range(len(y)):
                table[i + 1][j + 1] = table[i][j] + 1 if x[i] == y[j] else max(table[i][j + 1], table[i + 1][j])
        found, rest = main_text.common_lines(x, y), iter(y)
        assert len(found) == table[-1][-1] and found == sorted(set(found)) and all(any(x[i] == w for w in rest) for i in found)
    began = time.process_time()
    for x, y in ((["q"] + ["x"] * 20_000, ["x"] * 19_000 + ["y", "q"]), ([str(rng.randrange(900)) for _ in range(9_000)], [str(rng.randrange(900)) for _ in range(9_000)])):
        main_text.common_lines(x, y)
    assert time.process_time() - began < 3


def test_main_text_over_partitions(spark, monkeypatch):
    """Hosts with copies, near copies and a long run of copies, against pairing by hand; the clashing columns are not read."""
    rng = random.Random(8)
    rows, hosts = [], defaultdict(list)
    for i in range(400):
        host = f"h{rng.choice([0, 0, 0, 1, 2, i])}.org"
        if hosts[host] and rng.random() < 0.4:
            body = rng.choice(hosts[host])[1]
            body += "<p>last</p>" if rng.random() < 0.3 else ""
        else:
            own = "".join(f"<p>{' '.join(rng.choice('abcdefghijklmnopqrstuvwxyz') * 3 for _ in range(6))} {i}</p>" for _ in range(4))
            body = f"<p>top {host}</p><p>{rng.choice(['x', 'y'])} notice</p>{own}" + rng.choice(["", f"<article><p>art {i} with a text of its own</p><p>shared in articles</p></article>"]) + "<p>foot</p>"
        path = f"/{rng.choice('abc')}/{i:03d}"
        hosts[host].append((path, body))
        rows.append((i, f"http://{host}{path}", _page(body), f"http://{host}", path, "k", 1))
    for i in range(400, 700):
        path = f"/b/50/{i}"
        hosts["h1.org"].append((path, "<p>top h1.org</p><p>a run of copies</p><p>foot</p>"))
        rows.append((i, f"http://h1.org{path}", _page(hosts["h1.org"][-1][1]), None, None, None, None))
    rows += [(1000, None, None, None, None, None, None), (1001, "http://alone.org/", "<p>only</p>", None, None, None, None), (1002, "http://", "<p>no host</p>", None, None, None, None)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string, path string, status string, part int").repartition(5)
    got = sorted((r.url or "", r.text, r.n_chars) for r in main_text.extract(pages).collect())
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = [("", "", 0), ("http://", "no host", 7), ("http://alone.org/", "only", 4)]
    for host, own in hosts.items():
        own = [(path, main_text.page_lines(_page(body))) for path, body in sorted(own, key=lambda x: x[0])]
        groups = []
        for page in own:
            if not groups or not main_text.are_copies(page[1], groups[-1][0][1]):
                groups.append([])
            groups[-1].append(page)
        for k, group in enumerate(groups):
            for path, page in group:
                sides = [(p[0], p[1][0]) for p in ([groups[k - 1][-1]] if k else [None]) + ([groups[k + 1][0]] if k + 1 < len(groups) else [None]) if p] if len(groups) > 1 else []
                both = sorted(sides, key=lambda s: -len(os.path.commonprefix([path, s[0]])))
                want.append((f"http://{host}{path}", *(lambda t: (t, len(t)))(main_text.main_text(*page, *[x[1] for x in both] or [None]))))
    assert got == sorted(want)
    assert all("foot" not in text for url, text, _ in got if "/b/50/4" in url)
    assert main_text.extract(pages.limit(0)).count() == 0


def test_warc(spark):
    long = "y" * 200
    rows = [(5, "u", long), (2, "u\r\nx", long), (2, "v", long), (None, None, long), (7, "w", None), (8, "w", "short"), (9, "w", "short"), (9, "w", "short"), (9, "w2", "other"), (10, "z", "é" * 300_000)]
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, digest string, first int")
    want = [(i, len((h or "").encode()), hashlib.sha256((h or "").encode()).hexdigest(), "revisit" if h == long and i != 2 else "response", 2 if h == long and i != 2 else None) for i, _, h in rows]
    assert Counter(map(tuple, warc.archived(pages).collect())) == Counter(want)
    root = warc.new_path(spark, "test")
    warc.write_archive(pages, root, frame=500, bundle=1000)
    assert {(r.record_id, r.payload.decode()) for r in warc.fetch(spark, root, spark.createDataFrame([(8,), (10,)], "page_id long")).collect()} == {("8", "short"), ("10", "é" * 300_000)}
    nines = warc.fetch(spark, root, spark.createDataFrame([(9,)], "page_id long")).collect()
    assert sorted(r.payload.decode() for r in nines) == ["other", "short", "short"] and len({r.urn for r in nines}) == 3
    index = spark.read.schema(warc.INDEX).parquet(f"{root}/index").collect()
    assert len(index) == len(rows) and len({r.urn for r in index}) == len(rows) - 1  # two rows of the smallest id with one payload
    assert warc.archived(pages.limit(0)).count() == 0


def _ids(text):
    return np.array(Tokenizer.from_file(BPE).encode(text or "", add_special_tokens=False).ids + [2], "<u4")


def test_token_files(docs):
    by = {t: _ids(t) for t in {r.text for r in docs.collect()}}
    got = sorted(token_files.tokenized(docs, BPE).collect(), key=lambda r: r.start)
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    assert [r.doc_id for r in got] == sorted((r.doc_id for r in got), key=lambda x: (x is not None, x))
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter((r.doc_id, len(by[r.text]), zlib.crc32(by[r.text].tobytes())) for r in docs.collect())
    assert token_files.tokenized(docs.limit(0), BPE).count() == 0


def test_re_pair_random_access():
    rng = np.random.default_rng(3)
    ids = [rng.zipf(1.5, n).clip(1, 900).astype("<u4").tobytes() + b"\2\0\0\0" for n in (0, 1, 5000, 40, 9000)]
    shard = token_files.load(token_files.dump(0, 7, ["a", None, "c", "d", ""], ids, 1000))
    assert shard.ids == ["a", None, "c", "d", ""] and shard.start == 7 and len(shard.rules)
    flat, at = shard.decode_all()
    for k, want in enumerate(ids):
        want = np.frombuffer(want, "<u4")
        assert np.array_equal(flat[at[k] : at[k + 1]], want) and np.array_equal(shard.decode(k), want)
        for a, b in ((0, 1), (len(want) // 3, len(want) // 2), (len(want) - 1, len(want) + 9)):
            assert np.array_equal(shard.decode(k, a, b), want[a:b])


def test_re_pair_leaves_no_frequent_pair():
    rng = np.random.default_rng(4)
    for k in range(12):
        parts = [rng.zipf(1.3, 3000).clip(1, 40), np.repeat(rng.integers(1, 5, 300), rng.integers(1, 30, 300)), rng.integers(1, 4, int(rng.integers(1, 2000)))]
        symbols = np.concatenate(parts[k % 3 :]).astype(np.uint32)
        last = rng.random(len(symbols)) < 0.02
        last[-1] = True
        packed, ends, rules = token_files.re_pair(symbols, last, 1000)
        assert np.array_equal(token_files.expand(packed, rules, 1000), symbols)
        sizes = token_files.Shard(0, 0, [], 1000, rules, token_files.expansion_lengths(rules, 1000), np.zeros(1), packed).sizes(packed)
        assert np.array_equal(np.cumsum(sizes)[ends] - 1, np.flatnonzero(last))
        counts, i = Counter(), 0
        while i < len(packed) - 1:  # occurrences that do not overlap themselves
            pair = int(packed[i]), int(packed[i + 1])
            if not ends[i]:
                counts[pair] += 1
            i += 2 if i + 2 < len(packed) and pair[0] == pair[1] == packed[i + 2] and not ends[i] and not ends[i + 1] else 1
        assert max(counts.values(), default=0) < token_files.LEAST
        assert np.all(np.bincount(np.concatenate([packed, rules.ravel()]), minlength=1000 + len(rules))[1000:] >= 1)


def test_chat_round_trip(spark):
    rows = [(1, 0, "user", "</s>[INST] ok [/INST]"), (1, 1, "assistant", "one\\"), (1, 2, "assistant", "[NEXT]\n<s>"), (2, None, None, None), (2, 0, "tool[TEXT]", "\\[\\INST]<<SYS>>"), (2, 0, "system", "<</SYS>>"), (None, 0, "assistant", "x")]
    chats = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.read_back(chat.format_chats(chats)).collect()}
    assert len(got) == 3
    for k in (1, 2, None):
        own = sorted(((t is not None, t), r or "", x or "") for i, t, r, x in rows if i == k)
        text, loss = "".join(f"{r}\n{x}\n" for _, r, x in own), "".join(x for _, r, x in own if r == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert (got[k].n_turns, got[k].turns_sha256, got[k].loss_chars, got[k].loss_sha256) == (len(own), sha(text), len(loss), sha(loss))
    assert chat.format_chats(chats.limit(0)).count() == 0


def test_long_chats(spark):
    """A conversation of thousands of turns and one of very long texts, with columns whose names the operator uses itself."""
    long = [(1, i, ("user", "assistant", "assistant")[i % 3], f"turn {i} </s> é😀" * (i % 3)) for i in range(6_000)] + [(2, i, "assistant" if i % 2 else "user", "long\n[NEXT] " * 60_000) for i in range(4)]
    chats = spark.createDataFrame([(*r, "x", [1]) for r in long], "conv_id long, turn long, role string, text string, formatted string, turns array<int>")
    began = time.time()
    got = {r.conv_id: r for r in chat.read_back(chat.format_chats(chats)).collect()}
    assert time.time() - began < 60
    for k in (1, 2):
        loss = "".join(x for i, _, r, x in long if i == k and r == "assistant")
        assert (got[k].n_turns, got[k].loss_chars, got[k].loss_sha256) == (sum(r[0] == k for r in long), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    spans = chat.format_chats(chats.where("conv_id = 1")).first()
    assert all(spans.formatted[s.start : s.end] == long[[i for i in range(6_000) if i % 3][k]][3].replace("</s>", "<\\/s>") for k, s in enumerate(spans.loss_spans))


def test_licenses(docs):
    got = Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in licenses.scan(docs).collect())
    want: Counter = Counter()
    for r in docs.collect():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (r.text or "").translate(LOWER))
        hits = [(i, label) for p, label in licenses.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        want[r.doc_id, len(w), len(hits), min((i for i, _ in hits), default=None), max((i for i, _ in hits), default=None), ",".join(sorted({x for _, x in hits}))] += 1
    assert got == want
    assert {r.labels for r in licenses.scan(docs).where("doc_id = 9").collect()} == {"apache,cc-by-nc,mit"}


def _standing(words, label_texts):
    """Labels and best share by comparing every stretch of every text with every template."""
    best = {}
    for label, text, key in label_texts:
        t, k = text.split(), key.split()
        long = int(licenses.STRETCH * len(t))
        for a in range(len(words)):
            own = words[a : a + long]
            if len(own) < 0.8 * len(t) or sum((Counter(own) & Counter(t)).values()) < 0.8 * len(t) - 1e-9 or not any(own[i : i + len(k)] == k for i in range(len(own))):
                continue
            row = [0] * (len(t) + 1)
            for w in own:
                before = row[:]
                for j, x in enumerate(t):
                    row[j + 1] = before[j] + 1 if w == x else max(before[j + 1], row[j])
            if row[-1] >= len(t) - int(0.2 * len(t) + 1e-9):
                best[label] = max(best.get(label, 0), row[-1] / len(t))
    return best


def test_license_templates_against_every_stretch(spark):
    rng = random.Random(12)
    rows = [(0, None), (1, ""), (2, "This program is free software: you can really redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"), (3, "Redistribution and use in source and binary forms, with or without any modification, are permitted provided that the following conditions are met")]
    vocabulary = licenses.template_words()
    for i in range(4, 90):
        words = []
        for _ in range(rng.randint(1, 3)):
            words += [rng.choice(vocabulary if rng.random() < 0.5 else ["zz", "yy"]) for _ in range(rng.randint(0, 12))]
            own = rng.choice(licenses.TEMPLATES)[1].split()
            for _ in range(rng.randint(0, 1 + len(own) // 3)):
                k = rng.randrange(len(own) + 1)
                own[k : k + rng.randint(0, 1)] = [rng.choice(["so", "the", "license"])] * rng.randint(0, 1)
            words += own
        rows.append((i, " ".join(words).upper() if i % 7 == 0 else ", ".join(words)))
    rows += [(4, rows[4][1]), (91, "mit license " * 5_000)]
    docs = spark.createDataFrame([(*r, "x", 1.5) for r in rows], "doc_id long, text string, labels string, score double")
    got = Counter((r.doc_id, r.labels, round(r.score, 9)) for r in licenses.scan(docs.repartition(3)).collect())
    want: Counter = Counter()
    for i, text in rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        base = {label for p, label in licenses.PHRASES.items() if any(w[k : k + len(p.split())] == p.split() for k in range(len(w)))}
        best = _standing(w, licenses.TEMPLATES) if i != 91 else {}
        want[i, ",".join(sorted(base | set(best))), round(max(best.values(), default=0.0), 9)] += 1
    assert got == want
    labels = {i: x for i, x, _ in got}
    assert labels[2] == "gpl" and labels[3] == "bsd"
    assert licenses.scan(docs.limit(0)).count() == 0


def test_only_the_rarest_words_of_a_file_are_looked_up():
    """What is looked up depends on the file and on the order of IDF; what is found does not."""
    rng = random.Random(3)
    vocabulary = licenses.template_words()
    counts = {w: 3 if len(w) > 4 else 800 for w in vocabulary}
    index, reverse = licenses.Index(counts, 1000), licenses.Index({w: 1000 - c for w, c in counts.items()}, 1000)
    work = [0, 0, 0]
    for _ in range(40):
        t = rng.randrange(len(licenses.TEMPLATES))
        own = licenses.TEMPLATES[t][1].split()
        for _ in range(rng.randint(0, index.templates[t].missing)):
            own[rng.randrange(len(own))] = "zz"
        words = [rng.choice(["the", "of", "to", "zz"]) for _ in range(300)] + own + ["of", "the"] * 50
        hashes = np.array([licenses.word_hash(w) for w in words])
        found = []
        for k, x in enumerate((index, reverse)):
            numbers = x.numbers(hashes)
            known = np.flatnonzero(numbers >= 0)
            lack = x.lacking(np.zeros(len(known), dtype=np.int64), numbers[known], 1)[0]
            found.append(x.found(hashes, numbers, lack))
            present = set(numbers[known].tolist())
            chosen = x.chosen(t, present, int(lack[t])) if lack[t] <= x.may_lack[t] else []
            assert len(chosen) <= x.templates[t].missing - lack[t] + x.templates[t].agree
            work[k] += int(np.isin(numbers, chosen).sum())
        work[2] += int((numbers >= 0).sum())
        assert found[0] == found[1]
    assert work[0] < work[1] / 2 and work[0] < work[2] / 2  # places looked up: by falling IDF, the other way, of all licence words


def test_packing(docs):
    by = {t: _ids(t) for t in {r.text for r in docs.collect()}}
    got = packing.pack(docs, BPE).collect()
    pieces, sequences = Counter(), defaultdict(list)
    for r in docs.collect():
        for k, (a, n) in enumerate(packing.cut(len(by[r.text]), 1024)):
            pieces[r.doc_id, k, a, n, zlib.crc32(by[r.text][a : a + n].tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == pieces
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for own in sequences.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:], strict=False)) and sum(n for _, n in own) <= 1024
    assert len(sequences) <= -(-sum(n for r in got for n in [r.length]) // 1024) + 1
    assert packing.pack(docs.limit(0), BPE).count() == 0


def test_evolution_beats_best_fit():
    """Pieces that were cut from full sequences, three from each: best fit in falling size wastes room that the search finds."""
    for seed in range(3):
        rng, sizes = random.Random(seed), []
        for _ in range(40):
            a = rng.randint(390, 500)
            b = rng.randint(260, (1024 - a) // 2)
            sizes += [a, b, 1024 - a - b]
        first: tuple = ([], [])
        packing.best_fit(sorted(range(120), key=lambda i: -sizes[i]), sizes, *first, 1024)
        population = []
        for epoch in range(4):
            population = packing.evolve(sizes, population, [], 1024, epoch)
        assert len(first[0]) >= 42 and len(population[0][0]) < len(first[0])
        assert packing.lower_bound(sizes, 1024) == 40 <= len(population[0][0])


def test_lower_bound_holds():
    rng = random.Random(5)
    assert packing.lower_bound([600] * 7 + [500] * 7, 1024) == 11 and packing.lower_bound([], 1024) == 0 and packing.lower_bound([1024, 512, 512], 1024) == 2
    for _ in range(200):  # pieces cut from full sequences need just these
        parts = [p for _ in range(rng.randint(1, 8)) for p in (lambda c: [b - a for a, b in zip([0, *c], [*c, 1024], strict=True)])(sorted(rng.sample(range(1, 1024), rng.randint(0, 4))))]
        assert packing.lower_bound(parts, 1024) == -(-sum(parts) // 1024)


def test_evolution_never_loses_a_piece():
    rng = random.Random(4)
    sizes = sorted((rng.randint(1, 700) for _ in range(300)), reverse=True)
    first = packing.evolve(sizes, [], [], 1024, 1)
    later = packing.evolve(sizes, first, [[sizes[0], sizes[-1]], [2000]], 1024, 2)
    for bins, fills in first + later:
        assert sorted(i for b in bins for i in b) == list(range(300)) and fills == [sum(sizes[i] for i in b) for b in bins] and max(fills) <= 1024
    assert len(later[0][0]) <= len(first[0][0])


def _counts(text):
    text = text or ""
    w = WORD.findall(text)
    three, covered, seen, dup = Counter(zip(w, w[1:], w[2:], strict=False)), set(), set(), 0
    for i in range(len(w) - 2):
        if three[w[i], w[i + 1], w[i + 2]] > 1:
            covered |= {i, i + 1, i + 2}
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(covered)


def test_quality(spark, docs):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)] + [(None, 1, 0), (2, None, 0)], "doc_id long, quality int, toxic int")
    got = quality.quality(docs, labels).collect()
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == Counter((r.doc_id, *_counts(r.text)) for r in docs.collect())
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.kept and r.base_failed) for r in got)
    assert quality.train(docs, labels.limit(0)) == quality.PRIOR and quality.quality(docs.limit(0), labels).count() == 0


def test_viterbi_finds_the_best_labelling():
    rng = random.Random(6)
    for _ in range(100):
        e, s = [rng.uniform(-2, 2) for _ in range(rng.randint(1, 7))], tuple((rng.uniform(-1, 1), rng.uniform(-1, 1)) for _ in range(2))

        def score(labels, e=e, s=s):
            return sum(x for x, y in zip(e, labels, strict=True) if y) + sum(s[a][b] for a, b in zip(labels, labels[1:], strict=False))

        best = max(score([k >> i & 1 for i in range(len(e))]) for k in range(1 << len(e)))
        assert score(quality.viterbi(e, s)) == pytest.approx(best)


def test_likelihood_against_all_labellings():
    rng = np.random.default_rng(7)
    x, w, s = rng.normal(size=(3, 5, 10)), rng.normal(size=10), rng.normal(size=(2, 2))
    there = np.array([[True] * 5, [True] * 3 + [False] * 2, [True] + [False] * 4])
    y = rng.integers(0, 2, (3, 5)) * there

    def value(w, s):
        total = 0.0
        for f, t, own in zip(x, there, y, strict=True):
            n = int(t.sum())
            each = {}
            for k in range(1 << n):
                labels = [k >> i & 1 for i in range(n)]
                each[tuple(labels)] = sum(float(f[i] @ w) for i in range(n) if labels[i]) + sum(s[a][b] for a, b in zip(labels, labels[1:], strict=False))
            total += each[tuple(own[:n].tolist())] - np.log(sum(np.exp(v) for v in each.values()))
        return total

    got, gw, gs = quality.likelihood(x, there, y, w, s)
    assert got == pytest.approx(value(w, s))
    for k in range(10):
        step = np.eye(10)[k] * 1e-5
        assert gw[k] == pytest.approx((value(w + step, s) - value(w - step, s)) / 2e-5, abs=1e-5)
    for a in (0, 1):
        for b in (0, 1):
            step = np.zeros((2, 2))
            step[a, b] = 1e-5
            assert gs[a, b] == pytest.approx((value(w, s + step) - value(w, s - step)) / 2e-5, abs=1e-5)


def test_lines_of_mixed_texts_are_told_apart(spark):
    """Held-out texts of whose lines a known share is junk: fitted weights find about that share, and training labels hold."""
    rng = random.Random(9)

    def line(good):
        words = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(8, 14))]
        return " ".join(words).capitalize() + "." if good else rng.choice([" ".join(w.upper() + "!!" for w in words), " | ".join(words), " ".join(w + "###" for w in words)])

    train = [(i, "\n".join(line(i % 2) for _ in range(rng.randint(2, 100)))) for i in range(120)]
    docs = spark.createDataFrame(train, "doc_id long, text string")
    crf = quality.train(docs, spark.createDataFrame([(i, i % 2) for i in range(120)], "doc_id long, quality int"))
    mixed = []
    for i in range(60):
        n = rng.randint(10, 30)
        k = rng.randint(3, n - 3)
        goods = [j < k for j in range(n)] if i % 2 else [(j // 5) % 2 == 0 for j in range(n)]
        lines = [line(g) for g in goods]
        words = [len(WORD.findall(x)) for x in lines]
        mixed.append((i, "\n".join(lines), sum(w for w, g in zip(words, goods, strict=True) if g) / sum(words)))
    found = {r.doc_id: r.quality.content_share for r in quality.with_quality(spark.createDataFrame([m[:2] for m in mixed], "doc_id long, text string"), crf).collect()}
    assert all(abs(found[i] - share) < 0.15 for i, _, share in mixed) and any(0.1 < x < 0.9 for x in found.values())
    f, w = np.zeros((4, 10)), np.array([10, 20, 30, 40])
    f[:, 0] = [-9, -8, -1, -0.5]
    labels = quality.line_labels(f, w, 1, quality.Crf((1.0, *[0.0] * 9), ((0.0, 0.0), (0.0, 0.0))))
    assert labels @ w >= 50 and labels.tolist() == [0, 0, 1, 1]


def test_contamination(spark, docs):
    texts = _texts()
    items = [(1, " ".join(texts[10].split(" ")[5:40])), (2, texts[40]), (3, "never seen before in any of these texts at all"), (4, None), (5, ""), (None, "a b c d"), (1, " ".join(texts[10].split(" ")[5:40])), (6, "one"), (7, " ".join(texts[-2].split(" ")[300:330]))]
    table = spark.createDataFrame(items, "item_id long, text string")
    want = set()
    for r in docs.collect():
        for k, t in items:
            own = _set(t, lower=False)
            n = len(own & _set(r.text, lower=False))
            if own and 100 * n >= 80 * len(own):
                want.add((r.doc_id, k, len(own), n))
    got = {(r.doc_id, r.item_id, r.n_item, r.n_shared) for r in decontam.contamination(docs, table).collect()}
    assert got == want and len(want) > 3
    assert decontam.contamination(docs, table.limit(0)).count() == 0 and decontam.contamination(docs.limit(0), table).count() == 0
    clean = decontam.without_contamination(docs, table)
    assert clean.columns == docs.columns and clean.count() == docs.count() - sum(r.doc_id in {x for x, *_ in want} for r in docs.collect() if any(len(_set(r.text, False) & _set(t, False)) * 100 >= 80 * len(_set(t, False)) > 0 for _, t in items))


def test_pipeline(spark):
    import corpus_pipeline

    data = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{data}/documents.parquet")
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:3]:
        kept = corpus_pipeline.written(stage(spark, kept, data), "test")
        assert kept.columns == docs.columns
    sets = [_set(r.text) for r in kept.collect()]
    items = [_set(r.text, lower=False) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    assert sets and all(10 * len(a & b) < 8 * len(a | b) for i, a in enumerate(sets) for b in sets[:i])
    assert all(10 * len(_set(r.text, False) & i) < 8 * len(i) for r in kept.collect() for i in items)
    clean = {r.doc_id for r in spark.read.parquet(f"{data}/labels.parquet").where("quality = 1").collect()}
    first = corpus_pipeline.quality_rules(spark, docs, data).select("doc_id").collect()
    failed = {r.doc_id for r in docs.collect() if (c := _counts(r.text))[0] < 50 or 100 * c[4] > 50 * c[0]}
    assert len((clean - failed) - {r.doc_id for r in first}) <= 0.02 * len(clean)
    assert {r.doc_id for r in corpus_pipeline.pack(spark, kept, data).collect()} == {r.doc_id for r in kept.collect()}
