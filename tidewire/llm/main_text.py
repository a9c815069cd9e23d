"""Main text of web pages by nearest-URL page differencing.

A page becomes the lines of text that its block elements hold. Pages of one host are sorted by URL path, and each is paired
with the nearest page before or after it that is not a copy of it, whichever path shares the longer prefix with its own.
The two pages' lines are aligned by their longest common subsequence, and lines that both have are the site's, not the
page's: they go (inside a declared article only if the neighbour on the other side has them too). Markup adds what a pair cannot show: lines of elements that announce that they are no text
(navigation, footers, adverts, forms, comments) go though no other page has them, and of a page that declares an
article, the plain lines outside it go unless they hold more text than the article.
"""

from __future__ import annotations

import html
import os.path
import re
from collections import Counter
from collections.abc import Iterator
from math import isqrt

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..common.store import small_batches, written

#: What a line's markup says of it; lines of a form count only on a page without others.
ARTICLE, PLAIN, OTHER, FORM = 0, 1, 2, 3
#: Words of a passage that is text and no notice; copies have that many in common, and more than half of both pages.
PASSAGE = 50
#: Pages that a task keeps while their run of copies goes on; later ones of the run get their partner in a join.
WAITING = 256

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(script|style)\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*+)>|<[!?][^>]*+>|<[a-zA-Z/!?][^>]*+\Z""",
    re.S | re.I,
)
# Elements that begin and end a line, that hold others, that are never text, and that name their role.
_BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead title tr ul".split())
_CONTAINERS = frozenset("article aside blockquote button details dialog div dl fieldset figure footer form head header iframe main menu nav noscript object ol section select span svg table template textarea tr ul video audio canvas label a p li td th".split())
_HIDDEN = frozenset("aside audio button canvas dialog fieldset footer form head iframe menu nav noscript object select svg template textarea title video".split())
_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
_NAMES = frozenset(
    "ad ads adsense advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer disqus footer gdpr login menu modal nav navbar navigation newsletter notice notices notification overlay pager pagination popup promo promotion related respond recommended share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar widget".split()
)
#: Of these, the names that say the same inside an article, where others may name what it is about.
_FOREIGN = frozenset("ad ads adsense advert adverts advertisement advertising comment comments disqus sponsored".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_ATTRIBUTE = re.compile(r"""([a-zA-Z:_-]+)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")


def _kind(tag: str, attributes: str, now: int) -> int:
    """What text inside an element is, given what it is around it.

    Names count whole: ``share-price`` is no ``share``. Inside an article only names of adverts and reader comments do.
    """
    declared = tag in ("article", "main")
    if now == OTHER or (tag in _HIDDEN and tag != "form") or (tag == "header" and now != ARTICLE):
        return OTHER
    found = {k.lower(): v.strip("\"'").lower() for k, v in _ATTRIBUTE.findall(attributes)} if attributes and not attributes.isspace() else {}
    if "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", ""):
        return OTHER
    if found.get("role") in _ROLES:
        return OTHER
    names = set(f"{found.get('class', '')} {found.get('id', '')}".split())
    if names & (_FOREIGN if now == ARTICLE else _NAMES) or (now != ARTICLE and names & {"header", "masthead"}):
        return OTHER
    if declared or found.get("role") in ("main", "article") or found.get("itemprop") == "articlebody":
        return ARTICLE
    if tag == "form":
        return OTHER if now == ARTICLE else FORM
    return now


def page_lines(source: str | None) -> tuple[list[str], list[int]]:
    """The lines of a page in order and the kind of each.

    Character references are decoded, white space becomes one space, ends are trimmed. Null: no lines.
    """
    lines: list[str] = []
    kinds: list[int] = []
    text: list[str] = []
    open_: list[tuple[str, int]] = []
    now = PLAIN

    def flush() -> None:
        line = " ".join(html.unescape("".join(text)).split())
        text.clear()
        if line:
            lines.append(line)
            kinds.append(now)

    at = 0
    source = source or ""
    for m in _TOKEN.finditer(source):
        if m.start() > at:
            text.append(source[at : m.start()])
        at = m.end()
        tag = m[3] or m[6]
        if not tag:
            continue
        tag, closing, attributes = tag.lower(), m[2] or m[5], m[4] if m[3] else m[7]
        if tag in _BLOCKS:
            flush()
        elif tag in ("br", "td", "th"):
            text.append(" ")
        if tag == "body" and not closing:
            open_, now = [], PLAIN
        elif tag in _VOID or tag not in _CONTAINERS or attributes.endswith("/"):
            continue
        elif closing:
            for k in range(len(open_) - 1, -1, -1):
                if open_[k][0] == tag:
                    before = open_[k][1]
                    if before != now:
                        flush()
                    now = before
                    del open_[k:]
                    break
        else:
            kind = _kind(tag, attributes, now)
            if tag in ("p", "li", "tr", "td", "th", "a", "span", "label") and kind == now:
                continue  # nothing hangs on where it ends
            if kind != now:
                flush()
            open_.append((tag, now))
            now = kind
    if at < len(source):
        text.append(source[at:])
    flush()
    return lines, kinds


def common_lines(a: list[str], b: list[str]) -> list[int]:
    """Places in ``a`` of a longest common subsequence of the lines of ``a`` and ``b``.

    Lines that only one page has are set aside first. The table of the others is kept as one long integer a line of
    ``a``, a bit for each line of ``b`` (bit-parallel), and only every k-th of about k² rows is kept, so
    20,000 equal or shuffled lines take well under a second and a few megabytes.
    """
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    inner = set(a[head : len(a) - tail])
    bits: dict[str, int] = {}
    n = 0
    for line in b[head : len(b) - tail]:
        if line in inner:
            bits[line] = bits.get(line, 0) | 1 << n
            n += 1
    rows = [i for i in range(head, len(a) - tail) if a[i] in bits]
    full = (1 << n) - 1

    def following(v: int, i: int) -> int:
        u = v & bits[a[i]]
        return (v + u | v - u) & full

    step = isqrt(len(rows)) + 1
    kept, v = [], full
    for k, i in enumerate(rows):
        if k % step == 0:
            kept.append(v)
        v = following(v, i)
    middle: list[int] = []
    j = n
    for block in range(len(kept) - 1, -1, -1):
        own = rows[block * step : (block + 1) * step]
        table = [kept[block]]
        for i in own:
            table.append(following(table[-1], i))
        for k in range(len(own), 0, -1):
            # The longest prefix of b whose last line adds to the subsequence: columns that add nothing are skipped.
            j = (~table[k] & (1 << j) - 1).bit_length()
            if not j:
                break
            if table[k - 1] >> (j - 1) & 1:  # without this line of a, that column would add nothing
                middle.append(own[k - 1])
                j -= 1
        if not j:
            break
    return [*range(head), *reversed(middle), *range(len(a) - tail, len(a))]


Page = tuple[list[str], list[int]]


def _pairs(lines: list[str]) -> set[tuple[str, str]]:
    words = " ".join(lines).split()
    return set(zip(words, [*words[1:], ""], strict=False))


def are_copies(a: Page, b: Page) -> bool:
    """Whether two pages have the same text, so that what they share says nothing about their site.

    They are copies if what one has of its own beside the shared lines is nothing, or mostly (half of the word pairs
    of the smaller) stands in the other's own lines as well, or if the shared lines have PASSAGE words and hold more than half of the
    text of both. Lines that are no text by their markup do not count.
    """
    own_a, own_b = ([line for line, kind in zip(*page, strict=True) if kind != OTHER] for page in (a, b))
    if not own_a or not own_b:
        return not own_a and not own_b
    places = common_lines(own_a, own_b)
    shared = [own_a[i] for i in places]
    size = sum(map(len, shared))
    if 2 * size > max(sum(map(len, own_a)), sum(map(len, own_b))) and sum(line.count(" ") + 1 for line in shared) >= PASSAGE:
        return True
    gone = set(places)
    rest_a, left = [line for i, line in enumerate(own_a) if i not in gone], Counter(own_b)
    left.subtract(shared)
    x, y = _pairs(rest_a), _pairs([line for line, k in left.items() if k > 0])
    return 2 * len(x & y) >= min(len(x), len(y))


def main_text(lines: list[str], kinds: list[int], other: list[str] | None, witness: list[str] | None = None) -> str:
    """A page's main text, given the lines of the page it is paired with and of the neighbour on its other side.

    A line shared with the partner goes; one inside a declared article goes only if the other neighbour, where there is one,
    shares it as well, since two articles may quote the same passage.
    """
    gone = set(common_lines(lines, other)) if other is not None else set()
    seen = gone if witness is None or not any(kinds[i] == ARTICLE for i in gone) else gone & set(common_lines(lines, witness))
    own: dict[int, list[int]] = {ARTICLE: [], PLAIN: [], OTHER: [], FORM: []}
    for i, kind in enumerate(kinds):
        if i not in (seen if kind == ARTICLE else gone):
            own[kind].append(i)
    size = {kind: sum(len(lines[i]) for i in places) for kind, places in own.items()}
    if ARTICLE in kinds and size[ARTICLE] >= size[PLAIN]:
        chosen = own[ARTICLE]
    else:
        chosen = sorted(own[ARTICLE] + own[PLAIN]) or own[FORM]
    return "\n\n".join(lines[i] for i in chosen)


Side = tuple[str, list[str]] | None


def by_nearness(path: str, before: Side, after: Side) -> list[list[str]]:
    """The lines of up to two pages (path, lines), that whose path shares more of its beginning with ``path`` first; of equal ones ``before``."""
    sides = [s for s in (before, after) if s is not None]
    return [lines for _, lines in sorted(sides, key=lambda s: -len(os.path.commonprefix([path, s[0]])))] or [None]


DONE, WAIT, RUN, HEAD, TAIL = range(5)
_ROW = "status int, part int, run int, url string, text string, host string, path string, lines array<string>, kinds array<int>, before_path string, before_lines array<string>, after_path string, after_lines array<string>, place int"
_FIELDS = [f.split()[0] for f in _ROW.split(", ")]


def _zip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages as they travel: compressed."""
    compress = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        packed = [None if h is None else compress(h.encode()) for h in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(packed, pa.binary())], [*batch.schema.names[:-1], "packed"])


class _Runs:
    """The pages of a sorted partition, run by run of copies; :attr:`out` takes the rows that are settled.

    A page's partner is the last page of the run before its own or the first of the run after it. Pages of a partition's
    first and last run, and those of a run beyond WAITING pages, wait (WAIT) for what their run's row (RUN) says; HEAD and TAIL rows
    offer a partition's outer pages to the partitions beside it.
    """

    def __init__(self, part: int):
        self.part, self.out = part, []
        self.run = -1
        self.key: tuple | None = None  # the page that the run's pages are copies of
        self.last: tuple | None = None
        self.earlier: tuple | None = None  # the last page of the run before, on the same host
        self.before: Side = None
        self.held: list[tuple] = []
        self.waits = False

    def row(self, page_id, status: int, **values) -> None:
        found = {"status": status, "part": self.part, "run": self.run, **values}
        self.out.append((page_id, *(found.get(n) for n in _FIELDS)))

    def _hold(self, page: tuple) -> None:
        page_id, url, host, path, lines, kinds = page
        if self.waits or len(self.held) >= WAITING:
            self.waits = True
            self.row(page_id, WAIT, url=url, path=path, lines=lines, kinds=kinds)
        else:
            self.held.append(page)

    def _close(self, after: tuple | None, at_end: bool) -> None:
        """End the current run; ``after`` is the next page of the same host."""
        if self.key is None:
            return
        side = (after[3], after[4]) if after is not None else None
        open_before = self.run == 0  # the partition before may hold this host's earlier pages
        if at_end or open_before:
            held, self.held, self.waits = self.held, [], True
            for page in held:
                self._hold(page)
        for page_id, url, _, path, lines, kinds in self.held:
            self.row(page_id, DONE, url=url, text=main_text(lines, kinds, *by_nearness(path, self.before, side)))
        if self.waits:
            b, a = self.before or (None, None), side or (None, None)
            place = (1 if open_before else 0) | (2 if at_end else 0)
            self.row(None, RUN, host=self.key[2], before_path=b[0], before_lines=b[1], after_path=a[0], after_lines=a[1], place=place)
        self.held, self.waits = [], False

    def _offer(self, status: int, page: tuple, place: int) -> None:
        self.row(None, status, host=page[2], path=page[3], lines=page[4], kinds=page[5], place=place)

    def add(self, page: tuple) -> None:
        page_id, url, host, path, lines, kinds = page
        if not host:
            self.row(page_id, DONE, url=url, text=main_text(lines, kinds, None))
            return
        same_host = self.key is not None and self.key[2] == host
        if not (same_host and are_copies((lines, kinds), self.key[4:])):
            self._close(page if same_host else None, False)
            self.before = (self.last[3], self.last[4]) if same_host else None
            self.earlier = self.last if same_host else None
            self.run, self.key = self.run + 1, page
            if self.run == 0 or (self.run == 1 and same_host):
                self._offer(HEAD, page, self.run)
        self._hold(page)
        self.last = page

    def end(self) -> None:
        if self.key is not None:
            self._close(None, True)
            self._offer(TAIL, self.last, 0)
            if self.earlier is not None:
                self._offer(TAIL, self.earlier, 1)


def _pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages that lie sorted in a partition, each with its partner's lines taken out where both lie in it."""
    runs = _Runs(TaskContext.get().partitionId())
    schema: pa.Schema | None = None
    unpack = zstandard.ZstdDecompressor().decompress

    def flush() -> pa.RecordBatch:
        columns = [list(c) for c in zip(*runs.out, strict=True)]
        runs.out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, schema.field(i).type) for i, c in enumerate(columns)], schema.names)

    for batch in batches:
        if schema is None:
            kinds = {"int": pa.int32(), "string": pa.string(), "array<string>": pa.list_(pa.string()), "array<int>": pa.list_(pa.int32())}
            schema = pa.schema([("page_id", batch.schema.field("page_id").type), *((f.split()[0], kinds[f.split()[1]]) for f in _ROW.split(", "))])
        for page_id, url, host, path, packed in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "host", "path", "packed")), strict=True):
            runs.add((page_id, url, host, path, *page_lines(None if packed is None else unpack(packed).decode())))
            if len(runs.out) >= 512:
                yield flush()
    runs.end()
    if runs.out:
        yield flush()


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Waiting pages with their run's partners, or with the pages that the partitions beside offer."""
    for batch in batches:
        texts = []
        for row in batch.to_pylist():
            page, sides = (row["lines"], row["kinds"]), []
            for side, offers in (("before", row["befores"]), ("after", row["afters"])):
                found = (row[f"{side}_path"], row[f"{side}_lines"]) if row[f"{side}_lines"] is not None else None
                if found is None:
                    others = sorted(offers or [], key=lambda o: o["place"])
                    found = next(((o["path"], o["lines"]) for o in others if not are_copies(page, (o["lines"], o["kinds"]))), None)
                sides.append(found)
            texts.append(main_text(*page, *by_nearness(row["path"], *sides)))
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of ``pages``: ``page_id``, ``url``, ``text`` and ``n_chars`` (code points).

    A null or empty page has an empty text; a page without a host in its URL, or alone on its host but for copies, has no
    partner, so nothing is deleted from it as shared. Repeated rows give repeated rows. Pages are range-partitioned by
    host and path, so a host that has a third of all pages is spread over many tasks; a partition's first and last run of
    copies meet the pages of the partitions beside it in a join (a run that fills the partition beside it whole has no
    partner on that side). Other columns, whatever their names, are not read.
    """
    small_batches(pages.sparkSession)
    pages = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    kind = pages.schema["page_id"].dataType.simpleString()
    url = r"(?s)^[^/]*//([^/?#]*)(.*)$"
    host, path = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), url, 1)), F.regexp_extract(F.coalesce("url", F.lit("")), url, 2)
    keyed = pages.select("page_id", "url", host.alias("host"), path.alias("path"), F.monotonically_increasing_id().alias("slot"), "html")
    packed = keyed.mapInArrow(_zip, f"page_id {kind}, url string, host string, path string, slot long, packed binary")
    sorted_ = packed.repartitionByRange("host", "path", "slot").sortWithinPartitions("host", "path", "slot").drop("slot")
    paired = written(sorted_.mapInArrow(_pair, f"page_id {kind}, {_ROW}"), "paired")

    parts = paired.where(F.col("status").isin(HEAD, TAIL)).select("part").distinct()
    beside = parts.select("part", F.lag("part").over(Window.orderBy("part")).alias("previous"), F.lead("part").over(Window.orderBy("part")).alias("next"))
    offer = F.collect_list(F.struct("place", "path", "lines", "kinds"))
    tails = paired.where(F.col("status") == TAIL).groupBy(F.col("part").alias("previous"), "host").agg(offer.alias("befores")).withColumn("open", F.lit(1))
    heads = paired.where(F.col("status") == HEAD).groupBy(F.col("part").alias("next"), "host").agg(offer.alias("afters")).withColumn("ends", F.lit(2))
    runs = paired.where(F.col("status") == RUN).select("part", "run", "host", "before_path", "before_lines", "after_path", "after_lines", F.col("place").bitwiseAND(1).alias("open"), F.col("place").bitwiseAND(2).alias("ends"))
    runs = runs.join(beside, "part").join(tails, ["previous", "host", "open"], "left").join(heads, ["next", "host", "ends"], "left")
    waiting = paired.where(F.col("status") == WAIT).select("page_id", "url", "part", "run", "path", "lines", "kinds")
    waiting = waiting.join(runs.drop("previous", "next", "host", "open", "ends"), ["part", "run"]).drop("part", "run")
    finished = waiting.mapInArrow(_finish, f"page_id {kind}, url string, text string")
    done = paired.where(F.col("status") == DONE).select("page_id", "url", "text")
    return done.unionByName(finished).withColumn("n_chars", F.length("text").cast("long"))
