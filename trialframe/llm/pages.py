"""The main text of web pages: markup tells most blocks apart, a host's suffix array the others.

A page is cut into blocks of text. Markup decides for blocks inside an article or main element, and for those
in menus, headers, footers, sidebars, forms and the like. All other blocks are undecided, those beside an
article too: of these the host's boilerplate is removed.

The token streams of a host's pages, their main text aside, are concatenated as one text whose suffix
array brings equal beginnings together. Spark sorts it: suffixes go to buckets by their first RUN tokens, buckets with
too few pages are dropped, and the distinct suffixes of the others are sorted by their first LONG tokens. What
neighbours share, from their longest common prefixes, gives the array's intervals: the suffixes that begin with the same
RUN to LONG tokens. No host, and no bucket, is gathered in a task: sorted suffixes pass one by one, and an interval's
distinct pages are counted. More than LONG tokens need not be compared: each LONG of a longer repeated substring are
repeated by the same pages, so they cover it.

A repeated substring is boilerplate if many of the host's pages hold it, and the rest of them differs: pages that are
equal, or have little but repeated runs of RUN tokens, are copies of each other and tell nothing. Undecided blocks lose
the maximal stretches that such substrings of LONG tokens cover, and go if they are a shorter one.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import small_batches, written

#: Tokens of the shortest repeated run.
RUN = 6
#: Tokens of the shortest stretch that a block loses. A shorter one goes if it is the whole block, on at least COMMON
#: of the host's pages.
LONG = 10
#: Pages that hold a run of boilerplate: so many at least, and this share of the host's.
PAGES, SHARE, COMMON = 3, 0.1, 0.5
#: A page more of which is repeated is a copy.
COPY = 0.8

_TAG = re.compile(r"<!--|<(?P<raw>script|style|iframe|textarea)\b|<(?P<shut>/?)(?P<name>[a-z][a-z0-9:-]*)|<[!?]", re.IGNORECASE)
_RAW_END = {name: re.compile(rf"</{name}\s*>", re.IGNORECASE) for name in ("script", "style", "iframe", "textarea")}
_SPACES = re.compile(r"\s*")
#: Elements that end the block before them and begin another.
_BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_MAIN = frozenset(("article", "main"))
_BOILER = frozenset("nav footer aside form button head title dialog menu fieldset label noscript template svg select".split())
#: Elements that a block inside them ends, where their end was left out.
_INLINE_ONLY = frozenset(("svg", "select"))
#: Words in class, id or role that mark what is not the article's text.
_MARKS = frozenset(
    "ad ads advert adverts advertisement advertising banner banners breadcrumb breadcrumbs comment comments comment-list commentlist cookie cookies consent copyright footer form login menu menus modal nav navbar navigation newsletter notice notices pagination pager popup promo promoted related respond responses search share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar topbar widget widgets".split()
)
_MAIN_MARKS = frozenset("article article-body articlebody entry-content main main-content maincontent post-content post-body story-body".split())
_ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.IGNORECASE)
#: A compound class word is a mark if a mark is among its parts and the others only tell of place or form:
#: ``site-footer`` is one, ``social-history`` and ``has-sidebar`` are not.
_FORM = frozenset("site page left right top bottom main header body inner outer wrapper wrap container content area section block box bar column col list item items link links button buttons icon icons slot unit zone group panel row text title label primary secondary global sticky fixed mobile desktop post posts article articles entry story form the and a js c l o u".split())
_HEADING = frozenset(("h1", "h2", "h3", "h4", "h5", "h6", "p"))
_ENDED_BY_HEADING = _HEADING | frozenset(("b", "i", "em", "strong", "span", "a", "font", "u"))


class Tag(NamedTuple):
    """A tag, comment or raw element from ``start`` to ``end``; the name is empty for what only goes."""

    start: int
    end: int
    name: str = ""
    shut: bool = False
    attributes: str = ""


class _Ends:
    """Where tags end, each part of the page being read once however many tags begin before it.

    A tag ends at the first ``>`` outside of quotes. Quotes hold only right behind an equals sign, and only if they are closed.
    """

    def __init__(self, page: str):
        self.page = page
        self.events = [m.start() for m in re.finditer("[>=]", page)]
        self.known: dict[int, int] = {}  # by equals sign
        self.last = {x: page.rfind(x) for x in ("'", '"')}

    def end(self, at: int) -> int:
        """The place of the ``>`` that ends a tag whose name ends at ``at``; -1 if there is none."""
        passed = []
        found = -1
        i = bisect_left(self.events, at)
        while i < len(self.events):
            sign = self.events[i]
            if self.page[sign] == ">":
                found = sign
                break
            if sign in self.known:
                found = self.known[sign]
                break
            passed.append(sign)
            quote = _SPACES.match(self.page, sign + 1).end()
            mark = self.page[quote : quote + 1]
            if mark in self.last and quote < self.last[mark]:
                i = bisect_left(self.events, self.page.index(mark, quote + 1))
            else:
                i += 1
        for sign in passed:
            self.known[sign] = found
        return found


def page_tags(page: str) -> Iterator[Tag]:
    """The tags, comments and raw elements of a page in order; what a ``<`` begins without an end is text."""
    ends = _Ends(page)
    last = page.rfind(">")
    at = 0
    while m := _TAG.search(page, at):
        start = m.start()
        if m[0] == "<!--":
            shut = page.find("-->", m.end())
            at = len(page) if shut < 0 else shut + 3
            yield Tag(start, at)
            continue
        if m[0] in ("<!", "<?"):
            if start > last:
                at = m.end()
                continue
            at = page.index(">", m.end()) + 1
            yield Tag(start, at)
            continue
        end = ends.end(m.end())
        if end < 0:
            at = m.end()
        elif m["raw"]:
            shut = _RAW_END[m["raw"].lower()].search(page, end + 1)
            at = shut.end() if shut else len(page)
            yield Tag(start, at)
        else:
            at = end + 1
            yield Tag(start, at, m["name"].lower(), bool(m["shut"]), page[m.end() : end])


class _Open:
    """The open elements: name, the role outside, whether an article had begun there."""

    def __init__(self):
        self.stack: list[tuple[str, str, bool]] = []
        self.names: Counter[str] = Counter()
        self.framing: list[int] = []  # places of blocks and of what a block inside ends

    def push(self, name: str, role: str, inside: bool) -> None:
        if name in _BLOCKS or name in _INLINE_ONLY:
            self.framing.append(len(self.stack))
        self.stack.append((name, role, inside))
        self.names[name] += 1

    def cut(self, depth: int) -> tuple[str, bool]:
        """Closes all from ``depth`` on; what was outside of them."""
        _, role, inside = self.stack[depth]
        for name, _, _ in self.stack[depth:]:
            self.names[name] -= 1
        del self.stack[depth:]
        while self.framing and self.framing[-1] >= depth:
            self.framing.pop()
        return role, inside

    def last(self, name: str) -> int | None:
        """The innermost element of that name; what lies inside it is then closed, so it is not searched again."""
        if not self.names[name]:
            return None
        return next(i for i in range(len(self.stack) - 1, -1, -1) if self.stack[i][0] == name)


class Block(NamedTuple):
    """A block's text, and whether it is the article's (main), not (boiler), or not told by markup (open)."""

    role: str
    text: str


def _marks(attributes: str) -> set[str]:
    found: set[str] = set()
    for m in _ATTRIBUTE.finditer(attributes) if "=" in attributes else ():
        for word in (m[2] or m[3] or m[4] or "").lower().split():
            found.add(word)
            parts = {re.sub(r"\d+$", "", x) for x in re.split(r"[-_]+", word)} - {""}
            if parts - _FORM <= _MARKS and word not in _MAIN_MARKS:
                found |= parts & _MARKS
    return found


def page_blocks(page: str) -> list[Block]:
    """The non-empty blocks of a page in order, white space collapsed and references decoded."""
    blocks: list[Block] = []
    opened = _Open()
    stack = opened.stack
    parts: list[str] = []
    role, inside = "open", False
    started = 0

    def close() -> None:
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            blocks.append(Block(role, text))
        parts.clear()

    for tag in page_tags(page):
        parts.append(page[started : tag.start])
        started = tag.end
        name = tag.name
        if not name:
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name in _BLOCKS:
            close()
            if not tag.shut and opened.framing and stack[opened.framing[-1]][0] in _INLINE_ONLY:
                role, inside = opened.cut(opened.framing[-1])
        if tag.shut:
            depth = opened.last(name)
            if depth is not None:
                if stack[depth][1:] != (role, inside) or any(x[1:] != stack[depth][1:] for x in stack[depth:]):
                    close()
                role, inside = opened.cut(depth)
            continue
        if name in _VOID or tag.attributes.endswith("/"):
            continue
        if name in _HEADING:  # these do not nest, and their ends are often left out
            while stack and stack[-1][0] in _ENDED_BY_HEADING:
                role, inside = opened.cut(len(stack) - 1)
        before = role, inside
        marks = _marks(tag.attributes)
        if role == "boiler" and not (name == "main" and not marks & _MARKS):  # a page has one main element, whatever wraps it
            pass
        elif name in _BOILER or (marks & _MARKS and not (name in _MAIN and not marks & {"comment", "comments", "ad", "ads", "related"}) and name not in ("html", "body")) or name == "header" and not inside:
            role = "boiler"
        elif name in _MAIN or marks & _MAIN_MARKS:
            role, inside = "main", True
        if (role, inside) != before and parts:
            now, nested = role, inside
            role, inside = before
            close()
            role, inside = now, nested
        opened.push(name, *before)
    parts.append(page[started:])
    close()
    return blocks


_BLOCK = "array<struct<role:string, text:string>>"
_FOUND = "array<struct<place:int, length:int, common:boolean>>"


def _blocks_of(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in pages:
        yield pd.Series([[{"role": x.role, "text": x.text} for x in page_blocks(page or "")] for page in part], dtype=object)


def _suffixes(column: str):
    """For each block an array of its suffixes: their place from 1, and hashes of their first LONG tokens."""
    of = lambda tokens: F.transform(F.sequence(F.lit(1), F.greatest(F.size(tokens) - RUN + 1, F.lit(1))), lambda i: F.struct(i.alias("place"), F.slice(tokens, i, LONG).alias("key")))
    # a variable of an outer transform, so that a block is split once and not for each of its suffixes
    return F.transform(F.array(F.transform(F.split(column, " "), lambda t: F.xxhash64(t))), of)[0]


def _intervals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(suffix, depth, interval) of sorted (bucket, key, suffix): by the longest common prefix with the suffix before it.

    Suffixes of an interval share their first ``depth`` tokens, RUN at least or all; it is named by its first suffix.
    """
    last, before, first = None, [], {}
    for batch in batches:
        suffixes, depths, intervals = [], [], []
        for bucket, key, suffix in zip(*(batch.column(c).to_pylist() for c in ("bucket", "key", "suffix")), strict=True):
            common = 0
            if bucket == last:
                common = next((i for i, (a, b) in enumerate(zip(before, key, strict=False)) if a != b), min(len(before), len(key)))
            for depth in range(min(RUN, len(key)), len(key) + 1):
                if depth > common:
                    first[depth] = suffix
                suffixes.append(suffix)
                depths.append(depth)
                intervals.append(first[depth])
            last, before = bucket, key
        yield pa.RecordBatch.from_arrays([pa.array(suffixes, pa.int64()), pa.array(depths, pa.int32()), pa.array(intervals, pa.int64())], names=["suffix", "depth", "interval"])


def suffix_array(suffixes: DataFrame) -> DataFrame:
    """The intervals of the suffix array of (bucket, key, suffix): (suffix, depth, interval), see ``_intervals``."""
    array = suffixes.distinct().repartitionByRange("bucket").sortWithinPartitions("bucket", "key")
    return array.mapInArrow(_intervals, "suffix long, depth int, interval long")


def _boilerplate(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(row, block, found) of what hosts repeat in undecided blocks, each with its place, length and whether it is common, and (row, known) of pages beside whose article the host can tell."""
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))
    texts = F.transform("blocks", lambda b: b["text"])
    main = F.filter("blocks", lambda b: b["role"] == "main")
    size = F.aggregate(main, F.lit(0), lambda n, b: n + F.size(F.split(b["text"], " "))).cast("long")
    pages = blocks.select("row", "page_id", host.alias("host"), F.xxhash64(host, F.array_join(texts, "\n")).alias("page"), F.xxhash64(F.array_join(F.transform(main, lambda b: b["text"]), "\n")).alias("main"), size.alias("main_size"), F.filter("blocks", lambda b: b["role"] != "main").alias("others"), F.exists("blocks", lambda b: b["role"] == "open").alias("undecided"))
    # equal pages are one, and so are the rows of a page_id
    same = pages.filter("page_id is not null").groupBy("page_id").agg(F.min("page").alias("first"), F.count("*").alias("n")).filter("n > 1").select(F.col("page_id").alias("of"), "first")
    if same.head(1):
        pages = pages.join(same, F.col("page_id") == F.col("of"), "left").withColumn("page", F.coalesce("first", "page"))
    hosts = written(pages.groupBy("host").agg(F.count_distinct("page").alias("pages"), F.bool_or("undecided").alias("undecided")).filter("undecided").select("host", "pages"), "hosts")
    if not hosts.head(1):  # markup has told all
        spark = blocks.sparkSession
        return spark.createDataFrame([], f"row long, block int, found {_FOUND}"), spark.createDataFrame([], "row long, known boolean")
    # pages of other hosts add no run
    pages = pages.join(hosts.select("host"), "host", "left_semi")
    suffixes = pages.select("row", "host", "page", F.posexplode("others").alias("block", "b")).select("row", "host", "page", "block", F.col("b.role").alias("role"), F.explode(_suffixes("b.text")).alias("s"))
    suffixes = suffixes.select("row", "host", "page", "block", "role", "s.place", "s.key", F.xxhash64("host", F.slice("s.key", 1, RUN)).alias("run"), F.xxhash64("host", "s.key").alias("suffix"))

    held = suffixes.groupBy("run").agg(F.count_distinct("page").alias("n"), F.max(F.col("role") == "open").alias("open"), F.first("host").alias("host")).filter(F.col("open") & (F.col("n") >= PAGES))
    least = F.greatest(F.lit(PAGES), F.ceil(F.col("pages") * SHARE))
    repeated = written(held.join(hosts, "host").filter(F.col("n") >= least).select("run", "pages"), "repeated")
    hit = written(suffixes.join(repeated, "run").select("row", "block", "role", "place", "page", "run", "pages", "key", "suffix"), "hit")
    # what a page holds beside its repeated runs: so many suffixes and tokens, and their sum
    all_of = suffixes.join(hit.select("page").distinct(), "page", "left_semi").groupBy("row").agg(F.first("page").alias("page"), F.count("*").alias("all"), F.sum(F.col("run").cast("decimal(38,0)")).alias("sum"))
    hit_of = hit.groupBy("row").agg(F.count("*").alias("hit"), F.sum(F.col("run").cast("decimal(38,0)")).alias("hit_sum"))
    rest = all_of.join(hit_of, "row").join(pages.select("row", "main", "main_size"), "row").filter((F.col("all") + F.col("main_size")) * COPY >= F.col("hit"))
    rest = rest.groupBy("page").agg(F.min(F.xxhash64("main", (F.col("sum") - F.col("hit_sum")).cast("string"))).alias("rest"))
    of_interval = hit.join(suffix_array(hit.select(F.col("run").alias("bucket"), "key", "suffix")), "suffix").select("row", "block", "role", "place", "page", "pages", "depth", "interval")
    of_interval = written(of_interval, "intervals")
    votes = of_interval.select("depth", "interval", "page", "pages").distinct().join(rest, "page").groupBy("depth", "interval", "pages").agg(F.count_distinct("rest").alias("n"))
    boiler = votes.filter(F.col("n") >= least).select("depth", "interval", (F.col("n") >= F.col("pages") * COMMON).alias("common"))
    longest = of_interval.filter("role = 'open'").join(boiler, ["depth", "interval"]).groupBy("row", "block", "place").agg(F.max("depth").alias("length"), F.max_by("common", "depth").alias("common"))
    covered = longest.groupBy("row", "block").agg(F.sort_array(F.collect_list(F.struct("place", "length", "common"))).alias("found"))
    known = pages.filter("undecided").join(hosts.filter(F.col("pages") >= PAGES), "host").select("row", F.lit(True).alias("known"))
    return covered, known


def main_text(pages: DataFrame) -> DataFrame:
    """The main text of every page: (page_id, url, text, n_chars).

    ``pages`` is (page_id, url, html). Blocks are joined by an empty line, in page order; ``n_chars`` counts code
    points. An undecided block loses the stretches of LONG tokens or more that are boilerplate of its host, and a
    shorter one that is the whole block if most pages have it. On hosts of fewer than PAGES pages nothing is told by
    repetition; there, what stands beside an article is none of its text. Equal pages of a host count as one page, and
    so do rows that repeat a page_id.

    Null and empty html, and pages without main text, give an empty text. A null url counts as a host of its
    own. Repeated rows, and rows with a null page_id, have a row each. Other columns are not read.
    """
    small_batches(pages.sparkSession)
    blocks = pages.select("page_id", "url", F.pandas_udf(_blocks_of, _BLOCK)(F.col("html").cast("string")).alias("blocks")).withColumn("row", F.monotonically_increasing_id())
    blocks = written(blocks, "blocks")
    covered, known = _boilerplate(blocks)
    per_page = covered.groupBy("row").agg(F.collect_list(F.struct("block", "found")).alias("covered"))
    # only pages with undecided blocks are moved
    undecided = F.exists("blocks", lambda b: b["role"] == "open")
    moved = blocks.filter(undecided).join(per_page, "row", "left").join(known, "row", "left")
    moved = moved.select("page_id", "url", F.pandas_udf(_joined, "string")(F.col("blocks"), F.col("covered"), F.coalesce("known", F.lit(False))).alias("text"))
    main = F.transform(F.filter("blocks", lambda b: b["role"] == "main"), lambda b: b["text"])
    settled = blocks.filter(~undecided).select("page_id", "url", F.array_join(main, "\n\n").alias("text"))
    return settled.unionByName(moved).withColumn("n_chars", F.length("text").cast("long"))


def _stretches(found: list[dict], size: int) -> list[tuple[int, int]]:
    """The maximal stretches (from, to) of a block's ``size`` tokens that are boilerplate, from what is ``found`` in order of its place."""
    out: list[tuple[int, int]] = []
    for x in found:
        first, end = x["place"] - 1, x["place"] - 1 + x["length"]
        if x["length"] < LONG and not (x["common"] and x["length"] == size):
            continue
        if out and first <= out[-1][1]:
            out[-1] = out[-1][0], end
        else:
            out.append((first, end))
    return out


def _joined(blocks: pd.Series, covered: pd.Series, known: pd.Series) -> pd.Series:
    """The texts of pages: the main blocks, and of undecided ones what is not their host's boilerplate."""
    texts = []
    for page, gone, told in zip(blocks, covered, known, strict=True):
        places = {x["block"]: x for x in gone} if gone is not None else {}
        beside = any(block["role"] == "main" for block in page)
        kept, other = [], 0
        for block in page:
            if block["role"] == "main":
                kept.append(block["text"])
                continue
            if block["role"] == "open" and (told or not beside):
                tokens = block["text"].split(" ")
                hit = places.get(other)
                at = 0
                for first, end in _stretches(hit["found"], len(tokens)) if hit else ():
                    if at < first:
                        kept.append(" ".join(tokens[at:first]))
                    at = end
                if at < len(tokens):
                    kept.append(" ".join(tokens[at:]))
            other += 1
        texts.append("\n\n".join(kept))
    return pd.Series(texts, dtype=object)
