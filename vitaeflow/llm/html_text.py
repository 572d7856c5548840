"""Main text of web pages by differencing with pages of near URLs.

A page is parsed into blocks of visible text, its lines, menus and footers included. Within each host,
pages are put in the order of their URL paths, and every page is compared with up to ``WIDTH`` pages before and
after it; their lines are aligned by longest common subsequence. What is shared belongs to the site, not
to the page, unless one page is a copy of the other, or both quote the same. So

* pages with equal lines are taken once, and a pair that shares more than ``COPY_SHARE`` of a page's text tells
  nothing about that page;
* a place in the markup (the elements and classes a line stands in) is part of the site's frame if its lines
  recur: at least ``FRAME_LEAST`` of them, at ``FRAME_TIMES`` or more, are shared with some page, and
  ``FRAME_FACTOR`` times the share among the lines of the body, the place that holds most of the host's text. In
  article and main elements, beside the body and in headings at least ``FRAME_SHARE`` must be shared. All
  lines in such places are deleted on all pages of the host. The body is never one of them;
* outside article and main elements, shared lines are deleted wherever they stand. Inside, they are
  quoted passages as long as their place is not part of the frame.

What a site doesn't repeat, or has too few pages to tell, is told by its elements: menus, footers, sidebars,
dialogs, page headers and hidden elements go, and forms and elements whose class, id or role says that they are
furniture, however long they are. Two kinds of the latter stay: those that hold an article or main element, and
the longest one if without it no line of ``PROSE`` words were left. Of what is left, article and main elements
are taken alone, unless the text outside is over ``OUTSIDE`` times theirs.

Skew: pages are numbered in the order of (host, path) by ranges, and cut into runs of ``RUN`` pages, each with
the last ``WIDTH`` pages of the run before; so a host with a third of all pages is spread over many tasks, and the
result doesn't depend on their number. Only 64-bit hashes of lines are compared and moved. Lines are counted by
(host, place, line), map side first, and the frames of a host are dealt to its pages under ``SALTS`` keys. What
to delete is broadcast only if its rows, counted before, take less than ``BROADCAST_BYTES``, and joined by
``page_id`` otherwise.

Nulls and edge cases: a null html counts as empty and gives the empty text; null urls form one host
with empty paths; ties in the path are ordered by ``page_id``, then by content; repeated rows are
copies of each other and both keep their text; unclosed and stray tags and quotes are tolerated, in
time linear in the page's length; an unclosed script or comment, and a tag without end, end the page;
long pages are parsed whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitaeflow.llm.common import arrow_map, cut, numbered, read, text_or_empty

#: Pages before and after a page that it is compared with, and pages of a run.
WIDTH, RUN = 32, 256
#: A page that shares more of the text is a copy.
COPY_SHARE = 0.5
#: From which share of shared lines on, and so many times shared, a place is part of the frame; how many times
#: the share of the body; and the share that is asked of places in articles.
FRAME_LEAST, FRAME_TIMES, FRAME_FACTOR, FRAME_SHARE = 0.05, 3, 1.5, 0.5
#: Words of a line of prose.
PROSE = 5
#: Articles are taken alone unless the text outside is so many times as long, and so long at least.
OUTSIDE, OUTSIDE_CHARS = 4, 200
#: Products of lengths up to which the alignment is computed in full at once.
ALIGN_CELLS = 4_000_000
SALTS = 32
BROADCAST_BYTES = 8 << 20

# Elements by their role, and words of class, id and role that hint at page furniture.
SKIPPED = frozenset("script style noscript template iframe svg object canvas select button textarea title".split())
FURNITURE = frozenset("nav footer aside menu dialog".split())
MAIN = frozenset(("article", "main"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strong sub sup time tt u var wbr".split())
FURNITURE_WORDS = re.compile(
    r"(^|[\s_-])(nav|navbar|navigation|menu|breadcrumbs?|header|footer|sidebar|aside|ads?|advert(isement)?s?|banner|promo|sponsored|"
    r"cookies?|consent|notice|alert|popup|modal|newsletter|subscribe|share|social|related|comments?|respond|replies|disqus|widget|toolbar|pagination)($|[\s_-])",
    re.IGNORECASE,
)
# A tag with its attributes; and one that ends at the next ">" whatever is quoted.
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>]*+)|[\"'])*+)>")
_LOOSE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++))", re.IGNORECASE)
_ENDS = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*+>", re.IGNORECASE) for name in SKIPPED}
_TAG_BEGINS = re.compile(r"</?[a-zA-Z]")
_QUOTED = re.compile(r"\"[^\"]*+\"|'[^']*+'")
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:$|[\s=/])", re.IGNORECASE)
_DIGITS = re.compile(r"\d+")
_HEADING = re.compile(r"h[1-6]")


class Line(NamedTuple):
    """A visible block: its text, whether it stands in a main element and is a heading, its place in the markup
    and that of the element around, and whether its elements say that it is furniture."""

    text: str
    main: bool
    heading: bool
    place: int
    above: int
    away: bool


class _Wrap:
    """An element that may be furniture: surely, or unless it holds a main element or all of the prose."""

    __slots__ = ("above", "sure", "size", "mains", "prose")

    def __init__(self, above: int, sure: bool):
        self.above, self.sure, self.size, self.mains, self.prose = above, sure, 0, 0, False


@lru_cache(1 << 14)
def _place(above: int, name: str, classes: str) -> int:
    return xxhash.xxh3_64_intdigest(f"{above}/{name}.{_DIGITS.sub('', classes)}") - (1 << 63)


def lines(page: str) -> list[Line]:
    """The visible blocks of a page in order."""
    out: list[tuple] = []
    wraps = [_Wrap(0, False)]  # the page itself
    stack: list[tuple[str, int, int, int, int, bool]] = []  # element, wrap, main elements, place, that around, heading
    open_names: dict[str, int] = {}
    held: list[str] = []
    wrap = main = place = above = 0
    heading = False
    outside = ("", 0, 0, 0, 0, False)

    def settle() -> None:
        text = "".join(held)
        held.clear()
        text = " ".join((entities.unescape(text) if "&" in text else text).split())
        if text:
            out.append((text, main > 0, heading, place, above, wrap))
            wraps[wrap].size += len(text)
            wraps[wrap].prose = wraps[wrap].prose or text.count(" ") + 1 >= PROSE

    at, tag = 0, _TAG
    while True:
        start = page.find("<", at)
        if start < 0:
            held.append(page[at:])
            break
        if start > at:
            held.append(page[at:start])
        found = tag.match(page, start)
        if found is None:
            if page.startswith(("<!", "<?"), start):
                opening, closing = ("<!--", "-->") if page.startswith("<!--", start) else ("<![CDATA[", "]]>") if page.startswith("<![CDATA[", start) else ("<", ">")
                end = page.find(closing, start + len(opening))
                if end < 0:
                    break
                at = end + len(closing)
                continue
            if _TAG_BEGINS.match(page, start):
                tag = _LOOSE_TAG  # a quote or tag doesn't end: quotes aren't looked at from here on
                found = tag.match(page, start)
                if found is None:
                    break
            else:
                held.append("<")
                at = start + 1
                continue
        at = found.end()
        ends, name, inner = found.groups()
        if not name.islower():
            name = name.lower()
        if name not in INLINE:
            if held:
                settle()
        elif not (ends or inner or open_names.get(name)):  # plain emphasis makes no difference
            continue
        if ends:
            if open_names.get(name):
                while True:
                    own = stack.pop()
                    open_names[own[0]] -= 1
                    if own[0] == name:
                        break
                if held and wrap != (stack[-1][1] if stack else 0):
                    settle()
                _, wrap, main, place, above, heading = stack[-1] if stack else outside
        elif name in SKIPPED:
            end = _ENDS[name].search(page, at)
            if end is None:
                break
            at = end.end()
        elif name not in VOID and not inner.endswith("/"):
            if name == "p" and stack and stack[-1][0] == "p":  # an open paragraph ends
                stack.pop()
                open_names["p"] -= 1
                _, wrap, main, place, above, heading = stack[-1] if stack else outside
            marks = {m[0].lower(): m[1] or m[2] or m[3] for m in _ATTRIBUTE.findall(inner)} if "=" in inner else {}
            if name in FURNITURE or name == "header" and not main or "hidden" in inner.lower() and _HIDDEN.search(_QUOTED.sub("", inner)):
                if held:
                    settle()
                wraps.append(_Wrap(wrap, True))
                wrap = len(wraps) - 1
            elif name == "form" or marks and name not in MAIN and name not in ("html", "body") and FURNITURE_WORDS.search(" ".join(marks.values())):
                if held:
                    settle()
                wraps.append(_Wrap(wrap, False))
                wrap = len(wraps) - 1
            if name in MAIN:
                main += 1
                wraps[wrap].mains += 1
            if name not in INLINE:
                above, place = place, _place(place, name, marks.get("class", ""))
                heading = heading or _HEADING.fullmatch(name) is not None
            stack.append((name, wrap, main, place, above, heading))
            open_names[name] = open_names.get(name, 0) + 1
    settle()
    for k in range(len(wraps) - 1, 0, -1):  # inner elements come after outer ones
        if not wraps[k].sure:
            own, around = wraps[k], wraps[wraps[k].above]
            around.size += own.size
            around.mains += own.mains
            around.prose = around.prose or own.prose

    def furniture(spared: set[int]) -> list[bool]:
        away = [False]
        for k, w in enumerate(wraps[1:], 1):
            away.append(away[w.above] or w.sure or not w.mains and k not in spared)
        return away

    away = furniture(set())
    if len(wraps) > 1 and not any(not away[k] and text.count(" ") + 1 >= PROSE for text, *_, k in out):
        longest = max((k for k in range(1, len(wraps)) if not wraps[k].sure and wraps[k].prose), key=lambda k: wraps[k].size, default=0)
        spared = set()
        while longest:
            spared.add(longest)
            longest = wraps[longest].above
        away = furniture(spared)
    return [Line(*line, away[k]) for *line, k in out]


def key_of(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


def place_of(url: str) -> tuple[str, str]:
    """Host and path of a URL; what can't be read as one is a path without host."""
    try:
        parts = urlsplit(url.strip())
        return (parts.hostname or ""), parts.path.rstrip("/") or "/"
    except ValueError:
        return "", url


def common(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """A longest common subsequence of two arrays, as pairs of places."""
    out, lo = [], 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        out.append((lo, lo))
        lo += 1
    ea, eb, tail = len(a), len(b), []
    while ea > lo and eb > lo and a[ea - 1] == b[eb - 1]:
        ea, eb = ea - 1, eb - 1
        tail.append((ea, eb))
    # Values of one side only take no part, which leaves little to align.
    ia = lo + np.flatnonzero(np.isin(a[lo:ea], b[lo:eb]))
    ib = lo + np.flatnonzero(np.isin(b[lo:eb], a[lo:ea]))
    if len(ia) and len(ib):
        out += [(int(ia[i]), int(ib[j])) for i, j in _align(a[ia], b[ib])]
    return out + tail[::-1]


def _align(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    if len(a) * len(b) > ALIGN_CELLS and len(a) > 1:  # Hirschberg: halve, so memory stays linear
        half = len(a) // 2
        split = int(np.argmax(_row(a[:half], b) + _row(a[half:][::-1], b[::-1])[::-1]))
        return _align(a[:half], b[:split]) + [(i + half, j + split) for i, j in _align(a[half:], b[split:])]
    table = np.zeros((len(a) + 1, len(b) + 1), dtype=np.int32)
    for i in range(len(a)):
        table[i + 1, 1:] = np.maximum.accumulate(np.maximum(table[i, 1:], (table[i, :-1] + 1) * (b == a[i])))
    out, i, j = [], len(a), len(b)
    while i and j:
        if a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
            out.append((i, j))
        elif table[i - 1, j] >= table[i, j - 1]:
            i -= 1
        else:
            j -= 1
    return out[::-1]


def _row(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    row = np.zeros(len(b) + 1, dtype=np.int64)
    for x in a:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], (row[:-1] + 1) * (b == x)))
    return row


def shared_lines(a: list[int], b: list[int], both: set[int]) -> list[tuple[int, int]]:
    """A longest common subsequence of two pages' lines, of which they share ``both``, as pairs of places."""
    at, to = [i for i, x in enumerate(a) if x in both], [j for j, x in enumerate(b) if x in both]
    one, two = [a[i] for i in at], [b[j] for j in to]
    if one == two:
        return list(zip(at, to, strict=True))
    return [(at[i], to[j]) for i, j in common(np.asarray(one), np.asarray(two))]


_LINES = pa.list_(pa.struct([("key", pa.int64()), ("place", pa.int64()), ("above", pa.int64()), ("inside", pa.bool_()), ("main", pa.bool_()), ("size", pa.int32())]))
_LIGHT = "page_id long, digest long, host string, path string, lines array<struct<key: bigint, place: bigint, above: bigint, inside: boolean, main: boolean, size: int>>"


def _sketching(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for page, digest, url, html in zip(*(batch.column(k).to_pylist() for k in ("page_id", "digest", "url", "html")), strict=True):
            own = [{"key": key_of(x.text), "place": x.place, "above": x.above, "inside": x.main or x.heading, "main": x.main, "size": len(x.text)} for x in lines(html)]
            rows.append((page, digest, *place_of(url), own))
        if rows:
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), _LINES]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["page_id", "digest", "host", "path", "lines"])


class _Page:
    """A page that waits for those after it."""

    __slots__ = ("at", "own", "keys", "known", "sizes", "whole", "gone", "met")

    def __init__(self, at: int, own: bool, keys: list[int], sizes: list[int]):
        self.at, self.own, self.keys, self.known, self.sizes, self.whole, self.gone, self.met = at, own, keys, set(keys), sizes, sum(sizes), set(), 0

    def tell(self, same: list[int]) -> None:
        if sum(self.sizes[i] for i in same) <= COPY_SHARE * self.whole:
            self.gone.update(same)
            self.met += 1


_PAIRED = "at long, gone array<int>, met int"


def _pairing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compares the pages of each run, which are next to each other in order, with those of the same host around
    them; the first ones belong to the run before and are there for the others."""

    def out(pages: list[_Page]) -> Iterator[pa.RecordBatch]:
        told = [p for p in pages if p.met]
        if told:
            yield pa.RecordBatch.from_arrays([pa.array([p.at for p in told]), pa.array([sorted(p.gone) for p in told], pa.list_(pa.int32())), pa.array([p.met for p in told], pa.int32())], names=["at", "gone", "met"])

    last, near = None, []
    for batch in batches:
        done = []
        for run, at, own, host, keys, sizes in zip(*(batch.column(c).to_pylist() for c in ("run", "at", "own", "host", "keys", "sizes")), strict=True):
            if (run, host) != last:
                done += near
                last, near = (run, host), []
            if not keys or any(keys == p.keys for p in near):  # copies are taken once
                continue
            page = _Page(at, own, keys, sizes)
            for other in near:
                if own or other.own:
                    both = page.known & other.known
                    pairs = shared_lines(keys, other.keys, both) if both else []
                    page.tell([i for i, _ in pairs])
                    other.tell([j for _, j in pairs])
            near.append(page)
            if len(near) > WIDTH:
                done.append(near.pop(0))
        yield from out(done)
    yield from out(near)


def _keyed(pages: DataFrame) -> DataFrame:
    """Pages with texts for nulls and a digest, which tells rows with one ``page_id`` apart."""
    filled = pages.select("page_id", "url", text_or_empty("html").alias("html"))
    return filled.withColumn("digest", F.xxhash64("url", "html"))


def told_pages(light: DataFrame) -> DataFrame:
    """(at, gone) for the numbered pages that are compared with others: the lines they share."""
    run = F.floor(F.col("at") / RUN)
    ahead = F.array(F.struct(run.alias("run"), F.lit(True).alias("own")), F.struct((run + 1).alias("run"), F.lit(False).alias("own")))
    dealt = F.explode(F.when(F.col("at") % RUN >= RUN - WIDTH, ahead).otherwise(F.slice(ahead, 1, 1)))
    rows = light.select("at", "host", F.col("lines.key").alias("keys"), F.col("lines.size").alias("sizes"), dealt.alias("x")).select("x.run", "at", "x.own", "host", "keys", "sizes")
    paired = rows.repartition("run").sortWithinPartitions("run", "at").transform(arrow_map, _pairing, _PAIRED)
    return paired.groupBy("at").agg(F.array_distinct(F.flatten(F.collect_list("gone"))).alias("gone"))


def frame_places(told: DataFrame) -> DataFrame:
    """(host, frames): the places in the markup that are part of a host's frame, from the pages
    (host, lines, gone) that were compared."""
    spread = told.select("host", "gone", F.posexplode("lines").alias("i", "line"))
    shared = F.array_contains("gone", F.col("i")).cast("long")
    by_place = spread.groupBy("host", F.col("line.place").alias("place")).agg(
        F.first("line.above").alias("above"), F.bool_or("line.inside").alias("inside"), F.count("*").alias("n"), F.sum(shared).alias("times"), F.sum("line.size").alias("size")
    )
    share = F.col("times") / F.col("n")
    body = by_place.groupBy("host").agg(F.max(F.struct("size", "place", "above", share.alias("share"))).alias("body"))
    least = F.when(F.col("inside") | (F.col("above") == F.col("body.above")), FRAME_SHARE).otherwise(F.greatest(F.lit(FRAME_LEAST), FRAME_FACTOR * F.col("body.share")))
    frame = by_place.join(body, "host").filter((F.col("place") != F.col("body.place")) & (F.col("times") >= FRAME_TIMES) & (share >= least))
    return frame.groupBy("host").agg(F.collect_list("place").alias("frames"))


def differences(pages: DataFrame) -> DataFrame:
    """(page_id, digest, gone) for the pages that lose lines."""
    rows = _keyed(pages).select(F.col("page_id").cast("long"), "digest", text_or_empty("url").alias("url"), "html")
    light = numbered(cut(rows.transform(arrow_map, _sketching, _LIGHT)), ["host", "path", "page_id", "digest"], "at")
    told = cut(light.join(told_pages(light), "at").select("page_id", "digest", "host", "lines", "gone"))
    frames = frame_places(told).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = light.withColumn("salt", F.pmod("digest", F.lit(SALTS)).cast("int"))
    framed = salted.join(frames, ["host", "salt"]).select(
        "page_id", "digest", F.filter(F.transform("lines", lambda x, i: F.when(F.array_contains("frames", x["place"]), i)), lambda i: i.isNotNull()).alias("gone")
    )
    # Shared lines outside main elements go wherever they stand.
    loose = told.select("page_id", "digest", F.filter("gone", lambda i: ~F.get("lines", i)["main"]).alias("gone"))
    return loose.unionByName(framed).filter(F.size("gone") > 0).groupBy("page_id", "digest").agg(F.array_distinct(F.flatten(F.collect_list("gone"))).alias("gone"))


def chosen(page: list[Line], gone: set[int]) -> str:
    """The main text from a page's lines and the places of those that differencing deletes."""
    left = [x for i, x in enumerate(page) if i not in gone and not x.away]
    inside = sum(len(x.text) for x in left if x.main)
    outside = sum(len(x.text) for x in left if not x.main)
    alone = any(x.main for x in left) and not (outside >= OUTSIDE_CHARS and outside > OUTSIDE * inside)
    return " ".join(x.text for x in left if x.main or not alone)


def _extracting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [chosen(lines(html), set(gone or ())) for html, gone in zip(batch.column("html").to_pylist(), batch.column("gone").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"]
        )


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of ``pages``."""
    rows = _keyed(pages).alias("p")
    gone = cut(differences(pages))
    size = gone.agg(F.coalesce(F.sum(F.size("gone") * 4 + 64), F.lit(0))).first()[0]
    told = (F.broadcast(gone) if size <= BROADCAST_BYTES else gone).alias("g")
    joined = rows.join(told, (F.col("p.digest") == F.col("g.digest")) & F.col("p.page_id").cast("long").eqNullSafe(F.col("g.page_id")), "left")
    kind = rows.schema["page_id"].dataType.simpleString()
    return joined.select("p.page_id", "p.url", "html", "gone").transform(arrow_map, _extracting, f"page_id {kind}, url string, text string, n_chars long")


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    return extract(read(spark, sf_dir, "pages"))


ORACLE_SQL: dict[str, str] = {}
QUERIES = {"op5_main_text": op5_main_text}
