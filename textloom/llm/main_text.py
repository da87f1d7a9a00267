"""Main text of web pages: a maximum-scoring subsequence of words and tags.

A page is read as a sequence of tags and runs of words. Tags cost; words earn or cost by the place they stand in. One
linear scan finds the contiguous region with the largest sum. Words of the region that cost (an advert or a form amid
the article) are left out of its text.

A place is judged together, not tag by tag: first comes the boilerplate that encloses the words (a menu, a footer, a
sidebar, told by a tag, a role or a whole class name), then whether they stand in marked content (<article>, <main>, or
a class such as post-content), and only for words in neither does the tag of their block count, and whether the block is
all links. So a link or a list inside an article is as good as its paragraphs.

What these places are worth and what tags cost are log odds learned from labelled pages: pages that mark their article
label their own words. The mark itself is never a learned feature, so the weights also tell content on pages without
one; stated priors stand for what no labelled page shows. Class names that labelled pages have only outside of articles
are learned as boilerplate too.

A class can also describe a layout (right-sidebar on the element that holds everything). Boilerplate that encloses all
but nothing of the page's other words is taken for such a layout, and an article in it counts if there is none outside.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A quoted value ends at a quote that ends the attribute; without one, the quote is a plain character. An unfinished
#: tag ends the page; "<" that begins no tag is text.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/<>]*)((?:=\s*\"[^\"]*\"(?=[\s/>])|=\s*'[^']*'(?=[\s/>])|[^<>])*+)(?:>|\Z)", re.S)
_MARKS = re.compile(r"(?<![\w-])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")

#: What these hold is no text of the page: code, metadata, the parts of a form, or what stands in for scripts and frames.
_RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "select", "datalist", "noembed", "noframes", "annotation"}
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>", re.I) for t in _RAW}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr math mi mn mo ms mtext mrow msup msub mfrac".split())
#: Opened by the first, an open one of the second ends, if none of the third was opened since.
_ENDS = {
    "li": ("li", ("ul", "ol", "menu")),
    "dt": ("dt dd", ("dl",)),
    "dd": ("dt dd", ("dl",)),
    "td": ("td th", ("table",)),
    "th": ("td th", ("table",)),
    "tr": ("tr td th", ("table",)),
    "option": ("option", ("select",)),
}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}

#: Boilerplate by tag and by role.
_OUTSIDE = {"nav", "footer", "aside", "form", "menu", "dialog", "button", "fieldset", "head", "header"}
_ROLES = {"navigation": "nav", "banner": "header", "contentinfo": "footer", "complementary": "aside", "search": "form", "form": "form", "dialog": "dialog", "alertdialog": "dialog"}
#: Words that make a class name boilerplate, where the whole name says so: the last part of it, or the first with only
#: parts of the next list after it.
_OUTSIDE_WORDS = set(
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar footer cookie cookies consent gdpr banner notice popup modal overlay ad ads adv advert adverts "
    "advertisement advertising sponsor sponsored promo promotion comment comments reply replies disqus respond form signup subscribe newsletter login share sharing "
    "social related recommended pagination pager masthead topbar toolbar widget widgets header copyright legal disclaimer tags meta byline".split()
)
_HOLDERS = set("area bar block body bottom box button container content footer form heading holder inner item items left links list message notice panel right section slot text title top unit widget widgets wrap wrapper".split())
#: A name with one of these states something about a page and is no part of it.
_STATES = set("has with without no not is are open closed free enabled disabled on off hidden visible layout".split())
_CONTENT_WORDS = {"article", "content", "post", "entry", "story", "main", "body", "text", "hentry"}
#: Never taken for a layout.
_SURE = set("nav footer aside menu dialog button fieldset head .comment .comments .reply .replies .disqus .respond .cookie .cookies .consent .gdpr .ad .ads .adv .advert .adverts .advertisement .advertising .sponsor .sponsored .popup .modal".split())

#: Priors in log odds of being content, for words in no marked place; a block of links alone; boilerplate.
_PRIOR_BLOCKS = {"p": 1.0, "h1": 0.5, "blockquote": 1.0, "pre": 1.0}
PRIOR, LINKS, OUTSIDE, MOST = 0.4, -1.5, -6.0, 6.0


def class_kind(name: str) -> str:
    """'.word' for a class or id that names boilerplate, 'content' for one that names content, else ''."""
    parts = [p.lower() for p in _PARTS.findall(name)]
    if not parts or not _STATES.isdisjoint(parts):
        return ""
    last = parts[-1]
    if last in _OUTSIDE_WORDS and not (last == "header" and not {"article", "post", "entry", "story"}.isdisjoint(parts)):
        return "." + last
    if parts[0] in _OUTSIDE_WORDS and all(p in _HOLDERS or p.isdigit() for p in parts[1:]):
        return "." + parts[0]
    return "content" if last in _CONTENT_WORDS else ""


class Place(NamedTuple):
    """Where words stand: enclosing boilerplate, how content is marked (2 by tag, 1 by class), block tag, class, link."""

    outside: str = ""
    marked: int = 0
    block: str = ""
    name: str = ""
    link: bool = False


class _Open(NamedTuple):
    tag: str
    place: Place
    root: int  # number of the outermost boilerplate element, -1 for none


class Page:
    """Tags and runs of words of a page with their places.

    Unclosed tags end with what encloses them; a paragraph ends where a block begins and a cell or item where the next
    one does. Each step looks at the top of the open tags alone, so that depth costs nothing.
    """

    def __init__(self, page: str, learned: dict[str, float], layouts: frozenset[int] = frozenset(), reopen: bool = False) -> None:
        self.learned, self.layouts, self.reopen = learned, layouts, reopen
        self.pieces: list[tuple[str, str, Place, int]] = []  # tag, text, place, block number
        self.words: Counter = Counter()  # by number of the outermost boilerplate element
        self.roots: dict[int, str] = {}
        self.marked_outside = self.marked_inside = False
        self.stack: list[_Open] = []
        self.at: dict[str, list[int]] = {}
        self._read(page)

    def _cut(self, size: int) -> None:
        while len(self.stack) > size:
            self.at[self.stack.pop().tag].pop()

    def _last(self, tags) -> int:
        return max((own[-1] for t in tags if (own := self.at.get(t))), default=-1)

    def _open(self, tag: str, attributes: str, number: int) -> None:
        over = self.stack[-1] if self.stack else _Open("", Place(), -1)
        place, root = over.place, over.root
        outside, content, name = (tag if tag in _OUTSIDE else ""), tag in ("article", "main"), place.name
        by_class = False
        if "=" in attributes and tag not in ("html", "body"):
            for m in _MARKS.finditer(attributes):
                for x in html.unescape(m[2] or m[3] or m[4] or "").split():
                    kind = _ROLES.get(x.lower(), "content" if x.lower() in ("main", "article") else "") if m[1].lower() == "role" else class_kind(x)
                    if kind == "content":
                        by_class = True
                    elif kind and not (tag in ("article", "main") and not kind.startswith(".comment")):
                        outside = outside or kind
                    elif not kind and m[1].lower() != "role":
                        name = x
                        if self.learned.get("class " + x, 0.0) <= -3 and tag not in ("article", "main"):
                            outside = outside or "class " + x
        if place.marked == 2 and outside in ("header", ".header"):
            outside = ""  # it heads the article
        if content and not outside:
            if place.outside:
                self.marked_inside = True
                if self.reopen:
                    place, root = Place(), -1
            else:
                self.marked_outside = True
        if outside and not place.outside and number not in self.layouts:
            place, root = place._replace(outside=outside), number
            self.roots[number] = outside
        marked = place.marked
        if not place.outside:
            marked = max(marked, 2 if content else 1 if by_class else 0)
        block = place.block if tag in _INLINE else tag
        self.at.setdefault(tag, []).append(len(self.stack))
        self.stack.append(_Open(tag, Place(place.outside, marked, block, name, place.link or tag == "a"), root))

    def _read(self, page: str) -> None:
        at = number = block = 0
        while True:
            m = _TOKEN.search(page, at)
            end = m.start() if m else len(page)
            if end > at:
                over = self.stack[-1] if self.stack else _Open("", Place(), -1)
                text = page[at:end]
                self.words[over.root] += len(text.split())
                self.pieces.append(("", text, over.place, block))
            if not m:
                return
            at, tag, number = m.end(), (m[2] or "").lower(), number + 1
            if not tag:
                continue
            if m[1]:
                if own := self.at.get(tag):
                    self._cut(own[-1])
            elif tag in _RAW:
                close = _RAW_END[tag].search(page, at)
                at = close.end() if close else len(page)
            elif tag not in _VOID:
                if tag not in _INLINE:
                    p = self._last(("p",))
                    if p > self._last(("td", "th", "button", "object")):
                        self._cut(p)
                    if tag in _HEADINGS and self.stack and self.stack[-1].tag in _HEADINGS:
                        self._cut(len(self.stack) - 1)
                if tag in _ENDS:
                    ended, scope = _ENDS[tag]
                    since = self._last(scope)
                    first = [own[-1] for t in ended.split() if (own := self.at.get(t)) and own[-1] > since]
                    if first:
                        self._cut(min(first))
                self._open(tag, m[3], number)
            if tag not in _INLINE and tag != "li":  # the items of a list are judged together
                block += 1
            self.pieces.append((("/" if m[1] else "") + tag, "", self.stack[-1].place if self.stack else Place(), block))

    def layout(self) -> int:
        """Number of an element that is taken for boilerplate but holds all but nothing of the page's other words; -1 for none."""
        most = max((k for k, kind in self.roots.items() if kind not in _SURE), key=lambda k: self.words[k], default=-1)
        return most if most >= 0 and self.words[most] and self.words[-1] * 10 < self.words[most] else -1


def read_page(page: str, learned: dict[str, float]) -> Page:
    """The page, read again while an element turns out to be a layout, or the only article to stand in boilerplate."""
    layouts: frozenset[int] = frozenset()
    found = Page(page, learned)
    if found.marked_inside and not found.marked_outside:
        found = Page(page, learned, layouts, True)
    for _ in range(8):
        if (wrap := found.layout()) < 0:
            break
        layouts |= {wrap}
        found = Page(page, learned, layouts, found.reopen)
    return found


@dataclass
class Weights:
    """Log odds by feature ('block p', 'outside nav', 'class x') and costs of tags. Empty: priors only."""

    places: dict[str, float] = field(default_factory=dict)
    tags: dict[str, float] = field(default_factory=dict)

    def worth(self, place: Place, level: int, linked: bool) -> float:
        """What a word earns: 1 at most, less than 0 where its place speaks against it. level: how the page marks content."""
        if place.outside:
            known = min(-1.0, self.places.get("outside " + place.outside, OUTSIDE))
            # What interrupts marked content costs next to nothing, whatever its length.
            return -0.001 if level and place.marked >= level else max(-0.3, known)
        if level:
            return 1.0 if place.marked >= level else -0.5
        total = PRIOR + self.places.get("block " + place.block, _PRIOR_BLOCKS.get(place.block, 0.0)) + (LINKS if linked else 0.0)
        return max(-1.0, min(1.0, total))

    def cost(self, tag: str, place: Place, level: int) -> float:
        if level:
            return 0.0001 if place.marked >= level else 0.3
        plain = tag.lstrip("/")
        return self.tags.get(tag, 0.05 if plain in _INLINE or plain in _HEADINGS or plain in _ENDS or plain in ("p", "br") else 0.3)


def best_region(scores: list[float]) -> tuple[int, int]:
    """(start, end) of the contiguous part with the largest sum, the first of equals and shortest; (0, 0) if none is above 0."""
    best, region, total, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, region = total, (start, i + 1)
    return region


def _level(page: Page) -> int:
    """How content is marked: by tag (2), by class (1), or not (0). A mark on a few of the words is none."""
    marked = Counter()
    for tag, text, place, _ in page.pieces:
        if not tag and not place.outside:
            marked[place.marked] += len(text.split())
    if marked[2] and marked[2] * 3 >= marked[0] + marked[1]:
        return 2
    inside = marked[1] + marked[2]
    return 1 if inside and inside * 3 >= marked[0] else 0


def main_text(page: str | None, weights: Weights) -> str:
    """The main text of one page, '' if it has none."""
    read = read_page((page or "").replace("\x00", "�"), weights.places)
    level = _level(read)
    in_block, in_links = Counter(), Counter()
    for tag, text, place, block in read.pieces:
        if not tag:
            n = len(text.split())
            in_block[block] += n
            if place.link:
                in_links[block] += n
    worth: dict[tuple, float] = {}
    scores, kept = [], []
    for tag, text, place, block in read.pieces:
        key = (tag, place, not tag and in_links[block] * 10 >= in_block[block] * 8)
        if key not in worth:
            worth[key] = -weights.cost(tag, place, level) if tag else weights.worth(place, level, key[2])
        kept.append(worth[key] > 0)
        scores.append(worth[key] if tag else worth[key] * len(text.split()))
    start, end = best_region(scores)
    out, glue = [], ""
    for (tag, text, _, _), keep in zip(read.pieces[start:end], kept[start:end], strict=True):
        if tag:
            if tag.lstrip("/") not in _INLINE:
                glue = " "
        elif keep:
            out.append(glue + html.unescape(text))
            glue = ""
        else:
            glue = " "
    return " ".join("".join(out).split())


def _observed(page: str) -> Counter:
    """Counts of a labelled page: (kind, name, inside); none for a page that doesn't mark its article.

    Words under boilerplate count for that alone and tags under it not at all, so that a menu's items say nothing of
    items elsewhere.
    """
    read = read_page(page.replace("\x00", "�"), {})
    mark = any(place.marked == 2 for _, _, place, _ in read.pieces)
    counts: Counter = Counter()
    for tag, text, place, _ in read.pieces if mark else []:
        inside = place.marked == 2 and not place.outside
        if tag and not place.outside:
            counts["tag", tag, inside] += 1
        elif n := len(text.split()):
            counts["words", "", inside] += n
            counts["place", "outside " + place.outside if place.outside else "block " + place.block, inside] += n
            if place.name and not place.outside:
                counts["place", "class " + place.name, inside] += n
    return counts


def learn(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", max_pages: int = 3_000, least: int = 20) -> Weights:
    """Weights from the pages that mark their article, of a sample of about max_pages taken by a hash of the id."""
    total = pages.count()
    own = pages.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    if total > max_pages:
        own = own.filter(F.pmod(F.xxhash64("page_id", F.lit("pages")), F.lit(1_000_000)) < int(1_000_000 * max_pages / total))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for page in batch.column(0).to_pylist():
                counts.update(_observed(page))
        yield pa.RecordBatch.from_pylist([{"kind": k, "name": x, "inside": i, "n": n} for (k, x, i), n in counts.items()], schema=pa.schema([("kind", pa.string()), ("name", pa.string()), ("inside", pa.bool_()), ("n", pa.int64())]))

    summed = own.select("html").mapInArrow(run, "kind string, name string, inside boolean, n long").groupBy("kind", "name").agg(F.sum(F.when(F.col("inside"), F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("inside"), 0).otherwise(F.col("n"))).alias("b"))
    rows = summed.filter(F.col("a") + F.col("b") >= least).collect()  # at most the names in max_pages pages
    words = next(((r["a"], r["b"]) for r in rows if r["kind"] == "words"), (0, 0))
    weights = Weights()
    if not words[0] or not words[1]:
        return weights
    for r in rows:
        odds = math.log((r["a"] + 1) / (words[0] + 2)) - math.log((r["b"] + 1) / (words[1] + 2))
        if r["kind"] == "place":
            weights.places[r["name"]] = max(-MOST, min(MOST, odds))
        elif r["kind"] == "tag" and r["name"].lstrip("/") not in ("article", "main"):
            # A tag that stands mostly in articles costs next to nothing, one that stands mostly outside up to 1.
            weights.tags[r["name"]] = max(0.01, min(1.0, -odds / MOST))
    return weights


def extract(pages: DataFrame, weights: Weights, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars (code points) for every row of pages.

    A null or empty html gives an empty text, as does a page without a region that earns anything. Repeated rows each
    give a row; null ids and urls stay null. An empty table gives an empty result. Other columns are not read.
    """
    shared = pages.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p, shared.value) for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    own = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return own.mapInArrow(run, "page_id long, url string, text string, n_chars long")
