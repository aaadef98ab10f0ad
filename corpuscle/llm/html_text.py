"""Main text of web pages: parser events, text-to-tag ratio, smoothing, and threshold clusters.

Each page runs once through the standard library's streaming parser. Its events are cut into lines at block elements;
a line has text, tags, and the text inside links. The text-to-tag ratio of each line and that smoothed by a Gaussian over
neighbouring lines are taken for all lines that are seen, whatever they are in. The threshold is the smoothed ratios'
deviation, or half of their mean if that is less. Lines that pass it by their own ratio and by the smoothed one are the cores
of content clusters; the smallest container that holds all cores, or an ``article`` or ``main`` that does, is the content region. Lines beside it that the
smoothed ratio still counts to its cluster come along if they are a heading, a paragraph, or dense enough themselves. All
lines in the region stay, short ones included, so that a short paragraph between long ones stays.

Names of elements and of classes are evidence: they lower a line's weight and delete nothing by themselves. A line in
navigation, headers, footers, sidebars, forms, adverts, notices, comments and the like (by element, role, class or id) has a
hundredth of its ratio, one in an element whose class only has such a word among others ("share-economy"), or which is part
of a text (a quotation, a paragraph), half, and one outside of the page's ``article`` and ``main`` a quarter. Such an
element in the region goes unless at least half of its text is in lines that pass the threshold with that weight. An ``article``
with less than a quarter of the largest one's text is a teaser and has a hundredth. Where the whole page is so marked, all
weights are alike and change nothing. Pages of fewer than ``SPARSE`` characters have no clusters to speak of: what isn't
marked stays, and of a page with ``article`` or ``main`` what is in there; if nothing is, and there is none, all does.
Scripts, styles, controls and hidden elements (``hidden``, ``display:none``, ``aria-hidden``) never count.

White space inside a line becomes one space, lines are trimmed, empty ones dropped, the others joined by a line feed;
character references are decoded. Null and empty pages have an empty text; text without any markup is one line. Pages
of any depth and length take time in proportion to their size. Null and repeated ids are pages of their own. Other columns
are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIGMA, REACH, SHARE = 1.0, 2, 0.5
#: Shares of text by which an element holds the page, a second article is none, and a neighbouring line is dense.
HOLDS, TEASER, DENSE = 0.5, 0.25, 0.25
#: Characters outside links below which a page has no clusters, and the weight of what is outside of an article.
SPARSE, OUTSIDE = 200, 0.25
#: Elements that stand in a line of text and don't end it (fixed values); br becomes white space.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that show no text of their own or only controls (fixed values).
UNSEEN = frozenset("script style noscript template iframe svg canvas object audio video button select option textarea head title map datalist".split())
#: Elements that usually aren't main text (fixed values).
ASIDE = frozenset("nav footer aside form menu dialog".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form".split())
#: Words in a class or id that mark what isn't main text (fixed values).
MARKS = frozenset("ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu submenu sidebar sidebars rail widget widgets footer header masthead topbar breadcrumb breadcrumbs cookie cookies consent gdpr notice notices alert comment comments disqus reply replies respond reader share sharing social related recommended newsletter subscribe subscription signup login popup modal overlay paywall pagination pager toolbar search copyright legal skip".split())
#: Words before a mark that say something of the page and not of the element (fixed values).
NOT_ITSELF = frozenset(("has", "with", "no", "without", "hide"))
TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
UNSHOWN = re.compile(r"(?i)display\s*:\s*none|visibility\s*:\s*hidden")
MAIN = frozenset(("article", "main"))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that are part of a text and not what holds it (fixed values).
TEXTUAL = HEADINGS | INLINE | frozenset("p li dt dd ul ol dl blockquote pre figure figcaption table tbody thead tfoot tr td th caption".split())
#: An open element that a new one of the same kind ends, and what bounds the search for it.
ENDS = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th")}
BOUNDS = tuple("ul ol dl table select article main section div body html".split())
#: How much an element says of its text: nothing, a class's word among others, a class or an element's name, or that it isn't seen.
NOTHING, WEAK, STRONG, HARD = range(4)
WEIGHTS = (1.0, 0.5, 0.01, 0.0)


def marking(value: str, inside_main: bool = False) -> int:
    """What a class or id says: STRONG if one of its names consists of marking words, WEAK if one has such a word.

    Two words that follow each other may make a mark; "with sidebar" is none, and an article's own header stays.
    """
    marks, found = MARKS - {"header"} if inside_main else MARKS, NOTHING
    for name in value.split():
        words = [t.lower() for t in TOKEN.findall(name)]
        hits = [t in marks and not (k and words[k - 1] in NOT_ITSELF) for k, t in enumerate(words)]
        if words and all(hits) or "".join(words) in marks:
            return STRONG
        if any(hits) or any(a + b in marks for a, b in zip(words, words[1:])):
            found = WEAK
    return found


class Page(HTMLParser):
    """A page's elements in the order in which they open, by arrays with each one's parent, and its lines.

    A line is (text, tags, linked characters, element). Element 0 stands for the whole page.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tag, self.parent, self.mark, self.by_name = [""], [0], [NOTHING], [False]
        self.lines: list[tuple[str, int, int, int]] = []
        #: Open elements, and for each name their places among those.
        self.stack, self.open = [0], {}
        self.blocks: list[int] = [0]
        self.parts: list[str] = []
        self.tags = self.linked = self.links = self.mains = 0

    def flush(self):
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                self.lines.append((text, self.tags, self.linked, self.stack[-1]))
            self.parts = []
        self.tags = self.linked = 0

    def says(self, tag: str, attrs) -> tuple[int, bool]:
        """What the element says of its text, and whether it says so by its name or role."""
        inside = self.mains > 0
        if tag in UNSEEN:
            return HARD, True
        found, by_name = NOTHING, False
        if tag in ASIDE or tag == "header" and not inside:
            found, by_name = STRONG, True
        for name, value in attrs:
            if name == "hidden" or value and (name == "style" and UNSHOWN.search(value) or name == "aria-hidden" and value.lower() == "true"):
                return HARD, True
            if value and name == "role" and value.lower() in ROLES:
                found, by_name = STRONG, True
            if value and name in ("class", "id") and tag not in ("html", "body"):
                said = marking(value, inside or tag in INLINE)
                said = WEAK if said == STRONG and tag in TEXTUAL and tag not in INLINE else said
                found = max(found, NOTHING if said == WEAK and (tag in MAIN or tag in INLINE) else said)
        return found, by_name

    def push(self, tag: str, attrs, found: int, by_name: bool):
        self.tag.append(tag)
        self.parent.append(self.stack[-1])
        self.mark.append(found)
        self.by_name.append(by_name)
        self.open.setdefault(tag, []).append(len(self.stack))
        if tag not in INLINE:
            self.blocks.append(len(self.stack))
        self.mains += tag in MAIN
        self.stack.append(len(self.tag) - 1)

    def pop_to(self, place: int):
        """Closes the open elements from ``place`` on."""
        while len(self.stack) > place:
            tag = self.tag[self.stack.pop()]
            self.open[tag].pop()
            if tag not in INLINE:
                self.blocks.pop()
            self.mains -= tag in MAIN

    def last_open(self, tags) -> int:
        return max((self.open[t][-1] for t in tags if self.open.get(t)), default=0)

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if tag in INLINE:
            if tag == "br":
                self.parts.append("\n")
            elif tag == "a":
                self.links += 1
            if tag not in VOID and (attrs or tag == "a"):
                found, by_name = self.says(tag, attrs) if attrs else (NOTHING, False)
                if found:
                    self.flush()
                self.push(tag, attrs, found, by_name)
            return
        self.flush()
        if tag in VOID:
            return
        if tag in ENDS:
            place = self.last_open(ENDS[tag])
            if place > self.last_open(BOUNDS):
                self.pop_to(place)
        self.push(tag, attrs, *self.says(tag, attrs))

    def handle_startendtag(self, tag, attrs):
        self.tags += 1
        if tag not in INLINE:
            self.flush()
        elif tag == "br":
            self.parts.append("\n")

    def handle_endtag(self, tag):
        self.tags += 1
        if tag == "a":
            self.links = max(0, self.links - 1)
        if tag not in INLINE:
            self.flush()
        places = self.open.get(tag)
        if not places or tag in INLINE and places[-1] < self.blocks[-1]:
            return
        if self.mark[self.stack[places[-1]]]:
            self.flush()
        self.pop_to(places[-1])

    def handle_data(self, data):
        if self.tag[self.stack[-1]] in ("script", "style"):
            return
        self.parts.append(data)
        if self.links:
            self.linked += len(data)

    def run(self, html: str) -> "Page":
        self.feed(html)
        self.close()
        self.flush()
        #: The last element inside each one; elements are numbered as they open, so an element holds a range of numbers.
        self.last = list(range(len(self.tag)))
        for k in range(len(self.tag) - 1, 0, -1):
            self.last[self.parent[k]] = max(self.last[self.parent[k]], self.last[k])
        return self

    def out(self, least: int, overruled: frozenset = frozenset()) -> list[bool]:
        """For each element whether its text is left out: it or one that holds it says ``least`` or more.

        What classes say outside of an ``article`` or ``main`` doesn't reach into it.
        """
        out, named = [False] * len(self.tag), [False] * len(self.tag)
        for k in range(1, len(self.tag)):
            up, own = self.parent[k], self.mark[k] >= least and k not in overruled
            named[k] = named[up] or own and self.by_name[k]
            out[k] = own or (named[up] if self.tag[k] in MAIN else out[up])
        return out

    def mass(self, out: list[bool]) -> list[int]:
        """Characters outside links that each element holds."""
        found = [0] * len(self.tag)
        for text, _, linked, at in self.lines:
            if not out[at]:
                found[at] += max(0, len(text) - linked)
        for k in range(len(self.tag) - 1, 0, -1):
            found[self.parent[k]] += found[k]
        return found

    def outer_mains(self, out: list[bool]) -> list[int]:
        found, end = [], -1
        for k, tag in enumerate(self.tag):
            if k > end and tag in MAIN and not out[k]:
                found.append(k)
                end = self.last[k]
        return found


def ratios(lines, out: list[bool]) -> list[float]:
    """Text outside links for each tag, nothing where a line isn't seen."""
    return [0.0 if out[at] else max(0, len(text) - linked) / max(1, tags) for text, tags, linked, at in lines]


def smoothed(values: list[float], sigma: float = SIGMA, reach: int = REACH) -> list[float]:
    weights = [math.exp(-(k * k) / (2 * sigma * sigma)) for k in range(-reach, reach + 1)]
    out = []
    for i in range(len(values)):
        near = [(w, values[i + k]) for k, w in zip(range(-reach, reach + 1), weights) if 0 <= i + k < len(values)]
        out.append(sum(w * v for w, v in near) / sum(w for w, _ in near))
    return out


def marks(page: Page, unseen: list[bool]) -> list[int]:
    """What each element says of itself; second articles with little text count as marked."""
    mark = list(page.mark)
    mass = page.mass(unseen)
    mains = [m for m in page.outer_mains(unseen) if mass[m]]
    for m in mains:
        if mass[m] < TEASER * max(mass[x] for x in mains):
            mark[m] = max(mark[m], STRONG)
    return mark


def weights(page: Page, mark: list[int], unseen: list[bool]) -> list[float]:
    """How much of its ratio a line in each element keeps; what classes say outside of an ``article`` doesn't reach into it."""
    found, named = [1.0] * len(mark), [1.0] * len(mark)
    mass = page.mass(unseen)
    inside = [m for m in page.outer_mains(unseen) if mass[m] and mark[m] < STRONG]
    if inside:
        found[0] = OUTSIDE
    for k in range(1, len(mark)):
        up, own = page.parent[k], WEIGHTS[mark[k]]
        named[k] = min(named[up], own) if page.by_name[k] else named[up]
        found[k] = min(named[up], own) if page.tag[k] in MAIN else min(found[up], own)
    return found


def region(page: Page) -> list[int]:
    """Places of the lines that are the page's text."""
    lines, unseen = page.lines, page.out(HARD)
    shown = [k for k, x in enumerate(lines) if not unseen[x[3]]]
    mark = marks(page, unseen)
    if sum(max(0, len(lines[k][0]) - lines[k][2]) for k in shown) < SPARSE:
        return by_names(page, mark, shown)
    weight, ratio = weights(page, mark, unseen), ratios(lines, unseen)
    own = [r * weight[x[3]] for r, x in zip(ratio, lines)]
    raw, smooth = smoothed(ratio), smoothed(own)
    mean = sum(raw) / len(raw)
    threshold = min(math.sqrt(sum((r - mean) ** 2 for r in raw) / len(raw)), SHARE * mean, SHARE * max(smooth))
    cluster = [r > 0 and s >= threshold for r, s in zip(own, smooth)]
    core = [k for k in shown if cluster[k] and own[k] >= threshold]
    if not core:
        return []
    inside = lambda k, a: a <= lines[k][3] <= page.last[a]
    # elements are numbered as they open: what holds the first and the last one holds all between
    at, last = min(lines[k][3] for k in core), max(lines[k][3] for k in core)
    while at and (page.last[at] < last or page.tag[at] in TEXTUAL):
        at = page.parent[at]
    # an article that holds all cores is their container, short as its other lines may be
    at = next((m for m in page.outer_mains(unseen) if m <= at and page.last[at] <= page.last[m]), at)
    held = [k for k in shown if inside(k, at)]

    def joins(k: int, above: bool) -> bool:
        kind = next_tag(page, lines[k][3])
        return cluster[k] and (kind == "p" or above and kind in HEADINGS or own[k] >= DENSE * threshold)

    first, end = shown.index(held[0]), shown.index(held[-1])
    while first and joins(shown[first - 1], True):
        first -= 1
    while end + 1 < len(shown) and joins(shown[end + 1], False):
        end += 1
    gone = left_out(page, mark, {k for k in core}, unseen)
    return [k for k in shown[first : end + 1] if not gone[lines[k][3]]]


def left_out(page: Page, mark: list[int], core: set[int], unseen: list[bool]) -> list[bool]:
    """For each element whether it, or one that holds it, is marked and has less than half of its text in cores."""
    every, dense = page.mass(unseen), [0] * len(mark)
    for k in core:
        text, _, linked, at = page.lines[k]
        dense[at] += max(0, len(text) - linked)
    for k in range(len(mark) - 1, 0, -1):
        dense[page.parent[k]] += dense[k]
    gone = [False] * len(mark)
    for k in range(1, len(mark)):
        gone[k] = gone[page.parent[k]] or mark[k] > NOTHING and (not every[k] or dense[k] < HOLDS * every[k])
    return gone


def by_names(page: Page, mark: list[int], shown: list[int]) -> list[int]:
    """Lines of a page with little text that nothing marks: those in ``article`` and ``main``, or all where there is none."""
    gone = [False] * len(mark)
    for k in range(1, len(mark)):
        gone[k] = gone[page.parent[k]] or mark[k] > NOTHING
    mains = page.outer_mains(gone)
    kept = [k for k in shown if not gone[page.lines[k][3]]]
    found = [k for k in kept if any(m <= page.lines[k][3] <= page.last[m] for m in mains)] or kept
    return found if found or any(t in MAIN for t in page.tag) else shown


def next_tag(page: Page, at: int) -> str:
    """The name of the nearest element that isn't inline."""
    while page.tag[at] in INLINE:
        at = page.parent[at]
    return page.tag[at]


def main_text(html: str | None) -> str:
    """The page's main text."""
    page = Page().run(html or "")
    return "\n".join(page.lines[k][0] for k in region(page)) if page.lines else ""


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""

    @F.pandas_udf("string")
    def text_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for html in batches:
            yield html.map(main_text, na_action=None)

    rows = pages.select("page_id", "url", text_of(F.coalesce(F.col("html").cast("string"), F.lit(""))).alias("text"))
    return rows.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
