"""Main text of web pages by line-block distribution.

1. Strip markup: the page is read as a stream of tags; every block element ends a line. White space in a line becomes
   one space. Text in page furniture (navigation, site header and footer, asides, forms, notices, adverts, reader
   comments, hidden parts) or in scripts, styles and the head stays out of the lines; between two lines it leaves one
   barrier, an empty line. Headings, and paragraphs in a main container, are no furniture by their class alone; a block
   there whose class is a word of the second list (`related`, say) is furniture only if its letters outside links less
   those inside stay below half the threshold.
2. Weigh lines: the letters and digits outside links less those inside, at least 0. The page's main containers
   (article, main) decide if they hold at least as much of that as the rest of the page, or if there is one only and it
   holds prose outside headings. Then each of their lines, but items of lists that are mostly links, weighs half the
   threshold more, and the lines outside weigh nothing.
3. Sum weights over sliding windows of `window` lines, inside containers and outside them apart. A surge is a line with
   weight where the windowed sum reaches the threshold from below, a dive the line where it falls to nothing again; in
   containers that decide, the line after the last one with weight. The lines between a surge and its dive are the text
   (outside containers those with weight), with the headings that lead up to it. On a page whose windows all stay below
   the threshold, the largest sum is the threshold.

Defined results: a null or empty html gives an empty text; nothing is cut by length; repeated rows give equal rows; an
empty table gives no rows. Elements left open are closed as browsers do for p, li, dt, dd, tr, td, th and option.
Markup declarations that HTML doesn't know are comments up to the next >. Time grows in proportion to the page.
"""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Element and attribute words of HTML pages.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search "
    "section select summary table tbody td tfoot th thead tr ul".split()
)
FURNITURE = frozenset("nav aside form dialog menu button select textarea footer search".split())
UNSEEN = frozenset("script style head title noscript template iframe object svg canvas audio video math".split())
ROLES = frozenset(
    "navigation banner contentinfo complementary search dialog alertdialog form menu menubar alert toolbar".split()
)
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion promoted sidebar "
    "nav navbar navigation menu menus breadcrumb breadcrumbs footer cookie cookies consent gdpr banner notice notices "
    "popup modal newsletter subscribe signup comment comments commentlist disqus replies respond masthead topbar toolbar "
    "pagination pager skip hidden".split()
)
#: Furniture outside main containers; inside, the text of a block with such a class decides.
TOPICS = frozenset(
    "related recommended recommendations share sharing social widget widgets overlay subscription login".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
    "th": {"td", "th"}, "option": {"option"},
}
SCOPES = frozenset("ul ol dl table select menu".split())
_SPLIT = re.compile(r"[^a-z0-9]+")
_SPACE = re.compile(r"\s+")
_HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Line:
    __slots__ = ("text", "prose", "main", "heading", "item")

    def __init__(self, text: str, prose: int, main: bool, heading: bool, item: bool):
        self.text, self.prose, self.main, self.heading, self.item = text, prose, main, heading, item


class _Lines(HTMLParser):
    """Collects lines; None is a barrier."""

    def __init__(self, least: int):
        super().__init__(convert_charrefs=True)
        self.least = least  # prose that a block with a topic's class has to hold
        self.prose = 0  # of all lines so far
        self.doubted: list[tuple[int, int, int]] = []  # open blocks with a topic's class: place in the stack, lines and prose before
        self.containers = 0  # outermost ones met
        self.lines: list[Line | None] = []
        self.stack: list[tuple[str, bool]] = []  # element, whether its text is left out
        self.open: Counter[str] = Counter()  # open elements by name
        self.blocks: list[int] = []  # places of open blocks in the stack
        self.inline: list[Counter[str]] = [Counter()]  # open inline elements by name, since each open block
        self.scoped: list[Counter[str]] = [Counter()]  # open list and table parts by name, since each open list or table
        self.out = 0  # open elements whose text is left out
        self.main = self.link = self.head = 0
        self.parts: list[tuple[str, bool]] = []

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        return self.parse_bogus_comment(i, 0)  # <![ ... >

    def end_line(self) -> None:
        text = _SPACE.sub(" ", "".join(t for t, _ in self.parts)).strip()
        if text:
            prose = sum((1 - 2 * linked) * sum(map(str.isalnum, t)) for t, linked in self.parts)
            self.lines.append(Line(text, prose, self.main > 0, self.head > 0, self.open["li"] > 0))
            self.prose += prose
        self.parts = []

    def furniture(self, tag: str, attrs: list[tuple[str, str | None]]) -> bool:
        if tag in UNSEEN or tag in FURNITURE or tag == "header" and not self.main:
            return True
        if tag in ("html", "body", "article", "main"):
            return bool({"comment", "comments", "reply"} & self.names(attrs)) if tag == "article" else False
        given = dict(attrs)
        if "hidden" in given or (given.get("aria-hidden") or "").lower() == "true":
            return True
        if (given.get("role") or "").lower() in ROLES or _HIDING.search(given.get("style") or ""):
            return True
        by_name = tag not in HEADINGS and not (tag == "p" and self.main)
        if not by_name:
            return False
        names = self.names(attrs)
        return bool(NAMES & names) or bool(TOPICS & names) and not self.doubtful(tag)

    def doubtful(self, tag: str) -> bool:
        return self.main > 0 and tag in BLOCK

    @staticmethod
    def names(attrs: list[tuple[str, str | None]]) -> set[str]:
        given = dict(attrs)
        return set(_SPLIT.split(f"{given.get('class') or ''} {given.get('id') or ''}".lower()))

    def barrier(self) -> None:
        if self.lines and self.lines[-1] is not None:
            self.lines.append(None)

    def push(self, tag: str, out: bool) -> None:
        self.open[tag] += 1
        if tag in BLOCK:
            self.blocks.append(len(self.stack))
            self.inline.append(Counter())
        else:
            self.inline[-1][tag] += 1
        if tag in CLOSES:
            self.scoped[-1][tag] += 1
        if tag in SCOPES:
            self.scoped.append(Counter())
        self.stack.append((tag, out))
        self.out += out
        self.main += tag in ("article", "main")
        self.link += tag == "a"
        self.head += tag in HEADINGS

    def pop(self) -> str:
        tag, out = self.stack.pop()
        if self.doubted and self.doubted[-1][0] == len(self.stack):
            _, lines, prose = self.doubted.pop()
            if self.prose - prose < self.least:
                del self.lines[lines:]
                self.prose = prose
                self.barrier()
        self.open[tag] -= 1
        if tag in SCOPES:
            self.scoped.pop()
        if tag in CLOSES:
            self.scoped[-1][tag] -= 1
        if tag in BLOCK:
            self.blocks.pop()
            self.inline.pop()
        else:
            self.inline[-1][tag] -= 1
        self.main -= tag in ("article", "main")
        self.link -= tag == "a"
        self.head -= tag in HEADINGS
        self.out -= out
        if out and not self.out:
            self.barrier()
        return tag

    def close(self, *tags: str) -> None:
        """Closes the innermost open element of these names and all in it; without names, ends the page."""
        if not tags:
            return super().close()
        while self.pop() not in tags:
            pass

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCK:
            self.end_line()
            if tag != "br" and self.blocks and self.stack[self.blocks[-1]][0] == "p":
                self.close("p")  # a block ends an open paragraph
            if tag in CLOSES and any(self.scoped[-1][t] for t in CLOSES[tag]):
                self.close(*CLOSES[tag])
        if tag in VOID:
            if tag in ("img", "input"):
                self.parts.append((" ", False))
            return
        out = self.furniture(tag, attrs)
        if out and not self.out:
            self.end_line()
            self.barrier()
        if not out and not self.out:
            self.containers += tag in ("article", "main") and not self.main
            if self.doubtful(tag) and tag not in HEADINGS and tag != "p" and TOPICS & self.names(attrs):
                self.doubted.append((len(self.stack), len(self.lines), self.prose))
        self.push(tag, out)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # HTML ignores the slash

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK:
            self.end_line()
        # an inline end tag doesn't close blocks
        if self.open[tag] if tag in BLOCK else self.inline[-1][tag]:
            self.close(tag)

    def handle_data(self, data: str) -> None:
        if not self.out:
            self.parts.append((data, self.link > 0))


def page_lines(html: str, least: int) -> tuple[list[Line | None], int]:
    """Lines and the number of outermost main containers."""
    parser = _Lines(least)
    parser.feed(html)
    parser.close()
    parser.end_line()
    while parser.stack:
        parser.pop()
    return parser.lines, parser.containers


def windowed(weights: np.ndarray, window: int) -> np.ndarray:
    """Sums of each line's weight and those of the lines after it, `window` in all."""
    return np.convolve(weights, np.ones(window, np.int64))[window - 1 :] if len(weights) else weights


def between_surge_and_dive(weights: np.ndarray, sums: np.ndarray, threshold: int, whole: bool = False) -> np.ndarray:
    """Which lines lie between a surge and its dive; if `whole`, the dive is after the last line with weight."""
    inside, keep = False, np.zeros(len(weights), bool)
    last = int(np.flatnonzero(weights).max(initial=-1))
    for i in range(len(weights)):
        if not inside and weights[i] and sums[i] >= threshold:
            inside = True
        elif inside and (i > last if whole else not sums[i]):
            inside = False
        keep[i] = inside
    return keep


def main_text(html: str | None, window: int = 3, threshold: int = 80) -> str:
    lines, containers = page_lines(html or "", threshold // 2)
    weights = np.array([0 if x is None else max(0, x.prose) for x in lines], np.int64)
    main = np.zeros(len(lines), bool)
    for i, x in enumerate(lines):
        main[i] = x.main if x is not None else i and main[i - 1]
    lone = containers == 1 and any(x is not None and x.main and x.prose > 0 and not x.heading for x in lines)
    decide = lone or 2 * weights[main].sum() >= weights.sum()
    heads = weights > 0
    if decide and main.any():
        weights += (threshold // 2) * np.array([x is not None and x.main and (x.prose >= 0 or not x.item) for x in lines], bool)
        weights[~main] = 0
    cuts = [0, *(np.flatnonzero(main[1:] != main[:-1]) + 1).tolist(), len(lines)]
    apart = list(zip(cuts, cuts[1:], strict=False))
    sums = np.concatenate([windowed(weights[i:j], window) for i, j in apart]) if len(lines) else weights
    reached = min(threshold, int(sums.max(initial=0)))
    keep = np.zeros(len(lines), bool)
    for i, j in apart:
        keep[i:j] = between_surge_and_dive(weights[i:j], sums[i:j], reached, decide and main[i:j].any())
    keep &= (weights > 0) | main
    keep &= np.array([x is not None for x in lines], bool)
    for i in np.flatnonzero(keep[1:] & ~keep[:-1]):  # headings before a surge
        while i >= 0 and lines[i] is not None and lines[i].heading and (heads[i] or main[i]):
            keep[i] = True
            i -= 1
    return "\n".join(x.text for x, k in zip(lines, keep, strict=True) if k)


def extract(html: Column, window: int = 3, threshold: int = 80) -> Column:
    """The main text as a column."""

    @F.arrow_udf("string")
    def texts(pages: pa.Array) -> pa.Array:
        return pa.array([main_text(p.as_py(), window, threshold) for p in pages], pa.string())

    return texts(html)
