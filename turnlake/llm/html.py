"""Main text of web pages: parser events, text-to-tag ratio per block, Gaussian smoothing, clustering.

Each page is read once as a stream of standard-library parser events.  Block-level tags cut it into lines;
a line's ratio is its characters per tag, on a log scale.  The smoothed ratios are split by a threshold
(two-means, at most ``PROSE`` characters per tag, so that short paragraphs beside long ones are no boilerplate).
A container with its own lines is a region, an article with all inside it one.  Every region whose mean smoothed
ratio, weighted by characters, reaches the threshold is kept, and what directly encloses it (headings).  Lines are
kept in page order, except those inside boilerplate (menus, headers, footers, sidebars, notices, adverts, forms,
scripts, styles, reader comments): elements whose tag or role says so, and elements that a class or id speaks against and
the clustered text does not speak for (``_unsuspected``).  An article's own header is part of it.  White space is
[\x20\x09-\x0d]; a block of nothing but other space, such as no-break spaces, is none.

Null or empty html, and pages without text, give an empty string.  Unclosed and stray tags are tolerated.
Equal pages give equal texts; columns other than those named are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx

# HTML element names by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset(
    "head title script style noscript template nav header footer aside form button select textarea option "
    "iframe object svg canvas audio video dialog menu".split()
)
BLOCKS = frozenset(
    "address article blockquote body center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 hr "
    "html li main ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Characters per tag that are never below the threshold; lists of links have fewer.
PROSE = 5
CONTAINERS = frozenset("article main section div body td html".split())
ENDS_PARAGRAPH = BLOCKS - {"html", "body"}
# Words in class and id attributes, and ARIA roles, that mark boilerplate.
MARKS = frozenset(
    "ad ads advert adverts advertisement sponsor sponsored promo promotion banner cookie cookies consent notice "
    "notices alert popup modal overlay sidebar menu navbar nav navigation breadcrumb breadcrumbs footer "
    "comment comments respond disqus newsletter subscribe subscription social share sharing related "
    "recommended pagination pager toolbar masthead".split()
)
HEADERS = frozenset("header site-header page-header pageheader siteheader topbar".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())

_WORD = re.compile(r"[^a-z0-9]+")
_SPACE = re.compile(r"[\x20\x09-\x0d]+")


KEPT, WEAK, STRONG, GONE = range(4)


def _standing(tag: str, attrs: list[tuple[str, str | None]], in_article: bool) -> int:
    """What an element's tag and attributes say: gone for certain, or suspected by a name (a whole one or a part of one)."""
    if tag in SKIPPED:
        return KEPT if tag == "header" and in_article else WEAK if tag == "form" else GONE
    out = KEPT
    for name, value in attrs:
        value = (value or "").lower()
        if name in ("class", "id") and tag not in ("html", "body", "main"):
            for token in value.split():
                if token in HEADERS or token in MARKS:
                    out = STRONG
                elif not MARKS.isdisjoint(_WORD.split(token)):
                    out = max(out, WEAK)
        elif name == "role" and value in ROLES or name == "hidden" or (name == "aria-hidden" and value == "true"):
            return GONE
        elif name == "style" and "display:none" in value.replace(" ", ""):
            return GONE
    return out


class _Lines(HTMLParser):
    """Collects (text, tags, container, suspect, article) per block; suspects are elements that names speak against."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[tuple[str, int, int, int, int]] = []
        self.parent = [0]
        self.kind = ["page"]
        # tag, container, suspect and article before it, tags so far where it is a suspect, is gone
        self.stack: list[tuple[str, int, int, int, int | None, bool]] = []
        self.container, self.skipping, self.suspect, self.article = 0, 0, -1, -1
        self.suspects: list[tuple[int, bool]] = []  # suspect around it, strongly suspected
        self.articles: list[int] = []  # innermost suspect that holds it or is it
        self.text: list[str] = []
        self.tags = 0

    def updatepos(self, i: int, j: int) -> int:
        return j  # line numbers are not used

    def cut(self) -> None:
        if self.text:
            line = _SPACE.sub(" ", "".join(self.text)).strip(" ")
            if line and not line.isspace():
                self.found.append((line, self.tags, self.container, self.suspect, self.article))
                self.tags = 0
            self.text = []

    def pop_to(self, depth: int) -> None:
        while len(self.stack) > depth:
            _, self.container, self.suspect, self.article, tags, gone = self.stack.pop()
            self.skipping -= gone
            if tags is not None:
                self.tags = tags

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS or tag in SKIPPED:
            self.cut()
        if tag in ENDS_PARAGRAPH:
            self.end_open(("p",), CONTAINERS)
            if tag in ("li", "dd", "dt", "td", "th", "tr"):
                self.end_open((tag,) if tag not in ("dd", "dt") else ("dd", "dt"), frozenset(("ul", "ol", "dl", "table")))
        if not self.skipping:
            self.tags += 1
        if tag == "br" and not self.skipping:
            self.text.append(" ")
        if tag in VOID:
            return
        standing = _standing(tag, attrs, self.article >= 0)
        suspected = standing in (WEAK, STRONG) and not self.skipping
        self.stack.append((tag, self.container, self.suspect, self.article, self.tags if suspected else None, standing == GONE))
        self.skipping += standing == GONE
        if suspected:
            self.suspects.append((self.suspect, standing == STRONG))
            self.suspect = len(self.suspects) - 1
        if tag in ("article", "main") and not self.skipping:
            self.articles.append(self.suspect)
            self.article = len(self.articles) - 1
        if tag in CONTAINERS:
            self.parent.append(self.container)
            self.kind.append(tag)
            self.container = len(self.parent) - 1

    def end_open(self, tags: tuple[str, ...], barrier: frozenset[str]) -> None:
        """End the innermost open element of these tags, unless a barrier lies between."""
        for depth in range(len(self.stack) - 1, -1, -1):
            tag = self.stack[depth][0]
            if tag in tags:
                return self.pop_to(depth)
            if tag in barrier:
                return None
        return None

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS or tag in SKIPPED:
            self.cut()
        if not self.skipping:
            self.tags += 1
        for depth in range(len(self.stack) - 1, -1, -1):
            if self.stack[depth][0] == tag:
                self.pop_to(depth)
                break

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag in ("svg", "path"):
            self.handle_endtag(tag)

    def handle_data(self, data: str) -> None:
        if not self.skipping:
            self.text.append(data)


def smooth(ratio: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    """Gaussian-weighted mean over neighbouring lines, renormalised at the ends."""
    reach = int(np.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    centre = slice(reach, reach + len(ratio))
    return np.convolve(ratio, kernel)[centre] / np.convolve(np.ones(len(ratio)), kernel)[centre]


def two_means(values: np.ndarray, rounds: int = 50) -> float:
    """Threshold between a low and a high cluster (one-dimensional two-means)."""
    low, high = float(values.min()), float(values.max())
    for _ in range(rounds):
        cut = (low + high) / 2
        above = values >= cut
        if above.all() or not above.any():
            break
        new = float(values[~above].mean()), float(values[above].mean())
        if new == (low, high):
            break
        low, high = new
    return (low + high) / 2


def _ratios(found: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """Characters and smoothed ratio of each line."""
    chars = np.array([len(line[0]) for line in found], float)
    return chars, smooth(np.log1p(chars / np.array([max(1, line[1]) for line in found], float)))


def _unsuspected(page: _Lines) -> list[tuple]:
    """The lines outside those suspects that the clustered text does not speak for.

    A suspect stays if it holds at least half of the page's text above the threshold, unless an article or main element with such
    text lies outside all that is suspected or gone.  Text inside an article counts four times, text under a strong suspicion a quarter.
    """
    if not page.suspects:
        return page.found
    chars, ratio = _ratios(page.found)
    prose = chars * (ratio >= min(two_means(ratio), float(np.log1p(PROSE))) - 1e-9)
    strong: list[bool] = []
    for above, own in page.suspects:  # suspects come after those around them
        strong.append(own or above >= 0 and strong[above])
    total = np.zeros(len(page.suspects) + 1)
    spoken, some = np.zeros((2, len(page.articles) + 1), bool)
    for (_, _, _, suspect, article), weight in zip(page.found, prose):
        total[suspect] += weight * (4 if article >= 0 else 1) * (0.25 if suspect >= 0 and strong[suspect] else 1)
        spoken[article] |= weight > 0
        some[article] = True
    whole = total.sum()
    for k in range(len(page.suspects) - 1, -1, -1):
        if page.suspects[k][0] >= 0:
            total[page.suspects[k][0]] += total[k]
    # Where no article has such text, one with any text counts.
    spoken = spoken if spoken[:-1].any() else some
    in_clear = {suspect for suspect, has in zip(page.articles, spoken) if has}
    certain, stays = -1 in in_clear, []
    for k, (above, _) in enumerate(page.suspects):
        stays.append((above < 0 or stays[above]) and not certain and 2 * total[k] >= whole > 0)
        certain |= stays[k] and k in in_clear
    return [line for line in page.found if line[3] < 0 or stays[line[3]]]


def main_lines(html: str | None) -> list[str]:
    """The lines of the main region, in page order."""
    if not html:
        return []
    page = _Lines()
    page.feed(html)
    page.close()
    page.cut()
    found = page.found = _unsuspected(page) if page.found else []
    if not found:
        return []
    chars, ratio = _ratios(found)
    owner, own = _regions(page), np.array([line[2] for line in found])
    region = owner[own]
    mass, weight = np.zeros((2, len(owner)))
    np.add.at(mass, region, chars)
    np.add.at(weight, region, chars * ratio)
    score = weight / np.maximum(mass, 1)
    cut = min(two_means(ratio), float(np.log1p(PROSE)), score.max())
    kept = (mass > 0) & (score >= cut - 1e-9)
    for node in range(len(kept) - 1, 0, -1):  # children come after their parents
        kept[owner[page.parent[node]]] |= kept[owner[node]]
    return [line[0] for line, r in zip(found, region) if kept[r]]


def _regions(page: _Lines) -> np.ndarray:
    """The region of each container: its outermost article, else itself; a table cell of one line is part of what is around it."""
    lines = np.bincount([line[2] for line in page.found], minlength=len(page.parent))
    inner = np.bincount(page.parent[1:], minlength=len(page.parent))
    owner = np.arange(len(page.parent))
    for node in range(1, len(owner)):
        above = owner[page.parent[node]]
        if page.kind[above] == "article" or page.kind[node] == "td" and lines[node] < 2 and not inner[node]:
            owner[node] = above
    return owner


def extract(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The named columns of each page and its main ``text``: lines joined by an empty line."""
    source = pages.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)), F.col(html_col).cast("string").alias("text"))
    kinds = [source.schema[f"k{i}"].dataType.simpleString() for i in range(len(keep))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in tx.slices(whole):
                texts = ["\n\n".join(main_lines(h)) for h in part.column("text").to_pylist()]
                columns = [part.column(f"k{i}") for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string())], [*(f"k{i}" for i in range(len(keep))), "text"])

    schema = ", ".join([*(f"k{i} {kind}" for i, kind in enumerate(kinds)), "text string"])
    out = source.mapInArrow(run, schema)
    return out.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), "text")
