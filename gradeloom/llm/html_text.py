"""Main text of web pages by text-to-tag ratio.

The standard library's parser streams the page's events into lines, one a block element, with the number of tags in each. The ratio of
text to tags of the lines is smoothed by a Gaussian and parted into two clusters by a threshold; the lines of the upper
cluster are content. The region of the page that holds all the content, its articles if it marks any, is then taken
whole, but for parts whose element or class says that they are something else (menus, adverts, forms, comments ...). Names that content may bear, too
(related, share, header ...), only support the clusters: such a part goes unless most of its text is in the upper cluster and is not link text.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare, table

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements whose content is never main text.
NEVER = frozenset(
    "applet aside audio button canvas datalist dialog embed fieldset footer form frameset head iframe input map math menu nav noframes noscript object "
    "option script search select style svg template textarea title video".split()
)
REGIONS = frozenset(["article", "main"])
#: Words of a class, id or role that say the same.
NAMES = frozenset(
    "ad ads adbox adsense advert adverts advertisement advertising breadcrumb breadcrumbs comment comments consent contentinfo cookie cookies "
    "disqus footer gdpr masthead menu modal nav navbar navigation newsletter notice notices notification overlay pager pagination paywall popup "
    "promo promoted promotion reply replies respond sidebar signup sponsor sponsored subscribe subscription complementary".split()
)
#: Words that only support what the clusters say.
HINTS = frozenset("banner dialog header login recommended related response responses search share sharing social teaser toolbar widget".split())
#: A start tag of the key closes an open one of the values (as in HTML without end tags).
CLOSES = {t: frozenset(["p"]) for t in BLOCK} | {
    "li": frozenset(["li", "p"]), "dt": frozenset(["dt", "dd", "p"]), "dd": frozenset(["dt", "dd", "p"]), "tr": frozenset(["tr", "td", "th", "p"]),
    "td": frozenset(["td", "th", "p"]), "th": frozenset(["td", "th", "p"]), "option": frozenset(["option"]),
}
#: Within these an open element is not closed from inside.
WALLS = {"li": frozenset(["ul", "ol", "menu"]), "dt": frozenset(["dl"]), "dd": frozenset(["dl"]), "tr": frozenset(["table"]), "td": frozenset(["table"]), "th": frozenset(["table"])}


def named(attrs: list[tuple[str, str | None]]) -> tuple[bool, bool]:
    """Whether an element's names say that it is no main text, and whether they hint at it."""
    says = hints = False
    for key, value in attrs:
        if key in ("class", "id", "role"):
            words = (value or "").lower().replace("-", " ").replace("_", " ").split()
            says |= not NAMES.isdisjoint(words)
            hints |= not HINTS.isdisjoint(words)
        elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and "display:none" in (value or "").replace(" ", "").lower():
            says = True
    return says, hints


class Lines(HTMLParser):
    """Lists (text, tags, container, whether it can be content, hinted part, link characters) of each line. Containers are numbered in order and know their parent;
    container 0 is the page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, bool, int, int]] = []
        self.parents, self.regions = [0], set()
        self.stack: list[tuple[str, bool, bool]] = []  # tag, whether it hides, whether it is a container
        self.open: list[int] = [0]  # the open containers
        self.hinted: list[int] = [0]  # for each open element the hinted part around it, 0 if none
        self.text: list[str] = []
        self.tags, self.hidden, self.in_region, self.in_link, self.link, self.hints = 0, 0, 0, 0, 0, 0

    def line(self) -> None:
        if words := " ".join("".join(self.text).split()):
            self.lines.append((words, self.tags, self.open[-1], not self.hidden, self.hinted[-1], self.link))
        self.text, self.tags, self.link = [], 0, 0

    def handle_data(self, data: str) -> None:
        self.text.append(data)
        if self.in_link:
            self.link += len(data)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if closes := CLOSES.get(tag):
            wall = WALLS.get(tag, frozenset())
            for i in range(len(self.stack) - 1, -1, -1):
                name = self.stack[i][0]
                if name in closes:
                    self.close_from(i)
                elif name in wall or name in BLOCK and name not in closes:
                    break
        if tag == "br":
            self.text.append(" ")
        if tag in BLOCK:
            self.line()
        self.tags += 1
        if tag in VOID:
            return
        says, hints = named(attrs) if tag not in ("html", "body", "article", "main") else (False, False)
        hides = tag in NEVER or says and not (self.in_region and tag == "header") or tag == "header" and not self.in_region
        if hides and tag not in BLOCK and not self.hidden:
            self.outer, self.text = self.text, []  # text of a hidden inline element does not join the line around it
        container = tag in BLOCK and tag not in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li")
        if container:
            self.parents.append(self.open[-1])
            self.open.append(len(self.parents) - 1)
            if tag in REGIONS:
                self.regions.add(self.open[-1])
                self.in_region += 1
        self.in_link += tag == "a"
        self.hints += hints and not self.hinted[-1]
        self.hinted.append(self.hinted[-1] or (self.hints if hints else 0))
        self.stack.append((tag, hides, container))
        self.hidden += hides

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                self.close_from(i)
                return
        if tag in BLOCK:
            self.line()

    def close_from(self, i: int) -> None:
        while len(self.stack) > i:
            tag, hides, container = self.stack[-1]
            if tag in BLOCK:
                self.line()
            self.stack.pop()
            self.hinted.pop()
            self.hidden -= hides
            self.in_link -= tag == "a"
            if hides and tag not in BLOCK and not self.hidden:
                self.text = self.outer
            if container:
                self.open.pop()
                self.in_region -= tag in REGIONS


def smooth(x: np.ndarray, sigma: float) -> np.ndarray:
    r = max(1, int(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    return np.convolve(np.pad(x, r, mode="edge"), kernel / kernel.sum(), mode="valid")


def threshold(x: np.ndarray) -> float:
    """Between the means of the two clusters that x falls into."""
    a, b = float(x.min()), float(x.max())
    for _ in range(50):
        cut = (a + b) / 2
        low, high = x[x <= cut], x[x > cut]
        if not len(low) or not len(high) or (low.mean(), high.mean()) == (a, b):
            break
        a, b = float(low.mean()), float(high.mean())
    return (a + b) / 2


def main_text(html: str | None, sigma: float = 1.0) -> str:
    if not html:
        return ""
    parser = Lines()
    parser.feed(html)
    parser.close()
    parser.line()
    lines = parser.lines
    if not any(line[3] for line in lines):
        return ""
    ratio = smooth(np.log1p([len(text) / max(1, tags) for text, tags, *_ in lines]), sigma)
    high = ratio >= threshold(ratio)
    sums = np.zeros((parser.hints + 1, 3))  # of each hinted part: characters, those in the upper cluster, those of links
    for (text, *_, hint, link), up in zip(lines, high, strict=True):
        sums[hint] += len(text), len(text) * up, link
    fine = (2 * sums[:, 1] > sums[:, 0]) & (2 * sums[:, 2] < sums[:, 0])
    fine[0] = True
    can = [line[3] and fine[line[4]] for line in lines]
    content = [ok and up for ok, up in zip(can, high, strict=True)]
    if not any(content):
        content = can
    inside = within(parser.parents, parser.regions, [line[2] for line, yes in zip(lines, content, strict=True) if yes])
    return "\n".join(line[0] for line, ok, yes in zip(lines, can, content, strict=True) if ok and (yes or inside[line[2]]))


def within(parents: list[int], regions: set[int], chosen: list[int]) -> list[bool]:
    """Of each container whether it is part of the region that holds the chosen lines, given by their containers: the marked regions (articles, main) around chosen lines, and
    the containers of lines chosen outside them (of one that is also around a marked region only the chosen lines); without marks the deepest container of all."""
    holds = [False] * len(parents)  # a chosen line, at any depth
    for c in chosen:
        while not holds[c]:
            holds[c] = True
            c = parents[c]
    taken = [False] * len(parents)
    marked = {c for c in regions if holds[c]}
    if marked:
        deep = [c in marked for c in range(len(parents))]  # in a marked region, or one itself
        for c in range(1, len(parents)):
            deep[c] |= deep[parents[c]]
        around = [False] * len(parents)
        for c in marked:
            while c and not around[c]:
                around[c] = True
                c = parents[c]
        for c in marked.union(c for c in chosen if c and not deep[c] and not around[c]):
            taken[c] = True
    elif chosen:
        own, below = set(chosen), [0] * len(parents)
        for c in range(1, len(parents)):
            below[parents[c]] += holds[c]
        c = 0
        while c not in own and below[c] == 1:  # one way down
            c = next(k for k in range(c + 1, len(parents)) if parents[k] == c and holds[k])
        taken[c] = True
    for c in range(1, len(parents)):
        taken[c] |= taken[parents[c]]
    return taken


def extract_main_text(pages: DataFrame, *, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns in ``keep``, text and n_chars of each row. Null or empty html and pages without text give an empty text; rows are independent,
    so repeated ones are all kept; an empty table gives none."""
    prepare(pages.sparkSession)
    rows = pages.select(*keep, F.col(html_col).cast("string").alias("_html"))
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema[:-1]) + "text string, n_chars long"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            text = [main_text(h) for h in part.pop("_html")]
            part["text"], part["n_chars"] = text, np.array([len(t) for t in text], np.int64)
            yield part

    return rows.mapInPandas(run, schema)


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extract_main_text(pages)
