"""HTML extraction: the main text of a page from streamed parser events and text-to-tag ratios.

Every block of a page is a line with a ratio of text (that of links apart) to tags. The ratios are smoothed with a Gaussian and split
into two clusters; the lines of the upper one say where the content is, whatever elements they stand in. The content region is the
deepest container that holds all of them. With it go the lines that stand directly in a container round it (a heading, a lead)
and the containers beside it, or beside one round it, that are built alike (the same element and class, or sections of a text), unless links are all they hold.
All text of that is kept but for parts that are no content by their element or name: menus, page headers, footers, sidebars,
notices, adverts, forms, scripts, styles, reader comments. A form, a header or an overlay that holds most of the clustered text is content.

Defined results: a null or empty page, and one without text, gives an empty text with 0 characters; broken and unclosed markup
is read as browsers do (a block ends an open paragraph, a stray end tag is ignored); repeated rows give equal results; an empty
table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from abacist.llm.arrow import slices

ROWS = "page_id long, url string, text string, n_chars long"
#: Characters that the parser is fed at once.
FEED = 1 << 16
#: Width of the Gaussian, in lines.
SIGMA = 1.0

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that hold regions of a page.
CONTAINERS = frozenset("article aside body center div footer form header html main nav section".split())
#: Elements whose start or end ends a line.
BLOCKS = CONTAINERS | frozenset(
    "address blockquote caption dd details dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 hgroup hr legend li menu ol option p "
    "pre select summary table tbody td tfoot th thead title tr ul".split())
#: Elements that are never content.
NEVER = frozenset("aside button canvas datalist embed footer head iframe input menu nav noscript object script select style "
                  "svg template textarea title".split())
#: Elements and names that are no content unless they hold most of the clustered text.
UNLESS_MOST = frozenset("dialog form header banner modal overlay popup".split())
#: Names (of classes, ids and roles) of what is no content. As a part of a name they count if the other parts are in NAMES or PARTS.
NAMES = frozenset(
    "ad ads adslot advert advertisement advertising adverts alert alertdialog banner breadcrumb breadcrumbs comment commentlist comments "
    "complementary consent contentinfo cookie cookies disqus footer gdpr menu menubar modal nav navbar navigation newsletter notice "
    "notices notification overlay pager pagination popup promo promoted promotion related respond search share sharing sidebar "
    "signup social sponsor sponsored subscribe toolbar widget widgets".split())
PARTS = frozenset("area article articles aside bar block body bottom box btn button buttons center column container content desktop fixed form "
                  "global group header icon icons inner item items left links list main media mobile module news outer page panel "
                  "placeholder post posts primary reader right row secondary section site slot sticky stories text title top unit user "
                  "wrap wrapper".split())
#: Names that, beside one of those, only describe a page that has such parts.
ABOUT = frozenset("has no with without open closed enable enabled show hide".split())
#: Elements that a name alone never removes.
WHOLE = frozenset("html body article main".split())
#: A header within one of these, or with one of these parts in its name, is the text's own.
SECTIONS = frozenset(("article", "main", "section"))
OWN_HEADER = frozenset("article content entry post story title".split())


def _names(attributes: list) -> Iterator[list[str]]:
    for key, value in attributes:
        if key in ("class", "id", "role") and value:
            for name in value.lower().split():
                yield [part for part in re.split(r"[^a-z]+", name) if len(part) > 1]


def _no_content(tag: str, attributes: list, in_section: bool) -> str:
    """What makes an element no content (its tag or one of NAMES), or nothing."""
    if tag in NEVER or tag in ("form", "dialog"):
        return tag
    names = list(_names(attributes))
    if tag == "header":
        return "" if in_section or any(OWN_HEADER.intersection(parts) for parts in names) else tag
    if tag not in WHOLE:
        for parts in names:
            if all(part in NAMES or part in PARTS for part in parts):
                found = [part for part in parts if part in NAMES]
                if found:
                    return found[0]
    return ""


class Lines(HTMLParser):
    """Collects the lines of a page: (text, characters outside links, tags, container, guards).

    Guards are the elements round a line that make it no content; ``guards`` has what makes each of them so.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, int, tuple]] = []
        self.containers: list[tuple[int, str, str]] = [(-1, "", "")]  # the one it stands in, element, class
        self.guards: list[str] = []
        self.stack: list[tuple[str, int, tuple]] = []  # element, its container, its guards
        self.open: Counter = Counter()
        self.held: list[str] = []
        self.links = self.linked = self.tags = 0

    def _flush(self) -> None:
        text = " ".join("".join(self.held).split())
        self.held.clear()
        if text:
            _, container, guards = self.stack[-1] if self.stack else ("", 0, ())
            self.lines.append((text, max(0, len(text) - self.linked), self.tags, container, guards))
            self.tags = 0
        self.linked = 0

    def _pop(self, tag: str) -> None:
        while self.stack:
            last = self.stack.pop()[0]
            self.open[last] -= 1
            if last == tag:
                return

    def _close_paragraph(self) -> None:
        if not self.open["p"]:
            return
        for tag, _, _ in reversed(self.stack):
            if tag == "p":
                return self._pop("p")
            if tag in CONTAINERS:
                return

    def handle_starttag(self, tag: str, attributes: list) -> None:
        self.tags += 1
        if tag in BLOCKS:
            self._flush()
            self._close_paragraph()
        elif tag == "br":
            self.held.append(" ")
        elif tag == "a":
            self.links = int(any(key == "href" for key, _ in attributes))
        if tag in VOID:
            return
        _, container, guards = self.stack[-1] if self.stack else ("", 0, ())
        guard = _no_content(tag, attributes, any(self.open[x] for x in SECTIONS))
        if guard and (not guards or self.guards[guards[-1]] in UNLESS_MOST):
            self._flush()
            self.guards.append(guard)
            guards = (*guards, len(self.guards) - 1)
        if tag in CONTAINERS:
            named = " ".join(sorted(re.sub(r"[^a-z ]", "", (dict(attributes).get("class") or "").lower()).split()))
            self.containers.append((container, tag, named))
            container = len(self.containers) - 1
        self.stack.append((tag, container, guards))
        self.open[tag] += 1

    def handle_startendtag(self, tag: str, attributes: list) -> None:
        self.handle_starttag(tag, attributes)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in BLOCKS or self.stack and self.stack[-1][2]:
            self._flush()
        if tag == "a":
            self.links = 0
        if self.open[tag] > 0:
            self._pop(tag)

    def handle_data(self, data: str) -> None:
        if self.stack and self.stack[-1][0] in ("script", "style"):
            return
        self.held.append(data)
        if self.links:
            self.linked += len(data)

    def finish(self) -> None:
        if self.rawdata.startswith("<!"):  # a comment that never ends
            self.rawdata = ""
        self.close()
        self._flush()


def smoothed(values: list[float], sigma: float = SIGMA) -> list[float]:
    """Gaussian mean of each value and its neighbours; weights beyond the ends are left out."""
    reach = math.ceil(3 * sigma)
    weights = [math.exp(-d * d / (2 * sigma * sigma)) for d in range(-reach, reach + 1)]
    out = []
    for i in range(len(values)):
        near = [(w, values[i + d]) for d, w in zip(range(-reach, reach + 1), weights) if 0 <= i + d < len(values)]
        out.append(sum(w * v for w, v in near) / sum(w for w, _ in near))
    return out


def threshold(values: list[float]) -> float:
    """Halfway between the centres of two clusters of the values (one-dimensional 2-means from the extremes).

    Centres of which the lower one is half the other or more are those of one cluster; the threshold is below all values then.
    """
    low, high = min(values), max(values)
    for _ in range(50):
        cut = (low + high) / 2
        lower, upper = [v for v in values if v <= cut], [v for v in values if v > cut]
        if not lower or not upper:
            return low - 1 if low == high else cut
        moved = sum(lower) / len(lower), sum(upper) / len(upper)
        if moved == (low, high):
            break
        low, high = moved
    return min(values) - 1 if 2 * low >= high else (low + high) / 2


def main_text(html: str | None) -> str:
    """The main text of a page, its blocks joined by line feeds."""
    if not html:
        return ""
    page = Lines()
    for at in range(0, len(html), FEED):
        page.feed(html[at:at + FEED])
    page.finish()
    lines, guards = page.lines, page.guards
    possible = [all(guards[g] in UNLESS_MOST for g in line[4]) for line in lines]
    if not any(possible):
        return ""
    ratios = smoothed([own / (1 + tags) for _, own, tags, _, _ in lines])
    cut = threshold([r for r, ok in zip(ratios, possible) if ok])
    clustered = [ok and r > cut for r, ok in zip(ratios, possible)]

    # Guards that hold most of the clustered text guard nothing.
    held: Counter = Counter()
    for line, up in zip(lines, clustered):
        if up:
            held.update({g: len(line[0]) for g in (*line[4], -1)})
    content = [ok and all(2 * held[g] > held[-1] for g in line[4]) for line, ok in zip(lines, possible)]
    if not any(content):
        return ""

    containers = page.containers
    mass, text, links_only = [0] * len(containers), [0] * len(containers), [True] * len(containers)
    for (line, own, _, container, _), up, ok in zip(lines, clustered, content):
        if ok:
            text[container] += 1
            mass[container] += up
            links_only[container] &= not own
    for i in range(len(mass) - 1, 0, -1):  # a container comes after the one it stands in
        up = containers[i][0]
        mass[up] += mass[i]
        text[up] += text[i]
        links_only[up] &= links_only[i]
    weight = mass if mass[0] else text
    region = max(i for i, n in enumerate(weight) if n == weight[0])  # of such containers each stands inside the one before
    below, round_it = {}, set()  # the way down to the region: a container round it, and what it holds on that way
    way = region
    while way > 0:
        below[containers[way][0]] = way
        way = containers[way][0]
        round_it.add(way)
    inside = [False] * len(containers)
    for i, (up, tag, named) in enumerate(containers):
        if i == region or up >= 0 and inside[up]:
            inside[i] = True
        elif up in below and i not in round_it and text[i] and not links_only[i]:
            like, its = containers[below[up]][1:], (tag, named)
            inside[i] = its == like or tag in SECTIONS and like[0] in SECTIONS
    return "\n".join(line for (line, own, _, container, _), ok in zip(lines, content)
                     if ok and (inside[container] or container in round_it and own))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page of ``pages`` (page_id, url, html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            texts = [main_text(x) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
                 pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.col("html").cast("string").alias("html")).mapInArrow(run, ROWS)


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES = {"op10_main_text": op10_main_text}
ORACLES: dict[str, str] = {}
