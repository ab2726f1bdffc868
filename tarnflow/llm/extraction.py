"""Main text of HTML pages by text-to-tag ratio.

The standard library's streaming parser turns a page into lines, one for each block of text, with
the number of characters and of tags that belong to it. The ratio of text to tags is lowered by
``PRIOR`` for each element around the line that names itself an advert, a notice or reader
comments, and is nothing in navigation, headers, footers, asides and forms. Line by line it is
smoothed by a Gaussian, and two-means clustering of the logarithms gives the threshold above which a
line belongs to the content. The content region is the element with the most text of such lines less
``COST`` of the text of others, the innermost of equals, and its headings if they stand before it;
inside an article or main element the text of others counts a little for it. The region's lines are
the main text, in page order, also the short ones, without those of elements that name themselves
something else and hold no content line. So a name alone drops nothing: an article in an element with
a misleading name is lower than it might be, but still above the rest.

Null, empty and tag-only pages give an empty text. Pages without any region (plain text) give all
their lines. Every row gives one row, whatever its id.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnflow.llm.common import batches

# HTML element names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style noscript template head title svg math canvas object iframe select option textarea button".split())
FURNITURE = frozenset("nav header footer aside form menu dialog fieldset".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SINGLE = HEADINGS | frozenset("p li dt dd td th tr caption summary figcaption pre address".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
#: Words in a class or id that say that an element isn't the article, and words that say nothing beside them.
MARKS = frozenset(
    "ad ads adv advert advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription"
    " nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager toolbar sidebar sidebars aside widget widgets related recommended share sharing social footer header masthead"
    " comment comments comentarios kommentare commentaires disqus reply replies respond discussion login signup search form".split()
)
NEUTRAL = frozenset("list box block wrap wrapper container area section bar item items inner outer site top bottom left right thread reader readers user the js".split())
#: Elements whose names are of text in the article, not of parts of the page.
TEXT = frozenset("html body article main h1 h2 h3 h4 h5 h6 p li td th dt dd span a b i em strong blockquote pre figcaption".split())
#: What a name lowers the ratio to; the share of other lines' text that counts against an element, and for it inside an article.
PRIOR, COST, INSIDE = 0.02, 0.5, 0.05
_WORDS = re.compile(r"[a-z]+|[A-Z][a-z]*|[A-Z]+")
_SPACE = re.compile(r"\s+")
#: Elements that an opening tag closes when they are the innermost open one of the kind.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_P_CLOSERS = BLOCKS - {"html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "li", "dd", "dt", "summary", "figcaption"} | {"li", "dd", "dt"}


def is_furniture(tag: str, attributes: list[tuple[str, str | None]]) -> bool:
    """Whether an element is not of the article by its tag or role."""
    return tag in FURNITURE or any(name == "hidden" or name == "aria-hidden" and value == "true" or name == "role" and (value or "").lower() in ROLES for name, value in attributes)


def is_marked(tag: str, attributes: list[tuple[str, str | None]]) -> bool:
    """Whether a name of an element, all its words taken together, says that it is not of the article."""
    if tag not in TEXT:
        for name, value in attributes:
            if value and name in ("class", "id"):
                for one in value.split():
                    words = {w.lower() for w in _WORDS.findall(one)}
                    if words & MARKS and words <= MARKS | NEUTRAL:
                        return True
    return False


class Lines(HTMLParser):
    """Parser events to lines: text, tags, the open elements, and whether furniture holds it."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, int, bool, bool]] = []  # tag, number, furniture, silent
        self.path: tuple[int, ...] = ()
        self.tags: dict[int, str] = {}
        self.marked: set[int] = set()
        self.parts: list[str] = []
        self.seen = 0
        self.lines: list[tuple[str, int, tuple[int, ...], bool]] = []
        self.elements = 0

    def flush(self) -> None:
        if self.parts:
            text = _SPACE.sub(" ", "".join(self.parts)).strip()
            if text:
                self.lines.append((text, max(1, self.seen), self.path, bool(self.open) and self.open[-1][2]))
                self.seen = 0
            self.parts = []

    def _pop(self, k: int) -> None:
        if any(t in BLOCKS for t, *_ in self.open[k:]):
            self.flush()
        del self.open[k:]
        self.path = tuple(n for t, n, _, _ in self.open if t in BLOCKS or n in self.marked)

    def handle_starttag(self, tag, attrs):
        self.seen += 1
        if tag == "br":
            self.parts.append(" ")
        if tag in VOID:
            if tag == "hr":
                self.flush()
            return
        if tag in _P_CLOSERS:
            for k in range(len(self.open) - 1, -1, -1):
                if self.open[k][0] == "p":
                    self._pop(k)
                    break
                if self.open[k][0] in BLOCKS:
                    break
        if tag in CLOSES:
            for k in range(len(self.open) - 1, -1, -1):
                if self.open[k][0] in CLOSES[tag]:
                    self._pop(k)
                    break
                if self.open[k][0] in ("ul", "ol", "dl", "table", "div", "body", "select"):
                    break
        above = self.open[-1] if self.open else ("", 0, False, False)
        if tag in BLOCKS:
            self.flush()
        self.elements += 1
        self.tags[self.elements] = tag
        if is_marked(tag, attrs):
            self.marked.add(self.elements)
        self.open.append((tag, self.elements, above[2] or is_furniture(tag, attrs), above[3] or tag in SILENT))
        if tag in BLOCKS or self.elements in self.marked:
            self.path = (*self.path, self.elements)

    def handle_startendtag(self, tag, attrs):
        self.seen += 1
        if tag in ("br", "hr"):
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        self.seen += 1
        if tag == "p" and not any(t == "p" for t, *_ in self.open):
            self.flush()
            return
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                self._pop(k)
                return

    def handle_data(self, data):
        if not (self.open and self.open[-1][3]):
            self.parts.append(data)


def lines_of(html: str) -> Lines:
    reader = Lines()
    reader.feed(html)
    reader.close()
    reader.flush()
    return reader


def smoothed(ratios: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    """Convolved with a Gaussian of three sigmas to each side; beyond the ends the first and last values go on."""
    reach = int(np.ceil(3 * sigma))
    weights = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.convolve(np.pad(ratios, reach, mode="edge"), weights / weights.sum(), mode="valid")


def threshold(values: np.ndarray) -> float:
    """Two-means of the logarithms: the point halfway between the means; 0 where there is a single value."""
    logs = np.log1p(values)
    low, high = float(logs.min()), float(logs.max())
    if high - low < 1e-9:
        return 0.0
    for _ in range(20):
        middle = (low + high) / 2
        a, b = logs[logs <= middle], logs[logs > middle]
        new = (float(a.mean()) if len(a) else low, float(b.mean()) if len(b) else high)
        if new == (low, high):
            break
        low, high = new
    return float(np.expm1((low + high) / 2))


def main_text(html: str | None) -> str:
    """The page's main text, blocks joined by one space."""
    page = lines_of(html or "")
    lines, marked = page.lines, page.marked
    if all(line[3] for line in lines):
        return ""
    prior = np.array([0.0 if line[3] else PRIOR ** len(marked.intersection(line[2])) for line in lines])
    # lowered before, so that it lifts no neighbours, and after, so that these don't lift it
    ratios = smoothed(prior * [len(line[0]) / line[1] for line in lines]) * prior
    at = threshold(ratios)
    gain: dict[int, float] = {}
    full: set[int] = set()  # elements with a content line
    for (text, _, path, furniture), ratio in zip(lines, ratios):
        if not furniture:
            weight = 1.0 if ratio >= at else INSIDE if any(page.tags[k] in ("article", "main") for k in path) else -COST
            for k in path:
                gain[k] = gain.get(k, 0.0) + weight * len(text)
            if weight == 1.0:
                full.update(path)
    kept = [line for line in lines if not line[3] and all(k in full for k in marked.intersection(line[2]))]
    # a paragraph or a cell is no region; the whole page, which has number 0, is
    gain[0] = sum(gain.get(k, 0.0) for k in {line[2][0] for line in lines if not line[3] and line[2]}) + sum(len(line[0]) for line in lines if not line[3] and not line[2])
    region = max((k for k in gain if not k or page.tags[k] not in SINGLE), key=lambda k: (gain[k], k))
    above = next((line[2] for line in lines if region in line[2]), ())
    for outer in above[: above.index(region)][::-1] if region else ():
        more = [line[2][-1] for line in kept if outer in line[2] and region not in line[2]]
        if not all(page.tags[k] in HEADINGS and k < region for k in more):
            break
        region = outer if more else region
    return " ".join(line[0] for line in kept if not region or region in line[2])


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every page."""

    def walk(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(given):
            texts = [main_text(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(page_id).cast("bigint").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).alias("html"))
    return rows.mapInArrow(walk, "page_id bigint, url string, text string, n_chars bigint")
