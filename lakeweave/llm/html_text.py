"""Main text of web pages from a stream of parser events.

The standard library's HTML parser emits events; block elements cut the text
into lines.  A line's text-to-tag ratio is its characters per tag; on every
page the ratios are smoothed with a Gaussian, and lines at or above a threshold, the
smoothed ratios' standard deviation, form the content cluster.  A region (the lines
of one container or list) that holds clustered lines and is as dense itself is
content as a whole, so that its short paragraphs and headings stay.

Elements and classes are an aid.  Containers that are boilerplate by them never
become regions.  Within article and main elements the threshold is ``WITHIN`` at
most, the smoothed ratio alone decides of a region of one line, and regions
outside count only where none inside is content; of those, small ones before the
first or after the last large one go, as adverts and footers do.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


#: Elements whose content is never main text.
BOILERPLATE = frozenset("nav footer aside form script style noscript template svg math iframe object select button textarea menu dialog head title canvas audio video map datalist".split())
#: Containers that are tracked; all but these, and void elements, may stay unclosed.
CONTAINERS = BOILERPLATE | frozenset("html body header div section article main center fieldset figure table ul ol dl".split())
#: Containers of the main text.
SEMANTIC = frozenset(["article", "main"])
#: Containers that open no region of their own within article or main, and outside.
JOINED, LISTS = frozenset("html body header figure table".split()), frozenset("ul ol dl".split())
#: Elements that break a line.
BLOCKS = CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd tr td th thead tbody tfoot caption blockquote pre address hr figcaption details summary hgroup option".split())
#: Words of a class or id, or a role, that mark boilerplate.
MARKED = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|adv|advert|adverts|advertisement|sponsor|sponsored|promo|banner|sidebar|side|menu|nav|navbar|navigation|breadcrumb|breadcrumbs|toolbar|"
    r"header|masthead|footer|cookie|cookies|consent|notice|notices|alert|popup|modal|newsletter|subscribe|subscription|signup|login|form|search|"
    r"comment|comments|commentlist|disqus|discussion|replies|respond|share|sharing|social|related|recommended|widget|pager|pagination|legal|copyright|skip)(?:$|[\s_-])",
    re.I,
)
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
SIGMA = 1.5
#: Characters a tag from which lines within article or main are content: links of a list have four tags.
WITHIN = 8.0
#: Share of the largest region's characters from which a region outside article and main begins or ends the content.
CORE = 0.3


class Lines(HTMLParser):
    """Collects ``(region, text, tags)`` per line; region -1 is boilerplate, and
    ``semantic`` holds the regions within article or main."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[int, str, int]] = []
        self.semantic: set[int] = set()
        self.open: list[tuple[str, int]] = []  # containers with their regions
        self.region = self.regions = 0
        self.text: list[str] = []
        self.tags = 0

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            self.lines.append((self.region, text, self.tags))
            self.tags = 0
        self.text = []

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            self.flush()
        self.tags += 1
        if tag == "br":
            self.text.append(" ")
        if tag not in CONTAINERS:
            return
        if tag == "body" and self.open and self.open[-1][0] in ("head", "title"):
            self.open = []  # an unclosed head ends here
            self.region = 0
        outer = self.region
        if outer >= 0:
            if tag in BOILERPLATE or (tag == "header" and outer not in self.semantic) or self.marked(tag, attrs):
                self.region = -1
            elif tag not in JOINED if outer in self.semantic else tag not in LISTS:
                self.regions += 1
                self.region = self.regions
                if tag in SEMANTIC or outer in self.semantic:
                    self.semantic.add(self.region)
        self.open.append((tag, outer))

    @staticmethod
    def marked(tag, attrs) -> bool:
        if tag in ("html", "body", "main", "header"):
            return False
        return any(v and (k in ("class", "id") and MARKED.search(v) or k == "role" and v.lower() in ROLES or k == "hidden" or k == "aria-hidden" and v == "true") for k, v in attrs)

    def handle_startendtag(self, tag, attrs):
        if tag in ("script", "style"):  # a slash doesn't close these
            self.handle_starttag(tag, attrs)
            return
        if tag in BLOCKS:
            self.flush()
        self.tags += 1
        if tag == "br":
            self.text.append(" ")

    def handle_endtag(self, tag):
        if tag in BLOCKS:
            self.flush()
        self.tags += 1
        if tag in CONTAINERS:
            for i in range(len(self.open) - 1, -1, -1):
                if self.open[i][0] == tag:
                    self.region = self.open[i][1]
                    del self.open[i:]
                    break

    def handle_data(self, data):
        self.text.append(data)


def smooth(x: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing, with the weights within the page."""
    reach = int(3 * sigma + 0.5)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.convolve(x, kernel)[reach:-reach] / np.convolve(np.ones(len(x)), kernel)[reach:-reach]


def main_text(html: str | None, sigma: float = SIGMA) -> str:
    """The blocks of the content regions, in page order, joined by one space."""
    if not html:
        return ""
    parser = Lines()
    parser.feed(html)
    if parser.rawdata.startswith("<!--"):  # a comment without an end reaches to the page's
        parser.rawdata = ""
    parser.close()
    parser.flush()
    lines = parser.lines
    if not lines:
        return ""
    ratio = smooth(np.array([len(text) / max(1, tags) for _, text, tags in lines]), sigma)
    threshold = float(ratio.std())
    peak, chars, tags, count = Counter(), Counter(), Counter(), Counter()
    for (region, text, n), r in zip(lines, ratio.tolist(), strict=True):
        peak[region] = max(peak[region], r)
        chars[region] += len(text)
        tags[region] += n
        count[region] += 1

    def content(regions: set[int], least: float) -> tuple[set[int], set[int]]:
        dense = {r for r in regions if peak[r] >= least}
        return {r for r in dense if count[r] == 1 and r in parser.semantic or chars[r] >= least * max(1, tags[r])}, dense

    def between(regions: set[int], single: set[int]) -> set[int]:
        """Without what stands before the first or after the last region of size: an advert, a
        footer; with the ``single`` regions of one line that stand between."""
        least = CORE * max((chars[r] for r in regions), default=0)
        at = [i for i, (region, _, _) in enumerate(lines) if region in regions and chars[region] >= least]
        return {r for r, _, _ in lines[at[0] : at[-1] + 1] if r in regions or r in single and count[r] == 1} if at else regions

    inside = {r for r in count if r in parser.semantic}
    outside = {r for r in count if r >= 0} - inside
    (kept, some), (others, dense) = content(inside, min(threshold, WITHIN)), content(outside, threshold)
    kept = kept or between(others, dense) or some or between(dense, dense) or inside or outside
    return " ".join(text for region, text, _ in lines if region in kept)


def page_text(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``(key, url, text, n_chars)`` for each row of ``pages``.

    Null and empty html, and pages without main text, give the empty string; pages of
    any length are parsed whole, one at a time; keys and urls pass through, null or
    repeated; other columns are not read.  An empty table gives an empty one.  Lines of
    equal ratio are treated alike, so ties decide nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                some = batch.slice(at, 200)
                texts = [main_text(x) for x in some.column(2).to_pylist()]
                yield pa.record_batch([some.column(0), some.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["key", "url", "text", "n_chars"])

    source = pages.selectExpr(f"`{key}` as key", f"cast(`{url}` as string) as url", f"`{html}` as html")
    kind = source.schema["key"].dataType.simpleString()
    return source.mapInArrow(run, f"key {kind}, url string, text string, n_chars long").withColumnRenamed("key", key)
