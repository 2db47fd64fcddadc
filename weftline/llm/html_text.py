"""HTML extraction: parser events to lines, text-to-tag ratios, Gaussian smoothing and clustering to find the content region.

The standard library's streaming parser turns a page into lines, one for each block element's stretch of text, and notes for each line
its characters, its tags and the elements around it. The ratio of characters to tags is smoothed along the page with a Gaussian kernel
and split into two clusters; the upper one marks content. The region is the article (or main element) that holds most of the
content's text, if that is half of all content at least; else the deepest element that holds nearly all of the content. Inside the region the
ratios are smoothed and clustered again: runs of lines that are links and lie in the lower cluster, as lists of related pages do, are left out;
other lines are kept whole, but for those inside elements that are no text of the article by their kind, role or class. What follows has-, with-, without- or
no- in a class or id speaks of the layout and is not read. An element that holds the article, or more than half of its text (without an
article: of the page's text), is not left out for its class or for being a form, as whole pages stand in one on many sites: such a page is parsed again with these elements spared. So is a page on which
an element such as nav or aside is never closed: it then ends where the next article, main, section or div begins.

Defined results: a null or empty page, and one without any text, has the text '' and n_chars 0. Character references are decoded; white
space inside a block becomes one space. <br> and table cells count as white space. Rows that repeat a page_id are extracted each.
Extra columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import table

# Fixed values of HTML: element kinds.
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SPACES = frozenset("br td th option wbr img".split())
#: Elements whose text is no text of the article.
OUTSIDE = frozenset("head title nav footer aside script style noscript template iframe object svg canvas button select textarea menu dialog audio video map".split())
#: Elements that are kept open until their own end tag, for region search.
CONTAINERS = frozenset("html body article main section div table td header figure blockquote details center".split())
CLASS_OUT = re.compile(
    r"(?:^|[\s_-])(?:ads?|adv|adverts?|advertisement|advertising|adsense|banners?|sponsor\w*|promo\w*|cookies?|consent|gdpr|notices?|alerts?|pop-?ups?|modal|overlay|"
    r"newsletters?|subscri\w+|sign-?up|sidebars?|side-?bar|widgets?|related|recommend\w*|share|sharing|social|breadcrumbs?|menus?|nav|navbar|navigation|topbar|"
    r"footers?|masthead|comments?|comment-?list|disqus|respond|repl(?:y|ies)|login|search|toolbar|pagination|pager|skip-?link|hidden|copyright|disclaimer)(?:$|[\s_-])",
    re.I,
)
HEADER_OUT = re.compile(r"(?:^|[\s_-])headers?(?:$|[\s_-])", re.I)
#: Layout classes such as has-sidebar, post-no-comments or comments-open.
MODIFIED = re.compile(r"(?<![^\s_-])(?:(?:has|with|without|no)[_-]\S*|comments?[_-](?:open|closed)(?!\S))", re.I)
#: Comments of readers may be longer than the article; they are spared with nearly all of the text only.
READERS = re.compile(r"comment|disqus|respond|repl(?:y|ies)", re.I)
ROLES_OUT = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
#: Standard deviation of the smoothing kernel, in lines.
SIGMA = 1.5
#: A child element with this share of its parent's content text is searched further.
DEEPER = 0.8
#: Elements left out by their kind that may lack an end tag, and those that begin only behind them then.
UNCLOSED = frozenset("nav aside header footer form menu dialog".split())
BEHIND = frozenset("article main section div".split())
#: Share of all content that an article or main element holds at least.
HALF = 0.5
#: So many lines of links behind one another are a list of them.
LINK_RUN = 3
#: Outside any smaller region, a line next to content belongs to it from this length on.
LONG_LINE = 80

_KERNEL = np.exp(-0.5 * (np.arange(-4, 5) / SIGMA) ** 2)
_KERNEL /= _KERNEL.sum()


class _Lines(HTMLParser):
    """Lines of a page: (text, tags, link characters, tuple of container numbers around it, heading, paragraph)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.clear()

    def clear(self, spared: frozenset[int] = frozenset(), ended: frozenset[int] = frozenset()) -> None:
        self.reset()
        self.ended = ended  # numbers of start tags that end where the article may begin
        self.unclosed: set[int] = set()
        self.lines: list[tuple[str, int, int, tuple[int, ...], bool, bool]] = []
        self.kinds: list[str] = []  # by container number
        self.open: list[tuple[str, int, int, bool, int]] = []  # open block and outside elements: container's number or -1, _is_out, watched, start tag
        self.path: tuple[int, ...] = ()
        self.out = self.hard = 0  # open elements whose text is left out; those of them that are not left out for their class
        self.inside_article = 0
        self.parts: list[str] = []
        self.tags = self.links = self.in_link = 0
        self.heading = self.paragraph = False
        self.spared = spared  # numbers of start tags that are not left out for their class
        self.seen = 0
        # Elements left out for their class, and articles: start tags open now; by start tag its kind, those around it, and its characters outside links.
        self.watched: tuple[int, ...] = ()
        self.kind: dict[int, str] = {}
        self.around: dict[int, tuple[int, ...]] = {}
        self.chars: dict[int, int] = {}
        self.total = self.plain = 0  # characters outside links: all, and those not left out

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                self.lines.append((text, self.tags, self.links, self.path, self.heading, self.paragraph))
            self.parts = []
        self.tags = self.links = 0
        self.heading = self.paragraph = False

    def handle_starttag(self, tag, attrs):
        self.seen += 1
        if self.ended and tag in BEHIND:
            first = next((k for k, e in enumerate(self.open) if e[4] in self.ended), None)
            if first is not None:
                self.flush()
                self.close_from(first)
        if tag in SPACES:
            self.tags += 1
            if self.parts:
                self.parts.append(" ")
        elif tag in BLOCKS:
            self.flush()
            if self.open and (self.open[-1][0] == "p" or self.open[-1][0] == tag == "li"):  # end tags that were left out
                self.close_from(len(self.open) - 1)
            self.tags = 1
            self.paragraph = tag == "p"
            if tag[0] == "h" and len(tag) == 2 and tag != "hr":
                self.heading = True
        else:
            self.tags += 1
            if tag == "a":
                self.in_link += 1
        if tag in VOID:
            return
        out = self._is_out(tag, attrs)
        # Of p and li only those left out are kept open, and lists inside them.
        if out or tag in CONTAINERS or (tag in ("ul", "ol", "li") and any(e[0] == "li" for e in self.open)):
            number = -1
            if tag in CONTAINERS and not out:
                number = len(self.kinds)
                self.kinds.append(tag)
                self.path += (number,)
                self.inside_article += tag in ("article", "main")
            watched = out == 2 or (not out and tag in ("article", "main"))
            if watched:
                if not out:
                    self.kind[self.seen] = tag
                else:
                    self.kind[self.seen] = "readers" if any(n in ("class", "id") and v and READERS.search(v) for n, v in attrs) else "out"
                self.around[self.seen], self.chars[self.seen] = self.watched, 0
                self.watched += (self.seen,)
            self.open.append((tag, number, out, watched, self.seen))
            self.out += out > 0
            self.hard += out == 1

    def _is_out(self, tag, attrs) -> int:
        """1: left out; 2: left out for its class or id, or as a form, unless it holds the article."""
        if tag == "form":
            return 0 if self.seen in self.spared else 2
        if tag in OUTSIDE or (tag == "header" and not self.inside_article):
            return 1
        if not attrs or tag in ("html", "body"):
            return 0
        by_class = 0
        for name, value in attrs:
            if name == "hidden" or (name == "aria-hidden" and value == "true"):
                return 1
            if not value:
                continue
            if name == "role" and value in ROLES_OUT:
                return 1
            if name == "style" and HIDDEN.search(value):
                return 1
            if name in ("class", "id") and (tag not in ("article", "main") or "comment" in value.lower()):
                value = MODIFIED.sub("", value)
                if self.seen not in self.spared and (CLASS_OUT.search(value) or (not self.inside_article and HEADER_OUT.search(value))):
                    by_class = 2
        return by_class

    def close_from(self, k: int, own: str | None = None) -> None:
        """Close the open elements from the k-th on; of these only the first, if named `own`, by its own end tag."""
        for n, (name, number, out, watched, start) in enumerate(self.open[k:]):
            if (out == 1 or (out and name == "form")) and name in UNCLOSED and not (n == 0 and name == own):
                self.unclosed.add(start)
            if number >= 0:
                self.path = self.path[:-1]
                self.inside_article -= name in ("article", "main")
            if watched:
                self.watched = self.watched[:-1]
            self.out -= out > 0
            self.hard -= out == 1
        del self.open[k:]

    def to_spare(self) -> frozenset[int]:
        """The elements left out for their class that hold the article or most of its text."""
        outs = {n for n, kind in self.kind.items() if kind in ("out", "readers")}
        if not outs:
            return frozenset()
        # An article inside such an element is a teaser or a comment, unless it has more text than all that is not left out.
        inside = {n: [self.kind[k] for k in self.around[n] if k in outs] for n in self.kind}
        articles = [n for n, kind in self.kind.items() if n not in outs and self.chars[n] and (kind == "main" or not inside[n] or ("readers" not in inside[n] and self.chars[n] > self.plain))]
        best = max(articles, key=lambda n: (self.chars[n], -n), default=0)
        whole = self.chars[best] if best else self.total
        most = {n for n in outs if (not best or best in self.around[n]) and self.chars[n] > (DEEPER if self.kind[n] == "readers" else 0.5) * whole}
        return frozenset(most | (outs & set(self.around[best]) if best else set()))

    def handle_endtag(self, tag):
        self.tags += 1
        if tag in BLOCKS:
            self.flush()
        elif tag in SPACES:
            if self.parts:
                self.parts.append(" ")
        elif tag == "a" and self.in_link:
            self.in_link -= 1
        if self.open and ((self.open[-1][0] == "p" != tag and tag in BLOCKS) or (self.open[-1][0] == "li" and tag in ("ul", "ol"))):
            self.close_from(len(self.open) - 1)
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                self.close_from(k, tag)
                break

    def handle_data(self, data):
        if self.hard:
            return
        if not self.in_link:
            size = len(data.strip())
            self.total += size
            for n in self.watched:
                self.chars[n] += size
            if not self.out:
                self.plain += size
        if not self.out:
            self.parts.append(data)
            if self.in_link:
                self.links += len(data)


def smoothed_ratios(lines: list) -> np.ndarray:
    """Characters for each tag by line, smoothed along the page."""
    ratio = np.array([(len(text) - links) / max(tags, 1) for text, tags, links, *_ in lines], float)
    padded = np.pad(ratio, len(_KERNEL) // 2, mode="edge")
    return np.convolve(padded, _KERNEL, mode="valid")


def upper_cluster(values: np.ndarray) -> np.ndarray:
    """Two clusters of values by Lloyd's steps from the extremes; which values are in the upper one. Equal values are all upper."""
    low, high = values.min(), values.max()
    if high - low <= 0.5 * high:
        return np.ones(len(values), bool)
    for _ in range(20):
        border = (low + high) / 2
        up = values > border
        new = values[~up].mean(), values[up].mean()
        if new == (low, high):
            break
        low, high = new
    return values > (low + high) / 2


def content_lines(lines: list) -> np.ndarray:
    """Which lines are content: the upper cluster of smoothed ratios, without lines that are mostly links."""
    return upper_cluster(smoothed_ratios(lines)) & np.array([2 * links <= len(text) for text, _, links, *_ in lines])


def without_link_lists(lines: list) -> list:
    """The lines but those of the lower cluster that are mostly links and stand in a run of such lines. Headings stay."""
    lower = ~upper_cluster(smoothed_ratios(lines)) if lines else np.zeros(0, bool)
    linked = [bool(low) and 2 * links > len(text) and not heading for low, (text, _, links, _, heading, _) in zip(lower, lines, strict=True)]
    kept, run = [], []
    for line, drop in zip([*lines, None], [*linked, False], strict=True):
        if drop:
            run.append(line)
            continue
        if len(run) < LINK_RUN:
            kept += run
        run = []
        if line is not None:
            kept.append(line)
    return kept


def main_text(parser: _Lines, html: str) -> str:
    spared: frozenset[int] = frozenset()
    ended: frozenset[int] = frozenset()
    for _ in range(3):
        parser.clear(spared, ended)
        parser.feed(html)
        parser.close()
        parser.flush()
        parser.close_from(0)
        if not ended and parser.unclosed:
            ended = frozenset(parser.unclosed)
        elif not spared and (now := parser.to_spare()):
            spared = now
        else:
            break
    lines = parser.lines
    if not lines:
        return ""
    content = content_lines(lines)
    weight: dict[int, int] = {}
    everything: dict[int, int] = {}
    for (text, _, links, path, *_), good in zip(lines, content, strict=True):
        for number in path:
            everything[number] = everything.get(number, 0) + len(text) - links
            if good:
                weight[number] = weight.get(number, 0) + len(text)
    total = sum(len(lines[k][0]) for k in np.flatnonzero(content))
    for kind in ("article", "main"):
        regions = [n for n in everything if parser.kinds[n] == kind]
        if regions:
            best = max(regions, key=lambda n: (weight.get(n, 0), everything[n], -n))
            if weight.get(best, 0) >= HALF * total:
                return "\n".join(line[0] for line in without_link_lists([line for line in lines if best in line[3]]))
    if not content.any():
        return ""
    region: tuple[int, ...] = ()
    while True:
        below: dict[int, int] = {}
        for k in np.flatnonzero(content):
            path = lines[k][3]
            if path[: len(region)] == region and len(path) > len(region):
                below[path[len(region)]] = below.get(path[len(region)], 0) + len(lines[k][0])
        best = max(below, key=below.get, default=-1)
        if best < 0 or below[best] < DEEPER * total:
            break
        region += (best,)
    inside = [k for k in range(len(lines)) if lines[k][3][: len(region)] == region and (content[k] or 2 * lines[k][2] <= len(lines[k][0]))]
    if not region or parser.kinds[region[-1]] in ("html", "body"):
        # The page as a whole: from the first to the last line of content, and headings, closing paragraphs or long lines next to them.
        marks = [n for n, k in enumerate(inside) if content[k]]
        first, last = marks[0], marks[-1]
        while first and (lines[inside[first - 1]][4] or len(lines[inside[first - 1]][0]) >= LONG_LINE):
            first -= 1
        while last + 1 < len(inside):
            after, before = lines[inside[last + 1]], lines[inside[last]]
            if len(after[0]) < LONG_LINE and not (after[5] and after[3] == before[3]):
                break
            last += 1
        inside = inside[first : last + 1]
    return "\n".join(line[0] for line in without_link_lists([lines[k] for k in inside]))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parser = _Lines()
    for batch in batches:
        for start in range(0, batch.num_rows, 500):
            part = batch.slice(start, 500)
            texts = [main_text(parser, html) if html else "" for html in part.column("html").to_pylist()]
            yield pa.record_batch([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, *, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of each row of pages."""
    return pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).alias("html")).mapInArrow(_extract, "page_id long, url string, text string, n_chars long")


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


QUERIES = {"op6_html_text": op6_html_text}
SQL: dict[str, str] = {}
