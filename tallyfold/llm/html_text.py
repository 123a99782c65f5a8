"""Main text of web pages from streaming parser events.

The standard library's parser turns a page into lines, one per block, each with
its text and the tags met since the last one.  The logarithm of the text-to-tag ratio
of the lines, smoothed by a Gaussian, is split into two clusters by a threshold; lines
of the high cluster are content.  The region runs from the first to the last of them
in the innermost element that holds nearly all their text.  Markup only corrects it:
headings and paragraphs next to the region in that element belong to it, and so does
the rest of an element that the page marks as its article; what the markup names as
navigation, form, notice, advert or comments is no line at all, unless hardly any
text is left without it.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Collection, Iterator
from dataclasses import dataclass, field
from html import unescape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import batched

#: Elements without text for readers; parts beside the text; elements that begin and end a line; elements without an end tag.
SILENT = frozenset("script style noscript template head title svg math iframe object canvas select option button textarea".split())
BESIDE_TAGS = frozenset("nav aside footer menu dialog".split())
BLOCKS = frozenset("address article aside blockquote body dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main nav ol p pre section summary table tbody td tfoot th thead tr ul br".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words that name a part beside the text, alone or in a hyphenated name; the other words that such a name may have.
BESIDE = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promos banner cookie cookies consent notice notices gdpr popup modal newsletter subscribe sidebar side nav navbar navigation menu menus breadcrumb breadcrumbs footer header masthead comment comments disqus replies respond related recommended recommendations share sharing social toolbar widget widgets pagination login signup copyright legal skip".split())
NEUTRAL = frozenset("a area article articles bar block body bottom box buttons col column container content desktop entry fixed global group holder home icons inner item items layout left link links list main message mobile outer overlay page panel policy post posts primary right row secondary section site slot small sticky the to top unit wrap wrapper".split())
#: Further words that make a container's class doubtful; words before which such a class only tells what the page has.
DOUBTFUL = frozenset("adsbygoogle bio discussion discussions thread threads".split())
TELLING = frozenset("has with no without not non is js hide show".split())
#: Elements whose class may make them doubtful; parts beside the text that are told apart inside each other.
CONTAINERS = frozenset("div section aside ul ol ins figure table".split())
DEEPEST = 32
#: Of these words, those that say nothing inside an article.
PLAIN_INSIDE = frozenset("header widget widgets".split())
#: Elements that close an open paragraph; which open elements an item of a list or table closes, and what encloses them; what a head may hold.
CLOSES_P = BLOCKS - {"body", "html", "br"}
ENDS = {t: (frozenset(closed.split()), frozenset(walls.split())) for tags, closed, walls in (("li", "li", "ul ol menu"), ("td th", "td th", "tr table"), ("tr", "tr td th", "table thead tbody tfoot"), ("thead tbody tfoot", "thead tbody tfoot tr td th", "table"), ("dt dd", "dt dd", "dl"), ("option", "option", "select optgroup datalist"), ("optgroup", "optgroup option", "select")) for t in tags.split()}
IN_HEAD = frozenset("base link meta noscript script style template title head html".split())
#: Elements that may be the one around the text; blocks that belong to the text next to them.
HOLDERS = frozenset("html body article main section div form td table details center".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre figcaption li dt dd".split())
#: A part beside the text is judged like other text if what is outside such parts is less than this share of it.
LITTLE = 0.25
#: Shares of the content lines' text and number that the element around the text holds; share of links from which a block is no prose.
NEARLY_ALL, MOST_LINES, LINKED = 0.9, 0.75, 0.5


def beside(names: str, inside: bool) -> bool:
    """Whether a class, id or role names a part beside the text; ``inside`` an article some words say nothing."""
    for name in names.split():
        words = [w for w in re.split(r"[^a-z]+", name) if w]
        words = [w for w in words if w not in PLAIN_INSIDE] if inside else words
        if any(w in BESIDE for w in words) and all(w in BESIDE or w in NEUTRAL for w in words):
            return True
    return False


def doubtful(names: str) -> bool:
    """Whether a container's class holds a word of a part beside the text among others. Ids are not asked: they often are words of a heading."""
    for name in names.split():
        words = [w for w in re.split(r"[^a-z]+", name) if w]
        if words and words[0] not in TELLING and any(w in BESIDE or w in DOUBTFUL for w in words if w not in PLAIN_INSIDE):
            return True
    return False


@dataclass
class Line:
    """A block's text with the named parts around it, tags since the last text, and where it stands."""

    parts: list[tuple[tuple[int, ...], str]] = field(default_factory=list)
    tags: int = 0
    holder: int = 0
    block: str = ""
    article: bool = False
    linked: int = 0


class _Lines(HTMLParser):
    """Collects the lines of a page, its holders (each one's parent) and the text in each named part."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[Line] = []
        self.line = Line()
        # Each open element: tag, whether it is hidden, in an article, named, a holder; and where each tag stands.
        self.open: list[tuple[str, bool, bool, bool, bool]] = []
        self.places: dict[str, list[int]] = defaultdict(list)
        self.hidden = 0
        self.article = 0
        self.links = 0
        self.named: tuple[int, ...] = ()
        self.held: list[int] = []
        self.lost: set[int] = set()
        self.parent = [-1]
        self.marked = [False]
        self.holders = [0]
        self.bare = 0
        # Length of the rest of the page in which no comment has an end; None while not known.
        self.endless: int | None = None

    def end_line(self) -> None:
        if self.line.parts:
            self.found.append(self.line)
            self.line = Line()

    def lines(self) -> list[tuple[str, Line]]:
        """The lines with text outside named parts, but for those parts without which hardly any is left."""
        shown = {k for k, n in enumerate(self.held) if k in self.lost and self.bare < LITTLE * n}
        out, before = [], 0
        for line in self.found:
            before += line.tags
            if text := " ".join("".join(x for named, x in line.parts if shown.issuperset(named)).split()):
                line.tags, before = before, 0
                out.append((text, line))
        return out

    def push(self, tag: str, hidden: bool = False, article: bool = False, named: bool = False) -> None:
        holder = tag in HOLDERS
        named = named and len(self.named) < DEEPEST
        self.places[tag].append(len(self.open))
        self.open.append((tag, hidden, article, named, holder))
        self.hidden += hidden
        self.article += article
        self.links += tag == "a"
        if named:
            self.named += (len(self.held),)
            self.held.append(0)
        if holder:
            self.parent.append(self.holders[-1])
            self.marked.append(article)
            self.holders.append(len(self.parent) - 1)

    def pop(self, ended: bool = False) -> None:
        tag, hidden, article, named, holder = self.open.pop()
        self.places[tag].pop()
        self.hidden -= hidden
        self.article -= article
        self.links -= tag == "a"
        if named:
            # A part beside the text that nothing ends may hold the text by mistake, and so may a form or a part that only its class names.
            if not (ended and tag in BESIDE_TAGS):
                self.lost.add(self.named[-1])
            self.named = self.named[:-1]
        if holder:
            self.holders.pop()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS:
            self.end_line()
        self.line.tags += 1
        if tag == "body" or (self.open and self.open[-1][0] == "head" and tag not in IN_HEAD):
            self.close_to(("head",), frozenset())
        if tag in VOID:
            return
        if tag in CLOSES_P:
            self.close_to(("p",), CLOSES_P - {"p"})
        if tag in ENDS:
            self.close_to(*ENDS[tag])
        names = " ".join([v for k, v in attrs if v and k in ("class", "id", "role")]).lower() if attrs else ""
        shut = bool(attrs) and any(k == "hidden" or (k == "aria-hidden" and v == "true") or (k == "style" and v and re.search(r"display\s*:\s*none", v)) for k, v in attrs)
        unsure = tag in CONTAINERS and bool(attrs) and any(v and k == "class" and doubtful(v.lower()) for k, v in attrs)
        aside = unsure or tag in BESIDE_TAGS or tag == "form" or (tag == "header" and not self.article) or (bool(names) and tag not in ("html", "body", "main") and beside(names, self.article > 0))
        article = tag in ("article", "main") and not self.hidden and not (tag == "article" and aside)
        hidden = tag in SILENT or shut
        self.push(tag, hidden, article, aside and not hidden and not self.hidden)

    def close_to(self, tags: Collection[str], walls: frozenset[str]) -> None:
        """Closes the outermost open one of ``tags`` that no wall encloses."""
        held = [self.places[t] for t in tags if self.places[t]]
        if held:
            wall = max((self.places[w][-1] for w in walls if w not in tags and self.places[w]), default=-1)
            least = min((at[k] for at in held if (k := bisect_right(at, wall)) < len(at)), default=len(self.open))
            while len(self.open) > least:
                self.pop()

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self.end_line()
        self.line.tags += 1
        if self.places[tag]:
            while self.open[-1][0] != tag:
                self.pop()
            self.pop(ended=True)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.open and self.open[-1][0] == tag:
            self.handle_endtag(tag)

    def handle_data(self, data: str) -> None:
        n = len(data.strip())
        if self.open and self.open[-1][0] == "head" and n:
            self.pop()
        if not self.hidden:
            line = self.line
            if n and not any(x.strip() for _, x in line.parts):
                line.holder, line.article = self.holders[-1], self.article > 0
                line.block = next((t for t, *_ in reversed(self.open[-20:]) if t in BLOCKS), "")
            line.parts.append((self.named, data))
            line.linked += n if self.links else 0
            self.bare += 0 if self.named else n
            for k in self.named:
                self.held[k] += n

    def parse_html_declaration(self, i: int) -> int:
        # Marked sections, whatever they say, are comments up to the next ">", as in browsers.
        return self.parse_bogus_comment(i) if self.rawdata.startswith("<![", i) else super().parse_html_declaration(i)

    def parse_comment(self, i: int, report: int = 1) -> int:
        # Where one comment had no end, none after it has: it is not searched for again.
        left = len(self.rawdata) - i
        if self.endless is not None and left <= self.endless:
            return -1
        k = super().parse_comment(i, report)
        self.endless = left if k < 0 else None
        return k

    def read(self, page: str) -> None:
        """Parses a whole page. What follows its last tag is text, so that no start without an end is looked for again and again."""
        last = page.rfind(">") + 1
        self.feed(page[:last])
        self.close()
        if last < len(page) and not self.cdata_elem:
            self.handle_data(unescape(page[last:]))
        self.end_line()
        while self.open:
            self.pop()


def smoothed(ratios: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    """A Gaussian average over neighbouring lines; at the ends over those there are."""
    reach = np.arange(-3, 4)
    kernel = np.exp(-(reach**2) / (2 * sigma**2))
    weights = np.convolve(np.ones(len(ratios)), kernel, "full")[3:-3]
    return np.convolve(ratios, kernel, "full")[3:-3] / weights


def content(ratios: np.ndarray) -> np.ndarray:
    """Which lines are in the high cluster: the threshold is moved to the middle of the two clusters' means until it stays."""
    level = smoothed(ratios)
    # Never above the greatest level, which the mean of equal ones may be by rounding.
    threshold = min(level.mean(), level.max())
    for _ in range(100):
        high, low = level[level >= threshold], level[level < threshold]
        if not len(low) or not len(high):
            break
        middle = (high.mean() + low.mean()) / 2
        if abs(middle - threshold) < 1e-9:
            break
        threshold = middle
    return level >= threshold


def region(lines: list[tuple[str, Line]], parent: list[int], marked: list[bool]) -> list[int]:
    """Which lines are the main text: those from the first to the last content line in their element, with what the markup adds."""
    high = np.flatnonzero(content(np.log1p([len(text) / max(line.tags, 1) for text, line in lines]))).tolist()
    weight, many = np.zeros(len(parent)), np.zeros(len(parent))
    for k in high:
        weight[lines[k][1].holder] += len(lines[k][0])
        many[lines[k][1].holder] += 1
    # Holders are numbered as they open, so a parent has a smaller number than its children.
    for h in range(len(parent) - 1, 0, -1):
        weight[parent[h]] += weight[h]
        many[parent[h]] += many[h]
    around = int(np.flatnonzero((weight >= NEARLY_ALL * weight[0]) & (many >= MOST_LINES * many[0]))[-1])
    article = around
    while article and not marked[article]:
        article = parent[article]
    around = article or around
    inside = [h == around for h in range(len(parent))]
    for h in range(around + 1, len(parent)):
        inside[h] = inside[parent[h]]
    high = [k for k in high if inside[lines[k][1].holder]]

    def belongs(k: int) -> bool:
        text, line = lines[k]
        return inside[line.holder] and (line.article or (line.block in PROSE and line.linked < LINKED * len(text)))

    def title(k: int) -> bool:
        return lines[k][1].block in ("h1", "h2") and lines[k][1].linked < LINKED * len(lines[k][0])

    first, last = high[0], high[-1]
    while first and (belongs(first - 1) or title(first - 1)):
        first -= 1
    while last + 1 < len(lines) and belongs(last + 1):
        last += 1
    return list(range(first, last + 1))


def main_text(html: str | None) -> str:
    """Main text of one page, a line per block; empty if there is none."""
    parser = _Lines()
    parser.read(html or "")
    lines = parser.lines()
    return "\n".join(lines[k][0] for k in region(lines, parser.parent, parser.marked)) if lines else ""


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of each row of ``pages`` (page_id, url, html; other columns are ignored).

    A null or empty page has an empty text.  Repeated rows are each returned; very
    long pages are read whole, in time that grows with their length.
    """
    batched(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kinds = dict(pages.dtypes)
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
