"""Main text of HTML pages: text-to-tag ratios of lines, smoothed and clustered, over streamed parser events.

The standard library's streaming parser gives events; they are folded into lines, one for each block of text, with the
line's text length, the tags read since the line before, and the container that it stands in. Markup is a veto only: lines
within menus, page headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments go, by element
name, role, or a class or id all of whose parts name such a thing or are neutral (``cookie-notice`` and ``comment-list`` go,
``social-science`` stays). A header within an article or main element is the article's own and stays.

What is left is chosen by clusters. The text-to-tag ratios of the lines are smoothed with a Gaussian kernel and parted by a
threshold into content and rest. The region is the outermost article or main element that holds half of the clustered text,
else the innermost container that holds nine tenths of it. Of an article all lines come out, short ones too. Of any other
region its parts count: those from the first to the last one whose text is content by half at least come out whole, of the
others only paragraphs and headings of its own, not lists, tables and boxes (unnamed menus and link lists). Without a
content line the text is empty.

White space inside a line becomes one space; lines are joined by an empty line. Null, empty and text-free pages give an
empty text, an empty table an empty one; rows that repeat, ties included, are answered as often as they come. Unclosed and
misnested elements are tolerated: an end tag closes up to its nearest open start, or nothing. A head ends at the first
thing that can't stand in it, an option at the next one, at a block or at its parent's end. Where a button or another
skipped element is never closed, the page is read again, and such elements end at the next block. Long pages and deep nests
take time and memory in proportion. The output has key, kept columns, text and n_chars; a kept column of such a name is an error.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.llm._common import sliced, small_batches, table

BLOCKS = frozenset("address article aside blockquote body center caption dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
SKIPPED = frozenset("script style noscript template head title iframe object svg math canvas select option button textarea".split())
BOILERPLATE = frozenset("nav footer aside form menu dialog".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What a head may hold; the start of anything else ends it.
IN_HEAD = frozenset("html head base basefont bgsound link meta title noscript noframes style script template".split())
#: Containers that may be the region.
REGIONS = frozenset("section div body td html".split())
OPTION_PARENTS = frozenset("datalist select optgroup".split())
PARAGRAPH_ENDS = BLOCKS - {"html", "body"}
#: Skipped elements whose end tag may be missing by mistake; scripts, styles and the like swallow the rest as in browsers.
REOPENED = frozenset("button select option object canvas noscript svg math template".split())
#: Parts of class and id names that veto an element, and parts that may stand beside them.
MARKS = re.compile("ad|ads|advert|adverts|advertisement|advertising|sponsor|sponsored|promo|promotion|banner|cookie|cookies|consent|notice|notices|popup|modal|newsletter|subscribe|nav|navbar|navigation|menu|menus|breadcrumb|breadcrumbs|sidebar|footer|header|masthead|comment|comments|respond|replies|disqus|share|sharing|social|related|widget|widgets")
NEUTRAL = re.compile("[0-9]*|bar|block|bottom|box|container|global|group|inner|item|items|left|links|list|main|outer|page|panel|post|reader|right|section|side|site|slot|thread|top|unit|user|wrap|wrapper")
#: Blocks of a region that are text, not boxes of lines.
PARAGRAPHS = frozenset("address blockquote caption center dd dt figcaption h1 h2 h3 h4 h5 h6 p pre summary".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu".split())
PLAIN_START = re.compile(r"<([a-z][a-z0-9]*)>")
PLAIN_END = re.compile(r"</([a-z][a-z0-9]*)>")


def is_marked(names: str) -> bool:
    """Whether one of the names, as a whole, says that an element isn't part of the article."""
    for name in names.lower().split():
        parts = re.split("[-_]+", name)
        if any(MARKS.fullmatch(x) for x in parts) and all(MARKS.fullmatch(x) or NEUTRAL.fullmatch(x) for x in parts):
            return True
    return False


class Lines(HTMLParser):
    """Folds parser events into lines: text, tags before it, container, vetoed. Containers have a kind and a parent with a lower number; -1 is the page."""

    def __init__(self, reopened: frozenset[str] = frozenset()) -> None:
        super().__init__(convert_charrefs=True)
        self.reopened = reopened
        self.lines: list[tuple[str, int, int, bool]] = []
        self.open: list[tuple[str, bool, int, bool]] = []  # name, vetoed from here on, container, in an article
        self.number_open: Counter[str] = Counter()
        self.kinds: list[str] = []
        self.parents: list[int] = []
        self.parts: list[str] = []
        self.tags = 0
        self.skip: list[str] = []  # the open elements of a skipped one, which is the first
        self.holds_blocks = False  # the skipped element
        self.unclosed: set[str] = set()  # skipped elements with blocks whose end tag was missing

    def updatepos(self, i: int, j: int) -> int:
        """Line numbers aren't used."""
        return j

    def parse_starttag(self, i: int) -> int:
        """Start tags without attributes, the most of them, need no attribute scan."""
        plain = PLAIN_START.match(self.rawdata, i)
        if plain is None or plain[1] in SKIPPED:
            return super().parse_starttag(i)
        self.handle_starttag(plain[1], [])
        return plain.end()

    def parse_endtag(self, i: int) -> int:
        plain = PLAIN_END.match(self.rawdata, i) if self.cdata_elem is None else None
        if plain is None:
            return super().parse_endtag(i)
        self.handle_endtag(plain[1])
        return plain.end()

    def flush(self) -> None:
        if not self.parts:
            return
        text = " ".join("".join(self.parts).split())
        self.parts.clear()
        if text:
            _, bad, container, _ = self.open[-1] if self.open else ("", False, -1, False)
            self.lines.append((text, self.tags, container, bad))
            self.tags = 0

    def close_down_to(self, k: int) -> None:
        for name, *_ in self.open[k:]:
            self.number_open[name] -= 1
        del self.open[k:]

    def ends_skip(self, tag: str) -> bool:
        """Whether a start tag ends the skipped element, whose end tag may be left out; then nothing is skipped any more."""
        first = self.skip[0]
        if first == "head":
            ended = tag == "body" or len(self.skip) == 1 and tag not in IN_HEAD
        elif first == "option":
            ended = tag in ("option", "optgroup") or tag in BLOCKS
        else:
            ended = first in self.reopened and tag in BLOCKS
        if ended:
            self.skip.clear()
        return ended

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.skip and not self.ends_skip(tag):
            if tag not in VOID:
                self.skip.append(tag)
            self.holds_blocks |= tag in BLOCKS
            return
        if tag in SKIPPED:
            self.tags += 1
            self.holds_blocks = False
            self.skip.append(tag)
            if tag in ("head", "title"):
                self.flush()
            return
        if tag not in BLOCKS:
            self.tags += 1
            if tag == "br":
                self.parts.append(" ")
            return
        self.flush()
        self.tags += 1
        if tag in PARAGRAPH_ENDS:  # a block ends an open paragraph
            while self.open and self.open[-1][0] == "p":
                self.close_down_to(len(self.open) - 1)
        if tag in VOID:
            return
        _, inside, parent, in_article = self.open[-1] if self.open else ("", False, -1, False)
        named = {k: v or "" for k, v in attrs if k in ("class", "id", "role")}
        bad = inside or tag in BOILERPLATE or tag == "header" and not in_article or named.get("role", "").lower() in ROLES
        if not bad and tag not in ("html", "body", "article", "main"):
            bad = any(is_marked(named[k]) for k in ("class", "id") if k in named)
        self.kinds.append(tag)
        self.parents.append(parent)
        self.number_open[tag] += 1
        self.open.append((tag, bad, len(self.kinds) - 1, in_article or tag in ("article", "main")))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.skip or tag in SKIPPED:
            return
        self.handle_starttag(tag, attrs)
        if tag in BLOCKS and tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if self.skip:
            for k in range(len(self.skip) - 1, -1, -1):
                if self.skip[k] == tag:
                    del self.skip[k:]
                    return
            # the end of an element around the skipped one ends that too
            around = tag in BLOCKS and (tag != "p" or self.skip[0] == "option") and self.number_open[tag] > 0
            if not around and not (self.skip[0] == "option" and tag in OPTION_PARENTS):
                return
            self.end_unclosed()
        if tag in BLOCKS and self.number_open[tag] > 0:
            self.flush()
            k = len(self.open) - 1
            while self.open[k][0] != tag:
                k -= 1
            self.close_down_to(k)

    def end_unclosed(self) -> None:
        if self.skip and self.holds_blocks:
            self.unclosed.add(self.skip[0])
        self.skip.clear()

    def handle_data(self, data: str) -> None:
        if self.skip == ["head"] and data.strip():  # text can't stand in a head
            self.skip.clear()
        if not self.skip:
            self.parts.append(data)


def read_lines(html: str) -> Lines:
    """The page's lines. Elements that swallowed blocks for want of an end tag are read again as ended by them, each name once."""
    reopened: frozenset[str] = frozenset()
    while True:
        parser = Lines(reopened)
        parser.feed(html)
        parser.close()
        parser.flush()
        parser.end_unclosed()
        more = parser.unclosed & REOPENED - reopened
        if not more:
            return parser
        reopened |= more


def content_cluster(length: np.ndarray, tags: np.ndarray, sigma: float) -> np.ndarray:
    """True for the lines whose smoothed text-to-tag ratio passes the threshold: one standard deviation, at most the mean."""
    ratio = length / np.maximum(1, tags)
    reach = max(1, int(np.ceil(3 * sigma)))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    n = len(ratio)
    smooth = np.convolve(ratio, kernel)[reach : reach + n] / np.convolve(np.ones(n), kernel)[reach : reach + n]
    return smooth >= min(smooth.std(), smooth.mean())


def region_of(held: list[int], kinds: list[str]) -> int:
    """The container of the content; held: content of each container, the page's last."""
    total = held[-1]
    for i, kind in enumerate(kinds):
        if kind in ("article", "main") and 2 * held[i] >= total:
            return i
    return max((i for i, kind in enumerate(kinds) if kind in REGIONS and 10 * held[i] >= 9 * total), default=-1)


def main_text(html: str | None, sigma: float = 1.0) -> str:
    if not html:
        return ""
    page = read_lines(html)
    lines = [(text, tags, container) for text, tags, container, bad in page.lines if not bad]
    if not lines:
        return ""
    kinds, parents = page.kinds, page.parents
    length = np.array([len(text) for text, *_ in lines])
    content = content_cluster(length, np.array([tags for _, tags, _ in lines]), sigma).tolist()
    held = [0] * (len(kinds) + 1)  # the last one is the page's, as parent -1
    for (text, _, container), is_content in zip(lines, content):
        if is_content:
            held[container] += len(text)
    for i in range(len(kinds) - 1, -1, -1):
        held[parents[i]] += held[i]
    if not held[-1]:
        return ""
    region = region_of(held, kinds)
    # the part of each container: the region's own child that it stands in; None outside, the region itself is its own
    part: list[int | None] = [None] * (len(kinds) + 1)
    part[region] = region
    for i, parent in enumerate(parents):
        if i != region and part[parent] is not None:
            part[i] = i if part[parent] == region else part[parent]
    mine = [(k, text, part[container]) for k, (text, _, container) in enumerate(lines) if part[container] is not None]
    if region >= 0 and kinds[region] in ("article", "main"):
        return "\n\n".join(text for _, text, _ in mine)
    # lines of the region's own are parts by themselves
    parts = [("line", k) if p == region else ("part", p) for k, _, p in mine]
    share: Counter[tuple[str, int]] = Counter()
    for (k, text, _), p in zip(mine, parts):
        share[p] += len(text) if content[k] else -len(text)
    strong = [i for i, p in enumerate(parts) if share[p] >= 0]
    first, last = (strong[0], strong[-1]) if strong else (0, -1)
    return "\n\n".join(text for i, ((_, text, p), whole) in enumerate(zip(mine, parts)) if first <= i <= last or whole[0] == "line" or kinds[p] in PARAGRAPHS)


def extract_main_text(pages: DataFrame, key: str = "page_id", html: str = "html", keep: tuple[str, ...] = ("url",), sigma: float = 1.0) -> DataFrame:
    """key, the kept columns, text and n_chars (code points) for every row of pages."""
    if {"text", "n_chars", "__html", key} & set(keep):
        raise ValueError(f"a kept column can't be called like the key, text, n_chars or __html: {keep}")
    rows = pages.select(F.col(key), *(F.col(c) for c in keep), F.col(html).alias("__html"))
    schema = rows.drop("__html").withColumns({"text": F.lit(""), "n_chars": F.lit(0).cast("long")}).schema
    for field in schema.fields:
        field.nullable = True

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "__html"):
            texts = [main_text(h, sigma) for h in batch.column(batch.num_columns - 1).to_pylist()]
            arrays = [*batch.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return rows.mapInArrow(extract, schema)


def op7_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return extract_main_text(table(spark, sf_dir, "pages"))
