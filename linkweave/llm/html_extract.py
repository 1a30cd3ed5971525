"""Main text of web pages: parser events, text-to-tag ratio per line, Gaussian smoothing, threshold clusters.

The standard library's parser streams a page's events; each block of text is a line with its number of tags. Smoothed ratios of
text to tags above one standard deviation mark the lines that hold content. They choose the region: the articles that hold them,
or else the smallest container of most of their text; its short lines belong to it. Elements that HTML itself marks as something
else (tags, roles, hidden) do not; class and id names are only a signal, which the marked text inside an element can outweigh.
Elements are numbered and know their parent, so a page of any depth takes time in proportion to its length.
"""

from __future__ import annotations

from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

SIGMA = 1.0
RADIUS = 2
REGION_SHARE = 0.8  # of the marked text that a container must hold
NAMED_SHARE = 0.9  # of the marked text, in two lines at least, that an element named as something else must hold to be content

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby rb rp rt s samp small span strike "
    "strong sub sup time tt u var wbr".split()
)
OTHER_TAGS = frozenset(
    "script style noscript template nav footer aside form head select button textarea iframe object svg canvas dialog menu "
    "audio video map fieldset".split()
)
OTHER_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
OTHER_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar menu nav navbar navigation "
    "breadcrumb breadcrumbs footer masthead comment comments cookie cookies consent gdpr notice notices newsletter subscribe signup "
    "social share sharing related popup modal widget toolbar pagination pager disqus reply replies respond skip".split()
)
COMMENT_NAMES = frozenset("comment comments reply replies respond disqus".split())
STATE_NAMES = frozenset("no has with without open opened closed enable enabled disable disabled allow allowed on off".split())
REGION_TAGS = frozenset(("article", "main"))
ENDS_PARAGRAPH = ("div", "article", "body", "section", "main", "td", "li")
NAME_PARTS = regex.compile(r"[^a-z0-9]+")
CONTENT, OTHER, NAMED, STATE = range(4)  # of elements: content, surely not, named as something else, named with a state ("no-sidebar")


class Line:
    __slots__ = ("parts", "tags", "linked", "container", "other", "region", "named")

    def __init__(self, container: int, other: bool, region: int, named: int):
        self.parts: list[str] = []
        self.tags = self.linked = 0
        self.container, self.other, self.region, self.named = container, other, region, named


class LineParser(HTMLParser):
    """Turns parser events into lines: one for each run of text between tags that begin or end a block.

    `parents` has the parent of each container, `named` the kind, parent and `holds a region` of each element that only its names
    mark; 0 stands for none. Open elements are kept with the places of each tag, so no event looks through all of them.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.parents = [0]
        self.named: list[tuple[int, int, bool]] = [(CONTENT, 0, False)]
        self.comments = {0: False}
        self._open: list[tuple[str, int]] = []  # tag, kind
        self._places: dict[str, list[int]] = {}
        self._blocks: list[int] = []  # places of what is not inline
        self._containers, self._regions, self._named, self._marked = [(-1, 0)], [(-1, 0)], [(-1, 0)], []
        self._others = self._links = 0
        self._seen_region = False
        self._new_line()

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """`<![...`: a comment up to the next `>`, whatever it says."""
        return self.parse_bogus_comment(i, 0)

    def read(self, html: str) -> None:
        """The whole page. Of what never ends nothing is searched for again and again: a comment then goes to the next `>`, and
        what follows the last `>` holds no tag.
        """
        end, ended = html.rfind(">") + 1, max(0, html.rfind("-->"))
        self.feed(html[: min(ended, end)] + html[ended:end].replace("<!--", "<! --"))
        self.close()
        if end < len(html):
            self.handle_data(unescape(html[end:]))

    def _new_line(self) -> None:
        region = self._regions[1][1] if len(self._regions) > 1 else 0  # the outermost: whoever is in an inner one is in it too
        self.line = Line(self._containers[-1][1], self._others > 0, region, self._named[-1][1])
        self.lines.append(self.line)

    def _kind(self, tag: str, attributes: list[tuple[str, str | None]]) -> tuple[int, bool]:
        """The element's kind, and whether it is named as comments."""
        if tag in OTHER_TAGS or tag == "header" and len(self._regions) == 1:
            return OTHER, False
        if tag in ("html", "body", "main"):
            return CONTENT, False
        given = dict(attributes)
        if tag != "article":
            style = (given.get("style") or "").replace(" ", "").lower()
            if "hidden" in given or "display:none" in style or given.get("aria-hidden") == "true" or (given.get("role") or "").lower() in OTHER_ROLES:
                return OTHER, False
        wanted = COMMENT_NAMES if tag == "article" else OTHER_NAMES
        kind, comments = CONTENT, False
        for name in f"{given.get('class') or ''} {given.get('id') or ''}".lower().split():
            parts = set(NAME_PARTS.split(name))
            if parts & wanted:
                kind = STATE if kind != NAMED and parts & STATE_NAMES else NAMED
                comments |= bool(parts & COMMENT_NAMES)
        return kind, comments

    def _pop(self, place: int) -> None:
        for tag, kind in self._open[place:]:
            self._others -= kind == OTHER
            self._links -= tag == "a"
            self._places[tag].pop()
        del self._open[place:]
        for places in (self._blocks, self._marked):
            while places and places[-1] >= place:
                places.pop()
        for places in (self._containers, self._regions, self._named):
            while places[-1][0] >= place:
                places.pop()

    def _push(self, tag: str, kind: int, comments: bool) -> None:
        place = len(self._open)
        self._open.append((tag, kind))
        self._places.setdefault(tag, []).append(place)
        self._others += kind == OTHER
        self._links += tag == "a"
        if kind != CONTENT:
            self._marked.append(place)
        if kind in (NAMED, STATE):
            self.comments[len(self.named)] = comments
            self.named.append((kind, self._named[-1][1], False))
            self._named.append((place, len(self.named) - 1))
        if tag not in INLINE:
            self._blocks.append(place)
            if tag != "p":
                self.parents.append(self._containers[-1][1])
                self._containers.append((place, len(self.parents) - 1))
        if tag in REGION_TAGS:
            self._regions.append((place, self._containers[-1][1]))
            inner = self._named[-1][1]
            if inner and not comments:
                self.named[inner] = (*self.named[inner][:2], True)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in VOID:
            self.line.tags += 1
            if tag in INLINE:
                self.line.parts.append(" " if tag == "br" else "")
            else:
                self._new_line()
            return
        if tag not in INLINE and self._blocks:  # a block ends an open paragraph, a list item the one before it
            last = self._open[self._blocks[-1]][0]
            if last == "p" or tag == "li" == last:
                self._pop(self._blocks[-1])
        if tag in ("body", *REGION_TAGS) and not self._seen_region:  # what was left open before them ends here
            if self._marked:
                self._pop(self._marked[0])
            self._seen_region = tag in REGION_TAGS
        kind, comments = self._kind(tag, attrs)
        self._push(tag, kind, comments)
        if tag not in INLINE or kind != CONTENT:
            self._new_line()
        self.line.tags += 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        places = self._places.get(tag)
        if not places:
            return
        place = places[-1]
        if tag in INLINE and self._blocks and self._blocks[-1] > place:
            return
        if tag == "p" and any(self._places.get(t, ()) and self._places[t][-1] > place for t in ENDS_PARAGRAPH):
            return
        block = tag not in INLINE or bool(self._marked) and self._marked[-1] >= place
        self._pop(place)
        if block:
            self._new_line()

    def handle_data(self, data: str) -> None:
        self.line.parts.append(data)
        if self._links:
            self.line.linked += len(data)


def smoothed(values: np.ndarray) -> np.ndarray:
    """Gaussian weights over the neighbours that exist."""
    offsets = np.arange(-RADIUS, RADIUS + 1)
    weights = np.exp(-(offsets**2) / (2 * SIGMA**2))
    around = np.convolve(values, weights, "full")[RADIUS : RADIUS + len(values)]
    return around / np.convolve(np.ones(len(values)), weights, "full")[RADIUS : RADIUS + len(values)]


def marks(ratio: np.ndarray, smooth: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Which of the own lines hold content: by smoothed ratio, else all with text outside links, else all."""
    marked = own & (smooth >= min(smooth.std(), smooth[own].max(initial=0.0))) & (ratio > 0)
    if not marked.any():
        marked = own & (ratio > 0) if (own & (ratio > 0)).any() else own
    return marked


def left_out(parser: LineParser, lines: list[tuple[Line, str]], marked: np.ndarray) -> list[bool]:
    """Which named elements are something else, by the marked text that they hold.

    A name with a state ("no-sidebar", "comments-open") is outweighed by any marked line. A plain name is outweighed by a region in
    the element, or if it holds nine tenths of the marked text outside other named elements, in two lines or more; a name for
    comments never is.
    """
    named = parser.named
    size, number, region = [0] * len(named), [0] * len(named), [holds for _, _, holds in named]
    for i in np.flatnonzero(marked):
        size[lines[i][0].named] += len(lines[i][1])
        number[lines[i][0].named] += 1
    free = size[0]
    for k in range(len(named) - 1, 0, -1):
        parent = named[k][1]
        if parent:
            size[parent] += size[k]
            number[parent] += number[k]
            region[parent] |= region[k]
    gone = [False] * len(named)
    for k in range(1, len(named)):
        kind, parent, _ = named[k]
        most = number[k] >= 2 and size[k] >= NAMED_SHARE * (free + size[k])
        kept = size[k] > 0 and (kind == STATE or not parser.comments[k] and (region[k] or most))
        gone[k] = gone[parent] or not kept
    return gone


def main_lines(html: str | None) -> list[str]:
    """The lines of the main text, in page order. Malformed markup of any kind is read as browsers do, or as text."""
    parser = LineParser()
    if html:
        parser.read(html)
    lines = [(line, text) for line in parser.lines if (text := " ".join("".join(line.parts).split()))]
    if not lines:
        return []
    ratio = np.array([max(0, len(text) - line.linked) / max(1, line.tags) for line, text in lines])
    smooth = smoothed(ratio)
    own = np.array([not line.other for line, _ in lines])
    if len(parser.named) > 1:
        gone = left_out(parser, lines, marks(ratio, smooth, own))
        own &= np.array([not gone[line.named] for line, _ in lines])
    chosen = np.flatnonzero(marks(ratio, smooth, own))
    kept = [(line, text) for (line, text), mine in zip(lines, own, strict=True) if mine]
    regions = {lines[i][0].region for i in chosen} - {0}
    if regions:
        return [text for line, text in kept if line.region in regions]
    held = [0] * len(parser.parents)
    for i in chosen:
        held[lines[i][0].container] += len(lines[i][1])
    enough = REGION_SHARE * sum(held)
    for k in range(len(held) - 1, 0, -1):  # parents have smaller numbers
        held[parser.parents[k]] += held[k]
    container = max((k for k, size in enumerate(held) if size >= enough), default=0)  # the last opened is the innermost
    inside = [k == container for k in range(len(held))]
    for k in range(1, len(held)):
        inside[k] |= inside[parser.parents[k]]
    return [text for line, text in kept if inside[line.container]]


def extract(pages: DataFrame, html_column: str = "html") -> DataFrame:
    """The pages' other columns and `main_text`: the lines of the main text joined by newlines.

    A null or empty page, one without text and one that is all menus and the like give an empty text. Rows are taken one by one, so
    repeated ones are each kept. A column that is already called `main_text` is replaced.
    """
    others = [c for c in pages.columns if c not in (html_column, "main_text")]
    rows = pages.select(*others, html_column)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                texts = ["\n".join(main_lines(html)) for html in part.column(len(others)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.string())], [*others, "main_text"])

    return rows.mapInArrow(read, T.StructType([*rows.schema.fields[:-1], T.StructField("main_text", T.StringType())]))
