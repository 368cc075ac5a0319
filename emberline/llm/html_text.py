"""Main text of web pages: parser events, text-to-tag ratios, smoothing, clustering."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pieces_of, table

#: Standard deviation, in lines, of the smoothing kernel.
SIGMA = 1.5
#: A line with more than this share of its characters in links is navigation.
LINKED = 0.6
#: A form or an unclosed part that holds this share of a page's text that isn't linked doesn't mark it.
UNMARKS = 0.7
#: A container holds the article if it has this share of the content lines' characters.
HOLDS = 0.8

# Element names of the HTML standard by what they mean here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
NEVER = frozenset("head title script style noscript template nav footer aside form button select textarea input iframe object svg canvas dialog menu audio video map datalist".split())
#: Elements that may be around a whole page, by design or because nothing ended them.
WRAPPERS = frozenset("form nav aside header menu".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTAINERS = frozenset("article main section div td body html".split())
LISTS = frozenset("ul ol dl menu dir".split())
#: Elements before which an open paragraph ends, and those in which list items and cells of their own begin.
ENDS_P = BLOCK - frozenset("body br caption dd dialog dt head html li option select summary tbody td tfoot th thead title tr".split())
SCOPES = BLOCK - frozenset("address br dd div dt hr li option p tbody td tfoot th thead tr".split())
#: By element: the open ones of its scope that it ends.
IMPLIED = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("td", "th", "tr"), "tbody": ("td", "th", "tr", "tbody", "thead"), "tfoot": ("td", "th", "tr", "tbody", "thead"), "thead": ("td", "th", "tr", "tbody", "thead")}
_IN_SCOPE = frozenset(x for names in IMPLIED.values() for x in names)

#: Words of class and id values that mark what isn't the article.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion "
    "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toolbar "
    "header masthead footer sidebar aside rail widget widgets related recommended "
    "cookie cookies consent gdpr notice notices alert popup modal newsletter subscribe subscription signup login paywall "
    "comment comments commentlist respond replies disqus share sharing social hidden".split()
)
#: Those of them that mark what readers wrote, wherever they stand.
COMMENTS = frozenset("comment comments commentlist respond replies disqus".split())
#: Words that mark it only where the clusters agree.
DOUBTFUL = frozenset("discussion follow form legal copyright overlay popular search skip trending".split())
#: Words that say nothing beside a mark: a name made of marks and of these marks what isn't the article, whatever the clusters say.
NEUTRAL = frozenset(
    "a area bar block body bottom box buttons center col column container desktop global group holder inner item items js left line link links list "
    "main mobile mod module outer page pane panel posts primary right row secondary section site slot stories sub sticky text thread title top unit wrap wrapper".split()
)
#: Words of names that belong to an article's own parts.
OWN = frozenset("article content entry post story".split())
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

#: What a name or an element says about its text: nothing, not the article if the clusters agree, not the article.
PLAIN, DOUBT, OUT = 0, 1, 2


@dataclass(slots=True)
class Line:
    """One block of a page: its text, the tags in it, its link characters, and the innermost container around it."""

    parts: list[str] = field(default_factory=list)
    tags: int = 0
    linked: int = 0
    inside: int = -1
    out: bool = False
    doubt: int = -1  # containers that had opened before the innermost doubtful element
    heading: bool = False
    paragraph: bool = False
    item_of: int = -1  # the innermost list
    aside: int = 0  # characters in inline elements that words mark
    held_by: int = -1  # the outermost element that marks it other than by words
    text: str = ""


def _named(value: str, in_article: bool) -> int:
    """What a class or id value says, by the words of its names."""
    worst = PLAIN
    for name in value.split():
        words = [w.lower() for w in _WORDS.findall(name)]
        marks = [w in MARKS and not (w == "header" and (in_article or OWN.intersection(words))) for w in words]
        if any(marks):
            if all(m or w in NEUTRAL or w in DOUBTFUL for m, w in zip(marks, words, strict=True)):
                return OUT
            # one mark among other words may be the article's own matter ("share-prices"): the clusters say
            worst = DOUBT
        elif DOUBTFUL.intersection(words):
            worst = DOUBT
    return worst


def _said(name: str, attrs: list[tuple[str, str | None]], in_article: bool) -> tuple[int, bool]:
    """What an element says about its text, and whether by the words of its class or id alone.

    Ids of headings and paragraphs say nothing, as they are made of the text;
    those of an article's sections may be, unless they name comments.
    """
    if name in NEVER or (name == "header" and not in_article):
        return OUT, False
    words = PLAIN
    for key, value in attrs:
        if (key == "role" and value and value.lower() in ROLES) or key == "hidden" or (key == "aria-hidden" and value == "true"):
            return OUT, False
        if key in ("class", "id") and value and name not in ("html", "body", "main", "article"):
            own = _named(value, in_article)
            if key == "id" and (name in HEADINGS or name == "p"):
                own = PLAIN
            elif key == "id" and name == "section" and in_article and not COMMENTS.intersection(w.lower() for w in _WORDS.findall(value)):
                own = min(own, DOUBT)
            words = max(words, own)
    return (words if words == OUT or name in BLOCK else PLAIN), True


@dataclass(slots=True)
class Open:
    """An open element."""

    name: str
    said: int
    words: bool
    container: int
    number: int = -1
    aside: bool = False


class Lines(HTMLParser):
    """Takes parser events and closes a line at every block boundary.

    Elements that html lets open end where their successors begin: paragraphs
    before blocks, items, terms, rows and cells before the next of their list or
    table. All searches among open elements go by index, so that time is linear in
    the page however deep it nests.

    With cancel, an article or main element undoes the marks of the elements
    around it, but for those that hide. The elements whose numbers are in free
    mark nothing. An inline element that words mark is left out only where it is
    a line of its own.
    """

    def __init__(self, cancel: bool = False, free: frozenset[int] = frozenset()) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.kinds: list[str] = []  # of containers, by number
        self.parent: list[int] = []  # container around a container, or -1
        self.open: list[Open] = []
        self.places: dict[str, list[int]] = {}  # of open elements, by name
        self.blocks: list[int] = []  # places of open block elements
        self.holders: list[int] = []  # numbers of open containers
        self.scopes: list[dict[str, int]] = [{}]  # places of open items and cells, by scope
        self.by_words: list[int] = []  # places of elements that words marked
        self.doubts: list[tuple[int, int]] = []  # places of doubtful elements, and containers that had opened before
        self.said = [0, 0, 0]
        self.now = Line()
        self.cancel, self.free = cancel, free
        self.seen = 0  # elements so far
        self.names: dict[int, str] = {}  # of elements that mark other than by words, by number
        self.lists: list[int] = []  # numbers of open lists
        self.n_aside = 0  # open inline elements that words mark
        self.holding: list[int] = []  # places of elements that mark other than by words

    def _close_line(self) -> None:
        now = self.now
        now.text = " ".join("".join(now.parts).split())
        now.out |= 0 < now.aside == len("".join(now.text.split()))
        if now.text:
            self.lines.append(now)
            tags = 0
        else:
            tags = now.tags
        self.now = Line(tags=tags)

    def _imply(self, tag: str) -> None:
        """Ends what the start of `tag` ends."""
        if tag == "body":  # ends an unclosed head
            self._end("head")
        if tag in ENDS_P and self.blocks and self.open[self.blocks[-1]].name == "p":
            self._pop_from(self.blocks[-1])
        if tag in HEADINGS and self.blocks and self.open[self.blocks[-1]].name in HEADINGS:
            self._pop_from(self.blocks[-1])
        at = min((self.scopes[-1][x] for x in IMPLIED.get(tag, ()) if x in self.scopes[-1]), default=-1)
        if at >= 0:
            self._pop_from(at)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCK:
            self._close_line()
        self.now.tags += 1
        if tag == "body":
            self.now.tags = 1  # those of the head belong to no line
        self._imply(tag)
        if tag in VOID:
            return
        in_article = bool(self.places.get("article") or self.places.get("main"))
        said, words = _said(tag, attrs, in_article)
        self.seen += 1
        if self.seen in self.free:
            said = PLAIN
        aside = said == OUT and words and tag not in BLOCK
        if aside:
            said = PLAIN
        if self.cancel and tag in ("article", "main") and not in_article:
            hides = [i for i in self.holding if self.open[i].number < 0]
            for i in [*self.by_words, *(i for i in self.holding if self.open[i].number >= 0)]:
                self.said[self.open[i].said] -= 1
                self.open[i].said = PLAIN
                self.said[PLAIN] += 1
            self.by_words.clear()
            self.doubts.clear()
            self.holding = hides
        at, number = len(self.open), -1
        if said == DOUBT:
            self.doubts.append((at, len(self.kinds)))
        if tag in CONTAINERS:
            number = len(self.kinds)
            self.kinds.append(tag)
            self.parent.append(self.holders[-1] if self.holders else -1)
            self.holders.append(number)
        self.open.append(Open(tag, said, words, number, self.seen, aside))
        if aside:
            self.n_aside += 1
        if said == OUT and not words:
            if any(k == "hidden" or (k == "aria-hidden" and v == "true") for k, v in attrs):
                self.open[at].number = -1
            self.holding.append(at)
            self.names[self.seen] = tag
        if tag in LISTS:
            self.lists.append(self.seen)
        self.places.setdefault(tag, []).append(at)
        self.said[said] += 1
        if tag in BLOCK:
            self.blocks.append(at)
        if tag in SCOPES:
            self.scopes.append({})
        if tag in _IN_SCOPE:
            self.scopes[-1][tag] = at
        if said and words:
            self.by_words.append(at)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def _gone(self, x: Open, at: int) -> None:
        self.places[x.name].pop()
        self.said[x.said] -= 1
        if self.by_words and self.by_words[-1] == at:
            self.by_words.pop()
        if self.doubts and self.doubts[-1][0] == at:
            self.doubts.pop()
        if self.holding and self.holding[-1] == at:
            self.holding.pop()
        if x.name in LISTS:
            self.lists.pop()
        if x.aside:
            self.n_aside -= 1

    def _pop_from(self, at: int) -> None:
        """Ends the element at this place and all that are in it."""
        while len(self.open) > at:
            x = self.open.pop()
            if not x.name:
                continue
            self._gone(x, len(self.open))
            if x.container >= 0:
                self.holders.pop()
            if x.name in BLOCK:
                self.blocks.pop()
            if x.name in SCOPES:
                self.scopes.pop()
            if self.scopes[-1].get(x.name) == len(self.open):
                del self.scopes[-1][x.name]

    def _end(self, tag: str) -> None:
        own = self.places.get(tag)
        if not own:
            return
        at = own[-1]
        if tag not in BLOCK and tag not in NEVER and self.blocks and self.blocks[-1] > at:
            # an inline element that began outside the block ends without it
            x = self.open[at]
            self._gone(x, at)
            self.open[at] = Open("", PLAIN, False, -1)
            return
        self._pop_from(at)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK:
            self._close_line()
        self.now.tags += 1
        if tag not in VOID:
            self._end(tag)

    def handle_data(self, data: str) -> None:
        out = self.said[OUT] > 0
        if not self.now.parts:
            near = [x.name for x in self.open[-3:]]
            self.now.inside = self.holders[-1] if self.holders else -1
            self.now.out, self.now.doubt = out, self.doubts[-1][1] if self.doubts else -1
            self.now.heading = any(x in HEADINGS for x in near)
            self.now.item_of = self.lists[-1] if self.lists else -1
            self.now.held_by = self.open[self.holding[0]].number if self.holding else -1
            self.now.paragraph = "p" in near
        elif data.strip() and not out and self.now.out:
            self._close_line()  # text after a marked inline element
            self.handle_data(data)
            return
        elif data.strip() and out and not self.now.out:
            if "".join(self.now.parts).strip():
                return  # a marked inline element within a line
            self.now.out = True
        self.now.parts.append(data)
        if self.n_aside:
            self.now.aside += len("".join(data.split()))
        if self.places.get("a"):
            self.now.linked += len(data.strip())

    def finish(self) -> list[Line]:
        self.close()
        self._close_line()
        return self.lines


def smoothed(ratio: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing along a page's lines; weights beyond the page's ends go to the lines there are."""
    reach = int(4 * sigma + 0.5)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    part = np.convolve(ratio, kernel)[reach : reach + len(ratio)]
    return part / np.convolve(np.ones(len(ratio)), kernel)[reach : reach + len(ratio)]


def threshold(x: np.ndarray) -> float:
    """The border between two clusters of values: half way between their means, repeated until it stays."""
    t = float(x.mean())
    for _ in range(50):
        high, low = x[x > t], x[x <= t]
        if not len(high) or not len(low):
            break
        new = (float(high.mean()) + float(low.mean())) / 2
        if abs(new - t) < 1e-9:
            break
        t = new
    return t


def _parsed(html: str) -> tuple[Lines, list[Line]]:
    """The page's lines; marks around its articles, or around nearly all of its text, are undone."""

    def read(**how) -> tuple[Lines, list[Line]]:
        parser = Lines(**how)
        parser.feed(html)
        return parser, parser.finish()

    parser, lines = read()
    if "article" in parser.kinds or "main" in parser.kinds:
        held = _within(parser, {k for k, kind in enumerate(parser.kinds) if kind in ("article", "main")})
        inside = [x for x in lines if x.inside >= 0 and held[x.inside]]
        if any(not x.out for x in inside):
            return parser, lines
        if inside:  # the articles are all marked: by what is around them, perhaps
            again = read(cancel=True)
            if any(not x.out and x.inside >= 0 and held[x.inside] for x in again[1]):
                return again
    free: frozenset[int] = frozenset()
    for _ in range(3):  # a form around the whole page, or a menu that was never closed
        plain = [x for x in lines if x.linked <= LINKED * len(x.text)]
        by: dict[int, int] = {}
        for x in plain:
            if x.held_by >= 0:
                by[x.held_by] = by.get(x.held_by, 0) + len(x.text)
        most = max(by, key=by.__getitem__, default=-1)
        if most < 0 or by[most] < UNMARKS * sum(len(x.text) for x in plain) or parser.names.get(most) not in WRAPPERS:
            break
        free |= {most}
        parser, lines = read(free=free)
    return parser, lines


def _within(parser: Lines, regions: set[int]) -> list[bool]:
    """By container: whether it is one of the regions or in one."""
    out: list[bool] = []
    for k, above in enumerate(parser.parent):  # containers are numbered as they open
        out.append(k in regions or (above >= 0 and out[above]))
    return out


def main_text(html: str) -> str:
    """The article of a page: its blocks joined by a newline.

    The clusters of smoothed text-to-tag ratios give the content lines; the
    innermost container that holds them is the region, or without one the lines
    from the first to the last of them. Of the region all blocks are taken but
    for those that an element, a role or an unmistakable class or id marks. Outside
    article and main elements, blocks with a doubtful name and lists of links are left
    out too if they aren't content lines either. Articles side by side are all taken. A
    form around the whole page, or a menu that nothing closed, marks nothing.
    """
    if not html:
        return ""
    parser, lines = _parsed(html)
    if not lines:
        return ""
    size = np.array([len(x.text) for x in lines], dtype=float)
    out = np.array([x.out for x in lines])
    linked = np.array([x.linked for x in lines]) > LINKED * size
    ratio = size / np.array([max(1, x.tags) for x in lines])
    ratio[out | linked] = 0.0
    if not ratio.any():
        ratio = np.where(out, 0.0, size)  # links are all there is
        if not ratio.any() or not any(kind in ("article", "main") for kind in parser.kinds):
            return ""
    smooth = smoothed(ratio)
    high = smooth > min(threshold(smooth), float(smooth.mean()))
    content = high & ~out & ~linked
    if not content.any():
        content = ~out & ~linked if (~out & ~linked).any() else ~out
    # the smallest container that holds the content lines; an article or main element before others
    weight = [0.0] * len(parser.kinds)
    for line, c, n in zip(lines, content, size, strict=True):
        if c and line.inside >= 0:
            weight[line.inside] += n
    for k in range(len(weight) - 1, -1, -1):
        if parser.parent[k] >= 0:
            weight[parser.parent[k]] += weight[k]
    total = float(size[content].sum())
    named = [k for k, w in enumerate(weight) if w and parser.kinds[k] in ("article", "main") and w >= 0.5 * total]
    held = [k for k, w in enumerate(weight) if w >= HOLDS * total and parser.kinds[k] not in ("body", "html")]
    doubt = np.array([x.doubt for x in lines])
    items: dict[int, list[bool]] = {}
    for x, link in zip(lines, linked.tolist(), strict=True):
        items.setdefault(x.item_of, []).append(link)
    menus = {k: len(v) > 1 and 2 * sum(v) > len(v) for k, v in items.items()}
    menu = linked & ~high & np.array([menus[x.item_of] if x.item_of >= 0 else not x.paragraph for x in lines])
    if named or held:
        at = max(named or held)  # the innermost
        parts = {at}
        if parser.kinds[at] == "article":  # an article may come in parts, side by side
            parts |= {k for k, w in enumerate(weight) if w and parser.kinds[k] == "article" and parser.parent[k] == parser.parent[at]}
        region = _within(parser, parts)
        inside = np.array([x.inside >= 0 and region[x.inside] for x in lines])
        taken = inside & ~out if named else inside & ~out & ~((doubt > at) & ~high) & ~menu
    else:
        # no container: from the first content line, with the headings before it, to the last, with the paragraphs that go on from it
        at = np.flatnonzero(content)
        first, last = int(at[0]), int(at[-1])
        while first and lines[first - 1].heading and not out[first - 1]:
            first -= 1
        while last + 1 < len(lines) and lines[last].paragraph and lines[last + 1].paragraph and not out[last + 1]:
            last += 1
        place = np.arange(len(lines))
        taken = (first <= place) & (place <= last) & ~out & ~((doubt >= 0) & ~high) & ~menu
    return "\n".join(x.text for x, t in zip(lines, taken.tolist(), strict=True) if t)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of pages (page_id, url, html).

    text is the main text, whole: blocks in page order joined by a newline,
    white space within a block as one space, character references decoded.
    Null and empty html, and pages without an article, have empty text; an
    empty table gives no rows. Very long pages take time and memory in proportion
    to their length. Null ids and urls, and repeated rows, stay; other columns are
    ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b for whole in batches for b in pieces_of(whole, "html")):
            texts = [main_text(x.as_py()) for x in batch.column(2)]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
