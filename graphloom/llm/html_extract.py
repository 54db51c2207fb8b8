"""Main-text extraction from HTML: parser events to lines, text-to-tag ratio, smoothing and threshold clusters."""

from __future__ import annotations

import re
from html.parser import HTMLParser, commentclose

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import load, ship

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup p pre section summary table tbody td tfoot th thead "
    "tr ul".split()
)
HOLDERS = frozenset("article main section div td body html".split())
SKIPPED = frozenset(
    "nav header footer aside form script style noscript template head title iframe object svg canvas math button select option "
    "textarea datalist dialog menu audio video map".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
#: Words in the names of page parts that are no content, and those that may stand beside them in such a name.
MARKS = frozenset(
    "ad ads adv advert advertisement advertising adsbygoogle banner breadcrumb breadcrumbs comment comments consent cookie "
    "cookies disclaimer disqus footer gdpr masthead menu modal nav navbar navigation newsletter notice notification pager "
    "pagination popup promo promoted promotion related replies respond share sharing sidebar signup skip social sponsor "
    "sponsored subscribe subscription toolbar widget".split()
)
FILLERS = frozenset(
    "area bar block bottom box btn button buttons col column container content count form global group head header heading "
    "holder icon icons inner item items label layer left link links list main message module outer overlay page pane panel "
    "placeholder post posts primary right row secondary section side site slot small sticky stories strip text thread title "
    "top unit wrap wrapper zone".split()
)
ABOUT = frozenset("has hide is js no with without".split())
#: What an unclosed page part can't hold: an article or main that starts inside one ends it.
OUTER = frozenset("nav header footer form aside menu".split())
NAMES = re.compile(r"[^a-z0-9]+")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
#: Number references of more digits than any code point has.
LONG_NUMBER = re.compile(r"&#(?:0*[1-9][0-9]{7,}|[xX]0*[1-9a-fA-F][0-9a-fA-F]{6,}|0{64,}|[xX]0{64,})")
#: An open p ends where one of these starts.
ENDS_P = BLOCK - {"html", "body"}
P_SCOPE = HOLDERS | {"li", "blockquote"}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
CONTENT, DOUBTFUL, UNWANTED = 0, 1, 2


def _name_kind(value: str, inside: bool) -> int:
    """What a class or id says. UNWANTED: a page part's name and nothing else; in an article every one of its names must
    be such a part's, outside one of them. DOUBTFUL: a part's word beside other words, as in "social-history"."""
    whole = marked = known = names = 0
    for name in value.lower().split():
        words = [w for w in NAMES.split(name) if w]
        # A mark after one of these says something of the page, as in "no-sidebar".
        marks = [w in MARKS and (i == 0 or words[i - 1] not in ABOUT) for i, w in enumerate(words)]
        names += bool(words)
        marked += any(marks)
        plain = bool(words) and all(m or w in FILLERS for m, w in zip(marks, words, strict=True))
        known += plain
        whole += plain and any(marks)
    if not marked:
        return CONTENT
    return UNWANTED if whole and (known == names or not inside) else DOUBTFUL


def _kind(tag: str, attrs, inside: bool) -> int:
    if tag in SKIPPED:
        return UNWANTED
    if tag in ("html", "body", "article", "main") and not any(k == "class" and "comment" in NAMES.split((v or "").lower()) for k, v in attrs):
        return CONTENT
    found = CONTENT
    for k, v in attrs:
        v = v or ""
        if k in ("class", "id"):
            found = max(found, _name_kind(v, inside))
        elif k == "hidden" or k == "role" and v.lower() in ROLES or k == "aria-hidden" and v.lower() == "true":
            return UNWANTED
        elif k == "style" and HIDDEN.search(v.lower()):
            return UNWANTED
    return found


class Lines(HTMLParser):
    """Turns parser events into lines, one a block: (text, inline tags in it, characters inside links, holder, doubtful).

    holder and doubtful are the innermost such elements around the line by number, -1 for none; `above` has each
    holder's own holder. Any text is taken, in time linear in its length: what the standard parser gives up on or looks
    for again and again (marked sections, comments and tags that never end) is a bogus comment or text here.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, int, int]] = []
        self.open: list[tuple[str, int, int, int]] = []  # tag, kind, the holder and the doubtful element around it
        self.places: dict[str, list[int]] = {}  # of each open tag its places in `open`
        self.away: list[int] = []  # places of unwanted elements in `open`
        self.kinds: list[str] = []
        self.above: list[int] = []
        self.text: list[str] = []
        self.holder = self.doubtful = -1
        self.n_doubtful = self.tags = self.linked = self.links = self.inside = 0
        self.last_gt: tuple[int, int] | None = None
        self.endless = False

    # -- markup that has no end
    def _no_end(self, i: int) -> bool:
        """Whether no > follows; then the < is text."""
        if self.last_gt is None or self.last_gt[0] != len(self.rawdata):
            self.last_gt = len(self.rawdata), self.rawdata.rfind(">")
        if i > self.last_gt[1]:
            self.handle_data("<")
            return True
        return False

    def parse_comment(self, i, report=1):
        if self._no_end(i):
            return i + 1
        for empty in ("<!-->", "<!--->"):
            if self.rawdata.startswith(empty, i):
                return i + len(empty)
        end = None if self.endless else commentclose.search(self.rawdata, i + 4)
        if end:
            return end.end()
        self.endless = True  # no later comment ends either
        return self.rawdata.find(">", i) + 1

    def parse_html_declaration(self, i):
        if self._no_end(i):
            return i + 1
        if self.rawdata.startswith("<![CDATA[", i) and (end := self.rawdata.find("]]>", i)) > 0:
            return end + 3
        return self.rawdata.find(">", i) + 1

    def parse_pi(self, i):
        return i + 1 if self._no_end(i) else self.rawdata.find(">", i) + 1

    def parse_endtag(self, i):
        return i + 1 if self._no_end(i) else super().parse_endtag(i)

    def parse_starttag(self, i):
        if self._no_end(i):
            return i + 1
        end = super().parse_starttag(i)
        if end < 0:  # a quote that is never closed: the tag without attributes
            end = self.rawdata.find(">", i) + 1
            self.handle_starttag(re.match(r"[^\s/>\x00]+", self.rawdata[i + 1 : i + 65])[0].lower(), [])
        return end

    # -- events
    def flush(self) -> None:
        if self.text:
            line = " ".join("".join(self.text).split())
            if line:
                self.lines.append((line, self.tags, self.linked, self.holder, self.doubtful))
            self.text, self.linked = [], 0
        self.tags = 0

    def _pop(self) -> None:
        tag, kind, holder, doubtful = self.open.pop()
        if tag in BLOCK or doubtful != self.doubtful:
            self.flush()
        self.holder, self.doubtful = holder, doubtful
        self.places[tag].pop()
        if kind == UNWANTED:
            self.away.pop()
        self.links -= tag == "a"
        self.inside -= tag in ("article", "main")

    def _pop_to(self, place: int) -> None:
        while len(self.open) > place:
            self._pop()

    def _innermost(self, tags) -> int:
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=-1)

    def _close(self, tags, scope) -> None:
        """Ends the innermost open element of `tags`, unless one of `scope` stands around the current place first."""
        place = self._innermost(tags)
        if place >= 0 and place >= self._innermost(scope):
            self._pop_to(place)

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if tag == "br":
            self.text.append(" ")
        if tag in VOID:
            if tag == "hr":
                self.flush()
            return
        if tag in ENDS_P:
            self._close({"p"}, P_SCOPE)
        if tag in SIBLINGS:
            self._close(SIBLINGS[tag], SCOPES[tag])
        if tag in ("article", "main", "body"):
            if tag == "body":
                self._close({"head"}, ())
            while self.away and self.open[self.away[0]][0] in OUTER:
                self._pop_to(self.away[0])
        kind = _kind(tag, attrs, self.inside > 0)
        if tag in BLOCK or kind == DOUBTFUL:
            self.flush()
        place = len(self.open)
        self.open.append((tag, kind, self.holder, self.doubtful))
        self.places.setdefault(tag, []).append(place)
        if tag in HOLDERS:
            self.kinds.append(tag)
            self.above.append(self.holder)
            self.holder = len(self.kinds) - 1
        if kind == DOUBTFUL and self.doubtful < 0:
            self.doubtful, self.n_doubtful = self.n_doubtful, self.n_doubtful + 1
        elif kind == UNWANTED:
            self.away.append(place)
        self.links += tag == "a"
        self.inside += tag in ("article", "main")

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self.tags += 1
        if self.places.get(tag):
            self._pop_to(self.places[tag][-1])
        elif tag in BLOCK:
            self.flush()

    def handle_data(self, data):
        if not self.away:
            self.text.append(data)
            if self.links:
                self.linked += len(data)


def smoothed(x: np.ndarray, radius: int) -> np.ndarray:
    """x under a Gaussian window of the given radius, which is one standard deviation; ends are renormalised."""
    at = np.arange(-radius, radius + 1)
    w = np.exp(-(at**2) / (2 * radius**2))
    clip = slice(radius, radius + len(x))
    return np.convolve(x, w)[clip] / np.convolve(np.ones(len(x)), w)[clip]


def clusters(length: np.ndarray, tags: np.ndarray, radius: int) -> np.ndarray:
    """Which lines are content: those whose smoothed text-to-tag ratio reaches the ratios' standard deviation, or the mean if that is less."""
    ratio = np.maximum(length, 0) / np.maximum(tags, 1)
    smooth = smoothed(ratio, radius)
    return smooth >= min(ratio.std(), smooth.mean())


def extract(html: str | None, *, radius: int = 2, share: float = 0.9) -> str:
    """The main text of a page, its blocks joined by an empty line; "" if there is none.

    Lines inside page parts that are never content are left out as they are parsed. Of the rest, `clusters` finds the
    content lines. An element whose name only hints at a page part stays if its lines are content: in an article it goes
    if most of its text is links and most of its lines are no content, elsewhere if either holds. The region is the
    article or main elements that hold most of the clusters' text, else the innermost element that holds `share` of it,
    there cut to the lines from the first cluster to the last; every line of the region is kept, short ones too.

    Any text is a page: malformed, unclosed and deeply nested markup costs time linear in its length and raises nothing.
    A comment or declaration that never ends goes up to the next >, a < without any > after it is text, and of a script
    or style that is never closed the rest of the page is a part.
    """
    parser = Lines()
    parser.feed(LONG_NUMBER.sub("&#1114112", html or ""))
    parser.close()
    parser.flush()
    lines = parser.lines
    if not lines:
        return ""
    sizes, tags, linked, holder, doubtful = np.array([(len(t), *x) for t, *x in lines], np.int64).T
    length = (sizes - linked).astype(float)
    content = clusters(length, tags, radius)
    kinds, above = parser.kinds, parser.above
    around = np.zeros(len(kinds), bool)  # whether a holder is an article or main or lies in one
    for h, kind in enumerate(kinds):
        around[h] = kind in ("article", "main") or above[h] >= 0 and around[above[h]]
    kept = np.ones(len(lines), bool)
    if parser.n_doubtful:
        sum_of = lambda x, at: np.bincount(doubtful[at], x[at], parser.n_doubtful)
        at = doubtful >= 0
        links = 2 * sum_of(linked, at) > sum_of(sizes, at)
        thin = 2 * sum_of(np.where(content, sizes, 0), at) < sum_of(sizes, at)
        own = np.array([h >= 0 and around[h] for h in holder])
        gone = np.where(own, (links & thin)[doubtful], (links | thin)[doubtful])
        kept = ~(at & gone)
    content &= kept
    weight, any_content = np.zeros(len(kinds)), np.zeros(len(kinds), bool)
    at = content & (holder >= 0)
    np.add.at(weight, holder[at], length[at])
    any_content[holder[at]] = True
    for h in range(len(kinds) - 1, -1, -1):  # a holder's number is above that of what is around it
        if above[h] >= 0:
            weight[above[h]] += weight[h]
            any_content[above[h]] |= any_content[h]
    total = float(length[content].sum())
    # Articles with content, and what lies in them.
    chosen, outermost = np.zeros(len(kinds), bool), 0.0
    for h, kind in enumerate(kinds):
        inherited = above[h] >= 0 and chosen[above[h]]
        own = kind in ("article", "main") and any_content[h]
        outermost += weight[h] if own and not inherited else 0.0
        chosen[h] = inherited or own
    if chosen.any() and outermost >= total / 2:
        return "\n\n".join(t for (t, *_, h, _), yes in zip(lines, kept, strict=True) if yes and h >= 0 and chosen[h])
    inner = max((h for h in range(len(kinds)) if any_content[h] and weight[h] >= share * total), default=-1)
    within = np.zeros(len(kinds) + 1, bool)  # the last one stands for no holder
    for h in range(len(kinds)):
        within[h] = h == inner or above[h] >= 0 and within[above[h]]
    inside = kept & (within[holder] if inner >= 0 else True)
    at = np.flatnonzero(content & inside)
    first, last = (at[0], at[-1]) if len(at) else (0, len(lines) - 1)
    return "\n\n".join(lines[i][0] for i in range(first, last + 1) if inside[i])


def extract_pages(pages: DataFrame, columns: list[str]) -> DataFrame:
    """pages' `columns`, text and n_chars for every row of pages (html); null html counts as empty, and no row is dropped."""

    def run(batches):
        for batch in batches:
            texts = [extract(x.as_py()) for x in batch.column(0)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*columns, "text", "n_chars"])

    ship(pages.sparkSession)
    source = pages.select(F.col("html").alias("_html_"), *columns)
    shape = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[1:]), "text string, n_chars long"])
    return source.mapInArrow(run, shape)


def op8_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract_pages(load(spark, sf_dir, "pages"), ["page_id", "url"])
