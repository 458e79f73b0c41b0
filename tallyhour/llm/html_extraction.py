"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one for each block of text. Elements that never hold main text (menus,
headers, footers, sidebars, notices, adverts, forms, comments, scripts, styles) leave empty lines in their place, as do,
where a page marks its article, all lines outside it. Characters of lines, those inside links left out where
most of a line is linked, are summed over a sliding window. The page's own distribution sets the threshold: a share
of the mean window. The text surges at a line that reaches it by itself, and dives where the window after does not.

The stretch with most text is the main one. Around it everything is kept that stands in the smallest element that holds more
than it, so long as that is not the whole body: short lines, headings, parts beyond an advert. Sections side by
side belong together. Paragraphs right in the body are kept from first to last if they are most of what stands
there, and a heading next to the stretch goes with it. Another stretch is kept if it has ``KEPT_SHARE`` of
the main one's text.

Furniture is known by its tag, or by a class, id or role that names nothing else. A form, header or named element that holds
most of the text of the page's articles (of the page, if it marks none) is not left out, and none that holds its main element.

Defined cases: a null or empty page has an empty text; markup that is cut off or unbalanced is read up to its
end, in time that grows with the page; rows that repeat an id are extracted one by one; a null id or url stays null; an
empty table gives no rows; columns not named are left alone.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhour.llm.tables import own

WINDOW = 3
KEPT_SHARE = 0.3
MAX_LINKED = 0.6
#: The least that a line and a window must have, as a share of the mean window.
SURGE = 0.15

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*)(?:>|\Z)"
    r"|</[^>]*(?:>|\Z)",
    re.S,
)
_ATTR = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_SPACE = re.compile(r"\s+")
_RAW = frozenset("script style noscript template textarea title svg annotation annotation-xml iframe object xmp".split())
_FURNITURE = frozenset(
    "nav footer aside form menu dialog select button fieldset head header noscript canvas audio video map".split()
)
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table "
    "tbody td tfoot th thead tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Names of page furniture in class, id or role: a whole name between spaces, or one made of these and ``_PLAIN`` words.
_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion adsense "
    "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toolbar "
    "sidebar sidenav rail aside complementary "
    "footer masthead topbar "
    "cookie cookies consent gdpr notice notices notification alert popup modal overlay disclaimer "
    "comment comments commentlist discussion disqus respond reply replies "
    "share sharing social related recommended newsletter subscribe subscription signup login search searchform "
    "widget widgets contentinfo".split()
)
#: Words that say where furniture stands or how it is made up, and nothing of what it holds.
_PLAIN = frozenset(
    "site page main primary secondary global top bottom left right upper lower inner outer sticky fixed mobile desktop "
    "container wrapper wrap box bar area zone block row col column list items item links link group unit slot holder frame section "
    "panel panels form button buttons icon icons tags posts articles stories header js the in".split()
)
#: Furniture whatever it holds, unless that is the page's main element.
_NEVER = frozenset(
    "comment comments commentlist discussion disqus respond reply replies cookie cookies consent gdpr".split()
)
_COMMENT = frozenset({"comment", "comments"})
_COMMENT_PARTS = frozenset("body content text author meta entry".split())
_NUMBER = re.compile(r"\d+(?:x\d+)?\Z")
_SURE = _FURNITURE - {"form", "fieldset", "header"}
_ARTICLE_ROLES = frozenset({"main", "article"})
_CONTAINERS = frozenset("article main section div td center body html".split())
_LISTS = frozenset("ul ol menu dir".split())
_HEADINGS = frozenset({"h1", "h2"})
#: A line of these may be one link and still be text.
_PROSE = frozenset("p blockquote dd figcaption pre h1 h2 h3 h4 h5 h6".split())
_WHOLE = frozenset({"body", "html"})
_SELF_CLOSED = re.compile(r"""(?:^|[\s"'])/\s*\Z""")
_TEXT, _OPEN, _CLOSE, _BREAK = range(4)


def _furniture(token: str) -> set[str]:
    """Names of furniture in a class, if it names nothing else: ``cookie-notice`` and not ``has-sidebar``."""
    parts = [part for part in re.split(r"[^a-z0-9]+", token) if part]
    named = _NAMES.intersection(parts)
    if not named or parts[0] in _COMMENT and _COMMENT_PARTS.issuperset(parts[1:]):
        return named
    return named if all(part in named or part in _PLAIN or _NUMBER.match(part) for part in parts) else set()


def _names(attrs: str) -> tuple[set[str], str, bool]:
    """Furniture named by class, id and role; the role; whether the element is hidden."""
    words, role, hidden = set(), "", bool(re.search(r"(?:^|\s)hidden(?:\s|=|/|$)", attrs))
    for name, *values in _ATTR.findall(attrs):
        value = next((v for v in values if v), "").lower()
        name = name.lower()
        if name in ("class", "id", "role"):
            for token in value.split():
                words |= _furniture(token)
            if name == "role":
                role = value.strip()
        elif name == "style" and re.search(r"display\s*:\s*none", value):
            hidden = True
        elif name == "aria-hidden" and value == "true":
            hidden = True
    return words, role, hidden


class _Element:
    """An open tag: what it is, where it closes, what it holds, and the container, article and heading it lies in."""

    __slots__ = (
        "tag", "words", "hidden", "parent", "is_article", "is_main", "named", "container", "article", "heading",
        "prose", "opened", "closed", "holds_main", "holds_text",
    )

    def __init__(self, tag: str, attrs: str, parent: _Element | None):
        self.tag, self.parent = tag, parent
        self.words, role, self.hidden = _names(attrs) if "=" in attrs or "hidden" in attrs else (set(), "", False)
        self.named = bool(self.words)
        self.is_main = tag == "main" or role == "main"
        self.is_article = (tag in ("article", "main") or role in _ARTICLE_ROLES) and not self.words & _COMMENT
        self.container = self if tag in _CONTAINERS else parent and parent.container
        self.article = parent and parent.article or (self if self.is_article else None)
        self.heading = tag in _HEADINGS or bool(parent and parent.heading)
        self.prose = tag in _PROSE or bool(parent and parent.prose)
        self.opened = self.closed = 0
        self.holds_main = self.holds_text = False

    def furniture(self) -> bool:
        """Left out whatever the rest of the page is."""
        return self.hidden or self.tag in _SURE or bool(self.words & _NEVER) and not self.is_article

    def left_out(self) -> bool:
        if self.hidden or self.tag == "head":
            return True
        if self.holds_main or self.holds_text and not self.furniture():
            return False
        if self.tag == "header" and self.article and not self.named:
            return False  # the heading of an article belongs to it
        return self.tag in _FURNITURE or self.named and self.tag not in ("body", "html") and not self.is_article


def _parse(page: str) -> list[tuple[int, object]]:
    """Texts, and elements that open and close, in order; an element left open ends with the one around it."""
    events: list[tuple[int, object]] = []
    stack: list[_Element] = []
    n_open: dict[str, int] = {}

    def close_from(place: int) -> None:
        while len(stack) > place:
            one = stack.pop()
            n_open[one.tag] -= 1
            one.closed = len(events)
            events.append((_CLOSE, one))

    def near(tag: str, stops) -> int | None:
        """Place of the open ``tag`` above the last element that stops the search."""
        if n_open.get(tag):
            for place in range(len(stack) - 1, -1, -1):
                if stack[place].tag == tag:
                    return place
                if stops(stack[place].tag):
                    return None
        return None

    at, n = 0, len(page)
    while at < n:
        found = _TOKEN.search(page, at)
        if not found:
            events.append((_TEXT, page[at:]))
            break
        if found.start() > at:
            events.append((_TEXT, page[at : found.start()]))
        at = found.end()
        if found["cdata"] is not None:
            events.append((_TEXT, found["cdata"]))
        if not found["tag"]:
            continue
        tag, closing, attrs = found["tag"].lower(), bool(found["close"]), found["attrs"]
        if tag in _RAW and not closing and not attrs.rstrip().endswith("/"):
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if closing:
            block = tag in _BLOCK
            place = near(tag, (lambda t: False) if block and tag != "p" else _BLOCK.__contains__)
            if place is not None:
                close_from(place)
            elif block:
                events.append((_BREAK, None))
            continue
        if tag in _BLOCK:
            place = near("p", _BLOCK.__contains__)
            if place is None and tag == "li":
                place = near("li", _LISTS.__contains__)
            if place is not None:
                close_from(place)
        one = _Element(tag, attrs, stack[-1] if stack else None)
        one.opened = len(events)
        events.append((_OPEN, one))
        if tag not in _VOID:
            stack.append(one)
            n_open[tag] = n_open.get(tag, 0) + 1
            if _SELF_CLOSED.search(attrs):
                close_from(len(stack) - 1)
    close_from(0)
    _weigh(events)
    return events


def _weigh(events: list[tuple[int, object]]) -> None:
    """Mark the elements that hold the page's main element, or most of the text of its articles.

    Where no article is marked, all text outside links and sure furniture counts.
    """
    elements = [one for kind, one in events if kind == _OPEN and one.tag not in _VOID]
    in_articles, anywhere = [0], [0]
    mains = [0]
    n_out = n_links = n_articles = 0
    for kind, one in events:
        size = 0
        if kind == _TEXT and not n_out and not n_links:
            size = len(_SPACE.sub(" ", one).strip())
        elif kind in (_OPEN, _CLOSE) and one.tag not in _VOID:
            step = 1 if kind == _OPEN else -1
            n_out += step * one.furniture()
            n_links += step * (one.tag == "a")
            n_articles += step * one.is_article
        in_articles.append(in_articles[-1] + (size if n_articles else 0))
        anywhere.append(anywhere[-1] + size)
        mains.append(mains[-1] + (kind == _OPEN and one.is_main and not one.hidden))
    sums = in_articles if in_articles[-1] else anywhere
    for one in elements:
        one.holds_main = mains[one.closed] > mains[one.opened]
        one.holds_text = 2 * (sums[one.closed] - sums[one.opened]) > sums[-1]


class _Lines:
    """Lines of a page in order: text, characters inside links, and the innermost element around."""

    def __init__(self):
        self.lines: list[tuple[str, int, _Element | None]] = []
        self.parts: list[str] = []
        self.linked = 0

    def text(self, raw: str, in_link: bool) -> None:
        value = html.unescape(raw)
        self.parts.append(value)
        if in_link:
            self.linked += len(_SPACE.sub(" ", value).strip())

    def end(self, here: _Element | None) -> None:
        text = _SPACE.sub(" ", "".join(self.parts)).strip()
        if text:
            self.lines.append((text, self.linked, here))
        self.parts, self.linked = [], 0

    def gap(self, n: int) -> None:
        self.lines += [("", 0, None)] * n


def page_lines(page: str, window: int = WINDOW) -> list[tuple[str, int, _Element | None]]:
    """The lines of a page, with empty ones where furniture stood."""
    out = _Lines()
    events = _parse(page)
    here: _Element | None = None
    at = links = 0
    while at < len(events):
        kind, one = events[at]
        at += 1
        if kind == _TEXT:
            out.text(one, links > 0)
        elif kind == _BREAK:
            out.end(here)
        elif kind == _CLOSE:
            if one.tag in _BLOCK:
                out.end(here)
            links -= one.tag == "a"
            here = one.parent
            if one.article is one:
                out.gap(window + 1)
        elif one.tag not in _VOID and one.left_out():
            if one.tag in _BLOCK or one.named:
                out.end(here)
                out.gap(1 if here and here.article else window + 1)
            at = one.closed + 1
        else:
            if one.tag in _BLOCK:
                out.end(here)
            elif one.tag == "br":
                out.text(" ", False)
            if one.tag not in _VOID:
                here = one
                links += one.tag == "a"
                if one.article is one:
                    out.gap(window + 1)
    out.end(here)
    return out.lines


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    merged: list[tuple[int, int]] = []
    for start, stop in sorted(spans):
        if merged and start < merged[-1][1]:
            merged[-1] = (merged[-1][0], max(stop, merged[-1][1]))
        else:
            merged.append((start, stop))
    return merged


def _path(here: _Element | None) -> list[_Element]:
    """The elements around a line, outermost first."""
    out = []
    while here:
        out.append(here)
        here = here.parent
    return out[::-1]


def _around(lines: list, first: int, last: int) -> list[int]:
    """Lines that belong with those from ``first`` to ``last``: all in the smallest element that holds more, short of the body.

    Of an element that is a section, the sections beside it belong too.
    """
    shared = [a for a, b in zip(_path(lines[first][2]), _path(lines[last][2])) if a is b]
    one = shared[-1].container if shared else None
    if one is None or one.tag in _WHOLE:
        return []
    parent = one.parent and one.parent.container
    beside = parent if one.tag == "section" else None
    if parent and parent.tag not in _WHOLE:
        one = parent
    belongs: dict[_Element | None, bool] = {None: False}

    def inside(here: _Element | None) -> bool:
        climbed = []
        while here not in belongs:
            climbed.append(here)
            here = here.parent
        known = belongs[here]
        for element in reversed(climbed):
            among = element.tag == "section" and beside and element.parent and element.parent.container is beside
            known = belongs[element] = known or element is one or bool(among)
        return known

    return [at for at, (text, _, here) in enumerate(lines) if text and inside(here)]


def _back_to_heading(lines: list, lengths: list[int], start: int, stop: int) -> int:
    """The heading that a stretch without one goes back to: right before it, or held with it by more than the body."""
    texts = [at for at in range(start, stop) if lengths[at]]
    if any(lines[at][2] and lines[at][2].heading for at in texts):
        return start
    around = {one.container for one in _path(lines[max(texts, key=lengths.__getitem__)][2]) if one.tag not in _WHOLE}
    for at in range(start - 1, -1, -1):
        one = lines[at][2]
        if lengths[at] and one and one.heading:
            return at if all(lengths[at:start]) or around.intersection(_path(one)) else start
    return start


def _weights(lines: list, marked: bool, max_linked: float) -> list[int]:
    """Characters of each line that count; none of a line that cannot be text."""
    out = []
    for text, linked, here in lines:
        inside = here and here.article
        if not text or marked and not inside:
            out.append(0)
        elif linked > max_linked * len(text) and not inside:
            out.append(max(1, len(text) - linked) if here and here.prose else 0)
        else:
            out.append(len(text))
    return out


def _stretches(lengths: list[int], window: int, share: float) -> list[tuple[int, int]]:
    """From each surge to its dive."""
    sums = [0]
    for length in lengths:
        sums.append(sums[-1] + length)
    n = len(lengths)
    blocks = [sums[min(at + window, n)] - sums[at] for at in range(n)]
    texts = [at for at in range(n) if lengths[at]]
    least = share * sum(blocks[at] for at in texts) / max(len(texts), 1)
    found: list[tuple[int, int]] = []
    start = None
    for at in range(n):
        if start is None:
            if lengths[at] and lengths[at] >= least:
                start = at
        elif blocks[at] < max(least, 1):
            found.append((start, at))
            start = None
    if start is not None:
        found.append((start, n))
    return found


def main_text(page: str, window: int = WINDOW, kept_share: float = KEPT_SHARE, max_linked: float = MAX_LINKED) -> str:
    """The text between the surge and the dive of a page's lines, and what belongs with it."""
    lines = page_lines(page, window)
    marked = any(here and here.article for _, _, here in lines)
    lengths = _weights(lines, marked, max_linked)
    stretches = _stretches(lengths, window, SURGE)
    if not stretches:
        return ""
    sums = [0]
    for length in lengths:
        sums.append(sums[-1] + length)
    parents: dict[_Element | None, list[int]] = {}
    for at, (_, _, here) in enumerate(lines):
        if lengths[at]:
            first_last = parents.setdefault(here and (here.article if marked else here.container), [at, at, 0])
            first_last[1] = at
            first_last[2] += lengths[at]
    for parent, (first, last, size) in parents.items():
        # the body holds the whole page, so it is a parent of the text only if most of it stands there by itself
        if parent and parent.tag not in _WHOLE or 2 * size >= sums[last + 1] - sums[first]:
            stretches.append((first, last + 1))
    stretches = _merged(stretches)
    if not marked:
        start, stop = max(stretches, key=lambda span: sums[span[1]] - sums[span[0]])
        start = _back_to_heading(lines, lengths, start, stop)
        texts = [at for at in range(start, stop) if lengths[at]]
        held = [at for at in _around(lines, texts[0], texts[-1]) if lengths[at]]
        stretches = _merged([*stretches, (min([start, *held]), max([stop, *(at + 1 for at in held)]))])
    sizes = [sums[stop] - sums[start] for start, stop in stretches]
    kept = [range(*span) for size, span in zip(sizes, stretches) if size >= min(1, kept_share) * max(sizes)]
    return "\n".join(lines[at][0] for span in kept for at in span if lengths[at])


def html_extraction(
    pages: DataFrame,
    id_column: str = "page_id",
    url_column: str = "url",
    html_column: str = "html",
    window: int = WINDOW,
    kept_share: float = KEPT_SHARE,
) -> DataFrame:
    """``page_id, url, text, n_chars`` of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                texts = [main_text(page.as_py(), window, kept_share) for page in part.column("html")]
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                    names=["page_id", "url", "text", "n_chars"],
                )

    rows = own(pages, {"page_id": id_column, "url": url_column, "html": html_column}).select(
        F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html")
    )
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
