"""Main text of web pages by tag-path ratios.

A page is cut into blocks of text at its block-level tags. Blocks are grouped by root-to-leaf tag path
(block-level tags; generic containers with their first class). Each path has the ratio of its text
length, and of its punctuation, to its number of blocks, links left out; both are smoothed over the
page's sequence of blocks and fused, tags around them weigh in, and paths over a threshold of the page
are content. All blocks of content paths are returned, with those short ones between or beside them
in the same container that nothing speaks against (headings, list items, cells).

What speaks against a block, whatever its path: elements that no article's text is in (head, nav, aside
...), roles, hidden elements, names of class or id of which every word says so, forms that hold less
than half of the page's text, lists of links, and reader comments: by name, articles in an article, and
siblings most of which are signed by a time, a citation or an author.

Pages are parsed one by one with no state between them, so a hot host is as good as any other. A page
is read once from left to right, and open elements are found by tag, so that time grows with its
length whatever its tags; paths are numbers that refer to their parents'.

Defined results: null and empty pages, and those without text outside such elements, have empty text
and n_chars 0; unclosed and stray tags are met as browsers do for paragraphs and list items and are
else closed with their parents; unterminated comments, scripts, styles and tags run to the end;
repeated rows are returned each; an empty table gives no rows. Other columns pass through, but for
those named text and n_chars.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: A path is content from this share of the page's mean path score, weighed by text; smoothing's weights
#: of a block and its neighbours; the share of a page's text from which a form is its frame.
THRESHOLD, WEIGHTS, FRAME = 0.25, (1, 2, 1), 0.5
#: Weight of paths in an article or main element; share of a list's text in links that makes it a menu.
INSIDE, LINKS = 2.0, 0.8
#: Blocks of this many neighbours before the first content block may hold its heading.
BEFORE = 3
OPENING = re.compile(r"<(?:(!--)|(/?)([a-zA-Z][^\s/>]*)|[!?/])")
ATTRIBUTE = re.compile(r"[\s/]*(?:(>)|([^\s/>=][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?|=)")
RAW = frozenset("script style noscript template textarea title iframe svg math xmp noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LISTS = frozenset("ul ol dl menu".split())
#: Elements that no article's text is in.
NEVER = frozenset("head nav footer aside button select option optgroup datalist dialog menu object audio video canvas map fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
#: Words of names around an article; in a name that speaks, all words are of these or of the next.
WORDS = frozenset(
    "ad ads adbox adsense advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr popup modal overlay "
    "newsletter subscribe subscription signup login share sharing social recommended recommendations sidebar menu nav navbar navigation breadcrumb breadcrumbs "
    "comment comments reply replies respond disqus footer masthead topbar toolbar widget pagination pager paywall disclaimer copyright".split()
)
#: Words that speak outside of an article only, where they may name its parts.
OUTSIDE = frozenset("related notice notices alert alerts feedback thread threads discussion discussions reviews reactions responses guestbook talkback header popular trending tags".split())
FILLERS = frozenset("area bar block body box column container content footer global group inner item items left right link links list main message outer page panel section site top bottom wrap wrapper widget text form button buttons posts articles stories news media icons js c m o u".split())
#: Names of what signs a comment.
SIGNS = frozenset("author user username avatar commenter commentator nick nickname timestamp permalink".split())
#: Containers whose first class is part of a path.
CLASSED = frozenset("div section td ul ol dl table".split())
CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("td", "th", "tr"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
STOPS = frozenset("ul ol dl table div article section main body td th aside nav form blockquote".split())
PUNCTUATION = re.compile(r"[.,;:!?…。，！？；：、¿¡]")
SPLIT = re.compile(r"[^a-z0-9]+")


class Element:
    __slots__ = ("tag", "parent", "path", "never", "article", "form", "signed", "kids", "speaks", "block")

    def __init__(self, tag: str, parent: Element | None):
        self.tag, self.parent, self.kids = tag, parent, None
        self.block = parent.block if parent is not None and tag in INLINE else self  # the nearest that is no inline one
        self.path, self.signed, self.speaks = 0, False, False
        self.never = parent is not None and parent.never
        self.article = parent.article if parent is not None else None
        self.form = parent.form if parent is not None else None


def _speaks(name: str, inside: bool) -> bool:
    """Whether a class or id names what is around an article."""
    words = [w for w in SPLIT.split(name) if w and not w.isdigit()]
    known = [w for w in words if w in WORDS or not inside and w in OUTSIDE]
    return bool(known) and all(w in FILLERS or w in WORDS or w in OUTSIDE for w in words)


class Page:
    """Blocks of a page: element, text, code points in links."""

    def __init__(self, page: str):
        self.root = self.now = Element("", None)
        self.paths: dict[tuple[int, str], int] = {}
        self.stack, self.open, self.stops = [self.root], {}, [0]
        self.blocks: list[list] = []
        self.parts: list[str] = []
        self.links = self.in_link = 0
        self.owner = self.root
        self._read(page)

    # -- elements

    def _flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                self.blocks.append([self.owner, text, self.links])
            self.parts, self.links = [], 0

    def _text(self, text: str) -> None:
        if not text:
            return
        text = html.unescape(text)
        self.parts.append(text)
        if self.in_link:
            self.links += len(text.strip())

    def _begin(self, tag: str, attributes: dict[str, str], closed: bool) -> None:
        block = tag not in INLINE
        if block:
            self._flush()
            for other in CLOSES.get(tag, ()) or ("p",):
                at = self.open.get(other)
                if at and (at[-1] > self.stops[-1] or other in ("td", "th", "tr") and self._row(at[-1])):
                    self._cut(at[-1])
        e = Element(tag, self.stack[-1])
        if tag == "article" or tag == "main" and not e.article:
            if tag == "article" and e.article is not None and e.article.tag == "article":
                e.never = True  # an article in an article is a comment on it
            e.article = e
        if tag == "form":
            e.form = e
        inside = e.article is not None
        names = f"{attributes.get('class', '')} {attributes.get('id', '')}".lower().split()
        style = attributes.get("style", "").lower().replace(" ", "")
        if tag not in ("html", "body", "article", "main") and any(_speaks(n, inside) for n in names):
            e.never = True
        hidden = "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or "display:none" in style or "visibility:hidden" in style
        if tag in NEVER or tag == "header" and not inside or hidden or (attributes.get("role", "").lower().strip() in ROLES and tag != "form"):
            e.never = True
        e.signed = tag in ("time", "cite") or any(w in SIGNS for n in names for w in SPLIT.split(n))
        key = tag
        if tag in CLASSED and attributes.get("class", "").split():
            key = f"{tag}.{attributes['class'].split()[0]}"
        e.path = self.paths.setdefault((e.parent.path, key), len(self.paths) + 1) if block else e.parent.path
        if e.signed:
            self._sign(e)
        if tag in VOID or closed and tag not in STOPS and tag not in CLOSES:
            return
        self.stack.append(e)
        self.open.setdefault(tag, []).append(len(self.stack) - 1)
        if tag in STOPS:
            self.stops.append(len(self.stack) - 1)
        if tag == "a":
            self.in_link += 1
        if block:
            self.owner = e
            up = e.parent.block
            if up.kids is None:
                up.kids = []
            up.kids.append(e)

    def _row(self, at: int) -> bool:
        """Whether only cells and rows are open above this one, as a cell bounds its own contents only."""
        return all(e.tag in ("td", "th", "tr") or e.tag in INLINE for e in self.stack[at + 1 : at + 4]) and len(self.stack) - at <= 4

    def _sign(self, e: Element) -> None:
        """What holds a signature is signed, up to the next block but two."""
        up = e.parent.block
        for _ in range(3):
            if up.parent is None or up.tag in ("article", "main", "body"):
                break
            up.signed = True
            up = up.parent.block

    def _cut(self, at: int) -> None:
        """Closes open elements from that place on."""
        for i in range(len(self.stack) - 1, at - 1, -1):
            e = self.stack.pop()
            self.open[e.tag].pop()
            if e.tag in STOPS:
                self.stops.pop()
            if e.tag == "a":
                self.in_link -= 1
            if e.tag not in INLINE:
                self._flush()
        self.owner = self.stack[-1].block

    def _end(self, tag: str) -> None:
        if tag not in INLINE:
            self._flush()
        at = self.open.get(tag)
        if at and (tag not in INLINE or at[-1] > self.stops[-1]):
            self._cut(at[-1])
        elif tag in ("br", "p"):
            self._flush()

    # -- scanning

    def _read(self, page: str) -> None:
        at = start = 0
        lower = None
        while True:
            m = OPENING.search(page, at)
            if not m:
                break
            if m[1]:  # a comment
                self._text(page[start : m.start()])
                end = page.find("-->", m.end())
                at = start = len(page) if end < 0 else end + 3
                continue
            if not m[3]:  # a declaration, an instruction or a stray end
                self._text(page[start : m.start()])
                end = page.find(">", m.end())
                at = start = len(page) if end < 0 else end + 1
                continue
            self._text(page[start : m.start()])
            tag, attributes, closed, at = m[3].lower(), {}, False, m.end()
            while True:
                a = ATTRIBUTE.match(page, at)
                if not a:
                    at = len(page)  # the page ends in the tag
                    break
                closed = page[a.end() - 2 : a.end()] == "/>" if a[1] else False
                at = a.end()
                if a[1]:
                    break
                if a[2]:
                    attributes.setdefault(a[2].lower(), html.unescape(a[3] or a[4] or a[5] or ""))
            start = at
            if m[2]:
                self._end(tag)
                continue
            if tag in RAW and not (closed and tag in ("svg", "math")):
                lower = page.lower() if lower is None else lower
                lower = lower if len(lower) == len(page) else "".join(c.lower() if len(c.lower()) == 1 else c for c in page)
                end = lower.find(f"</{tag}", at)
                if end >= 0:
                    end = page.find(">", end)
                at = start = len(page) if end < 0 else end + 1
                continue
            self._begin(tag, attributes, closed)
        self._text(page[start:])
        self._cut(1)
        self._flush()


def _comments(root: Element) -> None:
    """Marks siblings of one tag most of which are signed, two or more, and all within."""
    todo = [root]
    while todo:
        e = todo.pop()
        if not e.kids:
            continue
        todo += e.kids
        if e.speaks:
            for k in e.kids:
                k.speaks = True
            continue
        for tag in ("li", "div", "article", "section", "dd", "tr"):
            some = [k for k in e.kids if k.tag == tag]
            if len(some) >= 2 and 2 * sum(k.signed for k in some) > len(some) and e.tag not in ("body", "html", ""):
                for k in some:
                    k.speaks = True


def _against(e: Element, frame: set[int]) -> bool:
    """Whether a block-level element or one around it speaks against its text."""
    return e.never or e.speaks or e.form is not None and id(e.form) not in frame


def _smooth(x: list[float]) -> list[float]:
    left, own, right = WEIGHTS
    out = []
    for i, v in enumerate(x):
        total, weight = own * v, own
        if i:
            total, weight = total + left * x[i - 1], weight + left
        if i + 1 < len(x):
            total, weight = total + right * x[i + 1], weight + right
        out.append(total / weight)
    return out


def extract(page: str | None) -> str:
    """The main text of a page."""
    p = Page(page or "")
    if not p.blocks:
        return ""
    _comments(p.root)
    total = sum(len(t) for e, t, _ in p.blocks if not e.never)
    forms: dict[int, int] = {}
    for e, t, _ in p.blocks:
        if e.form is not None and not e.never:
            forms[id(e.form)] = forms.get(id(e.form), 0) + len(t)
    frame = {f for f, n in forms.items() if n >= FRAME * total}
    lists: dict[int, list[int]] = {}
    for e, t, links in p.blocks:
        up = e if e.tag in LISTS else e.parent
        if up is not None and up.tag in LISTS:
            of = lists.setdefault(id(up), [0, 0, 0])
            of[0], of[1], of[2] = of[0] + len(t), of[1] + links, of[2] + 1
    menus = {k for k, (n, links, count) in lists.items() if links > LINKS * n and count > 1}
    rows = [(e, t, links) for e, t, links in p.blocks if not _against(e, frame) and id(e if e.tag in LISTS else e.parent) not in menus]
    if not rows:
        return ""
    # ratios by path, smoothed over the blocks, and fused
    length, marks, count = {}, {}, {}
    for e, t, links in rows:
        free = max(0, len(t) - links) / max(1, len(t))
        length[e.path] = length.get(e.path, 0) + free * len(t)
        marks[e.path] = marks.get(e.path, 0) + free * len(PUNCTUATION.findall(t))
        count[e.path] = count.get(e.path, 0) + 1
    by_length = _smooth([length[e.path] / count[e.path] for e, _, _ in rows])
    by_marks = _smooth([marks[e.path] / count[e.path] for e, _, _ in rows])
    score: dict[int, float] = {}
    for (e, _, _), x, y in zip(rows, by_length, by_marks):
        score[e.path] = score.get(e.path, 0) + x * (1 + y) * (INSIDE if e.article is not None else 1) / count[e.path]
    mean = sum(score[q] * n for q, n in length.items()) / max(1e-9, sum(length.values()))
    content = {q for q, s in score.items() if s >= THRESHOLD * mean}
    chosen = [e.path in content for e, _, _ in rows]
    # short blocks of the same containers
    first: dict[int, int] = {}
    last: dict[int, int] = {}
    articles = set()
    for i, (e, _, _) in enumerate(rows):
        if chosen[i]:
            for up in (e, e.parent):
                if up is not None:
                    first.setdefault(id(up), i)
                    last[id(up)] = i
            articles.add(id(e.article) if e.article is not None else 0)
    start = chosen.index(True) if True in chosen else len(rows)
    out = []
    for i, (e, t, links) in enumerate(rows):
        if not chosen[i]:
            if e.article is not None and id(e.article) in articles:
                pass
            elif e.tag in HEADINGS and start - BEFORE <= i < start or e.tag in HEADINGS and i + 1 < len(rows) and chosen[i + 1]:
                pass
            else:
                up, steps, near = e, 0, False
                while up is not None and steps < 4 and not near:
                    near = id(up) in first and first[id(up)] < i < last[id(up)]
                    up, steps = up.parent, steps + 1
                if not near or links > LINKS * len(t):
                    continue
        out.append(t)
    return " ".join(out)


def main_text(pages: DataFrame, column: str = "html") -> DataFrame:
    """pages without column, with text and n_chars (code points)."""
    keep = [c for c in pages.columns if c not in (column, "text", "n_chars")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                texts = [extract(x.as_py()) for x in part.column(column)]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*keep, "text", "n_chars"])

    schema = T.StructType([*[pages.schema[c] for c in keep], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return pages.select(*keep, column).mapInArrow(run, schema)
