"""Main text of web pages: blocks are labelled content or boilerplate by a minimum cut."""

from __future__ import annotations

import html
import re
from bisect import bisect_left, bisect_right
from collections import defaultdict, deque
from collections.abc import Iterable, Iterator
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Element names of HTML by what they do to text.
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose inside is no markup: it ends at the first end tag of that name.
RAW = frozenset("script style noscript iframe textarea title noembed noframes xmp".split())
#: Elements whose inside is markup that shows no text of the page.
SILENT = frozenset("template object svg canvas audio video annotation annotation-xml".split())
#: Start tags that end an unclosed svg, and the elements inside which they do not.
BREAKS_SVG = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 hr i img li listing menu nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
IN_SVG = frozenset("foreignobject desc".split())
BOILER = frozenset("nav footer aside form menu button select dialog fieldset header search option legend".split())
ENDS_P = BLOCKS - {"button", "option", "optgroup", "legend", "caption"}
SAME = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
WALLS = frozenset("ul ol dl table div article section main body nav aside footer header form".split())
#: Words of class, id and role that mark what is no content. A class counts whole: "share-buttons" is one, "share-price" is not.
HINTS = frozenset(
    "ad ads adbox advert adverts advertisement advertising sponsor sponsored sponsors promo promotion promoted cookie cookies consent gdpr newsletter subscribe subscription "
    "signup signin login popup related recommended recommendations share sharing social comment comments commentlist respond reply replies disqus discussion footer nav "
    "navbar navigation menu breadcrumb breadcrumbs pagination pager copyright legal disclaimer paywall".split()
)
#: Words that may also name the frame around an article: they count unless the article begins further in.
FRAMES = frozenset("sidebar widget widgets banner notice notices alert overlay modal header masthead skip toolbar search complementary contentinfo side".split())
#: Words that say what a part of a page is built of, not what it is about: beside a hint they leave it whole.
PLAIN = frozenset(
    "area article articles author bar block blocks body bottom box btn button buttons card col column container content count cta date div element entry footer form frame global group holder "
    "icon icons inline inner item items js label left line link links list main media meta module now outer page panel policy post posts primary right row secondary section site slot small "
    "sticky stories story strip tab text thread title top unit wrap wrapper zone".split()
)
#: Names of reader comments; they count on an article that lies in another.
READERS = frozenset("comment comments commentlist reply replies respond".split())

_TAG = re.compile(r"</?[A-Za-z][^<>\"']*+(?:(?:\"[^\"<>]*+\"|'[^'<>]*+')[^<>\"']*+)*+>")
_OTHER = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)", re.S)
_OPENS = re.compile(r"</?[A-Za-z]")
_BROKEN_TAG = re.compile(r"</?[A-Za-z][^<>]*+(?:>|\Z)")
_MARKS = re.compile(r"[>\"']")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}
_NAME = re.compile(r"</?([A-Za-z][^\s/>]*)")
_ATTR = re.compile(r"\b(class|id|role|style|aria-hidden|hidden|aria-label|itemprop)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_GAP = re.compile(r"\s+")

#: Weights of the block classifier, in log odds of content; links weigh less in an article.
WEIGHTS = {"offset": -1.2, "length": 0.9, "links": -5.0, "links_good": -2.3, "good": 3.0, "boiler": -15.0, "hint": -15.0, "doubt": -1.0, "hidden": -20.0, "heading": 1.0, "stops": 0.4}
SMOOTH = 1.5


def _hint(value: str) -> tuple[int, bool]:
    """(2 where a class is a hint and nothing else, 1 where it is or may be a frame; whether one only holds the word of a hint)."""
    level, doubt = 0, False
    for token in value.split():
        words = {w.lower() for w in _WORD.findall(token)}
        if words & HINTS:
            whole = all(len(w) == 1 or w in HINTS or w in FRAMES or w in PLAIN for w in words)
            level, doubt = max(level, 2 if whole else 1 if words & FRAMES else 0), doubt or not whole
        elif words & FRAMES:
            level = max(level, 1)
    return level, doubt


class _Element:
    """An open element, with what it and its ancestors say of the text inside, so that no one walks up the page for it.

    `boiler` and `hint` are for good; `frame` ends where an article begins further in, and so does `doubt` outside any article.
    """

    __slots__ = ("name", "key", "up", "depth", "silent", "link", "good", "boiler", "hint", "frame", "doubt", "hidden", "heading")

    def __init__(self, name: str, tag: str, key: int, up: _Element | None):
        self.name, self.key, self.up = name, key, up
        self.depth = up.depth + 1 if up else 1
        within = up is not None and up.good
        role, classes, hidden, body = "", "", False, False
        if len(tag) > len(name) + 2:
            for m in _ATTR.finditer(tag, len(name) + 1):
                kind, value = m[1].lower(), html.unescape(m[2] or m[3] or m[4] or "")
                if kind in ("class", "id", "role"):
                    classes += " " + value
                    role = value.strip().lower() if kind == "role" else role
                elif kind == "style":
                    hidden |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I))
                elif kind == "itemprop":
                    body |= value.strip().lower() == "articlebody"
                elif kind == "hidden" or kind == "aria-hidden" and value.lower() == "true":
                    hidden = True
        words = {w.lower() for w in _WORD.findall(classes)}
        own = name in ("article", "main") or role == "main" or body or "articlebody" in words
        level, doubt = (0, False) if name in ("html", "body") or not classes else _hint(classes)
        if own:
            level, doubt = 2 if level == 2 and within and words & READERS else 0, False
        roles = role in ("navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu")
        boiler = name in BOILER and not (name == "header" and within) or roles
        soft = name in ("form", "header")
        self.good = own or within
        self.link = name == "a" or up is not None and up.link
        self.silent = up.silent if up and up.silent else self.depth if name in SILENT else 0
        self.hidden = hidden or up is not None and up.hidden
        self.heading = name in ("h1", "h2", "h3") or up is not None and up.heading
        self.boiler = boiler and not soft or up is not None and up.boiler
        self.hint = level > 1 or up is not None and up.hint
        self.frame = not own and (level == 1 or boiler and soft or doubt and not within or up is not None and up.frame)
        self.doubt = not own and (doubt and within or up is not None and up.doubt)


class Block:
    """A run of text between block elements, with the innermost element around it, if any."""

    __slots__ = ("text", "links", "top", "good", "boiler", "hint", "doubt", "hidden", "heading")

    def __init__(self, text: str, links: int, top: _Element | None):
        self.text, self.links, self.top = text, links, top
        self.good = self.boiler = self.hint = self.doubt = self.hidden = self.heading = False
        if top:
            self.good, self.boiler, self.hint = top.good, top.boiler, top.hint or top.frame
            self.doubt, self.hidden, self.heading = top.doubt, top.hidden, top.heading


class _Open:
    """The open elements, with the places of each name, so that the innermost of a name is at hand."""

    def __init__(self) -> None:
        self.stack: list[_Element] = []
        self.places: dict[str, list[int]] = defaultdict(list)
        self.walls: list[int] = []

    @property
    def silent(self) -> bool:
        return bool(self.stack and self.stack[-1].silent)

    @property
    def shown(self) -> int:
        """Place of the outermost element that shows no text, or the number of open elements."""
        return self.stack[-1].silent - 1 if self.silent else len(self.stack)

    def push(self, name: str, tag: str, key: int) -> None:
        at = len(self.stack)
        self.stack.append(_Element(name, tag, key, self.stack[-1] if at else None))
        self.places[name].append(at)
        if name in WALLS or name in SILENT:
            self.walls.append(at)

    def innermost(self, names: Iterable[str]) -> int:
        return max((self.places[n][-1] for n in names if n in self.places and self.places[n]), default=-1)

    def close(self, at: int) -> None:
        for e in self.stack[at:]:
            self.places[e.name].pop()
        del self.stack[at:]
        while self.walls and self.walls[-1] >= at:
            self.walls.pop()

    def end(self, names: Iterable[str]) -> None:
        """Close the innermost element of these names, unless a container stands between."""
        at = self.innermost(names)
        if at >= 0 and (not self.walls or at > self.walls[-1]):
            self.close(at)

    def end_svg(self) -> None:
        """Close the innermost svg, unless an element that may hold other markup stands between."""
        at = self.innermost(("svg",))
        if at > self.innermost((IN_SVG | SILENT) - {"svg"}):
            self.close(at)


class _Tokens:
    """The tags, texts and other marks of a page one after the other, in time in proportion to the page.

    A tag ends at the first > outside quotes. That is looked up from the quotes met on the way, and every quote remembers where
    a tag that opens it ends, so that unfinished tags do not read the page again and again.
    """

    def __init__(self, page: str):
        self.page = page
        self.marks: list[int] | None = None
        self.quotes: dict[str, list[int]] = {}
        self.ends: dict[int, int] = {}

    def at(self, at: int) -> str:
        page = self.page
        if page[at] != "<":
            end = page.find("<", at)
            return page[at : end if end >= 0 else len(page)]
        quick = _TAG.match(page, at) or _OTHER.match(page, at)
        if quick:
            return quick[0]
        if not _OPENS.match(page, at):
            return "<"
        end = self.tag_end(at)
        if end >= 0:
            return page[at : end + 1]
        broken = _BROKEN_TAG.match(page, at)
        return broken[0] if broken else "<"

    def tag_end(self, at: int) -> int:
        if self.marks is None:
            self.marks = [m.start() for m in _MARKS.finditer(self.page)]
            self.quotes = {q: [k for k in self.marks if self.page[k] == q] for q in "\"'"}
        passed, end = [], -1
        while (i := bisect_left(self.marks, at)) < len(self.marks):
            k = self.marks[i]
            if self.page[k] == ">" or k in self.ends:
                end = self.ends.get(k, k)
                break
            passed.append(k)
            same = self.quotes[self.page[k]]
            if (j := bisect_right(same, k)) == len(same):
                break
            at = same[j] + 1
        for k in passed:
            self.ends[k] = end
        return end


def blocks_of(page: str) -> list[Block]:
    """The blocks of a page in order. Unclosed elements end where HTML ends them; cut-off pages are read as far as they go."""
    out: list[Block] = []
    opened, tokens = _Open(), _Tokens(page)
    texts: list[str] = []
    links = keys = at = 0

    def close() -> None:
        nonlocal links
        text = _GAP.sub(" ", "".join(texts)).strip()
        if text:
            shown = opened.shown
            out.append(Block(text, links, opened.stack[shown - 1] if shown else None))
        texts.clear()
        links = 0

    while at < len(page):
        token = tokens.at(at)
        at += len(token)
        silent = opened.silent
        if token[0] != "<" or token == "<":
            if not silent:
                text = html.unescape(token) if "&" in token else token
                texts.append(text)
                if opened.stack and opened.stack[-1].link:
                    links += len(text.strip())
            continue
        found = _NAME.match(token)
        if not found:
            if token.startswith("<![CDATA[") and not silent:
                texts.append(token[9:].removesuffix("]]>"))
            continue
        name, ending = found[1].lower(), token[1] == "/"
        if not ending and name in RAW:
            if not token.endswith("/>"):
                end = _RAW_END[name].search(page, at)
                at = end.start() if end else len(page)
            continue
        if name == "head":
            continue  # what may stand in it has no text; anything else ends it, with or without its end tag
        if ending:
            own = opened.innermost((name,))
            if name in BLOCKS and (own >= 0 or not silent) and own <= opened.shown:
                close()
            if name == "br" and not silent:
                texts.append(" ")
            if own >= 0:
                opened.close(own)
            continue
        if silent and name in BREAKS_SVG:
            opened.end_svg()
            silent = opened.silent
        if not silent:
            if name in BLOCKS:
                close()
            if name == "br":
                texts.append(" ")
        if name in ENDS_P:
            opened.end(("p",))
        if name in SAME:
            opened.end(SAME[name])
        if name in VOID or token.endswith("/>"):
            continue
        if name == "a":
            opened.end(("a",))
        keys += 1
        opened.push(name, token, keys)
    close()
    return out


def score(block: Block, weights: dict[str, float] = WEIGHTS) -> float:
    """Log odds that a block is content."""
    size = len(block.text)
    share = min(1.0, block.links / size)
    links, loss = (weights["links_good"], share / 2) if block.good else (weights["links"], share)
    value = weights["offset"] + weights["length"] * log(1 + size / 20) * (1 - loss) + links * share
    value += weights["stops"] * min(3, sum(block.text.count(c) for c in ".!?"))
    for name in ("good", "boiler", "hint", "doubt", "hidden", "heading"):
        value += weights[name] * getattr(block, name)
    return value


def _apart(a: _Element | None, b: _Element | None) -> int:
    """Steps from one element to the other by their common ancestor."""
    steps = 0
    while a is not b:
        if b is None or a is not None and a.depth >= b.depth:
            a = a.up
        else:
            b = b.up
        steps += 1
    return steps


def edges_of(blocks: list[Block], smooth: float = SMOOTH) -> list[tuple[int, int, float]]:
    """Smoothness between neighbours in the page, and between the next blocks below one parent; less with distance in the tree."""
    out = []
    last: dict[int, int] = {}
    for i, b in enumerate(blocks):
        if i:
            out.append((i - 1, i, smooth / (1 + _apart(blocks[i - 1].top, b.top))))
        parent = b.top.up.key if b.top and b.top.up else 0
        if parent in last and last[parent] < i - 1:
            out.append((last[parent], i, smooth / 3))
        last[parent] = i
    return out


def minimum_cut(source: list[float], sink: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """True for the nodes that stay with the source. Capacities: source to node, node to sink, and edges both ways.

    A node whose surplus to one side is more than all its edges stays on that side in any minimum cut; such nodes are
    settled first and their edges go to their neighbours' terminals. Flow is pushed along shortest paths through the rest.
    """
    n = len(source)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, c in edges:
        if a != b:
            near[a][b] = near[a].get(b, 0.0) + c
            near[b][a] = near[b].get(a, 0.0) + c
    gain = [s - t for s, t in zip(source, sink)]
    side: list[bool | None] = [None] * n
    todo = deque(range(n))
    while todo:
        v = todo.popleft()
        if side[v] is None and abs(gain[v]) > sum(near[v].values()):
            side[v] = gain[v] > 0
            for u, c in near[v].items():
                gain[u] += c if side[v] else -c
                del near[u][v]
                if side[u] is None:
                    todo.append(u)
            near[v] = {}
    for v in range(n):
        if side[v] is None:
            part, todo = {v}, deque([v])
            while todo:
                for u in near[todo.popleft()]:
                    if u not in part:
                        part.add(u)
                        todo.append(u)
            _flow(sorted(part), gain, near, side)
    return [bool(s) for s in side]


def _flow(rest: list[int], gain: list[float], near: list[dict[int, float]], side: list[bool | None]) -> None:
    """Augment along shortest paths until none is left; what the sources still reach is theirs."""
    supply = {v: gain[v] for v in rest if gain[v] > 0}
    demand = {v: -gain[v] for v in rest if gain[v] < 0}
    tiny = 1e-12
    while True:
        came: dict[int, int] = {v: -1 for v, s in supply.items() if s > tiny}
        queue, end = deque(came), -1
        while queue:
            v = queue.popleft()
            if demand.get(v, 0.0) > tiny:
                end = v
                break
            for u, c in near[v].items():
                if c > tiny and u not in came:
                    came[u] = v
                    queue.append(u)
        if end < 0:
            break
        path = [end]
        while came[path[-1]] >= 0:
            path.append(came[path[-1]])
        push = min([supply[path[-1]], demand[end], *(near[b][a] for a, b in zip(path, path[1:]))])
        supply[path[-1]] -= push
        demand[end] -= push
        for a, b in zip(path, path[1:]):
            near[b][a] -= push
            near[a][b] = near[a].get(b, 0.0) + push
    for v in rest:
        side[v] = v in came


def main_text(page: str | None) -> str:
    """The content blocks of a page, joined by line ends."""
    blocks = blocks_of(page or "")
    if not blocks:
        return ""
    scores = [score(b) for b in blocks]
    kept = minimum_cut([max(0.0, s) for s in scores], [max(0.0, -s) for s in scores], edges_of(blocks))
    return "\n".join(b.text for b, k in zip(blocks, kept) if k)


def html_text(pages: DataFrame) -> DataFrame:
    """Every row of pages (page_id, url, html): page_id, url, text (empty if none), n_chars (its code points).

    A page is cut into blocks at block elements; white space inside a block, br included, becomes one space, and character
    references are decoded. Scripts, styles, titles, embedded objects and comments have no blocks; a script or the like ends at its
    literal end tag, or else with the page, and the head at the first element that cannot stand in it. A linear classifier of
    each block gives the capacities to the two terminals; neighbouring blocks and blocks below one parent are tied by
    smoothness edges, weaker with their distance in the tree. The source side of the minimum cut is the text, in page order.
    A null or empty page gives an empty text; pages are read whole. Repeated rows give equal rows.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                texts = [main_text(p) for p in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(
        work, "page_id long, url string, text string, n_chars long"
    )
