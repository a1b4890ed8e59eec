"""Main text of a page by a minimum cut.

A page becomes blocks of text in page order. A linear classifier turns each
block's features into two costs, of calling it content and of calling it
boilerplate; they are the capacities to the two terminals. Neighbouring blocks,
and a container of the page and its blocks, are joined by smoothness edges. The
minimum cut of this graph labels the blocks.
"""

from __future__ import annotations

import html
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantlens.llm.common import map_batches

#: Elements whose content is never text of the page.
SILENT = {"script", "style", "noscript", "template", "svg", "math", "iframe", "object", "canvas", "select", "textarea", "head", "title", "button"}
RAW = {"script", "style", "textarea", "title", "iframe", "noscript", "svg", "template", "select"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "img", "wbr"}
#: Elements and roles that are boilerplate, or hold the content.
ASIDE = {"nav", "footer", "aside", "form", "menu", "dialog", "header"}
MAIN = {"article", "main"}
BAD_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar"}
#: Words of class names and ids, as the first or last part of a name.
BAD_WORDS = set("ad ads advert adverts advertisement banner sponsor sponsored promo promotion cookie cookies consent notice notices notification notifications alert alerts announcement disclaimer toolbar gdpr popup modal overlay newsletter subscribe signup nav navbar navigation menu breadcrumb breadcrumbs sidebar side widget widgets footer header masthead topbar share social comment comments commentlist respond reply replies disqus related recommended pagination pager login search".split())
GOOD_WORDS = set("article post entry story content main body text page".split())
#: A name that begins or ends so tells of a state or a layout, not of what the element holds.
STATES = {"has", "with", "without", "no", "is", "not", "hide", "show"}, {"enabled", "disabled", "open", "closed", "on", "off", "visible", "hidden"}
#: Elements that hold text itself; their names say less than those of containers.
TEXTUAL = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "td", "th", "pre", "blockquote", "figcaption", "caption"}
#: Weights of the classifier: what a feature adds to the score of content. Those
#: of places hold for the nearest container; FAR of it is left further inside.
WEIGHTS = {"bias": -0.6, "words": 0.06, "link_share": -2.5, "stops": 0.4, "heading": 0.3, "no_main": 0.3, "outside_main": -1.5}
IN_MAIN, IN_ASIDE, BAD_NAME, BAD_TEXT_NAME, GOOD_NAME, FAR = 3.5, -5.0, -4.5, -1.75, 1.2, 0.3
MOST_WORDS = 25
#: Smoothness: of blocks that follow each other (divided by how far apart they
#: are in the tree), of a container and its blocks, of a container and the next outside it.
NEIGHBOURS, CONTAINER, OUTER = 1.0, 0.5, 0.3

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)(?:>|$)", re.S)
_ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style)(?=[\s=/>]|$)(?:\s*=\s*("[^"]*"?|'[^']*'?|[^\s>]*))?""", re.I)
_SPACE = re.compile(r"\s+")


@dataclass
class Block:
    text: str
    container: int
    depth: int
    in_main: bool
    place: float  # evidence of the containers: above 0 for content
    heading: bool
    linked: int


@dataclass
class _Open:
    tag: str
    number: int
    in_main: bool = False
    in_aside: bool = False
    place: float = 0.0
    named: float = 0.0  # the part of place that names have given
    silent: bool = False
    link: bool = False
    heading: bool = False


def name_evidence(names: str) -> int:
    """-1 for a name of boilerplate, 1 for one of content, 0 for neither or both."""
    good = bad = False
    for name in names.lower().split():
        parts = [x for x in re.split(r"[-_]+", name) if x]
        if not parts or parts[0] in STATES[0] or (len(parts) > 1 and parts[-1] in STATES[1]):
            continue
        ends = {parts[0], parts[-1]}
        bad |= bool(ends & BAD_WORDS)
        good |= bool(ends & GOOD_WORDS) and not ends & BAD_WORDS
    return good - bad


def _enter(tag: str, attributes: str, parent: _Open, number: int, in_article: bool) -> _Open:
    values = {k.lower(): (v or "").strip("\"'") for k, v in _ATTRIBUTE.findall(attributes)} if attributes else {}
    role = values.get("role", "").lower()
    hidden = "hidden" in values or values.get("aria-hidden") == "true" or "display:none" in values.get("style", "").replace(" ", "").lower()
    names = name_evidence(f"{values.get('class', '')} {values.get('id', '')}") if values and tag not in ("html", "body") and tag not in INLINE else 0
    # a header inside an article holds its headline
    aside = (tag in ASIDE and not (tag == "header" and in_article)) or role in BAD_ROLES
    main = (tag in MAIN or role == "main") and names >= 0
    e = _Open(tag, number, parent.in_main or main, parent.in_aside or aside, parent.place, parent.named, parent.silent or tag in SILENT or hidden, parent.link or tag == "a")
    e.heading = tag in ("h1", "h2", "h3", "h4", "h5", "h6") or (parent.heading and tag in INLINE)
    if aside:
        e.place, e.named = IN_ASIDE + FAR * min(0.0, parent.place), FAR * min(0.0, parent.named)
    elif main and not parent.in_main and not parent.in_aside:
        e.place, e.named = IN_MAIN + FAR * parent.place, FAR * parent.named
    elif names < 0:
        far, own = (1.0, BAD_TEXT_NAME) if tag in TEXTUAL else (FAR, BAD_NAME)
        e.place, e.named = far * parent.place + own, far * parent.named + own
    elif names > 0 and not parent.in_main and not parent.in_aside:
        # inside boilerplate such a name says little
        e.place = parent.place + GOOD_NAME if parent.place < 0 else max(parent.place, GOOD_NAME)
        e.named = parent.named + e.place - parent.place
    return e


#: an open element of the first kind ends where one of the second begins
_ENDS = {"p": None, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}


class _Tree:
    """The open elements. Of each tag, and of all that are no inline elements,
    the places in the stack are kept, so that no step walks the stack."""

    def __init__(self):
        self.stack = [_Open("", 0)]
        self.places: dict[str, list[int]] = {}
        self.outer = [0]

    def push(self, e: _Open) -> None:
        self.places.setdefault(e.tag, []).append(len(self.stack))
        if e.tag not in INLINE:
            self.outer.append(len(self.stack))
        self.stack.append(e)

    def cut(self, at: int) -> None:
        while len(self.stack) > at:
            e = self.stack.pop()
            self.places[e.tag].pop()
            if e.tag not in INLINE:
                self.outer.pop()

    def last(self, tag: str) -> int:
        found = self.places.get(tag)
        return found[-1] if found else 0

    @property
    def container(self) -> _Open:
        return self.stack[self.outer[-1]]


@dataclass
class Page:
    blocks: list[Block] = field(default_factory=list)
    #: of each container of a block: the next container outside it
    outside: dict[int, int] = field(default_factory=dict)


def page_of(page: str, by_names: bool = True) -> Page:
    """Blocks of text in page order, each with where it stands. Takes time in
    proportion to the page, however deep its elements are nested."""
    tree, out = _Tree(), Page()
    said: list[str] = []
    linked = number = 0

    def close() -> None:
        nonlocal linked
        text = _SPACE.sub(" ", html.unescape("".join(said))).strip()
        if text:
            c = tree.container
            place = c.place if by_names else c.place - c.named
            out.blocks.append(Block(text, c.number, len(tree.outer), c.in_main, place, c.heading, min(linked, len(text))))
            out.outside.setdefault(c.number, tree.stack[tree.outer[-2]].number if len(tree.outer) > 1 else -1)
        said.clear()
        linked = 0

    def say(raw: str) -> None:
        nonlocal linked
        top = tree.stack[-1]
        if raw and not top.silent:
            said.append(raw)
            if top.link:
                linked += len(raw.strip())

    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            say(page[at:])
            break
        say(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                say(html.escape(m[0][9:].removesuffix("]]>"), quote=False))
            continue
        tag = m[2].lower()
        if tag == "br":  # white space inside its block
            say(" ")
            continue
        if tag not in INLINE:
            close()
        if m[1]:
            i = tree.last(tag)
            if i and (tag not in INLINE or i > tree.outer[-1]):
                tree.cut(i)
            continue
        if tag in VOID:
            continue
        if tag not in INLINE:
            ends = _ENDS.get(tree.container.tag, ())
            if ends is None or tag in ends:
                tree.cut(tree.outer[-1])
        number += 1
        tree.push(_enter(tag, m[3], tree.stack[-1], number, bool(tree.last("article"))))
        if m[3].endswith("/") and tag in ("svg", "path", "iframe"):
            tree.cut(len(tree.stack) - 1)
        elif tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            tree.cut(len(tree.stack) - 1)
            at = end.end() if end else n
    close()
    return out


def costs(b: Block, main_exists: bool) -> float:
    """Score of content: above 0 for content, below for boilerplate."""
    w = WEIGHTS
    words = b.text.count(" ") + 1
    s = w["bias"] + w["words"] * min(words, MOST_WORDS) + w["link_share"] * b.linked / len(b.text)
    s += w["stops"] * (b.text[-1] in ".!?…\"'") + w["heading"] * b.heading + b.place
    return s + (w["outside_main"] * (not b.in_main) if main_exists else w["no_main"])


class Cut:
    """Maximum flow by shortest augmenting levels; sparse, with float capacities."""

    def __init__(self, nodes: int):
        self.to: list[int] = []
        self.left: list[float] = []
        self.out: list[list[int]] = [[] for _ in range(nodes)]

    def join(self, a: int, b: int, forward: float, back: float = 0.0) -> None:
        for x, y, c in ((a, b, forward), (b, a, back)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.left.append(c)

    def _levels(self, s: int) -> list[int]:
        level = [-1] * len(self.out)
        level[s] = 0
        queue = deque([s])
        while queue:
            x = queue.popleft()
            for e in self.out[x]:
                if self.left[e] > 1e-9 and level[self.to[e]] < 0:
                    level[self.to[e]] = level[x] + 1
                    queue.append(self.to[e])
        return level

    def source_side(self, s: int, t: int) -> list[bool]:
        while (level := self._levels(s))[t] >= 0:
            tried = [0] * len(self.out)
            path: list[int] = []
            x = s
            while True:
                if x == t:
                    f = min(self.left[e] for e in path)
                    for k, e in enumerate(path):
                        self.left[e] -= f
                        self.left[e ^ 1] += f
                    k = next(k for k, e in enumerate(path) if self.left[e] <= 1e-9)
                    x = self.to[path[k] ^ 1]
                    del path[k:]
                    continue
                while tried[x] < len(self.out[x]):
                    e = self.out[x][tried[x]]
                    if self.left[e] > 1e-9 and level[self.to[e]] == level[x] + 1:
                        path.append(e)
                        x = self.to[e]
                        break
                    tried[x] += 1
                else:
                    if not path:
                        break
                    x = self.to[path.pop() ^ 1]
                    tried[x] += 1
        return [v >= 0 for v in level]


def label(page: Page) -> list[bool]:
    """For each block whether the minimum cut calls it content."""
    blocks = page.blocks
    if not blocks:
        return []
    main = any(b.in_main for b in blocks)
    n = len(blocks)
    containers = {c: n + i for i, c in enumerate(page.outside)}
    s, t = n + len(containers), n + len(containers) + 1
    g = Cut(t + 1)
    for i, b in enumerate(blocks):
        c = costs(b, main)
        g.join(s, i, c) if c > 0 else g.join(i, t, -c)
        if i:
            a = blocks[i - 1]
            near = NEIGHBOURS if a.container == b.container else NEIGHBOURS / (1 + abs(a.depth - b.depth) + (a.place != b.place))
            g.join(i - 1, i, near, near)
        g.join(i, containers[b.container], CONTAINER, CONTAINER)
    for c, outer in page.outside.items():
        if outer in containers:
            g.join(containers[c], containers[outer], OUTER, OUTER)
    return g.source_side(s, t)[:n]


def main_text(page: str) -> str:
    """The blocks that the cut calls content. Where it calls none so, as where
    a wrapper of all has a name of boilerplate, names do not count."""
    for by_names in (True, False):
        p = page_of(page, by_names)
        kept = [b.text for b, keep in zip(p.blocks, label(p)) if keep]
        if kept or not any(b.place < 0 for b in p.blocks):
            break
    return "\n".join(kept)


def extract_text(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, the main text of every whole page, and its code points
    (n_chars). A null or empty page has an empty text. Repeated rows are
    extracted each; other columns are not read."""
    pages = df.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p) for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return map_batches(pages, run, "page_id long, url string, text string, n_chars long")
