"""Main text of HTML pages by minimum-cut labelling.

A page becomes a list of text blocks. A logistic regression over the block's own text (length, link density,
punctuation, heading, words by which boilerplate names itself, class and id words) and that of its two
neighbours gives each block a cost of being called content and one of being called boilerplate. What the
innermost explicit container says (article, nav, footer, advert classes and the like) adds to these, by amounts of the
order of the smoothness, so that neighbours can overrule it. The sums are the capacities of the block's edges to
the two terminals. Blocks that follow each other, or that are the nearest blocks under one DOM parent or
grandparent, are joined by smoothness edges. The minimum cut of that graph is the labelling of least
total cost; content blocks are joined in page order.

Of nested containers the innermost decides: an ``article`` or ``main`` inside a wrapper with a boilerplate word is
content again, but an ``article`` among comments, or in a ``nav``, ``aside`` or ``footer``, isn't. A class or id counts
as a whole (``sidebar``, ``cookie-notice``, ``ad-slot``), not by a part of it (``has-sidebar``, ``header-fixed``). On a page
without content containers, a form or a class that holds most of the page's prose is a wrapper and says nothing.

The regression is fitted on the blocks inside explicit containers of a bounded sample of pages (``SAMPLE``
pages least by the hash of their id, ``BLOCKS`` blocks of each), whose containers are their labels and no features. It
is held near the weights in ``PLAIN``, which decide alone where there are no blocks of both kinds.

Null, empty and text-free pages give an empty string. Nothing is truncated; broken markup (unclosed
elements, cut-off pages) is read as far as it goes. Character references to no code point, however long,
become U+FFFD. Repeated rows and null ids are pages of their own; columns of the outputs' names are replaced.
"""

from __future__ import annotations

import html as _html
import re
from collections import deque

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import add_columns, hash_share, table

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S,
)
_ATTR = re.compile(r"([^\s=\"'/<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SPACE = re.compile(r"\s+")
_HINT = re.compile(r"[A-Za-z]+")
_ZEROS, _HUGE = re.compile(r"&#0+(?=[0-9])"), re.compile(r"&#[1-9][0-9]{7,};?")

#: Elements whose content is no text of the page.
DROPPED = frozenset("script style noscript template iframe svg math object select option button textarea head title canvas audio video map datalist".split())
#: Of these the content isn't markup, so only their own end tag ends them.
RAW = frozenset("script style textarea title noscript iframe".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr data".split())
#: Containers that speak for themselves.
BOILER_TAGS = frozenset("nav header footer aside form menu dialog fieldset address".split())
CONTENT_TAGS = frozenset("article main".split())
BOILER_HINTS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar side aside nav navbar navigation menu menubar breadcrumb breadcrumbs"
    " header masthead footer foot cookie cookies consent gdpr notice notices alert newsletter subscribe signup login popup modal overlay share sharing social related recommended"
    " comment comments disqus respond reply replies discussion toolbar pagination pager widget copyright legal disclaimer search form skip hidden".split()
)
CONTENT_HINTS = frozenset("article content main post entry story body text prose".split())
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar alertdialog".split())
#: Boilerplate whose articles are no main text either: containers, and class words that count on articles, too.
SEALED_TAGS = frozenset("nav footer aside menu dialog".split())
SEALED_HINTS = frozenset("comment comments disqus respond reply replies discussion related recommended".split())
#: Parts of a class that leave its meaning to the others.
NEUTRAL = frozenset("box slot unit block wrapper wrap container area panel section list bar links item items content inner outer text site page main global top bottom left right primary secondary article post entry".split())
#: Words by which a short block says itself that it is boilerplate.
_NAMES_ITSELF = re.compile(r"^©|all rights reserved|^(?:advertisement|sponsored|promoted|share this|related (?:articles|posts|stories)|read more|subscribe|sign up|log in|leave a (?:comment|reply)|we use cookies)\b", re.I)

#: Capacities (integers, so that flows are exact): of a boilerplate container, of a content container and of being outside all of a page that has one, the most that the classifier adds and what it adds for each unit of log odds; smoothness.
BOILER, CONTENT, OUTSIDE, MOST, ODDS, SMOOTH_NEXT, SMOOTH_PARENT, SMOOTH_GRAND = 18, 16, 16, 10, 3, 2, 3, 1
#: Pages of the fitting sample, blocks read of each; pull towards PLAIN for each row of the fit.
SAMPLE, BLOCKS, PULL = 2000, 64, 0.01
#: Weights of ``features`` where nothing can be learned.
PLAIN = (-1.5, 1.0, -4.0, 2.5, 1.0, -0.5, -2.5, 1.5, 1.0, -0.5)


def _named(value: str, words: frozenset[str]) -> bool:
    """Is one of the classes, as a whole, one of ``words`` (or made of them and neutral parts)?"""
    for token in value.lower().split():
        parts = [x for x in re.split(r"[-_]+|\d+", token) if x]
        if any(x in words for x in parts) and all(x in words or x in NEUTRAL or x in BOILER_HINTS for x in parts):
            return True
    return False


class _Node:
    """An element. kind: 1 content, -1 boilerplate, 0 neither, as the innermost container ``by`` says; sealed: 1 no article, 2 nothing inside is content."""

    __slots__ = ("by", "hint", "kind", "parent", "sealed", "serial", "tag")

    def __init__(self, tag: str, parent: _Node | None, serial: int, attrs: str = ""):
        self.tag, self.parent, self.serial = tag, parent, serial
        self.kind, self.by, self.sealed, self.hint = (parent.kind, parent.by, parent.sealed, parent.hint) if parent else (0, None, 0, 0)
        says = -1 if tag in BOILER_TAGS else 1 if tag in CONTENT_TAGS else 0
        seal, whole = int(tag in SEALED_TAGS), tag == "main"
        for m in _ATTR.finditer(attrs) if attrs else ():
            name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if name in ("class", "id"):
                if _named(value, SEALED_HINTS) and tag not in ("html", "body", "main"):
                    says, seal = -1, max(seal, 1)
                elif tag not in ("html", "body", "article", "main") and _named(value, BOILER_HINTS):
                    says = -1
                elif set(_HINT.findall(value.lower())) & CONTENT_HINTS:
                    self.hint += 1
            elif name == "role":
                if value.lower() in BOILER_ROLES:
                    says = -1
                elif value.lower() in ("main", "article"):
                    says, whole = 1, value.lower() == "main"
            elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
                says, seal = -1, 2
        if says < 0:
            self.kind, self.by, self.sealed = -1, self, max(seal, self.sealed)
        elif says > 0 and self.sealed < (2 if whole else 1):
            self.kind, self.by, self.sealed = 1, self, 0


def unescape(text: str) -> str:
    """Character references decoded; numbers beyond all code points are replaced before their digits are read."""
    if "&#" in text:
        text = _HUGE.sub("\ufffd", _ZEROS.sub("&#", text))
    return _html.unescape(text)


def blocks(page: str) -> list[tuple[str, int, _Node]]:
    """(text, characters inside links, DOM node) of each text block in page order."""
    out: list[tuple[str, int, _Node]] = []
    serial = 0
    node = root = _Node("#root", None, 0)
    parts: list[str] = []
    linked = 0
    in_link = False
    pos, end = 0, len(page)

    def flush() -> None:
        nonlocal linked
        if parts:
            text = _SPACE.sub(" ", unescape("".join(parts))).strip()
            if text:
                out.append((text, linked, node))
            parts.clear()
        linked = 0

    def text_of(a: int, b: int) -> None:
        nonlocal linked
        if a < b:
            parts.append(page[a:b])
            if in_link:
                linked += b - a

    while pos < end:
        at = page.find("<", pos)
        if at < 0:
            text_of(pos, end)
            break
        text_of(pos, at)
        m = _TOKEN.match(page, at)
        if not m:
            parts.append("&lt;")
            pos = at + 1
            continue
        pos = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        closing, tag, attrs = m[1] or m[4], tag.lower(), m[3] or m[6] or ""
        if closing:
            if tag in INLINE and tag != "a":
                n = node
                while n.tag in INLINE and n.tag != tag:
                    n = n.parent
                if n.tag == tag and n.tag in INLINE:
                    flush()
                    node = n.parent
                continue
            if tag == "a":
                in_link = False
                if node.tag == "a":
                    flush()
                    node = node.parent
                continue
            if tag == "br":
                parts.append(" ")
                continue
            flush()
            in_link = False
            n = node
            while n is not root and n.tag != tag:
                n = n.parent
            if n is not root:
                node = n.parent
            continue
        if tag in VOID:
            if tag == "br":
                parts.append(" ")
            elif tag not in INLINE:
                flush() if tag == "hr" else None
            continue
        if tag in DROPPED:
            if attrs.rstrip().endswith("/") and tag not in RAW:
                continue
            if tag in RAW:
                e = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*>?", re.I).search(page, pos)
                pos = e.end() if e else end
            elif tag == "head":
                continue  # its own children are dropped one by one; an unclosed head must not take the page along
            else:
                depth = 1
                for e in re.compile(rf"<(/?){tag}(?=[\s/>])[^>]*>", re.I).finditer(page, pos):
                    depth += -1 if e[1] else 0 if e[0].endswith("/>") else 1
                    if not depth:
                        pos = e.end()
                        break
                else:
                    if tag != "option":
                        pos = end
            if tag not in ("script", "style"):
                flush() if tag not in ("svg", "math", "button", "select") else parts.append(" ")
            continue
        if tag in INLINE:
            in_link = in_link or tag == "a"
            if attrs and ("class" in attrs or "id" in attrs or "hidden" in attrs or "display" in attrs):
                trial = _Node(tag, node, serial + 1, attrs)
                if trial.kind < 0 <= node.kind:
                    flush()
                    serial += 1
                    node = trial
            continue
        flush()
        in_link = False
        if tag == "p" or tag in ("h1", "h2", "h3", "h4", "h5", "h6", "div", "ul", "ol", "table", "section", "article", "footer", "header", "nav", "aside", "main", "form", "blockquote", "pre"):
            n = node
            while n.tag in INLINE:
                n = n.parent
            if n.tag == "p":  # a paragraph ends where a block begins
                node = n.parent
        elif tag in ("li", "tr", "td", "th", "dt", "dd"):
            n, stop = node, {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",)}.get(tag, ("table",))
            same = (tag,) if tag in ("li", "tr") else ("dt", "dd") if tag in ("dt", "dd") else ("td", "th")
            while n is not root and n.tag not in stop and n.tag not in same:
                n = n.parent
            if n.tag in same:
                node = n.parent
        serial += 1
        if not attrs.rstrip().endswith("/"):
            node = _Node(tag, node, serial, attrs)
    flush()
    return out


def features(text: str, linked: int, node: _Node, near: tuple[float, float] = (0.0, 0.0)) -> list[float]:
    """What the classifier sees of a block (its containers are left out: they are the labels); ``near``: length and link density of its neighbours."""
    words = text.count(" ") + 1
    length, density = size(text, linked)
    return [
        1.0,
        length,
        density,
        float(text[-1] in ".!?…\"”»" and words > 4),
        float(node.tag in ("h1", "h2", "h3", "h4", "h5", "h6")),
        float(words < 3),
        float(words < 25 and bool(_NAMES_ITSELF.search(text))),
        float(min(2, node.hint)) / 2,
        *near,
    ]


def size(text: str, linked: int) -> tuple[float, float]:
    """Length (logarithm of the words, 1 for about 50) and link density of a block."""
    return min(1.0, float(np.log1p(text.count(" ") + 1)) / 4), min(1.0, linked / len(text))


def surroundings(found: list[tuple[str, int, _Node]]) -> list[tuple[float, float]]:
    """Mean length and link density of the blocks before and after each one."""
    own = [size(t, n) for t, n, _ in found]
    out = []
    for i in range(len(own)):
        side = own[max(0, i - 1) : i] + own[i + 1 : i + 2]
        out.append((sum(x[0] for x in side) / len(side), sum(x[1] for x in side) / len(side)) if side else (0.0, 0.0))
    return out


def kinds(found: list[tuple[str, int, _Node]]) -> list[int]:
    """What the innermost container says of each block; on pages without content containers, one that holds most of the prose (and three blocks of it) says nothing."""
    out = [n.kind for _, _, n in found]
    if 1 in out:
        return out
    prose: dict[int, list[int]] = {}
    total = 0
    for i, (text, linked, node) in enumerate(found):
        if node.sealed:
            continue
        total += max(0, len(text) - linked)
        if node.kind < 0 and text.count(" ") > 9 and text[-1] in ".!?…\"”»" and linked * 2 < len(text):
            prose.setdefault(node.by.serial, []).append(i)
    for serial, at in prose.items():
        if len(at) > 2 and 2 * sum(len(found[i][0]) for i in at) > total:
            out = [0 if n.kind < 0 and n.by.serial == serial else k for k, (_, _, n) in zip(out, found, strict=True)]
    return out


def seeds(page: str | None) -> np.ndarray:
    """Features and label (last column) of up to BLOCKS blocks inside explicit containers, evenly spread over the page."""
    found = blocks(page or "")
    rows = [(*features(*x, near), float(x[2].kind > 0)) for x, near in zip(found, surroundings(found), strict=True) if x[2].kind]
    return np.array(rows[:: max(1, -(-len(rows) // BLOCKS))], np.float32).reshape(-1, len(PLAIN) + 1)


def fit_weights(rows: np.ndarray, steps: int = 12, pull: float = PULL) -> tuple[float, ...]:
    """Logistic regression by Newton's method, held near PLAIN; both labels weigh the same in all."""
    x, y = rows[:, :-1].astype(np.float64), rows[:, -1].astype(np.float64)
    if not len(y) or y.min() == y.max():
        return PLAIN
    share = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    prior, ridge = np.array(PLAIN), 1.0 + pull * len(y)
    w = prior.copy()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (share * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w -= np.linalg.solve(h, x.T @ (share * (p - y)) + ridge * (w - prior))
    return tuple(float(v) for v in w)


def fit(pages: DataFrame, html: str = "html", page_id: str = "page_id", sample: int = SAMPLE) -> tuple[float, ...]:
    """The classifier's weights from a bounded sample: at most ``sample`` pages and BLOCKS rows of features of each reach the driver."""
    near = hash_share(pages.select(F.col(f"`{page_id}`").alias("page_id"), F.col(f"`{html}`").alias("html")), sample, "page_id")
    made = add_columns(near, ["html"], {"_f": "binary"}, lambda: lambda found: ([seeds(x).tobytes() for x in found],), drop=("html",))
    got = made.orderBy(F.xxhash64("page_id"), "page_id", "_f").limit(sample).toArrow()["_f"].to_pylist()
    return fit_weights(np.frombuffer(b"".join(got), np.float32).reshape(-1, len(PLAIN) + 1))


def costs(text: str, linked: int, node: _Node, has_content: bool, weights: tuple[float, ...] = PLAIN, near: tuple[float, float] = (0.0, 0.0), kind: int | None = None) -> tuple[int, int]:
    """Cost of calling the block boilerplate, cost of calling it content."""
    odds = sum(a * b for a, b in zip(weights, features(text, linked, node, near), strict=True))
    part = round(min(MOST, ODDS * abs(odds)))
    as_boiler, as_content = (1 + part, 1) if odds > 0 else (1, 1 + part)
    kind = node.kind if kind is None else kind
    if kind < 0:
        as_content += BOILER
    elif kind > 0:
        as_boiler += CONTENT
    elif has_content:
        as_content += OUTSIDE
    return as_boiler, as_content


def min_cut(source: list[int], sink: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """True for each node on the source side of a minimum cut (Dinic). Of several minimum cuts, the one with most nodes on the source side."""
    n = len(source)
    s, t = n, n + 1
    to: list[int] = []
    cap: list[int] = []
    adj: list[list[int]] = [[] for _ in range(n + 2)]

    def arc(u: int, v: int, c: int, back: int) -> None:
        adj[u].append(len(to))
        to.append(v)
        cap.append(c)
        adj[v].append(len(to))
        to.append(u)
        cap.append(back)

    for i in range(n):  # what flows straight through a node needs no search
        through = min(source[i], sink[i])
        arc(s, i, source[i] - through, 0)
        arc(i, t, sink[i] - through, 0)
    for u, v, c in edges:
        arc(u, v, c, c)
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = deque([s])
        while queue:
            u = queue.popleft()
            for e in adj[u]:
                if cap[e] and level[to[e]] < 0:
                    level[to[e]] = level[u] + 1
                    queue.append(to[e])
        if level[t] < 0:
            break
        at = [0] * (n + 2)
        while True:  # one augmenting path after another, without recursion
            path: list[int] = []
            u = s
            while u != t:
                while at[u] < len(adj[u]):
                    e = adj[u][at[u]]
                    if cap[e] and level[to[e]] == level[u] + 1:
                        break
                    at[u] += 1
                else:
                    if not path:
                        u = -1
                        break
                    e = path.pop()
                    u = to[e ^ 1]
                    at[u] += 1
                    continue
                path.append(e)
                u = to[e]
            if u < 0:
                break
            least = min(cap[e] for e in path)
            for e in path:
                cap[e] -= least
                cap[e ^ 1] += least
    reach = [False] * (n + 2)  # what still reaches the sink is boilerplate
    reach[t] = True
    queue = deque([t])
    while queue:
        v = queue.popleft()
        for e in adj[v]:
            if cap[e ^ 1] and not reach[to[e]]:
                reach[to[e]] = True
                queue.append(to[e])
    return [not reach[i] for i in range(n)]


def graph(found: list[tuple[str, int, _Node]], weights: tuple[float, ...] = PLAIN) -> tuple[list[int], list[int], list[tuple[int, int, int]]]:
    """Capacities from the source and to the sink, and the smoothness edges, of the blocks of a page."""
    said = kinds(found)
    terminal = [costs(*x, 1 in said, weights, near, kind) for x, near, kind in zip(found, surroundings(found), said, strict=True)]
    edges: list[tuple[int, int, int]] = []
    before: dict[tuple[int, int], int] = {}
    for i, (_, _, node) in enumerate(found):
        if i:
            edges.append((i - 1, i, SMOOTH_NEXT))
        up = node.parent or node
        for kind, anchor, weight in ((0, up.serial, SMOOTH_PARENT), (1, (up.parent or up).serial, SMOOTH_GRAND)):
            if (kind, anchor) in before:
                edges.append((before[kind, anchor], i, weight))
            before[kind, anchor] = i
    return [c for c, _ in terminal], [c for _, c in terminal], edges


def label(found: list[tuple[str, int, _Node]], weights: tuple[float, ...] = PLAIN) -> list[bool]:
    """Content (True) or boilerplate of each block, by the minimum cut."""
    return min_cut(*graph(found, weights))


def extract_text(page: str | None, weights: tuple[float, ...] = PLAIN) -> str:
    """The page's main text; blocks are joined by one space."""
    found = blocks(page or "")
    return " ".join(b[0] for b, keep in zip(found, label(found, weights), strict=True) if keep) if found else ""


def extract(pages: DataFrame, html: str = "html", text: str = "text", n_chars: str = "n_chars", weights: tuple[float, ...] = PLAIN) -> DataFrame:
    """Add the main text of ``html`` and its length in code points; other columns stay (same names are replaced).

    One narrow pass: no shuffle, one Arrow batch of pages in memory at a time.
    """

    def make():
        def of(found: list[str | None]) -> tuple[list[str], list[int]]:
            texts = [extract_text(x, weights) for x in found]
            return texts, [len(x) for x in texts]

        return of

    return add_columns(pages, [html], {text: "string", n_chars: "bigint"}, make)


def op1_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = table(spark, sf_dir, "pages")
    return extract(pages, weights=fit(pages)).select("page_id", "url", "text", "n_chars")
