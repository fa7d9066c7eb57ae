"""Main text of web pages: gradient-boosted trees over DOM nodes and a decoding over the tree.

Every block element of a page becomes a node with features of its subtree (text, tags, links),
its attribute tokens and those of its ancestors, its depth and its siblings. Boosted trees give each node a
probability of being main text. The decoding then picks, from the leaves up, the cheapest of
three choices for a subtree: keep it, drop it, or decide for each child. A kept subtree has no
dropped descendant and a dropped one no kept descendant.

There are no labels for nodes, so the trees learn from pages with an ``article`` or ``main``
element: what lies in it is main text. Pages are varied for learning (other container names,
further menus, notices, sidebars, forms and reader comments), so that the trees do not rest on that element.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field
from math import log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.tables import arrow_map

FIT_PAGES = 400          # pages learned from at most, those with the smallest hashes
FIT_CHARS = 4_000_000    # characters of all these pages together; the first page is taken whatever its length
TREES, DEPTH, BINS, SHRINK = 40, 4, 32, 0.25
SWITCH = 1.5             # cost of deciding for each child

# fixed values: elements of HTML by how they take part in the tree
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = set("script style noscript template iframe object svg math head select option textarea button canvas audio video".split())
# of these, what has no elements inside and so reaches to its end tag, or else to the end of the page
RAW = set("script style textarea iframe".split())
IN_HEAD = set("base basefont bgsound link meta noscript script style template title".split())
# end tags of elements around these do not end them
APART = set("object template".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike "
             "strong sub sup time tt u var wbr br img input".split())
CLOSES_P = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 "
               "h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
KINDS = [["p"], ["div"], ["article", "main"], ["section"], ["nav", "menu"], ["header"], ["footer"], ["aside"], ["form", "fieldset", "dialog"],
         ["ul", "ol", "dl"], ["li", "dt", "dd"], ["h1"], ["h2", "h3", "h4", "h5", "h6"], ["table", "tbody", "tr", "td", "th"],
         ["blockquote", "pre", "figure", "figcaption"], ["body", "html"]]
KIND = {tag: k for k, tags in enumerate(KINDS) for tag in tags}

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<[!?][^>]*>""", re.S)
_ATTR = re.compile(r"""\b(id|class|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_TOKEN = re.compile(r"[A-Za-z][a-z]*")


@dataclass
class Node:
    tag: str
    parent: int      # -1 for the root
    depth: int
    tokens: list[str] = field(default_factory=list)
    parts: list[tuple[int, str, bool]] = field(default_factory=list)  # (block number, text, inside a link)
    children: list[int] = field(default_factory=list)


def _end_tag(page: str, tag: str, at: int) -> int:
    """Where the next end tag of ``tag`` ends, -1 without one."""
    m = re.compile(rf"</{re.escape(tag)}(?:[\s/][^>]*)?>", re.I).search(page, at)
    return m.end() if m else -1


def _head_to(page: str, at: int) -> int:
    """The end of a head: behind its end tag, or before the first text or tag that cannot be in it."""
    while (m := _TAG.search(page, at)) is not None and not page[at:m.start()].strip("\ufeff \t\r\n\f"):
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "head":
                return at
            if tag in ("body", "html"):
                return m.start()
        elif tag not in IN_HEAD:
            return at if tag == "head" else m.start()
        elif tag in ("noscript", "script", "style", "template", "title") and not m[3].endswith("/"):
            end = _end_tag(page, tag, at)
            at = end if end >= 0 else len(page) if tag in RAW else at
    return at


def skipped_to(page: str, tag: str, at: int, around: dict[str, list[int]], ends: dict[str, int]) -> int:
    """Where an element of ``SKIPPED`` ends whose start tag ends at ``at``.

    ``around`` has the places of the open elements around it. ``ends`` keeps where the last end
    tag of each kind is. Raw text reaches to its end tag or the end of the page, a head as far as
    heads can. Anything else ends behind its own end tag, before the end tag of a block around it,
    an option also before the next one. Without an end tag of its own (none on the page any more,
    or another button or select comes first) it ends before the first block.
    """
    if tag in RAW or tag == "noscript":
        end = _end_tag(page, tag, at)
        if end >= 0:
            return end
        if tag in RAW:
            return len(page)
    if tag == "head":
        return _head_to(page, at)
    if tag not in ends:
        ends[tag] = max((m.start() for m in re.finditer(rf"</{re.escape(tag)}(?=[\s/>])", page, re.I)), default=-1)
    ended = ends[tag] >= at
    inside: dict[str, int] = {}
    first, own, here = -1, -1, at  # the first block inside, the last end tag of this kind
    while (m := _TAG.search(page, here)) is not None:
        here = m.end()
        if m[2] is None:
            continue
        t = m[2].lower()
        if m[1]:
            if t == tag and not inside.get(t):
                return here
            if t == tag:
                own = here
            if inside.get(t):
                inside[t] -= 1
            elif t not in INLINE and tag not in APART and (around.get(t) or t in ("body", "html", "datalist", "select")):
                return m.start()
            continue
        if tag == "option" and t in ("option", "optgroup"):
            return m.start()
        if t == tag and tag in ("button", "select"):  # the end tag behind is that one's
            return first if first >= 0 else m.start()
        if t not in INLINE and t not in VOID and t not in ("option", "optgroup"):
            if not ended:
                return m.start()
            first = first if first >= 0 else m.start()
        if m[3].endswith("/") or t in VOID:
            continue
        if t in RAW:
            end = _end_tag(page, t, here)
            here = end if end >= 0 else len(page)
        else:
            inside[t] = inside.get(t, 0) + 1
    if ended:
        ends[tag] = -1
    return own if own >= 0 else first if first >= 0 else at


def parse(page: str) -> list[Node]:
    """Block elements of a page in page order, the root first; a parent precedes its children."""
    nodes = [Node("html", -1, 0)]
    stack: list[tuple[str, int]] = [("html", 0)]  # open elements with their block node
    places: dict[str, list[int]] = {}  # where each tag is in the stack
    blocks = [0]                       # where blocks are in the stack
    ends: dict[str, int] = {}          # where the last end tag of a skipped element is
    links, block, at = 0, 0, 0

    def push(tag: str, node: int) -> None:
        places.setdefault(tag, []).append(len(stack))
        if tag not in INLINE:
            blocks.append(len(stack))
        stack.append((tag, node))

    def pop() -> str:
        tag = stack.pop()[0]
        places[tag].pop()
        if tag not in INLINE:
            blocks.pop()
        return tag

    def say(text: str) -> None:
        if text:
            nodes[stack[-1][1]].parts.append((block, html.unescape(text), links > 0))

    while True:
        m = _TAG.search(page, at)
        if m is None:
            say(page[at:])
            return nodes
        say(page[at:m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag, closing = m[2].lower(), bool(m[1])
        if closing:
            k = places[tag][-1] if places.get(tag) else 0
            if k and (tag not in INLINE or k > blocks[-1]):  # an inline end tag does not close blocks
                while len(stack) > k:
                    t = pop()
                    block += t not in INLINE
                    links -= t == "a"
            continue
        if tag in SKIPPED:
            if not m[3].endswith("/"):
                at = skipped_to(page, tag, at, places, ends)
            continue
        if tag in VOID:
            if tag == "hr":
                block += 1
            elif tag == "br":
                say(" ")
            continue
        if tag in INLINE:
            if tag == "a":
                links += 1
            push(tag, stack[-1][1])
            continue
        block += 1
        if tag in ("html", "body"):
            nodes[stack[-1][1]].tokens += _tokens(m[3])
            continue
        closes = SAME.get(tag, set()) | ({"p"} if tag in CLOSES_P else set())
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] in closes:
                while len(stack) > k:
                    links -= pop() == "a"
                break
            if stack[k][0] not in INLINE and stack[k][0] != "p":
                break
        while stack[-1][0] in INLINE:  # formatting left open does not reach into a new block
            links -= pop() == "a"
        up = stack[-1][1]
        nodes.append(Node(tag, up, nodes[up].depth + 1, _tokens(m[3])))
        nodes[up].children.append(len(nodes) - 1)
        push(tag, len(nodes) - 1)


def _tokens(attributes: str) -> list[str]:
    return [t.lower() for _, v in _ATTR.findall(attributes) for t in _TOKEN.findall(v)] if "=" in attributes else []


def node_rows(nodes: list[Node], odds: dict[str, float]) -> list[tuple]:
    """Numbers of each node; ``odds`` are the learned leanings of attribute tokens."""
    n = len(nodes)
    own, linked, stops, marks = [0] * n, [0] * n, [0] * n, [0] * n
    for i, x in enumerate(nodes):
        for _, text, in_link in x.parts:
            text = text.strip()
            if not text:
                continue
            own[i] += len(text)
            linked[i] += len(text) if in_link else 0
            stops[i] += text.count(". ") + text.count(".\n") + (text[-1] in ".!?")
            marks[i] += text.count("©") + text.count("|") + text.count("·")
    total, links, sentences, tags, below = own[:], linked[:], stops[:], [1] * n, [0] * n
    for i in range(n - 1, 0, -1):
        p = nodes[i].parent
        total[p] += total[i]
        links[p] += links[i]
        tags[p] += tags[i]
        sentences[p] += sentences[i]
        below[p] = max(below[p], below[i] + 1)
    whole, before = max(1, total[0]), 0
    lean, above, rank = [0.0] * n, [0] * n, [0] * n
    kin_mean, kin_most = [0.0] * n, [0.0] * n
    rows = []
    for i, x in enumerate(nodes):
        p = x.parent
        here = 0.0
        for t in x.tokens:
            here += odds.get(t, 0.0)
        kind = KIND.get(x.tag, len(KINDS))
        if p >= 0:
            above[i] = above[p] | 1 << KIND.get(nodes[p].tag, len(KINDS))
            lean[i] = lean[p]
            siblings = len(nodes[p].children)
        else:
            siblings, kin_mean[i], kin_most[i] = 1, total[i], total[i]
        lean[i] += here
        if x.children:
            sizes = [total[c] for c in x.children]
            mean, most = sum(sizes) / len(sizes), max(sizes)
            for k, c in enumerate(x.children):
                rank[c], kin_mean[c], kin_most[c] = k, mean, most
        size = total[i]
        rows.append((
            kind, above[i], log1p(own[i]), log1p(size), log1p(tags[i]), size / tags[i], links[i] / max(1, size),
            sentences[i], sentences[i] / tags[i], marks[i], x.depth, below[i], len(x.children), siblings, rank[i], rank[i] / siblings,
            log1p(kin_mean[i]), log1p(kin_most[i]), before / whole, (before + size) / whole, size / whole,
            here, lean[i], len(x.tokens), size / max(1, total[p]) if p >= 0 else 1.0))
        before += own[i]
    return rows


def matrix(rows: list[tuple]) -> np.ndarray:
    """Features: the own kind and the ancestors' kinds as flags, then the other numbers."""
    x = np.array(rows, np.float64).reshape(len(rows), -1)
    kinds = np.arange(len(KINDS))
    return np.concatenate([x[:, :1] == kinds, (x[:, 1:2].astype(np.int64) >> kinds) & 1, x[:, 2:]], axis=1)


class BoostedTrees:
    """Logistic gradient boosting on binned features; complete trees of a fixed depth."""

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        grid = np.linspace(0, 1, BINS + 1)[1:-1]
        self.edges = [np.unique(np.quantile(x[:, f], grid)) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, f], "right") for f, e in enumerate(self.edges)], axis=1)
        n, width = binned.shape
        rate = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
        self.start = float(np.log(rate / (1 - rate)))
        self.feature = np.zeros((TREES, 1 << DEPTH), np.int64)
        self.cut = np.full((TREES, 1 << DEPTH), np.inf)
        self.leaf = np.zeros((TREES, 1 << DEPTH))
        margin = np.full(n, self.start)
        offset = np.arange(width) * BINS
        for t in range(TREES):
            p = 1 / (1 + np.exp(-margin))
            grad, hess = p - y, np.maximum(p * (1 - p), 1e-6)
            at = np.ones(n, np.int64)
            for level in range(DEPTH):
                base = 1 << level
                slot = ((at - base)[:, None] * width * BINS + offset + binned).ravel()
                size = base * width * BINS
                g = np.bincount(slot, np.repeat(grad, width), size).reshape(base, width, BINS).cumsum(axis=2)
                h = np.bincount(slot, np.repeat(hess, width), size).reshape(base, width, BINS).cumsum(axis=2)
                ga, ha = g[:, :, -1:], h[:, :, -1:]
                gain = g ** 2 / (h + 1) + (ga - g) ** 2 / (ha - h + 1) - ga ** 2 / (ha + 1)
                gain[(h < 1) | (ha - h < 1)] = 0
                for b in range(base):
                    f, c = divmod(int(gain[b].argmax()), BINS)
                    if gain[b, f, c] > 1e-6 and c < len(self.edges[f]):
                        self.feature[t, base + b], self.cut[t, base + b] = f, self.edges[f][c]
                at = 2 * at + (x[np.arange(n), self.feature[t, at]] >= self.cut[t, at])
            leaf = at - (1 << DEPTH)
            self.leaf[t] = -SHRINK * np.bincount(leaf, grad, 1 << DEPTH) / (np.bincount(leaf, hess, 1 << DEPTH) + 1)
            margin += self.leaf[t, leaf]
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        out, flat = np.full(len(x), self.start), np.ascontiguousarray(x).ravel()
        row = np.arange(len(x)) * x.shape[1]
        for t in range(TREES):
            at = np.ones(len(x), np.int64)
            for _ in range(DEPTH):
                at = 2 * at + (flat[row + self.feature[t][at]] >= self.cut[t][at])
            out += self.leaf[t][at - (1 << DEPTH)]
        return out


def decode(nodes: list[Node], keep: list[float], drop: list[float]) -> list[bool]:
    """Which nodes' own text is kept, after the cheapest consistent choice for the whole tree.

    ``keep`` and ``drop`` are what either choice costs for a node with a short text.
    """
    n = len(nodes)
    weight = [0.2 + min(4.0, log1p(sum([len(t) for _, t, _ in x.parts]))) for x in nodes]
    keep_all, drop_all = [w * c for w, c in zip(weight, keep)], [w * c for w, c in zip(weight, drop)]
    split = [SWITCH + min(a, b) for a, b in zip(keep_all, drop_all)]
    state = [0] * n  # 1: all kept, -1: all dropped, 0: decided for each child
    for i in range(n - 1, -1, -1):
        best, choice = (keep_all[i], 1) if keep_all[i] <= drop_all[i] else (drop_all[i], -1)
        if nodes[i].children and split[i] < best:
            best, choice = split[i], 0
        state[i] = choice
        p = nodes[i].parent
        if p >= 0:
            keep_all[p] += keep_all[i]
            drop_all[p] += drop_all[i]
            split[p] += best
    kept = [False] * n
    for i, x in enumerate(nodes):
        if x.parent >= 0 and state[x.parent]:
            state[i] = state[x.parent]
        kept[i] = state[i] == 1 or (state[i] == 0 and keep[i] < drop[i])
    return kept


def joined_text(nodes: list[Node], kept: list[bool]) -> str:
    """Texts of the kept nodes, one line for each block, in page order."""
    blocks: dict[int, list[str]] = {}
    for x, k in zip(nodes, kept):
        if k:
            for block, text, _ in x.parts:
                blocks.setdefault(block, []).append(text)
    lines = (" ".join("".join(blocks[b]).split()) for b in sorted(blocks))
    return "\n".join(line for line in lines if line)


@dataclass
class Extractor:
    trees: BoostedTrees
    odds: dict[str, float]

    def texts(self, pages: list[str | None]) -> list[str]:
        out: list[str] = []
        for lo in range(0, len(pages), 64):
            parsed = [parse(p or "") for p in pages[lo:lo + 64]]
            margin = self.trees.margin(matrix([r for nodes in parsed for r in node_rows(nodes, self.odds)]))
            keep, drop = np.logaddexp(0, -margin).tolist(), np.logaddexp(0, margin).tolist()
            at = 0
            for nodes in parsed:
                end = at + len(nodes)
                out.append(joined_text(nodes, decode(nodes, keep[at:end], drop[at:end])))
                at = end
        return out


# words that pages use for their parts; only for varying the pages that are learned from
MAIN_NAMES = ["content", "post", "entry", "article", "story", "main", "body", "text"]
SIDE_NAMES = {
    "nav": ["menu", "nav", "navbar", "breadcrumb", "links", "toc"], "header": ["header", "masthead", "banner", "top", "site"],
    "footer": ["footer", "copyright", "bottom", "legal"], "aside": ["sidebar", "related", "widget", "rail", "popular", "recent"],
    "notice": ["cookie", "notice", "consent", "alert", "popup", "gdpr", "newsletter", "subscribe"],
    "ad": ["ad", "ads", "advert", "advertisement", "promo", "sponsored"], "form": ["form", "search", "login", "signup", "contact"],
    "comments": ["comments", "comment", "reply", "discussion", "responses", "disqus"]}


def _part(rng: np.random.Generator, kind: str, words: list[str]) -> str:
    def some(lo: int, hi: int) -> str:
        n, k = int(rng.integers(lo, hi)), int(rng.integers(0, max(1, len(words) - hi)))
        return " ".join(words[k:k + n])
    name = rng.choice(SIDE_NAMES[kind])
    named = [f' class="{name}"', f' id="{name}"', f' class="{name}-{rng.integers(1, 9)} box"', ""][int(rng.integers(0, 4))]
    tag = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form", "comments": "section"}.get(kind, "div")
    if rng.random() < 0.5 and named:
        tag = "div"
    if not named and tag in ("div", "section"):
        named = f' class="{name}"'
    if kind == "nav" or (kind in ("aside", "footer", "header") and rng.random() < 0.5):
        body = "<ul>" + "".join(f'<li><a href="#">{some(1, 4)}</a></li>' for _ in range(int(rng.integers(2, 9)))) + "</ul>"
    elif kind == "comments":
        body = "<h3>" + some(1, 3) + "</h3>" + "".join(
            f'<div class="comment"><b>{some(1, 2)}</b><p>{some(5, 60)}</p></div>' for _ in range(int(rng.integers(1, 6))))
    elif kind == "form":
        body = f'<label>{some(1, 4)}</label><input name="q"><p>{some(1, 9)}</p><button>{some(1, 3)}</button>'
    else:
        body = "".join(f"<p>{some(3, 40)}</p>" for _ in range(int(rng.integers(1, 3)))) if rng.random() < 0.6 else some(3, 25)
    return f'<{tag}{named} data-side="1">{body}</{tag}>'


def varied(page: str, rng: np.random.Generator) -> str:
    """The page with another container and further parts around and inside its main element."""
    m = re.search(r"<(article|main)\b[^>]*>(.*)</\1>", page, re.S | re.I)
    if m is None:
        return page
    words = re.sub(r"<[^>]*>", " ", m[2]).split() or ["x"]
    inner = m[2]
    if rng.random() < 0.3:
        spots = [x.start() for x in re.finditer(r"<p>", inner)]
        if spots:
            k = int(rng.choice(spots))
            inner = inner[:k] + _part(rng, str(rng.choice(["ad", "notice", "aside", "form"])), words) + inner[k:]
    if rng.random() < 0.3:
        inner += _part(rng, "comments", words)
    style = rng.random()
    name = rng.choice(MAIN_NAMES)
    opening, tag = ("<article>", "article") if style < 0.4 else ("<main>", "main") if style < 0.55 else (f'<div class="{name}">', "div") \
        if style < 0.85 else (f'<div id="{name}-{rng.integers(1, 9)}">', "div")
    opening = opening[:-1] + ' data-side="0">'
    before = "".join(_part(rng, str(k), words) for k in rng.choice(["header", "nav", "notice", "ad", "aside", "form"], int(rng.integers(0, 4))))
    after = "".join(_part(rng, str(k), words) for k in rng.choice(["comments", "footer", "aside", "ad", "nav", "notice"], int(rng.integers(0, 4))))
    return page[:m.start()] + before + opening + inner + f"</{tag}>" + after + page[m.end():]


_SIDE = re.compile(r'data-side="(\d)"')


def labelled(page: str) -> tuple[list[Node], np.ndarray]:
    """Nodes of a page with 1 for those in its main element and not in a part marked as beside it."""
    sides: list[str] = []
    marked = re.sub(r"<(article|main)\b(?![^>]*data-side)", r'<\1 data-side="0"', page, flags=re.I)
    nodes = parse(_SIDE.sub(lambda m: sides.append(m[1]) or f'class="zzside{"ab"[int(m[1])]}"', marked))
    y = np.zeros(len(nodes))
    for i, x in enumerate(nodes):
        y[i] = y[x.parent] if x.parent >= 0 else 0
        if "zzsidea" in x.tokens:
            y[i] = 1
        elif "zzsideb" in x.tokens:
            y[i] = 0
        x.tokens = [t for t in x.tokens if not t.startswith("zzside")]
    return nodes, y


def learn(pages: list[str], seed: int = 4) -> Extractor:
    rng = np.random.default_rng(seed)
    parsed = [labelled(p) for p in pages] + [labelled(varied(p, rng)) for p in pages for _ in range(2)]
    seen: dict[str, list[float]] = {}
    for nodes, y in parsed:
        for x, v in zip(nodes, y):
            for t in x.tokens:
                c = seen.setdefault(t, [0.0, 0.0])
                c[0] += v
                c[1] += 1
    odds = {t: float(np.log((a + 1) / (n - a + 1))) for t, (a, n) in seen.items() if n >= 5}
    x = matrix([r for nodes, _ in parsed for r in node_rows(nodes, odds)])
    return Extractor(BoostedTrees().fit(x, np.concatenate([y for _, y in parsed])), odds)


# what marks a part beside the main text where there is nothing to learn from: elements, and words in their attributes
SIDE_TAGS = {"nav", "menu", "header", "footer", "aside", "form", "dialog"}
SIDE_WORDS = {w for names in SIDE_NAMES.values() for w in names} - {"top", "contact", "discussion", "responses", "sponsored"}


def by_names(nodes: list[Node]) -> list[bool]:
    """Which nodes to keep by names alone; a part inside one that is left out is left out as well."""
    keep: list[bool] = []
    for x in nodes:
        beside = x.tag in SIDE_TAGS or (x.tag not in ("body", "html", "article", "main") and not SIDE_WORDS.isdisjoint(x.tokens))
        keep.append(not beside and (x.parent < 0 or keep[x.parent]))
    return keep


def fit(pages: DataFrame, fit_pages: int = FIT_PAGES) -> Extractor | None:
    """An extractor learned from at most ``fit_pages`` whole pages with an article or main element.

    Pages come in the order of their hashes, whatever their length, until they have ``FIT_CHARS`` together.
    """
    usable = pages.filter(F.col("html").rlike("(?is)<(article|main)\\b.*</(article|main)>")).select(
        "html", F.xxhash64("html").alias("hash"))
    # first the hashes alone, so that no task sends pages that are not chosen; copies of a page count once
    first = usable.groupBy("hash").agg(F.max(F.length("html")).alias("size")).orderBy("hash").limit(fit_pages).collect()
    total = np.cumsum([r.size for r in first])
    chosen = [r.hash for i, r in enumerate(first) if i == 0 or total[i] <= FIT_CHARS]
    rows = sorted(r.html for r in usable.filter(F.col("hash").isin(chosen)).groupBy("hash").agg(F.min("html").alias("html")).collect())
    return learn(rows) if rows else None


def extract_text(pages: DataFrame, fit_pages: int = FIT_PAGES) -> DataFrame:
    """``page_id, url, text, n_chars`` for every row of ``pages`` (page_id, url, html).

    ``text`` is the main text of the whole page: character references decoded, white space
    inside a block turned into one blank, blocks in page order joined by a line feed.
    ``n_chars`` counts its code points.

    A null or empty page has an empty text. Repeated rows get equal results, null ids and urls
    stay null, other columns are not read, an empty table gives no rows. Where no page has
    an article or main element to learn from, parts are told by the names of their elements and attributes.
    """
    model = fit(pages, fit_pages)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        pages = batch.column(2).to_pylist()
        if model is None:
            texts = [joined_text(nodes, by_names(nodes)) for nodes in map(parse, [p or "" for p in pages])]
        else:
            texts = model.texts(pages)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()),
                                           pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])
    return arrow_map(pages.select(F.col("page_id").cast("long"), "url", "html"), run, "page_id long, url string, text string, n_chars long")
