"""Main text of web pages by a minimum cut over their blocks and elements.

A page becomes blocks in order, and the elements that hold them. What a block looks like,
its length, links, punctuation and place, gives it a score by a logistic fit, which is its
capacity from the source or to the sink; what an element calls itself gives the element
one. Smoothness edges tie a block to the element it stands in, elements to those around
them, and neighbours to each other. The minimum cut, found by maximum flow, labels all
blocks of the page at once: a short paragraph follows the long ones around it, and a
fluent advert the element that holds it.

The fit needs no labelled pages: blocks inside elements that say what they are (an article,
a footer) teach what such blocks look like; the words by which they say so are no feature.
"""

from __future__ import annotations

import math
import re
from collections import deque
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements whose text is not text of the page.
HIDDEN = frozenset("script style noscript template svg math canvas iframe object embed audio video head title textarea select option datalist button input".split())
#: Elements that part blocks.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
                   "header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements, and words of class, id or role, by which a page says what a part of it is.
BOILERPLATE_TAGS = frozenset("nav footer aside form menu dialog fieldset header".split())
CONTENT_TAGS = frozenset("article main".split())
BOILERPLATE_WORDS = re.compile(
    r"(?:^|[^a-z])(?:ad|ads|advert|adverts|advertisement|advertising|adbox|sponsor|sponsored|promo|promotion|banner|cookie|cookies|consent|gdpr|notice|alert|popup|modal|overlay|newsletter|subscribe|signup|"
    r"nav|navbar|navigation|menu|menubar|breadcrumb|breadcrumbs|pager|pagination|toolbar|sidebar|side|aside|widget|widgets|related|recommended|recommendations|trending|share|sharing|social|"
    r"footer|foot|masthead|header|topbar|comment|comments|disqus|respond|reply|replies|feedback|login|search|tags|legal|copyright|skip|complementary|contentinfo)(?![a-z])")
CONTENT_WORDS = re.compile(r"(?:^|[^a-z])(?:article|content|main|post|story|entry|body|text|prose)(?![a-z])")
#: Cost of parting a block from the element around it (an element: times the root of its blocks), neighbours inside one element, other neighbours.
TREE, ADJACENT, BESIDE = 3.0, 0.5, 0.1
#: A block's score is between these; what an element says of itself weighs so much for each of its blocks, more than their scores and edges.
LEAST, MOST, SAYS = -3.8, 2.5, 7.0
#: Pages that the scores are fitted on, at most about.
FIT_PAGES = 2000
#: Scores of pages that teach nothing (words, links, end of sentence, inner marks, heading, middle, constant): a fit to the given pages.
PLAIN = (0.5, -5.0, 0.0, 1.4, 1.8, 1.8, -0.7)

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)(?:>|\Z)", re.S)
_NAMED = re.compile(r"(?:^|\s)(class|id|role|aria-hidden|hidden|style)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
_RAW = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I) for name in ("script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "math")}
_HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
#: Closing one of these by opening another, as browsers do.
_CLOSES = {"p": ("p",), "li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_MARKS = re.compile(r"[.,;:!?](?=\s)")
_INLINE_SCOPE = frozenset("a b i u s em strong span small font sub sup code kbd mark q cite abbr label time tt big".split())


class Block:
    """Text of a block, the path of its elements, characters inside links, and the element it is the text of."""

    __slots__ = ("text", "path", "linked", "tag")

    def __init__(self, text: str, path: tuple, linked: int, tag: str):
        self.text, self.path, self.linked, self.tag = text, path, linked, tag


def blocks_of(html: str) -> tuple[list[Block], dict[int, int]]:
    """(blocks with visible text, in order; what elements call themselves: 1 content, -1 boilerplate). Unclosed and crossed tags are borne."""
    out: list[Block] = []
    said_by: dict[int, int] = {}
    # an open element: name, number, hidden
    stack: list[tuple] = []
    parts: list[str] = []
    linked = serial = at = 0
    anchors = 0

    def flush():
        nonlocal linked
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            parts.clear()
            if text and not (stack and stack[-1][2]):
                around = [e for e in stack if e[0] not in _INLINE_SCOPE]
                out.append(Block(text, tuple(e[1] for e in around), linked, around[-1][0] if around else ""))
        linked = 0

    for m in _TOKEN.finditer(html):
        if m.start() < at:
            continue
        piece = html[at:m.start()]
        if piece and not (stack and stack[-1][2]):
            parts.append(piece)
            if anchors:
                linked += len(piece.strip())
        at = m.end()
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        if m[1]:
            place = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), -1)
            if place < 0:
                if name == "p":
                    flush()
                continue
            if name in BLOCKS or any(e[0] in BLOCKS for e in stack[place:]):
                if name in _INLINE_SCOPE:  # an inline end tag does not close blocks opened inside it
                    stack[place] = ("", *stack[place][1:])
                    if name == "a":
                        anchors -= 1
                    continue
                flush()
            anchors -= sum(e[0] == "a" for e in stack[place:])
            del stack[place:]
            continue
        if name in ("br", "wbr"):
            parts.append(" " if name == "br" else "")
            continue
        if name in BLOCKS:
            flush()
            if name == "hr":
                continue
        if name in _CLOSES or name in BLOCKS:
            closing = _CLOSES.get(name, ()) + (("p",) if name in BLOCKS and name != "p" else ())
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in closing:
                    anchors -= sum(e[0] == "a" for e in stack[i:])
                    del stack[i:]
                    break
                if stack[i][0] in BLOCKS and stack[i][0] not in ("p",):
                    break
        if name in VOID or m[3].endswith("/"):
            continue
        attributes = {k.lower(): (v or "").strip("\"'") for k, v in _NAMED.findall(m[3])} if m[3].strip() else {}
        serial += 1
        inside = any(e[0] in CONTENT_TAGS for e in stack)
        told = -1 if name in BOILERPLATE_TAGS and not (name == "header" and inside) else 1 if name in CONTENT_TAGS else 0
        said = " ".join(attributes.get(k, "") for k in ("class", "id", "role")).lower()
        if said.strip() and not told and name not in ("body", "html"):
            told = -1 if BOILERPLATE_WORDS.search(said) else 1 if CONTENT_WORDS.search(said) else 0
        if told:
            said_by[serial] = told
        hidden = bool(stack and stack[-1][2]) or name in HIDDEN or "hidden" in attributes or attributes.get("aria-hidden") == "true" or bool(_HIDING.search(attributes.get("style", "")))
        stack.append((name, serial, hidden))
        if name == "a":
            anchors += 1
        if name in _RAW:
            end = _RAW[name].search(html, at)
            at = end.start() if end else len(html)
            continue
    if at < len(html) and not (stack and stack[-1][2]):
        parts.append(html[at:])
    flush()
    return out, said_by


def measures(blocks: list[Block]) -> np.ndarray:
    """(blocks, measures): what each block looks like, without any word of its elements' names."""
    out = np.zeros((len(blocks), len(PLAIN)))
    for i, b in enumerate(blocks):
        words = b.text.count(" ") + 1
        out[i] = (math.log(min(words, 80)), min(1.0, b.linked / max(1, len(b.text))), b.text[-1] in ".!?:;\"')", min(1.0, len(_MARKS.findall(b.text)) / 4),
                  b.tag in _HEADINGS, 1 - abs(2 * i - (len(blocks) - 1)) / max(1, len(blocks) - 1), 1)
    return out


def told(blocks: list[Block], said_by: dict[int, int]) -> np.ndarray:
    """What the innermost element with a name for it calls each block: 1, -1, or 0 if none does."""
    return np.array([next((said_by[e] for e in reversed(b.path) if e in said_by), 0) for b in blocks], np.int64)


def fit_scores(x: np.ndarray, y: np.ndarray, rounds: int = 25) -> tuple[float, ...]:
    """Weights of the measures by logistic regression (Newton steps, both labels weighing the same); PLAIN if a label is missing."""
    if not (y > 0).any() or not (y < 0).any():
        return PLAIN
    goal, share = (y > 0).astype(float), np.where(y > 0, 0.5 / (y > 0).mean(), 0.5 / (y < 0).mean())
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (share * (p - goal)) + 1e-3 * len(x) * w
        curve = (x * (share * p * (1 - p))[:, None]).T @ x + 1e-3 * len(x) * np.eye(len(w))
        w = w - np.linalg.solve(curve, slope)
    return tuple(w.tolist())


def min_cut(to_source: list[float], to_sink: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes stay with the source, by maximum flow (shortest paths first, level by level)."""
    n = len(to_source)
    source, sink = n, n + 1
    head: list[list[int]] = [[] for _ in range(n + 2)]
    to, room = [], []

    def add(a, b, forth, back):
        head[a].append(len(to))
        to.append(b)
        room.append(forth)
        head[b].append(len(to))
        to.append(a)
        room.append(back)

    for i in range(n):
        both = min(to_source[i], to_sink[i])  # what flows straight through
        if to_source[i] - both > 0:
            add(source, i, to_source[i] - both, 0.0)
        if to_sink[i] - both > 0:
            add(i, sink, to_sink[i] - both, 0.0)
    for a, b, w in edges:
        add(a, b, w, w)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            u = queue.popleft()
            for e in head[u]:
                if room[e] > 1e-9 and level[to[e]] < 0:
                    level[to[e]] = level[u] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [level[i] >= 0 for i in range(n)]
        turn = [0] * (n + 2)
        path: list[int] = []
        u = source
        while True:
            if u == sink:
                least = min(room[e] for e in path)
                for k, e in enumerate(path):
                    room[e] -= least
                    room[e ^ 1] += least
                first = next(k for k, e in enumerate(path) if room[e] <= 1e-9)
                u = to[path[first] ^ 1]
                del path[first:]
                continue
            while turn[u] < len(head[u]):
                e = head[u][turn[u]]
                if room[e] > 1e-9 and level[to[e]] == level[u] + 1:
                    break
                turn[u] += 1
            else:
                if u == source:
                    break
                e = path.pop()
                u = to[e ^ 1]
                turn[u] += 1
                continue
            path.append(e)
            u = to[e]


def page_graph(blocks: list[Block], said_by: dict[int, int], weights: tuple[float, ...]) -> tuple[list[float], list[tuple[int, int, float]]]:
    """(score of each node, edges): blocks first, then the elements that hold several parts or say what they are.

    A positive score is the capacity from the source, content, a negative one to the sink.
    """
    scores = np.clip(measures(blocks) @ np.array(weights), LEAST, MOST).tolist()
    held: dict[int, set[int]] = {}  # the parts right inside an element, with the root as 0
    amount: dict[int, int] = {}
    for i, b in enumerate(blocks):
        chain = (0, *b.path)
        for outer, inner in zip(chain, (*chain[1:], -1 - i)):
            held.setdefault(outer, set()).add(inner)
        for e in b.path:
            amount[e] = amount.get(e, 0) + 1
    node: dict[int, int] = {}
    for e, parts in held.items():
        if len(parts) > 1 or e in said_by:
            node[e] = len(scores)
            scores.append(SAYS * said_by.get(e, 0) * amount.get(e, 0))
    edges, seen, inner = [], set(), []
    for i, b in enumerate(blocks):
        chain = [e for e in (0, *b.path) if e in node]
        inner.append(chain[-1] if chain else -1)
        for outer, e in zip(chain, chain[1:]):
            if e not in seen:
                seen.add(e)
                edges.append((node[outer], node[e], TREE * math.sqrt(amount[e])))
        if chain:
            edges.append((node[chain[-1]], i, TREE))
        if i:
            edges.append((i - 1, i, ADJACENT if inner[i] == inner[i - 1] else BESIDE))
    return scores, edges


def label_blocks(blocks: list[Block], said_by: dict[int, int], weights: tuple[float, ...] = PLAIN) -> list[bool]:
    """For each block whether it is content."""
    if not blocks:
        return []
    scores, edges = page_graph(blocks, said_by, weights)
    if all(s >= 0 for s in scores) or all(s <= 0 for s in scores):  # nothing pulls the other way
        return [scores[0] > 0 or max(scores) > 0] * len(blocks)
    return min_cut([max(0.0, s) for s in scores], [max(0.0, -s) for s in scores], edges)[:len(blocks)]


def main_text(html: str | None, weights: tuple[float, ...] = PLAIN) -> str:
    """Content blocks of a page, joined by an empty line; empty if there are none."""
    blocks, said_by = blocks_of(html or "")
    return "\n\n".join(b.text for b, keep in zip(blocks, label_blocks(blocks, said_by, weights)) if keep)


def fit_pages(pages: DataFrame, ident: str = "page_id", html: str = "html") -> tuple[float, ...]:
    """Weights learnt from those blocks of about FIT_PAGES pages, picked by hash, whose elements say what they are."""
    n = pages.count()
    some = pages.filter(F.pmod(F.xxhash64(ident, html), F.lit(1 << 30)) < int((1 << 30) * min(1.0, FIT_PAGES / max(1, n)))) if n > FIT_PAGES else pages

    def run(batches):
        for batch in batches:
            for x in batch.column(0):
                blocks, said_by = blocks_of(x.as_py() or "")
                y = told(blocks, said_by)
                yield pa.RecordBatch.from_arrays([pa.array([measures(blocks)[y != 0].tobytes()], pa.binary()), pa.array([y[y != 0].tobytes()], pa.binary())], ["x", "y"])

    rows = sorted(tuple(map(bytes, r)) for r in some.select(html).mapInArrow(run, "x binary, y binary").collect())  # about FIT_PAGES rows of numbers
    x = np.frombuffer(b"".join(r[0] for r in rows)).reshape(-1, len(PLAIN))
    return fit_scores(x, np.frombuffer(b"".join(r[1] for r in rows), np.int64))


def extract_pages(pages: DataFrame, ident: str = "page_id", url: str = "url", html: str = "html", weights: tuple[float, ...] | None = None) -> DataFrame:
    """(id, url, text, n_chars) of every page: map-only, each page whole, with scores fitted to a sample of the pages unless given.

    A null, empty or markup-only page has the empty text. Ties of the cut go to
    boilerplate. Repeated rows give repeated results. Other columns are not read.
    """
    kinds = dict(pages.dtypes)
    weights = weights or fit_pages(pages, ident, html)

    def run(batches):
        for batch in batches:
            texts = [main_text(x.as_py(), weights) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                             [ident, url, "text", "n_chars"])

    return pages.select(ident, url, html).mapInArrow(run, f"{ident} {kinds[ident]}, {url} {kinds[url]}, text string, n_chars long")
