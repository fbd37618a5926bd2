"""Main text of web pages: blocks are labelled content or boilerplate by a minimum cut.

A page is cut in blocks of text. A logistic classifier gives each block a cost for either label: by its length, links, sentences, function
words, tag and place, by its neighbours and by what else its parent holds, and by the zone that telling tags and names put it in, if any. The
costs are the capacities to the two terminals. Neighbouring blocks and siblings in the DOM are tied by smoothness edges. The maximum
flow's minimum cut is the labelling of least total cost.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surfmesh.llm.common import arrow_schema, map_arrow

# Kinds of HTML elements, and words in class and id names.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNREAD = frozenset("script style title textarea noscript template iframe noembed noframes xmp svg math canvas audio video object select button".split())
BOILER_TAGS = frozenset("nav footer aside form menu dialog search".split())
CONTENT_TAGS = frozenset("article main".split())
BOILER_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disqus footer form header login masthead menu modal nav navbar navigation newsletter notice overlay pagination paywall popup promo promoted recommended related reply replies respond share sharing sidebar signup social sponsor sponsored subscribe subscription tags toolbar widget".split()
)
CONTENT_WORDS = frozenset("article body content entry main post story text".split())
# Frequent function words of English, French, German and Spanish.
FUNCTION_WORDS = frozenset(
    "a an and are as at be by for from in is it of on or that the this to was with au aux avec ce dans de des du elle en est et il la le les ou par pas pour que qui se sur un une auf aus das dem den der die ein eine er es für ich im ist mit nicht sich sie und von zu al como con del el las lo los más no o para por su una y".split()
)

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:"[^"]*+"|'[^']*+'|[^"'>])*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)""", re.S)
_NAMED = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:[\s=/]|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SENTENCE = re.compile(r"[.!?…。]")
_CLOSES = {"p": BLOCK, "li": frozenset(["li"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "tr": frozenset(["tr"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "option": frozenset(["option"])}
CONTENT, NEUTRAL, BOILER = 1, 0, -1


#: What the classifier sees of a block, in the order of Costs.weights.
FEATURES = ("bias", "words", "link_share", "sentence", "function_words", "container_words", "container_link_share", "paragraph", "heading", "item", "before", "after", "edge_of_page", "zone_content", "zone_boiler")


@dataclass(frozen=True)
class Costs:
    """Weights of the classifier, and of the smoothness edges: `near` is that of two blocks under one parent, taken times `decay` for each
    further step between them in the DOM; `sibling` ties a block to the last one of the same parent, whatever stands between. An edge between
    two zones is taken times `across`, and by as much as the link shares of its ends differ it is weaker.

    The weights were fitted with train() to pages with known blocks, each three times as it is and once without telling names (tests/llm/page_maker.py).
    """

    # Fitted.
    weights: tuple[float, ...] = (-2.47, -0.01, -1.85, -0.26, -0.03, 0.67, -1.92, 0.73, 0.62, 1.68, 0.03, 0.12, -1.24, 2.55, -2.78)
    near: float = 1.0
    decay: float = 0.4
    sibling: float = 0.5
    across: float = 0.03


@dataclass
class Block:
    """A block's text, the zone that tags and names put it in, the number of its element's parent, its tag, the share of its text in links, and
    the steps in the DOM from the block before."""

    text: str
    zone: int
    parent: int
    tag: str
    link_share: float
    steps: int


def blocks_of(page: str) -> list[Block]:
    """The blocks of a page with text, in page order. Unread elements, comments and the head have none. Linear in the page's length."""
    out: list[Block] = []
    # Open elements: name, zone, whether something else than a form makes it boilerplate, number. boxes: the places of block elements among them.
    stack: list[tuple[str, int, bool, int]] = [("", NEUTRAL, False, 0)]
    boxes: list[int] = [0]
    is_open: Counter[str] = Counter()
    pieces: list[str] = []
    linked = number = pos = 0
    lowest = last_depth = 1  # of boxes, since the block before; at that block

    def flush() -> None:
        nonlocal pieces, linked, lowest, last_depth
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                depth = len(boxes)
                lowest = min(lowest, depth)
                parent = stack[boxes[-2]][3] if depth > 1 else 0
                out.append(Block(text, stack[-1][1], parent, stack[boxes[-1]][0], min(1.0, linked / len(text)), last_depth + depth - 2 * lowest))
                lowest = last_depth = depth
        pieces, linked = [], 0

    def close(k: int) -> None:
        """Closes the open elements from place k on."""
        nonlocal lowest
        for name, *_ in stack[k:]:
            is_open[name] -= 1
        del stack[k:]
        while boxes[-1] >= k:
            boxes.pop()
        lowest = min(lowest, len(boxes))

    def say(raw: str) -> None:
        nonlocal linked
        if raw and not is_open["head"]:
            text = html.unescape(raw) if "&" in raw else raw
            pieces.append(text)
            if is_open["a"]:
                linked += len(text.strip())

    while (m := _TOKEN.search(page, pos)) is not None:
        say(page[pos : m.start()])
        pos = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            if m[0].startswith("<![CDATA["):
                say(m[0][9:-3])
            continue
        closing, attributes = m[1] or m[4], (m[3] or m[6] or "")
        if closing:
            if is_open[name]:
                if name in BLOCK:
                    flush()
                k = len(stack) - 1
                while stack[k][0] != name:
                    k -= 1
                close(k)
            continue
        if name == "br":
            pieces.append(" ")
            continue
        if name in UNREAD and not attributes.endswith("/"):
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, pos)
            pos = end.end() if end else len(page)
            continue
        if name in BLOCK:
            flush()
            if name in _CLOSES.get(stack[boxes[-1]][0], ()):
                close(boxes[-1])
            if name == "body" and is_open["head"]:
                is_open["head"] = 0
        if name in VOID:
            continue
        number += 1
        is_open[name] += 1
        zone, hard = _zone(name, attributes, stack[-1][1], stack[-1][2], len(stack) > 1)
        if name in BLOCK:
            boxes.append(len(stack))
        stack.append((name, zone, hard, number))
    say(page[pos:])
    flush()
    return out


def _zone(name: str, attributes: str, zone: int, hard: bool, inner: bool) -> tuple[int, bool]:
    """The zone of a new element inside one of this zone, and whether anything but a form makes it boilerplate."""
    if name in BOILER_TAGS:
        return BOILER, hard or name != "form"
    if name in CONTENT_TAGS:
        return (BOILER, True) if zone == BOILER and hard else (CONTENT, False)
    if name == "header":
        return (zone, hard) if zone == CONTENT else (BOILER, True)
    if attributes and inner:
        if _HIDDEN.search(attributes):
            return BOILER, True
        if name not in ("html", "body"):
            words = {w.lower() for v in _NAMED.findall(attributes) for w in _PARTS.findall(v)}
            if words & BOILER_WORDS and not (zone == CONTENT and words & CONTENT_WORDS and not words & {"comment", "comments", "ad", "ads", "sidebar"}):
                return BOILER, True
            if words & CONTENT_WORDS and zone == NEUTRAL:
                return CONTENT, False
    return zone, hard


def features(blocks: list[Block]) -> np.ndarray:
    """A row of FEATURES for each block. Containers are the blocks under one parent; before and after are the words of the neighbours."""
    n = len(blocks)
    words = [b.text.split() for b in blocks]
    sizes = np.array([len(w) for w in words], dtype=float)
    links = np.array([b.link_share for b in blocks])
    _, box = np.unique(np.array([b.parent for b in blocks], dtype=np.int64), return_inverse=True)
    held = np.bincount(box, weights=sizes)
    held_links = np.bincount(box, weights=sizes * links) / np.maximum(held, 1)
    log = np.log1p(sizes)
    ahead = np.cumsum(sizes) - sizes / 2
    out = np.zeros((n, len(FEATURES)))
    out[:, 0] = 1
    out[:, 1] = np.minimum(log, 5)
    out[:, 2] = links
    out[:, 3] = [bool(_SENTENCE.search(b.text)) for b in blocks]
    out[:, 4] = [sum(w.lower().strip(",.;:!?") in FUNCTION_WORDS for w in ws) / len(ws) for ws in words]
    out[:, 5] = np.minimum(np.log1p(held)[box], 7)
    out[:, 6] = held_links[box]
    out[:, 7] = [b.tag in ("p", "pre", "blockquote") for b in blocks]
    out[:, 8] = [b.tag in ("h1", "h2", "h3", "h4") for b in blocks]
    out[:, 9] = [b.tag in ("li", "td", "th", "dt", "dd", "option") for b in blocks]
    out[1:, 10] = np.minimum(log[:-1], 5)
    out[:-1, 11] = np.minimum(log[1:], 5)
    out[:, 12] = np.abs(2 * ahead / max(sizes.sum(), 1) - 1) ** 3
    out[:, 13] = [b.zone == CONTENT for b in blocks]
    out[:, 14] = [b.zone == BOILER for b in blocks]
    return out


def train(pages: list[list[Block]], labels: list[list[bool]], *, penalty: float = 3e-3, steps: int = 3000) -> tuple[float, ...]:
    """Weights of the logistic classifier from pages with known blocks, by gradient descent; each page counts the same."""
    x = np.concatenate([features(p) for p in pages])
    y = np.concatenate([np.array(z, dtype=float) for z in labels])
    share = np.concatenate([np.full(len(p), 1 / len(p)) for p in pages]) / len(pages)
    w, speed = np.zeros(x.shape[1]), np.zeros(x.shape[1])
    for _ in range(steps):
        slope = x.T @ ((1 / (1 + np.exp(-np.clip(x @ w, -30, 30))) - y) * share) + penalty * w * (np.arange(len(w)) > 0)
        speed = 0.9 * speed - 0.05 * slope
        w = w + speed
    return tuple(round(float(v), 2) for v in w)


def content_scores(blocks: list[Block], costs: Costs) -> list[float]:
    """The classifier's log-odds of content of each block: its terminal capacities."""
    return (features(blocks) @ np.array(costs.weights)).tolist() if blocks else []


def min_cut(excess: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels of least cost: excess[i] is what it costs more to be False than True; an edge costs its weight where its ends differ.

    The source feeds nodes of positive excess, those of negative excess drain into the sink; shortest augmenting paths, level by level,
    until the sink is out of reach. True: the nodes that the source still reaches.
    """
    n = len(excess)
    heads: list[list[int]] = [[] for _ in range(n)]
    to: list[int] = []
    room: list[float] = []
    for a, b, w in edges:
        if w > 0 and a != b:
            heads[a].append(len(to))
            to.append(b)
            room.append(w)
            heads[b].append(len(to))
            to.append(a)
            room.append(w)
    feed = [max(x, 0.0) for x in excess]
    drain = [max(-x, 0.0) for x in excess]
    tiny = 1e-9
    while True:
        level = [-1] * n
        front = [i for i in range(n) if feed[i] > tiny]
        for i in front:
            level[i] = 0
        reached = False
        for i in front:  # grows while it is read
            reached |= drain[i] > tiny
            for e in heads[i]:
                if room[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[i] + 1
                    front.append(to[e])
        if not reached:
            return [x >= 0 for x in level]
        tried = [0] * n
        for s in range(n):
            while feed[s] > tiny and level[s] == 0:
                path, at = [], s
                while True:
                    if drain[at] > tiny:
                        flow = min([feed[s], drain[at], *(room[e] for e in path)])
                        feed[s] -= flow
                        drain[at] -= flow
                        for e in path:
                            room[e] -= flow
                            room[e ^ 1] += flow
                        break
                    while tried[at] < len(heads[at]):
                        e = heads[at][tried[at]]
                        if room[e] > tiny and level[to[e]] == level[at] + 1:
                            break
                        tried[at] += 1
                    if tried[at] < len(heads[at]):
                        path.append(e)
                        at = to[e]
                    elif path:
                        level[at] = -2
                        at = to[path.pop() ^ 1]
                        tried[at] += 1
                    else:
                        level[s] = -2
                        break


def smoothness(blocks: list[Block], costs: Costs) -> list[tuple[int, int, float]]:
    """Edges between neighbours, the weaker the further apart they are in the DOM, and between each block and the last one of its parent."""
    edges, last = [], {}

    def tie(i: int, j: int, weight: float) -> None:
        a, b = blocks[i], blocks[j]
        edges.append((i, j, weight * (costs.across if a.zone != b.zone else 1.0) * (1 - abs(a.link_share - b.link_share))))

    for i, block in enumerate(blocks):
        if i:
            tie(i - 1, i, costs.near * costs.decay ** max(0, block.steps - 2))
        if last.get(block.parent, i - 1) != i - 1:
            tie(last[block.parent], i, costs.sibling)
        last[block.parent] = i
    return edges


def labelled(page: str, costs: Costs = Costs()) -> list[tuple[Block, float, bool]]:
    """The blocks of a page, each with the classifier's log-odds and the cut's label."""
    blocks = blocks_of(page)
    scores = content_scores(blocks, costs)
    return list(zip(blocks, scores, min_cut(scores, smoothness(blocks, costs)), strict=True))


def main_text(page: str, costs: Costs = Costs()) -> str:
    """The blocks that the cut leaves with the content, in page order, joined by one space."""
    return " ".join(b.text for b, _, keep in labelled(page, costs) if keep)


OUT = "url string, text string, n_chars long"


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", costs: Costs = Costs()) -> DataFrame:
    """id_col, url, text and n_chars (code points) of every row.

    A null, empty or textless page has the empty text. Null ids and urls and repeated rows are rows like any other; an empty table gives an
    empty table; other columns of pages are not read. Whole pages are read and whole texts returned, however long.
    """
    schema = arrow_schema(f"{id_col} long, {OUT}")

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            pages = batch.column(2)
            texts = [main_text(pages[i].as_py() or "", costs) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(np.array([len(t) for t in texts], dtype=np.int64))], schema=schema)

    picked = pages.select(F.col(id_col).cast("long").alias(id_col), F.col(url_col).cast("string").alias("_url"), F.col(html_col).cast("string").alias("_html"))
    return map_arrow(picked, stage, f"{id_col} long, {OUT}")
