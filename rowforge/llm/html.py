"""Main text of web pages by minimum-cut labelling.

A page becomes a graph: its blocks of text in page order, and the elements that hold them. A classifier of the text
alone prices each block as content or boilerplate; it is learned from blocks inside elements whose tag or name says
what they are, so no page is labelled by hand. Elements with such a tag or name are seeds, whose terminal capacity
exceeds all else. Smoothness edges tie a block to its element, an element to the one around it, and blocks that
follow one another: the price of labelling them apart, less where a block is made of links. The minimum cut, by maximum flow, is
the cheapest labelling. So short paragraphs follow the article that they stand in, and prose in a footer or an advert
follows that.

Before the flow, nodes are merged that some minimum cut cannot part: a node whose price exceeds all its ties goes to its
terminal, and one whose tie to a neighbour exceeds its price and all other ties goes with that neighbour.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARKUP = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(?P<raw>script|style|title|textarea|noscript|template|iframe)\b(?:"[^"]*"|'[^']*'|[^'">])*>.*?(?:</(?P=raw)\s*>|\Z)"""
    r"""|<(?P<close>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:"[^"]*"|'[^']*'|[^'">])*)>|<[!?][^>]*>""",
    re.S | re.I,
)
NAMES = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
#: Tags that end a block (fixed by HTML).
BLOCKS = frozenset(
    "address article aside blockquote body caption dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Seeds: what tags and names say of an element. A seed for content counts only outside those for boilerplate.
BAD_TAGS = frozenset("nav footer header aside form menu dialog button select head fieldset".split())
GOOD_TAGS = frozenset("article main".split())
BAD = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs header masthead topbar footer sidebar side aside widget cookie cookies consent gdpr banner notice alert popup modal overlay ad ads advert adverts advertisement sponsor sponsored promo promotion comment comments reply replies discussion disqus share sharing social related recommended subscribe newsletter signup login search form copyright legal toolbar pagination pager tags skip".split()
)
GOOD = frozenset("article content main post entry story body".split())
SEED = 1e6
#: Prices are at most so large either way; below every tie to an element that a seed is around.
MOST = 3.0
#: Ties: inside a seed; outside, of an element within another, by whether it is a container; of blocks next to each other, and
#: what they have more if their elements stand in the same one; and the part of a tie that a block of links lacks.
SEEDED, INNER, OUTER, ADJACENT, SIBLINGS, LINKED = 4.5, 0.9, 0.4, 0.35, 0.4, 0.85
CONTAINERS = frozenset("article aside body details dialog div fieldset footer form head header html main menu nav section table".split())
#: About so many pages are read to learn the prices, at most, by a hash of their url and html.
FIT_PAGES = 2000
#: What the classifier sees: words by powers of two, fifths of the text that are links, whether it ends as a sentence does, kind.
WORDS, LINKS, ENDS, KINDS = 10, 6, 2, 3
#: Prices where no page has a seed: from a word to many, from text to links, without and with a sentence's end, and by kind.
PRIOR = np.array([-1.6, -1.2, -0.6, 0.1, 1, 1.5, 1.8, 2, 2, 2, 0, -0.6, -1.2, -1.6, -2, -2, -0.3, 0.3, 0, 0.2, -0.4])


@dataclass
class Page:
    """Blocks: text, cell of the classifier, share of links, element. Elements: the one around (-1: none), tag, seed
    (1 content, -1 boilerplate, 0 none), and the innermost seed from there outwards."""

    text: list[str] = field(default_factory=list)
    cell: list[int] = field(default_factory=list)
    links: list[float] = field(default_factory=list)
    element: list[int] = field(default_factory=list)
    around: list[int] = field(default_factory=list)
    tag: list[str] = field(default_factory=list)
    seed: list[int] = field(default_factory=list)
    inside: list[int] = field(default_factory=list)


def parse(html: str) -> Page:
    """The blocks and elements of a page, in time that grows with its length alone."""
    page = Page()
    stack: list = [("", -1, False)]  # tag, element that it is in or is, whether it is a link
    open_tags: dict[str, int] = {}
    text: list[str] = []
    linked = at = links = 0

    def element(tag: str, around: int, seed: int) -> int:
        page.around.append(around)
        page.tag.append(tag)
        inside = page.inside[around] if around >= 0 else 0
        page.seed.append(seed if seed < 0 or inside >= 0 else 0)
        page.inside.append(page.seed[-1] or inside)
        return len(page.tag) - 1

    def flush() -> None:
        nonlocal linked
        if text:
            line = " ".join(unescape("".join(text)).split())
            if line:
                own = stack[-1][1]
                tag = page.tag[own] if own >= 0 else ""
                words, share = line.count(" ") + 1, min(1.0, linked / len(line))
                kind = 1 if tag[:1] == "h" and tag[1:].isdigit() else 2 if tag in ("li", "td", "th", "dt", "dd", "option") else 0
                cell = min(words.bit_length() - 1, WORDS - 1)
                cell = ((cell * LINKS + int(share * 5)) * ENDS + (line[-1] in ".!?…。:;»\"”")) * KINDS + kind
                page.text.append(line)
                page.cell.append(cell)
                page.links.append(share)
                page.element.append(own)
            text.clear()
            linked = 0

    def close(i: int) -> None:
        nonlocal links
        for tag, _, link in stack[i:]:
            open_tags[tag] -= 1
            links -= link
        del stack[i:]

    for m in MARKUP.finditer(html):
        if m.start() > at:
            text.append(html[at : m.start()])
            if links:
                linked += m.start() - at
        at = m.end()
        tag = (m["tag"] or "").lower()
        if not tag:
            if m["raw"]:
                text.append(" ")
            continue
        if tag in BLOCKS:
            flush()
        elif tag == "br":
            text.append(" ")
        if m["close"]:
            if open_tags.get(tag):
                i = len(stack) - 1
                while stack[i][0] != tag:
                    i -= 1
                close(i)
        elif tag not in VOID and not m["attrs"].endswith("/"):
            if tag in BLOCKS:
                # a new paragraph or list item ends an open one, with whatever was left open in it
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] == "p" or stack[i][0] == tag == "li":
                        close(i)
                        break
                    if stack[i][0] in BLOCKS:
                        break
            seed = -1 if tag in BAD_TAGS else 1 if tag in GOOD_TAGS else 0
            if tag == "header" and stack[-1][1] >= 0 and page.inside[stack[-1][1]] > 0:
                seed = 0  # an article's own title
            if "=" in m["attrs"] and tag not in ("body", "html", "article", "main"):
                names = {w for x in NAMES.findall(m["attrs"]) for w in re.split(r"[^a-z0-9]+", "".join(x).lower())}
                if names & BAD:
                    seed = -1
                elif names & GOOD and tag in ("div", "section", "td"):
                    seed = seed or 1
            own = element(tag, stack[-1][1], seed) if tag in BLOCKS or seed else stack[-1][1]
            links += tag == "a"
            open_tags[tag] = open_tags.get(tag, 0) + 1
            stack.append((tag, own, tag == "a"))
    if at < len(html):
        text.append(html[at:])
    flush()
    return page


def graph(page: Page, prices: np.ndarray) -> tuple[list[float], list[tuple[int, int, float]]]:
    """Prices and ties of the page's nodes: its blocks, then its elements."""
    n = len(page.text)
    price = [float(prices[c]) for c in page.cell] + [SEED * s for s in page.seed]
    ties = []
    for i, e in enumerate(page.element):
        if e >= 0:
            ties.append((i, n + e, SEEDED * (1 - LINKED * page.links[i])))
        if i and (page.inside[page.element[i - 1]] if page.element[i - 1] >= 0 else 0) == (page.inside[e] if e >= 0 else 0):
            siblings = e >= 0 and page.element[i - 1] >= 0 and page.around[e] == page.around[page.element[i - 1]]
            ties.append((i - 1, i, ADJACENT + SIBLINGS * siblings))
        elif i:
            ties.append((i - 1, i, ADJACENT))
    for e, around in enumerate(page.around):
        if around >= 0:
            ties.append((n + e, n + around, SEEDED if page.inside[around] else OUTER if page.tag[e] in CONTAINERS else INNER))
    return price, ties


def minimum_cut(price: list[float], ties: list[tuple[int, int, float]]) -> list[bool]:
    """True for the nodes on the source's side; positive prices tie a node to the source, negative to the sink."""
    n = len(price)
    price, near, total = list(price), [{} for _ in range(n)], [0.0] * n
    for a, b, w in ties:
        if a != b:
            near[a][b] = near[a].get(b, 0.0) + w
            near[b][a] = near[b].get(a, 0.0) + w
            total[a] += w
            total[b] += w
    side: list = [None] * n
    with_: list = [None] * n  # the node that a node goes with
    queue = deque(range(n))
    while queue:
        i = queue.popleft()
        if side[i] is not None or with_[i] is not None:
            continue
        if not near[i] or abs(price[i]) >= total[i]:  # no labelling of its neighbours can turn it
            side[i] = price[i] > 0
            for j, w in near[i].items():
                price[j] += w if side[i] else -w
                total[j] -= w
                del near[j][i]
                queue.append(j)
            near[i] = {}
        elif len(near[i]) <= 8:
            j, w = max(near[i].items(), key=lambda x: x[1])
            if 2 * w >= abs(price[i]) + total[i]:  # it goes with its neighbour j
                with_[i] = j
                price[j] += price[i]
                total[j] -= w
                del near[j][i]
                for k, v in near[i].items():
                    if k != j:
                        del near[k][i]
                        near[k][j] = near[k].get(j, 0.0) + v
                        near[j][k] = near[j].get(k, 0.0) + v
                        total[j] += v
                        queue.append(k)
                near[i] = {}
                queue.append(j)
    rest = [i for i in range(n) if side[i] is None and with_[i] is None]
    if rest:
        number = {i: k for k, i in enumerate(rest)}
        edges = [(number[i], number[j], w) for i in rest for j, w in near[i].items() if i < j]
        for i, on in zip(rest, _flow([price[i] for i in rest], edges)):
            side[i] = on
    for i in range(n):  # what goes with a node has its side
        chain = []
        while side[i] is None:
            chain.append(i)
            i = with_[i]
        for j in chain:
            side[j] = side[i]
    return side


def _flow(price: list[float], ties: list[tuple[int, int, float]]) -> list[bool]:
    """The source's side of a minimum cut, by maximum flow along shortest paths, a level graph at a time."""
    n = len(price)
    source, sink = n, n + 1
    edges: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    room: list[float] = []

    def add(a: int, b: int, forth: float, back: float) -> None:
        edges[a].append(len(to))
        edges[b].append(len(to) + 1)
        to.extend((b, a))
        room.extend((forth, back))

    for a, b, w in ties:
        add(a, b, w, w)
    for i, p in enumerate(price):
        add(*((source, i) if p > 0 else (i, sink)), abs(p), 0.0)
    least = 1e-9
    while True:
        level = [-1] * (n + 2)
        level[source], queue = 0, deque([source])
        while queue:
            i = queue.popleft()
            for e in edges[i]:
                if room[e] > least and level[to[e]] < 0:
                    level[to[e]] = level[i] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [level[i] >= 0 for i in range(n)]
        place, path, at = [0] * (n + 2), [], source
        while True:
            if at == sink:
                flow = min(room[e] for e in path)
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
                k = next(k for k, e in enumerate(path) if room[e] <= least)
                at = to[path[k] ^ 1]
                del path[k:]
                continue
            while place[at] < len(edges[at]):
                e = edges[at][place[at]]
                if room[e] > least and level[to[e]] == level[at] + 1:
                    break
                place[at] += 1
            if place[at] < len(edges[at]):
                path.append(e)
                at = to[e]
            elif at == source:
                break
            else:
                e = path.pop()
                at = to[e ^ 1]
                place[at] += 1


def _features() -> np.ndarray:
    """For each cell of the classifier, which of its values hold."""
    out = []
    for cell in range(WORDS * LINKS * ENDS * KINDS):
        rest, kind = divmod(cell, KINDS)
        rest, end = divmod(rest, ENDS)
        words, link = divmod(rest, LINKS)
        row = np.zeros(WORDS + LINKS + ENDS + KINDS)
        row[[words, WORDS + link, WORDS + LINKS + end, WORDS + LINKS + ENDS + kind]] = 1
        out.append(row)
    return np.array(out)


def learn(good: np.ndarray, bad: np.ndarray) -> np.ndarray:
    """The price of each cell, log odds for content, by logistic regression on the labelled blocks' counts by cell; either
    label weighs the same in all, and what the counts do not tell is as in PRIOR."""
    x, w = _features(), PRIOR.copy()
    if good.sum() and bad.sum():
        good, bad = good / good.sum() * 500, bad / bad.sum() * 500
        n = good + bad
        for _ in range(30):  # Newton's steps
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            grad = x.T @ (good - n * p) - (w - PRIOR)
            step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + np.eye(len(w)), grad)
            w += step
            if np.abs(step).max() < 1e-6:
                break
    return np.clip(x @ w, -MOST, MOST)


def fit(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> np.ndarray:
    """The prices learned from about FIT_PAGES pages at most, whose seeds label their blocks."""
    cells = WORDS * LINKS * ENDS * KINDS
    n = pages.count()
    rows = pages.select(F.col(html_col).alias("html"), F.xxhash64(F.col(url_col).cast("string"), html_col).alias("h"))
    if n > FIT_PAGES:
        rows = rows.filter(F.pmod("h", F.lit(1 << 20)) < int((1 << 20) * FIT_PAGES / n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(2 * cells, np.int64)
        for batch in batches:
            for html in batch.column(0).to_pylist():
                page = parse(html or "")
                for cell, e in zip(page.cell, page.element):
                    if e >= 0 and page.inside[e]:
                        found[cell + cells * (page.inside[e] < 0)] += 1
        on = np.flatnonzero(found)
        yield pa.record_batch([pa.array(on), pa.array(found[on])], names=["cell", "n"])

    counts = np.zeros(2 * cells)
    for r in rows.select("html").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():  # at most 2 rows a cell
        counts[r["cell"]] = r["n"]
    return learn(counts[:cells], counts[cells:])


def main_text(html: str | None, prices: np.ndarray) -> str:
    """The content blocks, joined by line feeds; empty for null, empty and pure boilerplate."""
    page = parse(html) if html else Page()
    return "\n".join(x for x, keep in zip(page.text, minimum_cut(*graph(page, prices))) if keep)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` of each row, whatever its id and url, repeated rows alike.

    A null or empty page has an empty text; an empty table gives an empty result; other columns are not read. Pages
    without any seed are labelled by PRIOR and the ties.
    """
    prices = fit(pages, url_col, html_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                texts = [main_text(h, prices) for h in part.column(2).to_pylist()]
                yield pa.record_batch([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kind = pages.schema[id_col].dataType.simpleString()
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
