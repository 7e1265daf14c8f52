"""Main text of web pages: blocks are labelled by a minimum cut between content and boilerplate.

A page's text falls into blocks at its block elements. A classifier's costs of calling a block boilerplate or content
are its capacities to the two terminals; neighbouring blocks, and blocks near one another in the tree of elements, are
joined by smoothness edges. The cheapest cut separates the article from menus, headers, footers, sidebars, notices,
adverts, forms and reader comments. Scripts, styles, templates and markup have no blocks at all.
"""

from __future__ import annotations

import math
import re
from collections import deque
from collections.abc import Sequence
from dataclasses import dataclass, field
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm._common import carried, map_arrow, shuffle_partitions, text_slices, uncarried

#: Elements whose content is no text of the page.
SILENT = frozenset("script style noscript template title iframe noembed noframes xmp svg math canvas object audio video".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em embed font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr area base link meta param source track map picture".split())
#: Elements that stand for boilerplate, and the ARIA roles that do.
APART = frozenset("nav aside footer form menu dialog button select option optgroup textarea label legend fieldset input".split())
APART_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar tablist".split())
#: Words in class and id that do.
APART_WORDS = frozenset(
    "ad ads advert adverts advertisement adsense sponsor sponsored promo promotion banner sidebar widget nav navbar navigation menu breadcrumb breadcrumbs pagination pager "
    "masthead topbar header footer copyright cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login search "
    "comment comments disqus respond reply replies share sharing social related recommended recommendations trending toolbar".split()
)
COMMENT_WORDS = frozenset("comment comments disqus respond reply replies".split())
MAIN_WORDS = frozenset("article content entry story post main".split())
NEGATIONS = frozenset("has no with without is".split())

#: Log odds of content: of a block in an element that stands for boilerplate, in article or main, in one whose class says so.
APART_ODDS, MAIN_ODDS, MAIN_WORD_ODDS = -40.0, 12.0, 4.0
#: Bounds of what the classifier says from the text alone.
TEXT_ODDS = 6.0
#: Smoothness of two neighbouring blocks side by side, halved for each step between them in the tree, and of a block and its container.
NEXT_TO, WITHIN = 2.0, 1.0
#: Capacities are whole numbers of 1/SCALE.
SCALE = 64

#: How many pages teach the classifier.
SAMPLE_PAGES = 2_000
#: Weights before any page is seen: bias, log2 of characters, link density, sentence end, heading, paragraph, list item, commas.
PRIOR = (1.0, 0.3, -6.0, 0.5, 0.5, 1.0, -0.5, 0.5)
_TIGHTNESS = 4.0

_TOKEN = re.compile(r"""<!--(?:.*?-->|.*\Z)|<[!?][^>]*(?:>|\Z)|</(?:[^a-zA-Z>][^>]*)?(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"'=]++|=\s*+(?:"[^"]*"|'[^']*')?+|["'])*+)(>|\Z)""", re.S)
_HINT = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_SPACE = re.compile(r"\s+")
_ENDS = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I) for name in sorted(SILENT)}
#: An element of these ends another of the group that is open, unless one of the bounds is between.
_SIBLINGS = [(frozenset(["li"]), frozenset(["ul", "ol", "menu"])), (frozenset(["dt", "dd"]), frozenset(["dl"])), (frozenset(["td", "th"]), frozenset(["tr", "table"])), (frozenset(["tr"]), frozenset(["table", "tbody", "thead", "tfoot"])), (frozenset(["option"]), frozenset(["select"]))]
_GROUP = {name: (group, bounds) for group, bounds in _SIBLINGS for name in group}
_HEADINGS = frozenset(f"h{k}" for k in range(1, 7))


@dataclass
class Block:
    text: str
    container: int
    tag: str
    link_chars: int
    apart: bool
    main: float


@dataclass
class Page:
    """Blocks in order, and the parent of each block element, the page itself being element 0."""

    blocks: list[Block] = field(default_factory=list)
    parents: list[int] = field(default_factory=lambda: [0])


def _hints(attributes: str) -> tuple[set[str], str]:
    """The words of class and id, and the role. `has-sidebar` and the like say nothing."""
    words: set[str] = set()
    role = ""
    for name, *values in _HINT.findall(attributes):
        value = values[0] or values[1] or values[2]
        if name.lower() == "role":
            role = value.strip().lower()
            continue
        for token in value.split():
            parts = [w.lower() for w in _WORD.findall(token)]
            if parts and parts[0] not in NEGATIONS:
                words.update(parts)
    return words, role


@dataclass(slots=True)
class _Open:
    name: str
    container: int
    apart: bool
    comment: bool
    main: float
    link: bool


def _entered(name: str, attributes: str, above: _Open, container: int) -> _Open:
    """An element's standing, from its own name and hints and those above it."""
    words, role = _hints(attributes) if "=" in attributes else (set(), "")
    if name in ("html", "body"):
        words = set()
    hinted = words & APART_WORDS
    if hinted == {"header"} and (above.main or words & MAIN_WORDS):
        hinted = set()
    apart = name in APART or role in APART_ROLES or bool(hinted) or (name == "header" and not above.main)
    comment = bool(words & COMMENT_WORDS)
    landmark = name in ("article", "main") or role in ("main", "article")
    main = max(above.main, MAIN_ODDS if landmark and not apart else 0.0, MAIN_WORD_ODDS if words & MAIN_WORDS and not apart else 0.0)
    # an article in an element that was never closed, or in one named after its parts, is an article
    freed = landmark and not apart and not above.comment and above.name not in ("aside", "footer", "form", "dialog")
    return _Open(name, container, apart or (above.apart and not freed), comment or above.comment, main, above.link or name == "a")


def page_blocks(html: str) -> Page:
    """The text blocks of a page. Tags left open or never opened, quotes left open and a cut end do no harm."""
    page = Page()
    stack = [_Open("", 0, False, False, 0.0, False)]
    open_names: dict[str, int] = {}
    parts: list[str] = []
    linked = 0

    def say(text: str) -> None:
        nonlocal linked
        if text:
            parts.append(text)
            if stack[-1].link:
                linked += len(text)

    def flush() -> None:
        nonlocal linked
        if parts:
            text = _SPACE.sub(" ", unescape("".join(parts))).strip()
            if text:
                at = next(f for f in reversed(stack) if f.name not in INLINE)
                page.blocks.append(Block(text, at.container, at.name, linked, at.apart, at.main))
            parts.clear()
            linked = 0

    def close(depth: int) -> None:
        while len(stack) > depth:
            open_names[stack.pop().name] -= 1

    def implied(name: str) -> None:
        """Close what a start tag ends without saying so."""
        group, bounds = _GROUP.get(name, (frozenset(), frozenset()))
        for at in range(len(stack) - 1, 0, -1):
            frame = stack[at].name
            if frame in group:
                close(at)
                return
            if group:
                if frame in bounds:
                    break
            elif frame not in INLINE and frame != "p":
                break
            elif frame == "p":
                close(at)
                return

    at, size = 0, len(html)
    while at < size:
        found = _TOKEN.search(html, at)
        if found is None:
            say(html[at:])
            break
        say(html[at : found.start()])
        at = found.end()
        end, name, attributes, closed = found.groups()
        if name is None or not closed:
            continue
        name = name.lower()
        if name in INLINE:
            if name == "br":
                parts.append(" ")
            elif end:
                if open_names.get(name):
                    for depth in range(len(stack) - 1, 0, -1):
                        if stack[depth].name == name:
                            close(depth)
                            break
                        if stack[depth].name not in INLINE:
                            break
            elif name not in VOID:
                above = stack[-1]
                stack.append(_Open(name, above.container, above.apart, above.comment, above.main, above.link or name == "a"))
                open_names[name] = open_names.get(name, 0) + 1
            continue
        if name in SILENT:
            if not end and not attributes.endswith("/"):
                over = _ENDS[name].search(html, at)
                at = over.end() if over else size
            continue
        flush()
        if end:
            if open_names.get(name):
                depth = len(stack) - 1
                while stack[depth].name != name:
                    depth -= 1
                close(depth)
        else:
            implied(name)
            if name not in VOID:
                page.parents.append(stack[-1].container)
                stack.append(_entered(name, attributes, stack[-1], len(page.parents) - 1))
                open_names[name] = open_names.get(name, 0) + 1
    flush()
    return page


def features(block: Block) -> tuple[int, ...]:
    """Whole numbers told from a block's text and element: bits of its length, link density in quarters, and marks of a sentence."""
    text = block.text
    density = min(4, round(4 * block.link_chars / len(text)))
    commas = min(3, text.count(",") + text.count("、") + text.count(";"))
    return (len(text).bit_length(), density, int(text[-1] in ".!?…。！？:"), int(block.tag in _HEADINGS), int(block.tag in ("p", "blockquote", "pre")), int(block.tag in ("li", "dd", "dt", "td", "th")), commas)


def _inputs(found: np.ndarray) -> np.ndarray:
    bits, density, ends, heading, paragraph, item, commas = found.T.astype(float)
    return np.stack([np.ones(len(found)), bits, density / 4, ends, heading, paragraph, item, commas / 3], axis=1)


def fit_text_odds(pages: DataFrame, id_col: str, html_col: str = "html", sample_pages: int = SAMPLE_PAGES) -> tuple[float, ...]:
    """Weights of a logistic regression that tells content from boilerplate by text alone.

    Its labels are the pages' own landmarks: blocks in article or main against blocks in elements that stand for
    boilerplate. They are taken from `sample_pages` pages (those with the smallest hash of id) and counted by feature, so that
    a few thousand rows come to the driver at most. The fit shrinks towards PRIOR, which is what remains without labelled blocks.
    """
    key = F.xxhash64(F.col(id_col))
    bound = pages.select(key.alias("h")).orderBy("h").limit(sample_pages).agg(F.max("h")).head()[0]
    weights = np.array(PRIOR)
    if bound is None:
        return tuple(weights)

    def counted(batch: pa.RecordBatch):
        rows = []
        for _, texts in text_slices(batch.column(0)):
            for html in texts:
                rows += [(*features(b), int(not b.apart)) for b in page_blocks(html).blocks if b.apart or b.main >= MAIN_ODDS]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int32()) for k in range(8)], names=[f"f{k}" for k in range(8)])

    sample = pages.where(key <= bound).select(F.col(html_col).alias("html"), F.monotonically_increasing_id().alias("at")).limit(sample_pages)
    found = map_arrow(sample.repartition(shuffle_partitions(pages.sparkSession), "at").select("html"), counted, ", ".join(f"f{k} int" for k in range(8)))
    names = [f"f{k}" for k in range(8)]
    seen = np.array([tuple(r) for r in found.groupBy(*names).count().orderBy(*names).collect()], dtype=float).reshape(-1, 9)
    inputs, label, count = _inputs(seen[:, :7]), seen[:, 7], seen[:, 8]
    # both labels weigh alike
    weight = count * np.where(label == 1, 0.5 / max(1.0, count[label == 1].sum()), 0.5 / max(1.0, count[label == 0].sum())) * min(1_000.0, count.sum())
    prior, side = np.array(PRIOR), np.where(label == 1, 1.0, -1.0)

    def loss(w: np.ndarray) -> float:
        return float((weight * np.logaddexp(0, -side * (inputs @ w))).sum() + _TIGHTNESS / 2 * ((w - prior) ** 2).sum())

    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(inputs @ weights, -30, 30)))
        slope = inputs.T @ (weight * (p - label)) + _TIGHTNESS * (weights - prior)
        curve = (inputs * (weight * p * (1 - p))[:, None]).T @ inputs + _TIGHTNESS * np.eye(len(prior))
        step = np.linalg.solve(curve, slope)
        # halved until it descends, so that blocks that one feature tells apart don't throw it far off
        while loss(weights - step) > loss(weights) and np.abs(step).max() > 1e-9:
            step = step / 2
        weights = weights - step
        if np.abs(step).max() <= 1e-9:
            break
    return tuple(float(w) for w in weights)


def content_odds(block: Block, weights: Sequence[float]) -> float:
    """Log odds of content of one block: what its text says, within bounds, and where it stands."""
    bits, density, ends, heading, paragraph, item, commas = features(block)
    text = weights[0] + weights[1] * bits + weights[2] * density / 4 + weights[3] * ends + weights[4] * heading + weights[5] * paragraph + weights[6] * item + weights[7] * commas / 3
    return max(-TEXT_ODDS, min(TEXT_ODDS, text)) + block.main + (APART_ODDS if block.apart else 0.0)


def smoothness(page: Page) -> tuple[int, list[tuple[int, int, int]]]:
    """(number of nodes, edges (a, b, capacity)): nodes are the blocks, then the elements where several blocks or elements with blocks meet."""
    blocks, parents = page.blocks, page.parents
    children = [0] * len(parents)
    used = [False] * len(parents)
    for b in blocks:
        children[b.container] += 1
        at = b.container
        while not used[at]:
            used[at] = True
            if at == 0:
                break
            children[parents[at]] += 1
            at = parents[at]
    # elements with one child are passed over; parents come before their children
    meets, depth, node_of = [0] * len(parents), [0] * len(parents), {}
    for at in range(len(parents)):
        if used[at]:
            above = meets[parents[at]] if at else 0
            meets[at] = at if at == 0 or children[at] > 1 else above
            depth[at] = (depth[above] + 1 if meets[at] == at else depth[above]) if at else 0
            if meets[at] == at:
                node_of[at] = len(blocks) + len(node_of)
    within, edges = round(SCALE * WITHIN), []
    for i, b in enumerate(blocks):
        edges.append((i, node_of[meets[b.container]], within))
        if i:
            x, y, steps = meets[blocks[i - 1].container], meets[b.container], 0
            while x != y and steps < 6:
                if depth[x] >= depth[y]:
                    x = meets[parents[x]] if x else 0
                else:
                    y = meets[parents[y]]
                steps += 1
            edges.append((i - 1, i, max(1, round(SCALE * NEXT_TO) >> steps)))
    for at, node in node_of.items():
        if at:
            edges.append((node, node_of[meets[parents[at]]], within))
    return len(blocks) + len(node_of), edges


def source_side(count: int, gains: Sequence[int], edges: Sequence[tuple[int, int, int]]) -> list[bool]:
    """Which nodes a minimum cut leaves with the source: maximum flow by shortest augmenting levels.

    `gains` are capacities from the source where positive and to the sink where negative; `edges` hold in both directions.
    """
    source, sink = count, count + 1
    heads: list[int] = []
    room: list[int] = []
    near: list[list[int]] = [[] for _ in range(count + 2)]

    def join(a: int, b: int, forth: int, back: int) -> None:
        near[a].append(len(heads))
        heads.append(b)
        room.append(forth)
        near[b].append(len(heads))
        heads.append(a)
        room.append(back)

    for node, gain in enumerate(gains):
        if gain > 0:
            join(source, node, gain, 0)
        elif gain < 0:
            join(node, sink, -gain, 0)
    for a, b, capacity in edges:
        join(a, b, capacity, capacity)
    while True:
        level = [-1] * (count + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            at = queue.popleft()
            for e in near[at]:
                if room[e] and level[heads[e]] < 0:
                    level[heads[e]] = level[at] + 1
                    queue.append(heads[e])
        if level[sink] < 0:
            return [x >= 0 for x in level[:count]]
        turn = [0] * (count + 2)
        path: list[int] = []
        at = source
        while True:
            if at == sink:
                flow = min(room[e] for e in path)
                first = len(path)
                for k in range(len(path) - 1, -1, -1):
                    e = path[k]
                    room[e] -= flow
                    room[e ^ 1] += flow
                    if not room[e]:
                        first = k
                at = heads[path[first] ^ 1]
                del path[first:]
                continue
            while turn[at] < len(near[at]):
                e = near[at][turn[at]]
                if room[e] and level[heads[e]] == level[at] + 1:
                    break
                turn[at] += 1
            else:
                if at == source:
                    break
                e = path.pop()
                at = heads[e ^ 1]
                turn[at] += 1
                continue
            path.append(e)
            at = heads[e]


def main_text(html: str, weights: Sequence[float] = PRIOR) -> str:
    """The blocks on the content's side of the minimum cut, joined by newlines."""
    page = page_blocks(html)
    if not page.blocks:
        return ""
    count, edges = smoothness(page)
    gains = [round(SCALE * content_odds(b, weights)) for b in page.blocks] + [0] * (count - len(page.blocks))
    kept = source_side(count, gains, edges)
    return "\n".join(b.text for b, k in zip(page.blocks, kept) if k)


def extract_main_text(pages: DataFrame, carry: Sequence[str] = (), html_col: str = "html", weights: Sequence[float] | None = None, id_col: str = "page_id") -> DataFrame:
    """text and n_chars (its code points) of each page, and the columns to `carry`.

    The classifier is fitted on the pages unless its `weights` are given. A null or empty page has an empty text; each row is
    a page of its own, also where an id repeats. White space is what Unicode calls so; a line break counts as white space.
    """
    weights = tuple(fit_text_odds(pages, id_col, html_col) if weights is None else weights)

    def work(batch: pa.RecordBatch):
        for start, texts in text_slices(batch.column(0)):
            found = [main_text(t, weights) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64()), batch.column(1).slice(start, len(texts))], names=["text", "n_chars", "carried"])

    packed = pages.select(F.col(html_col).alias("html"), carried(carry, ("text", "n_chars")))
    schema = f"text string, n_chars long, carried {packed.schema['carried'].dataType.simpleString()}"
    return uncarried(map_arrow(packed, work, schema), "text", "n_chars")
