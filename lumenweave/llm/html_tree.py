"""Main text of web pages by a tree-structured graphical model.

A page's block elements are the nodes of a tree (inline elements belong to their block).
Each node is content or not; node potentials are linear in what the element is and holds,
edge potentials in the pair of parent and child. Sum-product messages go up from the leaves
and down from the root, for all pages of a batch at once, level by level, and give each
node's marginal. The text of nodes whose marginal is above one half is the main text.

The weights are fitted by the gradient of the log likelihood (node and edge marginals by the
same messages) to labelled pages (html_pages): some written by hand, and random layouts.
Names (class, id, role) are a few features among others: a name made of nothing but such
words weighs more than one that only holds one, and where the prose of a page stands, what
is linked, what lies outside the page's article, boxes between paragraphs and words that speak
to the reader count beside them. Potentials of parts that are named by their element (menus,
scripts, ...) are fixed; so are those of forms, but for one that holds most of the page's prose,
as some pages lie in a form: that is a part like any other.

A page is read in one pass, in time linear in its length whatever it holds. As in browsers,
a tag that the page's end cuts off is dropped, and elements nested deeper than DEPTH become
siblings; elements without text below them are left out of the tree.

Edge cases: null, empty and blank pages, and pages without content, give an empty text; a
page without any element is content;
broken markup (tags not closed, stray ends) is read as browsers do, roughly; a null page_id
or url is kept; repeated rows are each read; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenweave.llm.common import table
from lumenweave.llm.html_pages import hand_written
from lumenweave.llm.html_pages import random_pages as labelled_pages

# Names of elements by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template xmp iframe noframes".split())
BLOCK = frozenset("html head body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd pre blockquote figure figcaption table caption thead tbody tfoot tr td th nav header footer aside form fieldset address details summary dialog menu center hgroup search select button svg math video audio object canvas".split()) | RAW
NEVER = frozenset("head script style textarea title noscript template iframe noframes nav header footer aside menu dialog select button svg math video audio object canvas search".split())
HOLDS = frozenset("html body main article section div form fieldset".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote figcaption dd dt td th li caption".split())
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
WALLS = HOLDS - frozenset(("form", "fieldset")) | frozenset("ul ol dl table".split())
SCOPED = frozenset("p li dt dd tr td th option".split())
BAD_WORDS = "ad ads advert advertisement adverts banner breadcrumb breadcrumbs byline comment comments cookie consent copyright discussion disqus feedback footer form gdpr header masthead menu metabar modal nav navbar navigation newsletter notice notification pager pagination popup promo promoted recommended related replies reply respond responses search share sharing sidebar signup skip social sponsor sponsored subscribe subscription tags toc toolbar widget widgets warning".split()
PLAIN_WORDS = "area article bar block bottom box boxes col column container content entry global group holder inner item items left links list main outer page panel post posts primary right row secondary section site slot thread top unit user wrap wrapper".split()
GOOD_WORDS = "article articlebody body content entry entrycontent main maincontent paragraph post postbody postcontent story storybody text".split()

DEPTH = 512
#: Pages are read together up to so many characters.
GROUP = 1 << 20
#: A tag, from its "<" to its ">"; quotes hold a ">" only behind "=". No part of it is read twice.
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|=)*+)>")
_ATTRIBUTE = re.compile(r"(?<![^\s\"'/])(class|id|role|hidden|style|aria-hidden)(?![\w-])(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SPACE = re.compile(r"\s+")
_BAD, _PLAIN, _GOOD = frozenset(BAD_WORDS), frozenset(PLAIN_WORDS), frozenset(GOOD_WORDS)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_ENDS = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}


class Node:
    __slots__ = ("tag", "parent", "names", "hidden", "text", "linked", "links", "depth", "you", "words")

    def __init__(self, tag: str, parent: int, names: frozenset, hidden: bool, depth: int = 0):
        self.tag, self.parent, self.names, self.hidden, self.depth = tag, parent, names, hidden, depth
        self.text, self.linked, self.links, self.you, self.words = 0, 0, 0, 0, 0


def _read_names(attributes: str) -> tuple[frozenset, bool]:
    """Words of class, id and role, with "!bad" where one name is nothing but bad words and plain ones; whether the element is hidden."""
    words, hidden = set(), False
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id", "role"):
            for v in value.split():
                parts = [w.lower() for w in _PARTS.findall(v)]
                whole = v.lower().replace("-", "").replace("_", "")
                words.update(parts)
                words.add(whole)
                if whole in _BAD or (any(w in _BAD for w in parts) and all(w in _BAD or w in _PLAIN for w in parts)):
                    words.add("!bad")
        elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and _HIDDEN.search(value)):
            hidden = True
    return frozenset(words), hidden


_known_names = lru_cache(maxsize=4096)(_read_names)


def parse(page: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """Block elements with text in page order (0 is the root), and pieces of text with the number of their block; None parts blocks."""
    nodes = [Node("#root", -1, frozenset(), False)]
    pieces: list[tuple[int, str]] = []
    # open elements: name, node, whether it is a block; and where each name, each wall and each block stands
    stack: list[tuple[str, int, bool]] = [("#root", 0, True)]
    where: dict[str, list[int]] = {}
    walls, blocks = [0], [0]

    def put(text: str) -> None:
        if text:
            k = stack[-1][1]
            pieces.append((k, text))
            n = len(text) - text.count(" ")
            nodes[k].text += n
            if n:
                nodes[k].you += len(_YOU.findall(text))
                nodes[k].words += text.count(" ") + 1
            if where.get("a"):
                nodes[k].linked += n

    def cut(k: int) -> None:
        while len(stack) > k:
            name = stack.pop()[0]
            at = where[name]
            if at and at[-1] == len(stack):
                at.pop()
            for held in (walls, blocks):
                if held[-1] == len(stack):
                    held.pop()

    def close(names) -> None:
        """End the open element of these names that is innermost, if no wall stands above it."""
        k = max((where[n][-1] for n in names if where.get(n)), default=-1)
        if k > walls[-1]:
            cut(k)

    def push(name: str, k: int, is_block: bool) -> None:
        where.setdefault(name, []).append(len(stack))
        if name in WALLS:
            walls.append(len(stack))
        if is_block:
            blocks.append(len(stack))
        stack.append((name, k, is_block))

    def add(name: str, words: frozenset, hidden: bool) -> int:
        up = stack[-1][1]
        if nodes[up].depth >= DEPTH:
            up = nodes[up].parent
        nodes.append(Node(name, up, words, hidden, nodes[up].depth + 1))
        return len(nodes) - 1

    at, size = 0, len(page)
    while at < size:
        i = page.find("<", at)
        if i < 0:
            break
        put(page[at:i])
        m = _TAG.match(page, i)
        if m is None:
            after = page[i + 1 : i + 3]
            if page.startswith("<!--", i):
                end = page.find(">", i) if page.startswith((">", "->"), i + 4) else page.find("-->", i + 4)
                at = size if end < 0 else end + (1 if page[end] == ">" else 3)
            elif page.startswith("<![CDATA[", i) and (end := page.find("]]>", i)) >= 0:
                at = end + 3
            elif after[:1] in ("!", "?") or (after[:1] == "/" and not after[1:2].isspace()):
                end = page.find(">", i)
                at = size if end < 0 else end + 1
            elif after[:1].isascii() and after[:1].isalpha():  # cut off by the page's end
                at = size
            else:
                put("<")
                at = i + 1
            continue
        at = m.end()
        name = m[2].lower()
        if m[1]:
            found = where.get(name)
            if not found:
                if name == "p":
                    pieces.append((stack[-1][1], None))
            elif name in BLOCK:
                if name not in SCOPED or found[-1] > walls[-1] or name in WALLS:
                    cut(found[-1])
                    pieces.append((stack[-1][1], None))
            elif found[-1] > blocks[-1]:
                cut(found[-1])
            else:
                found.pop()  # an inline element that a block was begun in: it ends, the block goes on
            continue
        if name == "br":
            put(" ")
        if name in VOID:
            continue
        if name in ENDS_P:
            close(("p",))
        if name in CLOSES:
            close(CLOSES[name])
        if name in RAW:
            end = _ENDS[name].search(page, at)
            add(name, frozenset(), True)
            end = page.find(">", end.end()) if end else -1
            at = size if end < 0 else end + 1
            pieces.append((stack[-1][1], None))
            continue
        if m[3].endswith("/") and name not in BLOCK:
            continue
        if name == "a":
            nodes[stack[-1][1]].links += 1
            close(("a",))
        if name in BLOCK:
            words, hidden = (_known_names if len(m[3]) < 200 else _read_names)(m[3])
            push(name, add(name, words, hidden), True)
            pieces.append((stack[-1][1], None))
        else:
            push(name, stack[-1][1], False)
    put(page[at:])
    return _with_text(nodes, pieces)


def _with_text(nodes: list[Node], pieces: list) -> tuple[list[Node], list]:
    """Without the elements that have no text in or below them."""
    below = [n.text for n in nodes]
    for i in range(len(nodes) - 1, 0, -1):
        below[nodes[i].parent] += below[i]
    if all(below[1:]):
        return nodes, pieces
    number, kept = [-1] * len(nodes), []
    for i, n in enumerate(nodes):
        if i == 0 or below[i]:
            number[i] = len(kept)
            n.parent = number[n.parent] if i else -1
            kept.append(n)
    return kept, [(number[k], t) for k, t in pieces]


FEATURES = (
    "bias", "holds", "prose", "heading", "item", "all bad name", "part bad name", "good name", "in article", "in all bad", "in part bad", "outside article", "length", "link share", "links",
    "sentences", "length below", "link share below", "prose below a part bad name", "share of the page's prose", "body", "in a list item of blocks", "in a form", "share of the prose in its form",
    "box in a text", "named box in a text", "box in an article", "before the first long prose", "behind the last long prose", "beside the place of most prose", "second person", "mostly links",
)
NAMED = 30.0
#: Words by which a page speaks to its reader.
_YOU = re.compile(r"\b(?:you|your|yours|please|click|sign|subscribe|register|download|contact|follow us|we use)\b", re.I)
#: Text (without blanks) that counts as a sentence, and that an article of a page must have at least.
SENTENCE, ARTICLE = 60, 100


def describe(nodes: list[Node]) -> tuple[np.ndarray, np.ndarray]:
    """A row of features per node, and -1 for nodes that are never content by their element, 1 for the root of a page without elements, else 0."""
    n = len(nodes)
    parent = [k.parent for k in nodes]
    never = [False] * n
    for i, k in enumerate(nodes):
        never[i] = k.hidden or k.tag in NEVER or (i > 0 and never[parent[i]])
    below, linked, prose = [k.text for k in nodes], [k.linked for k in nodes], [0] * n
    you, words = [k.you for k in nodes], [k.words for k in nodes]
    for i in range(n - 1, 0, -1):
        for held in (below, linked, you, words):
            held[parent[i]] += held[i]
    plain = [i for i, k in enumerate(nodes) if i and not never[i] and k.linked * 3 < k.text]
    for i in [i for i in plain if nodes[i].text > SENTENCE] or plain:
        prose[parent[i]] += nodes[i].text
    whole = max(1, sum(prose))
    form = [0.0] * n
    box, named = [False] * n, [False] * n
    has_article = any(k.tag == "article" and below[i] > ARTICLE and not never[i] for i, k in enumerate(nodes))
    has_main = any(k.tag == "main" and below[i] > ARTICLE and not never[i] for i, k in enumerate(nodes))
    scope = "article" if has_article else "main" if has_main else None
    under = list(prose)  # prose of all below
    for i in range(n - 1, 0, -1):
        under[parent[i]] += under[i]
    for i, k in enumerate(nodes):  # a form that does not hold the page
        never[i] = never[i] or (i > 0 and never[parent[i]]) or (k.tag in ("form", "fieldset") and 2 * under[i] < whole)
    # where the text may be: in the page's article, if it has one, and not in parts whose names say otherwise
    may = [False] * n
    for i, k in enumerate(nodes):
        bad = "!bad" in k.names and k.tag not in ("body", "html")
        may[i] = not bad and (i == 0 or may[parent[i]])
    scoped = [scope is None] * n
    for i, k in enumerate(nodes):
        scoped[i] = scoped[i] or k.tag == scope or (i > 0 and scoped[parent[i]])
    may = [x and y for x, y in zip(may, scoped, strict=True)]
    direct = [0] * n  # paragraphs of some length that stand in the node itself
    long = [i for i in plain if nodes[i].text > SENTENCE and nodes[i].tag in PROSE]
    for i in long:
        direct[parent[i]] += 1
    long = [i for i in long if may[i]]
    most = max(range(n), key=lambda i: (may[i], prose[i], -i))
    path = set()
    while most >= 0:
        path.add(most)
        most = parent[most]
    first, last = (long[0], long[-1]) if long else (0, n)
    out, inside, outside, all_bad, part_bad, listed, share = [], *([False] * n for _ in range(5)), [0.0] * n
    for i, k in enumerate(nodes):
        p, t = parent[i], k.tag
        top = t in ("body", "html", "#root")
        bad_name = not top and "!bad" in k.names
        part_name = not top and not bad_name and not k.names.isdisjoint(_BAD)
        up = i > 0
        inside[i] = t in ("article", "main") or (up and inside[p])
        outside[i] = scope is not None and t != scope and (not up or outside[p])
        all_bad[i] = bad_name or (up and all_bad[p])
        part_bad[i] = part_name or (up and part_bad[p])
        listed[i] = (up and listed[p]) or (t in ("p", "div") and up and nodes[p].tag == "li")
        share[i] = max(prose[i] / whole, 0.7 * share[p] if up else 0.0)
        around = max(share[i], share[p] if up else 0.0)
        form[i] = under[i] / whole + 1e-9 if t in ("form", "fieldset") and not (up and form[p]) else form[p] if up else 0.0
        boxed = up and t in ("div", "section", "form") and direct[p] > 1 and 3 * under[i] < under[p] and below[i] < 4 * SENTENCE
        box[i] = boxed or (up and box[p])
        named[i] = (boxed and bool(k.names - _PLAIN - _GOOD)) or (up and named[p])
        out.append((
            1, t in HOLDS, t in PROSE, t[0] == "h" and t[1:].isdigit(), t in ("li", "td", "th", "dd", "dt"), bad_name, part_name, not bad_name and not k.names.isdisjoint(_GOOD),
            inside[i], all_bad[i], part_bad[i], outside[i], np.log1p(k.text) / 5, k.linked / k.text if k.text else 0, np.log1p(k.links),
            k.text > 2 * SENTENCE, np.log1p(below[i]) / 7, linked[i] / below[i] if below[i] else 0, part_bad[i] and not all_bad[i] and prose[i] > 3 * SENTENCE, around, top, listed[i], form[i] > 0, form[i], box[i], named[i], box[i] and inside[i], i < first and i not in path and below[i] > 0 and bool(long), i > last and bool(long), i not in path and (not up or p not in path or prose[p] < whole / 3) and not top, 20 * you[i] / words[i] if words[i] else 0, k.text > 0 and k.linked > 0.7 * k.text,
        ))
    never = -np.array(never, float)
    if n == 1:  # text without any element
        never[0] = 1.0
    return np.array(out, float).reshape(n, len(FEATURES)), never


def _edge_kinds(parent: np.ndarray, x: np.ndarray) -> np.ndarray:
    """0: a child like any; 1: a child whose name starts a bad part; 2: a child of an article or main part."""
    return np.where(x[:, 5] > 0, 1, np.where(x[:, 8] > 0, 2, 0))


class Forest:
    """Trees laid out by level; parent -1 are roots."""

    def __init__(self, parent: np.ndarray):
        self.parent = parent
        depth = np.zeros(len(parent), np.int64)
        for i, p in enumerate(parent.tolist()):
            if p >= 0:
                depth[i] = depth[p] + 1
        order = np.argsort(depth, kind="stable")
        cuts = np.searchsorted(depth[order], np.arange(depth.max() + 2 if len(depth) else 1))
        self.levels = [order[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis)
    return top + np.log(np.exp(x - np.expand_dims(top, axis)).sum(axis))


def marginals(forest: Forest, node: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """node: log potentials (n, 2); edge: of parent and child (n, 2, 2), roots' not read. Gives node and edge marginals and the log partition sum."""
    up = node.copy()
    sent = np.zeros_like(node)
    for level in reversed(forest.levels[1:]):
        sent[level] = _log_sum(edge[level] + up[level][:, None, :], 2)
        np.add.at(up, forest.parent[level], sent[level])
    down = np.zeros_like(node)
    pair = np.zeros_like(edge)
    for level in forest.levels[1:]:
        p = forest.parent[level]
        rest = up[p] + down[p] - sent[level]
        whole = rest[:, :, None] + edge[level]
        down[level] = _log_sum(whole, 1)
        both = whole + up[level][:, None, :]
        pair[level] = np.exp(both - _log_sum(both.reshape(len(level), 4), 1)[:, None, None])
    belief = up + down
    total = _log_sum(belief, 1)
    return np.exp(belief - total[:, None]), pair, float(total[forest.levels[0]].sum()) if len(node) else 0.0


class Model:
    def __init__(self, weights: np.ndarray, pairs: np.ndarray):
        self.weights, self.pairs = weights, pairs

    def potentials(self, parent: np.ndarray, x: np.ndarray, never: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        node = np.zeros((len(x), 2))
        node[:, 1] = x @ self.weights + NAMED * never
        return node, self.pairs[_edge_kinds(parent, x)]


def _marks(nodes: list[Node]) -> np.ndarray:
    """1 for blocks that are marked, and for those without text of their own most of whose text is in marked ones."""
    marked = ["xcontent" in n.names for n in nodes]
    below, good = [n.text for n in nodes], [n.text * m for n, m in zip(nodes, marked, strict=True)]
    for i in range(len(nodes) - 1, 0, -1):
        below[nodes[i].parent] += below[i]
        good[nodes[i].parent] += good[i]
    return np.array([m or (2 * g > b and not n.text) for n, m, g, b in zip(nodes, marked, good, below, strict=True)], int)


def train(pages: list[str], steps: int = 400, rate: float = 0.3, ridge: float = 0.002) -> Model:
    """pages: html whose content blocks have the name xcontent. Gradient steps on the log likelihood."""
    trees, rows, nevers, marks = [], [], [], []
    at = 0
    for page in pages:
        nodes, _ = parse(page)
        parent = np.array([n.parent for n in nodes])
        trees.append(np.where(parent >= 0, parent + at, -1))
        x, never = describe(nodes)
        rows.append(x)
        nevers.append(never)
        marks.append(_marks(nodes))
        at += len(nodes)
    parent, x, never, y = np.concatenate(trees), np.concatenate(rows), np.concatenate(nevers), np.concatenate(marks)
    forest = Forest(parent)
    child = parent >= 0
    kinds = _edge_kinds(parent, x)
    model = Model(np.zeros(x.shape[1]), np.zeros((3, 2, 2)))
    seen = np.zeros((len(x), 2, 2))
    seen[np.flatnonzero(child), y[parent[child]], y[child]] = 1
    speed_w, speed_p = np.zeros_like(model.weights), np.zeros_like(model.pairs)
    for _ in range(steps):
        node, edge = model.potentials(parent, x, never)
        belief, pair, _ = marginals(forest, node, edge)
        grad_w = x.T @ (y - belief[:, 1]) / len(x) - ridge * model.weights
        grad_p = np.zeros_like(model.pairs)
        np.add.at(grad_p, kinds[child], (seen - pair)[child])
        grad_p = grad_p / len(x) - ridge * model.pairs
        speed_w, speed_p = 0.9 * speed_w + grad_w, 0.9 * speed_p + grad_p
        model.weights, model.pairs = model.weights + rate * speed_w, model.pairs + rate * speed_p
    return model


@lru_cache(maxsize=1)
def trained() -> Model:
    return train(labelled_pages(100) + labelled_pages(100, seed=8, named=False) + 8 * hand_written(), steps=600, ridge=0.001)


def _text(kept: np.ndarray, pieces) -> str:
    """Kept pieces in page order; a run of one block's pieces is a block's text."""
    blocks: list[str] = []
    held: list[str] = []

    def flush() -> None:
        whole = _SPACE.sub(" ", html.unescape("".join(held))).strip()
        if whole:
            blocks.append(whole)
        held.clear()

    last = None
    for k, text in pieces:
        if text is None or k != last:
            flush()
        last = k
        if text is not None and kept[k]:
            held.append(text)
    flush()
    return " ".join(blocks)


def main_texts(pages: list[str | None], model: Model) -> list[str]:
    parsed = [parse(p or "") for p in pages]
    if not parsed:
        return []
    parents, rows, nevers, at = [], [], [], [0]
    for nodes, _ in parsed:
        parent = np.array([n.parent for n in nodes])
        parents.append(np.where(parent >= 0, parent + at[-1], -1))
        x, never = describe(nodes)
        rows.append(x)
        nevers.append(never)
        at.append(at[-1] + len(nodes))
    parent, x = np.concatenate(parents), np.concatenate(rows)
    belief, _, _ = marginals(Forest(parent), *model.potentials(parent, x, np.concatenate(nevers)))
    kept = belief[:, 1] > 0.5
    return [_text(kept[a:b], pieces) for (_, pieces), a, b in zip(parsed, at[:-1], at[1:], strict=True)]


def _extract(weights, pairs):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = Model(np.array(weights), np.array(pairs))
        for rows in batches:
            out: list[str] = []
            held, size = [], 0
            for page in rows["html"]:
                held.append(page)
                size += len(page or "")
                if len(held) >= 200 or size > GROUP:
                    out.extend(main_texts(held, model))
                    held, size = [], 0
            out.extend(main_texts(held, model))
            yield pd.DataFrame({"page_id": rows["page_id"].array, "url": rows["url"].array, "text": out, "n_chars": [len(t) for t in out]})

    return run


def extract(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """Per row: page_id, url, text, n_chars."""
    model = model or trained()
    held = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return held.mapInPandas(_extract(model.weights.tolist(), model.pairs.tolist()), "page_id long, url string, text string, n_chars long")


def op9_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


QUERIES = {"op9_html_extract": op9_html_extract}
