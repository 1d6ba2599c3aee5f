"""Main text of web pages: gradient-boosted trees over DOM-node features, decoded so that no node contradicts another.

A page is parsed into elements inside its own task. Trees score every element from what its subtree, attributes,
depth and siblings look like; the best consistent choice is then found from the leaves up: what is left out is left
out with all below it, and what is kept has kept all above it.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rookery.llm.common import ship, thinned

ship(__name__)

#: Fixed sets of the markup language.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title svg iframe object head".split())
#: Of these, what a browser reads as text to the end of the page if no end tag follows.
TO_THE_END = frozenset("script style textarea title".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: A start tag of the set ends an open element of the kind, up to the nearest of the bounds.
CLOSES = {
    "p": (BLOCK, frozenset("body div article section main td li blockquote aside footer header nav form".split())),
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "tr": (frozenset(["tr"]), frozenset(["table", "tbody", "thead", "tfoot"])),
    "td": (frozenset(["td", "th", "tr"]), frozenset(["table"])),
    "th": (frozenset(["td", "th", "tr"]), frozenset(["table"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
}
#: Never main text, whatever the trees say.
NEVER = frozenset("nav aside form footer button select script style noscript template iframe svg head".split())
TAGS = ("article", "main", "section", "div", "p", "h1", "h2", "h3", "ul", "ol", "li", "table", "tr", "td", "blockquote", "pre", "header", "figure")
#: Words in class, id and role, by what they speak for.
TOKENS = {
    "text": re.compile(r"article|content|post|entry|story|body|main|text"),
    "comment": re.compile(r"comment|discuss|reply|disqus|respond|review"),
    "advert": re.compile(r"\bads?\b|advert|sponsor|promo|banner|outbrain|taboola"),
    "menu": re.compile(r"nav|menu|breadcrumb|pagination|pager|tabs|toc"),
    "frame": re.compile(r"header|footer|sidebar|side|masthead|copyright|widget"),
    "notice": re.compile(r"cookie|consent|notice|alert|popup|modal|newsletter|subscribe|signup|login|gdpr"),
    "links": re.compile(r"related|share|social|tags|recommend|popular|more"),
}
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|textarea|title)(?=[\s/>]).*?(?:</\1\s*>|\Z)"
    r"|<(/?)(noscript|template|svg|iframe|object)(?=[\s/>])((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>",
    re.S | re.I,
)
_SPACE = re.compile(r"\s+")
_TAG_NUMBER = {t: k for k, t in enumerate(TAGS)}


@dataclass
class Node:
    tag: str
    parent: int
    depth: int
    tokens: str = ""
    children: list[int] = field(default_factory=list)
    #: Pieces of text and children of a block in page order; inline elements add their text to the block around them.
    parts: list[str | int] = field(default_factory=list)
    links: int = 0  # characters inside links, own block only


def hidden_ends(page: str) -> dict[int, int]:
    """Where each start tag of noscript, template, svg, iframe and object ends, if it is closed: the end of its end tag."""
    found, opened = {}, {}
    for m in _HIDDEN.finditer(page):
        if not m[3]:
            continue
        starts = opened.setdefault(m[3].lower(), [])
        if not m[2]:
            if not (m[3].lower() == "svg" and m[4].rstrip().endswith("/")):
                starts.append(m.end())
        elif starts:
            found[starts.pop()] = m.end()
    return found


def parse(page: str) -> list[Node]:
    """Block elements of a page in page order, each after its parent; text inside inline elements belongs to its block."""
    nodes = [Node("html", -1, 0)]
    block, opened, link, at = 0, [(0, "html")], 0, 0
    hidden: dict[int, int] | None = None
    while at < len(page):
        m = _TAG.search(page, at)
        text = page[at : m.start()] if m else page[at:]
        if text:
            text = html.unescape(text)
            nodes[block].parts.append(text)
            if link:
                nodes[block].links += len(text.strip())
        if not m:
            break
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            if name == "a":
                link = max(0, link - 1)
            for k in range(len(opened) - 1, 0, -1):
                if opened[k][1] == name:
                    del opened[k:]
                    block = opened[-1][0]
                    break
            if name in ("p", "br") or name in BLOCK:
                nodes[block].parts.append(" ")
            continue
        if name in RAW:
            if name != "head" and name not in TO_THE_END:
                hidden = hidden_ends(page) if hidden is None else hidden
                at = hidden.get(at, at)  # empty or never closed: what follows is page text
                nodes[block].parts.append(" ")
                continue
            end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            if name != "head":
                at = end.end() if end else len(page)
                nodes[block].parts.append(" ")
                continue
            at = end.end() if end else at
            continue
        if name == "br" or name == "hr":
            nodes[block].parts.append(" ")
        if name in VOID:
            continue
        if name == "a":
            link += not m[3].rstrip().endswith("/")
        if name in BLOCK:
            for kind, (starts, bounds) in CLOSES.items():
                if name in starts:
                    for k in range(len(opened) - 1, 0, -1):
                        if opened[k][1] == kind:
                            del opened[k:]
                            break
                        if opened[k][1] in bounds:
                            break
            block = opened[-1][0]
            if name in ("html",):
                continue
            tokens = " ".join(a or b or c for _, a, b, c in _ATTRIBUTE.findall(m[3])).lower()
            nodes.append(Node(name, block, nodes[block].depth + 1, tokens))
            nodes[block].children.append(len(nodes) - 1)
            nodes[block].parts.append(len(nodes) - 1)
            block = len(nodes) - 1
            if not m[3].rstrip().endswith("/"):
                opened.append((block, name))
            else:
                block = opened[-1][0]
        elif not m[3].rstrip().endswith("/"):
            opened.append((block, name))
    return nodes


def own_blocks(node: Node) -> list[str | int]:
    """Runs of text of a block, white space as one space, and its children, in page order."""
    found: list[str | int] = []
    run = ""
    for part in [*node.parts, -1]:
        if isinstance(part, str):
            run += part
            continue
        run = " ".join(run.split())
        if run:
            found.append(run)
        run = ""
        if part >= 0:
            found.append(part)
    return found


FEATURES = (
    *(f"tag_{t}" for t in TAGS), *(f"token_{t}" for t in TOKENS), *(f"above_{t}" for t in TOKENS), "in_article", "chars", "links", "nodes",
    "density", "depth", "siblings", "place", "same_tag", "children", "text_share", "parent_share", "stops", "word", "before", "longest",
)


def describe(pages: list[tuple[list[Node], list[list[str | int]]]]) -> np.ndarray:
    """Features of every element of some pages, page after page (elements, FEATURES)."""
    tag, marks, numbers = [], [], []
    none = (0,) * len(TOKENS)
    for nodes, blocks in pages:
        n = len(nodes)
        chars, links, size, stops, words, longest = [0] * n, [0] * n, [1] * n, [0] * n, [0] * n, [0] * n
        place, same, siblings, before = [0] * n, [1] * n, [1] * n, [0] * n
        own_marks, above, article = [none] * n, [none] * n, [0] * n
        seen = 0
        for i, node in enumerate(nodes):
            before[i] = seen
            for run in blocks[i]:
                if isinstance(run, str):
                    size_of = len(run)
                    chars[i] += size_of
                    stops[i] += run.count(".") + run.count(",")
                    words[i] += run.count(" ") + 1
                    if size_of > longest[i]:
                        longest[i] = size_of
            seen += chars[i]
            links[i] = min(node.links, chars[i])
            if node.tokens:
                own_marks[i] = tuple(bool(t.search(node.tokens)) for t in TOKENS.values())
            if i:
                p = node.parent
                above[i] = above[p] if own_marks[p] is none else tuple(x or y for x, y in zip(above[p], own_marks[p]))
                article[i] = article[p] or nodes[p].tag == "article" or nodes[p].tag == "main"
            if node.children:
                counts: dict[str, int] = {}
                for k in node.children:
                    counts[nodes[k].tag] = counts.get(nodes[k].tag, 0) + 1
                for at, k in enumerate(node.children):
                    place[k], same[k], siblings[k] = at, counts[nodes[k].tag], len(node.children)
        for i in range(n - 1, 0, -1):
            p = nodes[i].parent
            chars[p] += chars[i]
            links[p] += links[i]
            size[p] += size[i]
            stops[p] += stops[i]
            words[p] += words[i]
            if longest[i] > longest[p]:
                longest[p] = longest[i]
        whole = max(1, chars[0])
        for i, node in enumerate(nodes):
            tag.append(_TAG_NUMBER.get(node.tag, -1))
            marks.append(own_marks[i] + above[i])
            numbers.append((
                article[i], chars[i], links[i], size[i], node.depth, siblings[i], place[i], same[i], len(node.children),
                chars[i] / whole, chars[i] / max(1, chars[max(0, node.parent)]), stops[i], words[i], before[i] / whole, longest[i],
            ))
    v = np.array(numbers, np.float32).T
    tags = (np.array(tag)[:, None] == np.arange(len(TAGS))[None, :]).astype(np.float32)
    article, chars, links, size, depth, siblings, place, same, children, share, parent_share, stops, words, before, longest = v
    rest = (
        article, np.log1p(chars), links / np.maximum(chars, 1), np.log1p(size), np.log1p(chars / size), depth, siblings, place, same, children,
        share, parent_share, stops / np.maximum(words, 1), chars / np.maximum(words, 1), before, np.log1p(longest),
    )
    return np.concatenate([tags, np.array(marks, np.float32), np.stack(rest, axis=1)], axis=1)


@dataclass
class Trees:
    """Boosted trees of fixed depth: per tree and inner place the feature and the bound, per leaf the score."""

    start: float
    feature: np.ndarray  # trees x (2^depth - 1)
    bound: np.ndarray
    leaf: np.ndarray  # trees x 2^depth

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Log odds of each row."""
        total = np.full(len(x), self.start)
        inner = self.feature.shape[1]
        rows = np.arange(len(x))
        for feature, bound, leaf in zip(self.feature, self.bound, self.leaf):
            at = np.zeros(len(x), np.int64)
            for _ in range(inner.bit_length()):
                at = 2 * at + 1 + (x[rows, feature[at]] > bound[at])
            total += leaf[at - inner]
        return total


def boost(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.3, bins: int = 24, least: int = 10) -> Trees:
    """Newton boosting of the logistic loss with binned splits."""
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    share = min(0.99, max(0.01, float(y.mean()))) if len(y) else 0.5
    model = Trees(float(np.log(share / (1 - share))), np.zeros((trees, 2**depth - 1), np.int64), np.full((trees, 2**depth - 1), np.inf), np.zeros((trees, 2**depth)))
    score = np.full(len(y), model.start)
    for t in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)
        place = np.zeros(len(y), np.int64)
        for node in range(2**depth - 1):
            rows = np.flatnonzero(place == node)
            best = (1e-3, 0, np.inf)
            if len(rows) >= 2 * least:
                total_g, total_h = g[rows].sum(), h[rows].sum()
                base = total_g**2 / (total_h + 1)
                for j, c in enumerate(cuts):
                    if not len(c):
                        continue
                    b = binned[rows, j]
                    left_g = np.cumsum(np.bincount(b, g[rows], len(c) + 1))[:-1]
                    left_h = np.cumsum(np.bincount(b, h[rows], len(c) + 1))[:-1]
                    left_n = np.cumsum(np.bincount(b, minlength=len(c) + 1))[:-1]
                    gain = left_g**2 / (left_h + 1) + (total_g - left_g) ** 2 / (total_h - left_h + 1) - base
                    gain[(left_n < least) | (len(rows) - left_n < least)] = -1
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (gain[k], j, c[k])
            model.feature[t, node], model.bound[t, node] = best[1], best[2]
            place[rows] = 2 * node + 1 + (x[rows, best[1]] > best[2])
        place -= 2**depth - 1
        leaf_g, leaf_h = np.bincount(place, g, 2**depth), np.bincount(place, h, 2**depth)
        model.leaf[t] = rate * leaf_g / (leaf_h + 1)
        score += model.leaf[t][place]
    return model


def decode(nodes: list[Node], odds: np.ndarray) -> np.ndarray:
    """Which elements are kept: the most likely choice in which all above a kept element is kept.

    Kept, an element adds its log odds and the best of its children; left out, nothing, and neither does what is below it.
    """
    value = np.where([n.tag in NEVER for n in nodes], -np.inf, odds)
    for i in range(len(nodes) - 1, 0, -1):
        if value[i] > 0:
            value[nodes[i].parent] += value[i]
    kept = np.zeros(len(nodes), bool)
    for i, node in enumerate(nodes):
        kept[i] = value[i] > 0 and (node.parent < 0 or kept[node.parent])
    return kept


def text_of(nodes: list[Node], blocks: list[list[str | int]], kept: np.ndarray) -> str:
    """Kept blocks in page order, one line each."""
    lines: list[str] = []
    stack = [iter(blocks[0])] if kept[0] else []
    while stack:
        part = next(stack[-1], None)
        if part is None:
            stack.pop()
        elif isinstance(part, str):
            lines.append(part)
        elif kept[part]:
            stack.append(iter(blocks[part]))
    return "\n".join(lines)


#: Pages to learn from: at most so many, those of smallest hash.
SAMPLE_PAGES = 300


def variants(pages: list[str], seed: int = 5) -> list[tuple[str, str]]:
    """(page, its article as marked up) for learning: the pages as they are, and again with other frames around the article.

    The frames hold what an article must not: sidebars, notices, forms, adverts, comments, page headers, menus
    without menu tags. Their words are those of the pages' own menus, adverts and footers, their class names differ
    from page to page, and the article is put under other names too.
    """
    rng = np.random.default_rng(seed)
    strip = lambda s: _SPACE.sub(" ", re.sub(r"<[^>]*>", " ", s)).strip()
    found = []
    pool = [strip(x) for p in pages for x in re.findall(r"<(?:nav|footer)\b.*?</(?:nav|footer)>|<div class=\"ad\">.*?</div>", p, re.S)]
    articles = [m[1] for p in pages if (m := re.search(r"<article[^>]*>(.*?)</article>", p, re.S))]
    pool += [x for a in articles[::3] for x in re.findall(r"<p>([^<]{20,300})", a)[:2]]
    some = lambda: pool[rng.integers(len(pool))] if pool else "more"
    pick = lambda *x: x[rng.integers(len(x))]
    for page in pages:
        m = re.search(r"<article[^>]*>(.*?)</article>", page, re.S)
        if not m:
            continue
        found.append((page, m[1]))
        links = "".join(f'<li><a href="/{k}">{some()[:20]}</a></li>' for k in range(rng.integers(2, 9)))
        before = [
            f'<div class="{pick("site-header", "masthead", "header-top")}"><h2>{some()[:40]}</h2></div>', f"<header><h1>{some()[:50]}</h1><p>{some()}</p></header>",
            f'<div class="{pick("menu", "nav-links", "breadcrumb")}"><ul>{links}</ul></div>', f'<div class="{pick("cookie-notice", "consent-banner", "alert")}"><p>{some()}</p><button>OK</button></div>',
            f'<div class="{pick("ad", "advert", "sponsored", "ad-slot")}"><p>{some()}</p></div>',
        ]
        after = [
            f'<div class="{pick("sidebar", "side-column", "widget")}"><h3>{some()[:20]}</h3><ul>{links}</ul><p>{some()}</p></div>', f"<aside><p>{some()}</p></aside>",
            f'<section class="{pick("comments", "comment-list", "discussion")}" id="comments"><h3>Comments</h3>' + "".join(f'<div class="comment"><p>{some()}</p></div>' for _ in range(rng.integers(1, 6))) + "</section>",
            f'<div class="{pick("related", "share", "recommended")}"><ul>{links}</ul></div>', f'<div class="{pick("newsletter", "subscribe", "login-box")}"><form><p>{some()}</p><input><button>Go</button></form></div>',
            f'<div class="{pick("footer", "copyright", "page-footer")}"><p>{some()}</p></div>',
        ]
        body = m[1]
        inside = "".join(a for a in (before[4], after[3], after[4]) if rng.random() < 0.15)
        shell = pick(("<article>", "</article>"), ("<main>", "</main>"), ('<div class="content">', "</div>"), ('<div id="post-body">', "</div>"), ("<div>", "</div>"))
        made = "<body>" + "".join(b for b in before if rng.random() < 0.5) + shell[0] + body + inside + shell[1] + "".join(a for a in after if rng.random() < 0.5) + "</body>"
        found.append((made, body))
    return found


def learn(pages: list[str]) -> Trees | None:
    """Trees from pages whose article is marked; an element counts as main text if it or an element below it stands in the article."""
    xs, ys = [], []
    for page, article in variants(pages):
        lines: dict[str, int] = {}
        for block in map(own_blocks, parse(article)):
            for run in block:
                if isinstance(run, str):
                    lines[run] = lines.get(run, 0) + 1
        nodes = parse(page)
        blocks = [own_blocks(n) for n in nodes]
        hit = np.zeros(len(nodes))
        for i, own in enumerate(blocks):
            hit[i] = nodes[i].tag not in NEVER and any(isinstance(run, str) and run in lines for run in own)
        for i in range(len(nodes) - 1, 0, -1):
            hit[nodes[i].parent] += hit[i]
        xs.append(describe([(nodes, blocks)]))
        ys.append(hit > 0)
    return boost(np.concatenate(xs), np.concatenate(ys).astype(float)) if xs else None


def extractor(model: Trees | None):
    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = []
            for at in range(0, len(batch), 64):  # pages whose trees are scored together
                parsed = [parse(h or "") for h in batch["html"].iloc[at : at + 64]]
                blocks = [[own_blocks(n) for n in nodes] for nodes in parsed]
                x = describe(list(zip(parsed, blocks)))
                odds = model.scores(x) if model else np.ones(len(x))
                start = 0
                for nodes, own in zip(parsed, blocks):
                    texts.append(text_of(nodes, own, decode(nodes, odds[start : start + len(nodes)])))
                    start += len(nodes)
            yield batch.drop(columns="html").assign(text=texts, n_chars=np.array([len(t) for t in texts], np.int64))

    return extract


def main_text(pages: DataFrame, sample: int = SAMPLE_PAGES) -> DataFrame:
    """(page_id, url, text, n_chars): one row per input row; null and empty HTML give the empty text.

    Trees learn on a bounded sample of pages that mark their article. Without any such page every element but the
    ones that never hold main text is kept. Repeated rows each get a row; other columns are ignored.
    """
    marked = pages.where(F.col("html").contains("<article")).select("html", F.xxhash64("html").alias("_order"))
    marked = marked.where(F.length("html") < 20_000)  # a page to learn from is no longer than this
    drawn = [r["html"] for r in thinned(marked, "_order", sample).orderBy("_order", "html").limit(sample).collect()]
    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInPandas(extractor(learn(drawn)), f"page_id {kind}, url string, text string, n_chars long")
