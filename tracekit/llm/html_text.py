"""Main text of web pages by a tree-structured graphical model.

A page is a tree of block elements, with runs of text as leaves. Every node
holds content or none: an element holds content if a leaf below it does.
Potentials of a node come from its tag, the words of its class, id and role,
and the amount and kind of its text; potentials of an edge say how content
follows from parent to child. Messages sent upward and then downward (sum-
product) give each leaf's probability of being content, and leaves that are
more likely so make up the text.

Weights are trained by maximum likelihood on labelled pages, pairs of a page
and its main text. Those that come with the module are made by a small
generator of page layouts; others can be given.

Pages are independent rows: parsing and messages run inside tasks, for all
pages of a batch at once level by level, and nothing is shuffled.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

BLOCKS = """address article aside blockquote body button canvas caption center dd details dialog div dl dt fieldset figcaption figure
footer form h1 h2 h3 h4 h5 h6 header hgroup html label legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr
ul""".split()
SKIPPED = "script style template noscript svg iframe object select textarea title head datalist audio video map".split()
RAW = ("script", "style", "textarea", "title", "iframe", "noscript")  # hold text up to their own end tag only
BREAKS = ("br", "hr", "img", "input")
CLOSED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
             "tbody": ("tr", "td", "th", "thead", "tbody"), "tfoot": ("tr", "td", "th", "thead", "tbody")}
SCOPES = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"),
          "tbody": ("table",), "tfoot": ("table",)}
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")

_TOKEN = re.compile(r"""<!--.*?(?:--!?>|\Z) | <[!?][^>]*+(?:>|\Z)
    | <(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)(?:>|\Z)
    | <(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*+)(?P<attrs2>[^>]*+)(?:>|\Z) | </?\Z""", re.S | re.X)
_ATTR = re.compile(r"""(?:^|[\s"'])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[a-z]+")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I) for tag in RAW}
_BLOCK_SET, _SKIPPED_SET = frozenset(BLOCKS), frozenset(SKIPPED)
LEAF = "#text"


@dataclass
class Tree:
    """Nodes in page order; a parent comes before its children."""

    parent: list[int] = field(default_factory=list)
    tag: list[str] = field(default_factory=list)
    names: list[tuple[str, ...]] = field(default_factory=list)
    text: list[str | None] = field(default_factory=list)
    linked: list[int] = field(default_factory=list)  # characters inside links, of leaves

    def add(self, parent: int, tag: str, names: tuple[str, ...] = (), text: str | None = None, linked: int = 0) -> int:
        self.parent.append(parent)
        self.tag.append(tag)
        self.names.append(names)
        self.text.append(text)
        self.linked.append(linked)
        return len(self.parent) - 1


def parse(page: str | None) -> Tree:
    """The tree of a page; never fails, unclosed and stray tags included.

    Inline tags don't part text; breaks count as white space. Character
    references are decoded, white space in a run becomes one blank, runs
    without anything else are left out. Text of skipped elements is no part.
    """
    tree = Tree()
    page = page or ""
    stack = [tree.add(-1, "html")]
    run: list[str] = []
    linked = at = 0
    skipping: list[str] = []  # open skipped elements and the blocks in them
    in_link = False
    open_now: Counter[str] = Counter()  # blocks on the stack, but for the root

    def close_from(k: int) -> str:
        """Close the blocks from the k-th on; the k-th one's tag."""
        for i in stack[k:]:
            open_now[tree.tag[i]] -= 1
        first = tree.tag[stack[k]]
        del stack[k:]
        return first

    def flush() -> None:
        nonlocal linked
        if run:
            text = " ".join(html.unescape("".join(run)).split())
            if text:
                tree.add(stack[-1], LEAF, (), text, min(linked, len(text)))
            run.clear()
        linked = 0

    def put(text: str) -> None:
        nonlocal linked
        if text and not skipping:
            run.append(text)
            if in_link:
                linked += len(text)

    while at < len(page):
        m = _TOKEN.search(page, at)
        if m is None:
            put(page[at:])
            break
        put(page[at:m.start()])
        at = m.end()
        tag = (m["tag"] or m["tag2"] or "").lower()
        if not tag:
            continue
        ending = (m["end"] or m["end2"]) == "/"
        if tag in _SKIPPED_SET:
            if ending:
                if tag in skipping:
                    while skipping.pop() != tag:
                        pass
            elif tag in RAW:
                end = _RAW_END[tag].search(page, at)
                at = end.start() if end else len(page)
            elif not (m["attrs"] or "").endswith("/"):
                skipping.append(tag)
            continue
        if tag == "body":
            skipping.clear()
        elif skipping == ["head"] and not ending and tag in _BLOCK_SET and tag != "html":
            skipping.clear()  # both tags of head are optional
        if skipping and (tag in _BLOCK_SET or "-" in tag):
            if not ending:
                skipping.append(tag)
                continue
            if tag in skipping:
                while skipping.pop() != tag:
                    pass
                continue
            if not open_now[tag]:
                continue
            skipping.clear()  # the block that unclosed skipped elements stand in ends
        if skipping:
            continue
        if tag in BREAKS:
            run.append(" ")
        elif tag == "a":
            in_link = not ending
        elif tag in _BLOCK_SET or "-" in tag:
            flush()
            in_link = False
            if tag in ("html", "body") and (ending or tag == "html"):
                continue
            if ending:
                if open_now[tag]:
                    while close_from(len(stack) - 1) != tag:
                        pass
                continue
            if len(stack) > 1 and (tree.tag[stack[-1]] == "p" or tree.tag[stack[-1]] in HEADINGS and tag in HEADINGS):
                close_from(len(stack) - 1)
            if tag in CLOSED_BY and any(open_now[t] for t in CLOSED_BY[tag]):
                for k in range(len(stack) - 1, 0, -1):
                    if tree.tag[stack[k]] in SCOPES[tag]:
                        break
                    if tree.tag[stack[k]] in CLOSED_BY[tag]:
                        close_from(k)
                        if tag not in ("tr", "tbody", "tfoot"):
                            break
            attrs = m["attrs"] if m["tag"] else m["attrs2"]
            names = tuple(dict.fromkeys(w for a in _ATTR.finditer(attrs) for w in _WORD.findall((a[2] or a[3] or a[4] or "").lower()))) if attrs else ()
            stack.append(tree.add(stack[-1], tag, names))
            open_now[tag] += 1
    flush()
    return tree


# --- features ------------------------------------------------------------

_TAGS = {t: i for i, t in enumerate([LEAF, "?", *BLOCKS])}
NAME_BASE = 2 * len(_TAGS)
NAME_SPACE = 2048  # class, id and role words are hashed into as many places
LEAF_BASE = NAME_BASE + NAME_SPACE
BLOCK_BASE = LEAF_BASE + 24
N_WEIGHTS = BLOCK_BASE + 24
WORD_STEPS, LINK_STEPS = (3, 6, 12, 25, 50), (0.01, 0.3, 0.7)
SIGN_EVERY = 400  # characters: a run has signs if it has one for so many
_SIGNS = re.compile(r"[©®|»›·•]|\bcopyright\b", re.I)


def _name_place(word: str) -> int:
    h = 2166136261
    for c in word.encode():
        h = (h ^ c) * 16777619 & 0xFFFFFFFF
    return NAME_BASE + (h ^ h >> 15) % NAME_SPACE


@dataclass
class Forest:
    """Many trees' nodes, with the active features of each."""

    parent: np.ndarray
    depth: np.ndarray
    node: np.ndarray
    feature: np.ndarray
    is_leaf: np.ndarray


def forest(trees: list[Tree]) -> Forest:
    parent, depth, leaf, words, linked, size, ends, signs, tags, names_at, names = [], [], [], [], [], [], [], [], [], [], []
    for tree in trees:
        base = len(parent)
        for i, up in enumerate(tree.parent):
            parent.append(base + up if up >= 0 else -1)
            depth.append(depth[base + up] + 1 if up >= 0 else 0)
            text = tree.text[i]
            leaf.append(text is not None)
            tags.append(_TAGS.get(tree.tag[i], 1))
            words.append(text.count(" ") + 1 if text else 0)
            size.append(len(text) if text else 0)
            linked.append(tree.linked[i])
            ends.append(bool(text) and text[-1] in ".!?…。\"”»:;")
            found = len(_SIGNS.findall(text)) if text else 0
            signs.append(found > 0 and found * SIGN_EVERY >= len(text))
            for name in tree.names[i]:
                names_at.append(base + i)
                names.append(_name_place(name))
    parent, depth, leaf, tags = np.array(parent, np.int64), np.array(depth, np.int64), np.array(leaf, bool), np.array(tags, np.int64)
    words, size, linked = (np.array(x, float) for x in (words, size, linked))
    all_words, all_size, all_linked = words.copy(), size.copy(), linked.copy()
    order = np.argsort(-depth, kind="stable")
    bounds = np.searchsorted(-depth[order], np.arange(-depth.max(initial=0), 1), "right")
    start = 0
    for end in bounds[:-1]:  # a level at a time, from the deepest up to the roots' children
        level = order[start:end]
        for x in (all_words, all_size, all_linked):
            np.add.at(x, parent[level], x[level])
        start = end
    share = all_linked / np.maximum(1, all_size)
    n = np.arange(len(parent))
    word_step = np.searchsorted(WORD_STEPS, all_words, "right")
    link_step = np.searchsorted(LINK_STEPS, share, "right")
    base = np.where(leaf, LEAF_BASE, BLOCK_BASE)
    up = np.where(parent >= 0, tags[np.maximum(0, parent)], 1)
    node = [n, n, n, n, np.flatnonzero(leaf & np.array(ends, bool)), np.flatnonzero(np.array(signs, bool)), np.array(names_at, np.int64)]
    place = [tags, len(_TAGS) + up, base + word_step, base + 8 + link_step, None, None, np.array(names, np.int64)]
    place[4], place[5] = np.full(len(node[4]), LEAF_BASE + 14), np.full(len(node[5]), LEAF_BASE + 15)
    return Forest(parent, depth, np.concatenate(node), np.concatenate(place).astype(np.int64), leaf)


# --- sum-product ---------------------------------------------------------

@dataclass
class Model:
    weights: np.ndarray  # of content, by feature
    edges: np.ndarray  # log potentials [child is a leaf][parent][child]


def _lse(x: np.ndarray) -> np.ndarray:
    return np.logaddexp(x[..., 0], x[..., 1])


def marginals(f: Forest, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """P(content) of every node, and P(parent, child) of every node's edge."""
    n = len(f.parent)
    up = np.zeros((n, 2))
    up[:, 1] = np.bincount(f.node, model.weights[f.feature], minlength=n)
    edge = model.edges[f.is_leaf.astype(int)]
    order = np.argsort(f.depth, kind="stable")
    bounds = np.searchsorted(f.depth[order], np.arange(f.depth.max(initial=0) + 2))
    levels = [order[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
    message = np.zeros((n, 2))
    for level in reversed(levels[1:]):  # children to parents
        message[level] = _lse(edge[level] + up[level][:, None, :])
        np.add.at(up, f.parent[level], message[level])
    belief = up.copy()
    joint = np.zeros((n, 2, 2))
    for level in levels[1:]:  # parents to children
        rest = belief[f.parent[level]] - message[level]
        both = rest[:, :, None] + edge[level]
        belief[level] = up[level] + _lse(np.swapaxes(both, 1, 2))
        both = both + up[level][:, None, :]
        joint[level] = np.exp(both - _lse(_lse(both))[:, None, None])
    return 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -50, 50))), joint


def labels_of(tree: Tree, text: str) -> list[bool]:
    """Which nodes hold content, given the page's main text: its leaves in
    order make up the text, and elements above them hold content too."""
    found, at = [False] * len(tree.parent), 0
    for i, own in enumerate(tree.text):
        if own is not None and text.startswith(own, at) and text[at + len(own):at + len(own) + 1] in ("", " "):
            at += len(own) + 1
            while i >= 0 and not found[i]:
                found[i] = True
                i = tree.parent[i]
    return found


def train(pages: list[tuple[str, str]], steps: int = 100, rate: float = 0.2, ridge: float = 0.0005) -> Model:
    """Maximum likelihood on labelled pages, (page, main text) each."""
    trees = [parse(page) for page, _ in pages]
    f = forest(trees)
    y = np.array([v for tree, (_, text) in zip(trees, pages) for v in labels_of(tree, text)], float)
    model = Model(np.zeros(N_WEIGHTS), np.zeros((2, 2, 2)))
    given = np.zeros((len(y), 2, 2))
    child = np.flatnonzero(f.parent >= 0)
    given[child, y[f.parent[child]].astype(int), y[child].astype(int)] = 1
    first, second = [0.0, 0.0], [0.0, 0.0]
    for step in range(1, steps + 1):
        p, joint = marginals(f, model)
        grads = [np.bincount(f.feature, (y - p)[f.node], minlength=N_WEIGHTS) / len(trees) - ridge * model.weights,
                 np.stack([(given - joint)[child][f.is_leaf[child] == k].sum(0) for k in (False, True)]) / len(trees) - ridge * model.edges]
        for i, (x, g) in enumerate(zip((model.weights, model.edges), grads)):
            first[i], second[i] = 0.9 * first[i] + 0.1 * g, 0.99 * second[i] + 0.01 * g * g
            x += rate * (first[i] / (1 - 0.9 ** step)) / (np.sqrt(second[i] / (1 - 0.99 ** step)) + 1e-6)
    return model


# --- labelled pages ------------------------------------------------------

# words that authors put into class, id and role, by what they mark
CONTENT_NAMES = "article content post entry main story body text page single markdown prose"
OTHER_NAMES = {
    "menu": "nav menu navbar navigation breadcrumb breadcrumbs topbar pagination pager toc links submenu skip",
    "header": "header masthead banner logo branding site top hero",
    "footer": "footer copyright legal bottom colophon contentinfo credits imprint",
    "sidebar": "sidebar side aside widget widgets related recommended trending popular complementary more rail teaser",
    "notice": "cookie cookies consent notice gdpr alert popup modal overlay message warning disclaimer paywall privacy announcement",
    "advert": "ad ads advert advertisement adsbox sponsor sponsored promo promotion banner adslot advertising commercial partner",
    "form": "form search login signup subscribe newsletter register contact signin",
    "comments": "comments comment reply replies discussion disqus respond thread responses feedback reviews reader",
    "share": "share social follow tags meta byline author date print rating toolbar buttons",
}
TAGS_OF = {"menu": ("nav", "div", "ul", "menu"), "header": ("header", "div"), "footer": ("footer", "div"), "sidebar": ("aside", "div", "section"),
           "notice": ("div", "section", "dialog", "p", "aside"), "advert": ("div", "aside", "section", "p", "figure"), "form": ("form", "div"),
           "comments": ("section", "div", "aside", "ol"), "share": ("div", "ul", "p")}


def _sentence(rng: random.Random, low: int, high: int) -> str:
    words = ["".join(rng.choice("bcdfghklmnprstvw") + rng.choice("aeiouéö") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(low, high))]
    return " ".join(words).capitalize()


def _prose(rng: random.Random, most: int = 6) -> str:
    return " ".join(_sentence(rng, 1, 18) + rng.choice(("...", ".", ".", "!", "?", "")) for _ in range(rng.randint(1, most)))


def _other(rng: random.Random, kind: str) -> str:
    """A part of a page that is no content."""
    tag = rng.choice(TAGS_OF[kind])
    names = rng.sample(OTHER_NAMES[kind].split(), rng.randint(1, 2))
    name = rng.choice((f' class="{" ".join(names)}"', f' class="{"-".join(names)}"', f' id="{names[0]}"', f' class="{names[0]}"'))
    if tag in ("nav", "footer", "aside", "form", "header", "menu", "dialog") and rng.random() < 0.5:
        name = ""
    link = lambda: f'<a href="/{rng.randint(1, 99)}">{_sentence(rng, 1, 3)}</a>'
    if kind == "menu" or kind in ("sidebar", "share", "header", "footer") and rng.random() < 0.5:
        inner = "".join(f"<li>{link()}</li>" for _ in range(rng.randint(2, 8)))
        inner = inner if tag in ("ul", "menu") else f"<ul>{inner}</ul>"
    elif kind == "form":
        inner = f"<label>{_sentence(rng, 1, 3)}</label><input name=q><button>{_sentence(rng, 1, 2)}</button>"
        inner += f"<p>{_prose(rng, 2)}</p>" if rng.random() < 0.5 else ""
    elif kind == "comments":
        one = lambda: f"<p>{_prose(rng, 3)}</p>" if tag != "ol" else f"<li><p>{_prose(rng, 3)}</p></li>"
        inner = f"<h3>{_sentence(rng, 1, 3)}</h3>" * (tag != "ol") + "".join(
            one() if rng.random() < 0.6 else f'<div class="comment">{_prose(rng, 2)}</div>' for _ in range(rng.randint(1, 5)))
    else:
        text = rng.choice(("&copy; ", "", "")) * (kind == "footer") + _prose(rng, 3)
        inner = text if tag == "p" or rng.random() < 0.5 else f"<p>{text}</p>" + (f"<p>{_prose(rng, 2)}</p>" if rng.random() < 0.4 else "")
        inner += link() if tag != "p" and rng.random() < 0.3 else ""
    return f"<{tag}{name}>{inner}</{tag}>"


def labelled_pages(n: int = 600, seed: int = 1) -> list[tuple[str, str]]:
    """Made-up page layouts with their main text."""
    rng, out = random.Random(seed), []
    for _ in range(n):
        texts, parts = [], []

        def say(text: str) -> str:
            texts.append(" ".join(text.split()))
            return text

        kinds = list(OTHER_NAMES)
        before = [_other(rng, k) for k in ("header", "menu", "notice", "advert", "menu", "form") if rng.random() < 0.4]
        after = [_other(rng, k) for k in ("share", "sidebar", "comments", "form", "advert", "notice") if rng.random() < 0.35]
        after += [_other(rng, "footer")] if rng.random() < 0.8 else []
        inside = rng.random() < 0.4
        parts.append(f"<h1>{say(_sentence(rng, 2, 12))}</h1>" if rng.random() < 0.85 else "")
        for _ in range(rng.randint(1, 9)):
            kind = rng.random()
            if kind < 0.7:
                parts.append(f"<p>{say(_prose(rng))}" + "</p>" * (rng.random() < 0.9))
            elif kind < 0.78:
                parts.append(f"<{(h := rng.choice(('h2', 'h3')))}>{say(_sentence(rng, 1, 6))}</{h}>")
            elif kind < 0.84:
                parts.append("<ul>" + "".join(f"<li>{say(_prose(rng, 1))}</li>" for _ in range(rng.randint(2, 5))) + "</ul>")
            elif kind < 0.88:
                parts.append(f"<blockquote><p>{say(_prose(rng, 2))}</p></blockquote>")
            elif kind < 0.91:
                parts.append(f"<pre>{say(_sentence(rng, 2, 9))}</pre>")
            elif kind < 0.94:
                rows = "".join("<tr>" + "".join(f"<td>{say(_sentence(rng, 1, 3))}</td>" for _ in range(2)) + "</tr>" for _ in range(3))
                parts.append(f"<table>{rows}</table>")
            elif inside:
                parts.append(_other(rng, rng.choice(kinds)))
        if inside:
            parts += [_other(rng, k) for k in ("share", "comments", "sidebar") if rng.random() < 0.4]
        tag = rng.choice(("article", "article", "main", "div", "section"))
        name = f' class="{rng.choice(CONTENT_NAMES.split())}"' if tag == "div" or rng.random() < 0.3 else ""
        middle = f"<{tag}{name}>" + "".join(parts) + f"</{tag}>"
        if rng.random() < 0.3:
            middle = f'<div class="{rng.choice(("wrapper", "container", "layout", "row"))}">{middle}{after.pop(0) if after else ""}</div>'
        out.append(("<html><body>" + "".join(before) + middle + "".join(after) + "</body></html>", " ".join(texts)))
    return out


# --- operator ------------------------------------------------------------

GROUP = 256  # pages whose messages are passed together


def texts_of(pages: list[str | None], model: Model, least: float = 0.5) -> list[str]:
    """The main text of each page, empty if there is none."""
    out: list[str] = []
    for at in range(0, len(pages), GROUP):
        trees = [parse(page) for page in pages[at:at + GROUP]]
        p, _ = marginals(forest(trees), model)
        start = 0
        for tree in trees:
            own = p[start:start + len(tree.parent)]
            out.append(" ".join(t for t, q in zip(tree.text, own) if t is not None and q >= least))
            start += len(tree.parent)
    return out


def extract(pages: DataFrame, model: Model | None = None, id_col: str = "page_id") -> DataFrame:
    """(id_col, url, text, n_chars) for every row of ``pages``.

    Null, empty and broken pages give what text they have, or the empty one;
    repeated rows and null ids stay, empty tables work, other columns are not
    used. Whole pages are parsed.
    """
    sent = pages.sparkSession.sparkContext.broadcast(model or train(labelled_pages()))
    fields = pages.select(id_col, "url").schema

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = texts_of(batch.column(2).to_pylist(), sent.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())],
                                             names=[id_col, "url", "text", "n_chars"])

    spec = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return pages.select(id_col, "url", "html").mapInArrow(rows, f"{spec}, text string, n_chars long")


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
