"""Main text of web pages by a tree-structured graphical model.

A page becomes a tree of its block elements with the runs of text as leaves. Every node has a hidden
state, article text (1) or not (0). Unary potentials come from tags, class names,
link shares and punctuation, and on pages whose tags and names tell nothing from lengths and shares of the text; a potential on each edge couples parent and child. Sum-product message passing, upward
and then downward, gives the marginals; runs with a marginal of at least one half are the
text. Weights are trained on labelled pages by maximum likelihood, whose gradient is the observed less the
expected features, and the expectations come from the same messages.

Defined results: null and empty pages have an empty text. Markup that is not closed ends with its parent; a script or style
without its end goes on to the end of the page, as in a browser; a page cut inside a tag loses that tag; character references are decoded once. White space inside a run is one space, a line
break (br) too; runs are joined by a line feed. Rows are read each for itself. An empty table gives no rows.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from unitscope.llm.common import append, table
from unitscope.llm.html_pages import pages as labelled_pages
from unitscope.llm.registry import query

# What the markup language says of its tags.
BLOCKS = frozenset(
    "address article aside blockquote body button center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 "
    "h3 h4 h5 h6 header hgroup hr html label legend li main menu nav ol option p pre section select summary table tbody td "
    "tfoot th thead tr ul caption".split()
)
#: Elements whose text is no text of the page: all up to their end tag. Without one, the first two go
#: on to the end of the page, as a browser reads them, the others to the next block element.
RAW = frozenset("script style textarea title iframe".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
}
#: Elements whose tag says what they hold.
TELLING = frozenset("article main nav header footer aside".split())
#: Elements an implied end never reaches beyond.
SCOPE = frozenset("html body table td th ul ol dl div article section main aside nav footer header form".split())
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_CLASS = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_MARK = re.compile(r"""data-l="([01])\"""")
_PART = re.compile(r"[a-z]+")
_STOP = re.compile(r"[.!?](?=\s|$)")
_BARE = re.compile(r"[^\s>]*")
_SPACES = re.compile(r"\s*")
_HEADING = re.compile("h[1-6]")
_END_TAG = {tag: re.compile(f"</{tag}(?![a-z0-9-])", re.I) for tag in RAW}
_ANY_TAG = re.compile(r"</?([a-zA-Z][a-zA-Z0-9]*)")


def tag_end(page: str, at: int) -> int:
    """Place of the ``>`` that ends a tag, from behind its name, or -1.

    A quote opens a value only right after ``=``; one without its like is an ordinary sign.
    """
    while True:
        end = page.find(">", at)
        if end < 0:
            return -1
        equal = page.find("=", at, end)
        if equal < 0:
            return end
        value = _SPACES.match(page, equal + 1).end()
        mark = page[value : value + 1]
        if mark in ('"', "'"):
            over = page.find(mark, value + 1)
            at = value + 1 if over < 0 else over + 1
        else:
            at = _BARE.match(page, value).end()


def _raw_end(page: str, tag: str, at: int, unclosed: set[str]) -> int:
    """Place behind a raw element whose start tag ends at ``at``; ``unclosed`` collects those without another end tag."""
    found = None if tag in unclosed else _END_TAG[tag].search(page, at)
    if found:
        close = page.find(">", found.end())
        return len(page) if close < 0 else close + 1
    unclosed.add(tag)
    if tag in ("script", "style"):
        return len(page)
    return next((m.start() for m in _ANY_TAG.finditer(page, at) if m[1].lower() in BLOCKS), len(page))


@dataclass
class Tree:
    """Nodes in document order; a parent comes before its children."""

    parent: list[int] = field(default_factory=list)
    tag: list[str] = field(default_factory=list)
    names: list[str] = field(default_factory=list)
    text: list[str | None] = field(default_factory=list)  # of runs
    linked: list[int] = field(default_factory=list)  # characters inside links
    mark: list[int] = field(default_factory=list)  # labels of training pages, -1 if unknown

    def add(self, parent: int, tag: str, names: str = "", text: str | None = None, linked: int = 0, mark: int = -1) -> int:
        for row, value in zip((self.parent, self.tag, self.names, self.text, self.linked, self.mark), (parent, tag, names, text, linked, mark)):
            row.append(value)
        return len(self.parent) - 1


def parse(page: str, marks: bool = False) -> Tree:
    """The tree of block elements and runs of text."""
    tree = Tree()
    stack = [tree.add(-1, "html")]
    run: list[str] = []
    state = {"linked": 0, "link": False}

    def end_run() -> None:
        if run:
            text = " ".join(entities.unescape("".join(run)).split())
            if text:
                tree.add(stack[-1], "#", text=text, linked=state["linked"])
            run.clear()
        state["linked"] = 0
        state["link"] = False

    def say(text: str) -> None:
        run.append(text)
        if state["link"]:
            state["linked"] += len(text)

    opened: Counter = Counter()

    def cut_stack(k: int) -> None:
        opened.subtract(tree.tag[i] for i in stack[k:])
        del stack[k:]

    at, n, unclosed = 0, len(page), set()
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            say(page[at:])
            break
        if lt > at:
            say(page[at:lt])
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        ahead = page[lt + 1 : lt + 2]
        if ahead in ("!", "?"):
            end = page.find(">", lt)
            at = n if end < 0 else end + 1
            continue
        closing = ahead == "/"
        name = _NAME.match(page, lt + 1 + closing)
        if not name:
            say("<")
            at = lt + 1
            continue
        end = page.find(">", name.end()) if closing else tag_end(page, name.end())
        if end < 0:  # cut inside a tag
            break
        tag = name.group().lower()
        attributes = page[name.end() : end]
        at = end + 1
        if closing:
            if tag == "a":
                state["link"] = False
            elif tag in BLOCKS:
                end_run()
                heading = _HEADING.fullmatch(tag)
                if sum(opened[f"h{i}"] for i in range(1, 7)) if heading else opened[tag]:
                    for k in range(len(stack) - 1, 0, -1):
                        if tree.tag[stack[k]] == tag or heading and _HEADING.fullmatch(tree.tag[stack[k]]):
                            cut_stack(k)
                            break
            continue
        if tag in RAW:
            if not attributes.rstrip().endswith("/"):
                at = _raw_end(page, tag, at, unclosed)
            say(" ")
            continue
        if tag == "a":
            state["link"] = True
        elif tag == "br" or tag == "img":
            run.append(" ")
        elif tag in BLOCKS:
            end_run()
            if tag == "html":
                continue
            if tag in CLOSES or tag != "button":
                wanted = CLOSES.get(tag, set()) | ({"p"} if tag not in ("button", "label", "option") else set())
                for k in range(len(stack) - 1, 0, -1) if any(opened[w] for w in wanted) else ():
                    open_tag = tree.tag[stack[k]]
                    if open_tag in wanted:
                        cut_stack(k)
                        if open_tag == "p" and tag not in CLOSES or not any(opened[w] for w in wanted):
                            break
                    elif open_tag in SCOPE:
                        break
            found = " ".join("".join(m.groups("")) for m in _CLASS.finditer(attributes)).lower() if "=" in attributes else ""
            label = -1
            if marks and (m := _MARK.search(attributes)):
                label = int(m[1])
            node = tree.add(stack[-1], tag, found, mark=label)
            if tag not in VOID:
                stack.append(node)
                opened[tag] += 1
    end_run()
    return tree


def _bucket(n: int) -> int:
    return min(int(n).bit_length(), 9)


def observe(tree: Tree, shape: bool = False) -> list[list[str]]:
    """Names of the features of every node: tags, names, links and ends of runs; with ``shape``, sizes
    and shares of the page's text instead of names."""
    n = len(tree.parent)
    chars, linked = [0] * n, [0] * n
    for i in range(n - 1, -1, -1):
        if tree.text[i] is not None:
            chars[i], linked[i] = len(tree.text[i]), min(tree.linked[i], len(tree.text[i]))
        if i:
            chars[tree.parent[i]] += chars[i]
            linked[tree.parent[i]] += linked[i]
    out = []
    for i in range(n):
        share = 4 * linked[i] // chars[i] if chars[i] else 0
        text = tree.text[i]
        if text is not None:
            told = [f"#ends {min(len(_STOP.findall(text)), 4)}", f"#size {min(len(text).bit_length(), 9)}"] if shape else []
            out.append([f"#in {tree.tag[tree.parent[i]]}", f"#links {share}", f"#stop {text[-1] in '.!?'}", *told])
        elif shape:
            out.append([f"tag {tree.tag[i]}", f"links {share}", f"share {tree.tag[i]} {4 * chars[i] // max(chars[0], 1)}"])
        else:
            out.append([f"tag {tree.tag[i]}", f"links {share}", *(f"name {w}" for w in set(_PART.findall(tree.names[i])))])
    return out


@dataclass
class Model:
    unary: dict[str, float]
    edge: list[list[float]]  # log potential of (parent, child) states
    shape: Model | None = None  # for pages whose names and tags tell nothing

    def tells(self, tree: Tree) -> bool:
        """Whether any tag or name of a page says what an element is for."""
        return any(t in TELLING for t in tree.tag) or any(f"name {w}" in self.unary for names in set(tree.names) for w in _PART.findall(names))


def marginals(parent: list[int], unary: list[float], edge: list[list[float]]) -> tuple[list[float], list[tuple[float, float, float, float]]]:
    """P(state 1) of every node, and of every edge the four joint probabilities (00, 01, 10, 11)."""
    n = len(parent)
    e00, e01, e10, e11 = (math.exp(edge[a][b]) for a in (0, 1) for b in (0, 1))
    # upward: beliefs of subtrees, scaled to sum 1
    b0, b1 = [1.0] * n, [0.0] * n
    for i in range(n):
        u = max(min(unary[i], 30.0), -30.0)
        b1[i] = 1 / (1 + math.exp(-u))
        b0[i] = 1 - b1[i] if u < 0 else math.exp(-u) * b1[i]
    m0, m1 = [1.0] * n, [1.0] * n
    for i in range(n - 1, 0, -1):
        s = b0[i] + b1[i]
        x, y = b0[i] / s, b1[i] / s
        b0[i], b1[i] = x, y
        p = parent[i]
        m0[i], m1[i] = e00 * x + e01 * y, e10 * x + e11 * y
        b0[p] *= m0[i]
        b1[p] *= m1[i]
        s = b0[p] + b1[p]
        b0[p] /= s
        b1[p] /= s
    # downward: what the rest of the tree says of a node, through its parent
    own = [0.0] * n
    joint = [(0.0, 0.0, 0.0, 0.0)] * n
    full0, full1 = b0[:], b1[:]
    own[0] = b1[0] / (b0[0] + b1[0])
    for i in range(1, n):
        p = parent[i]
        up0, up1 = full0[p] / m0[i], full1[p] / m1[i]
        j00, j01, j10, j11 = up0 * e00 * b0[i], up0 * e01 * b1[i], up1 * e10 * b0[i], up1 * e11 * b1[i]
        s = j00 + j01 + j10 + j11
        joint[i] = (j00 / s, j01 / s, j10 / s, j11 / s)
        own[i] = (j01 + j11) / s
        full0[i], full1[i] = 1 - own[i], own[i]
    return own, joint


def truth(tree: Tree) -> list[int]:
    """States of a labelled page: a run has the state of the nearest mark, an element whether it holds such a run."""
    n = len(tree.parent)
    near, state = [0] * n, [0] * n
    for i in range(n):
        near[i] = tree.mark[i] if tree.mark[i] >= 0 else (near[tree.parent[i]] if i else 0)
    for i in range(n - 1, -1, -1):
        if tree.text[i] is not None:
            state[i] = near[i]
        elif tree.mark[i] == 1:
            state[i] = 1
        if i and state[i]:
            state[tree.parent[i]] = 1
    return state


def train(pages: Iterable[str], rounds: int = 60, rate: float = 0.5, decay: float = 2e-4, shape: bool = False) -> Model:
    """Maximum likelihood with a quadratic penalty, by AdaGrad over whole rounds."""
    trees = [parse(p, marks=True) for p in pages]
    names: dict[str, int] = {}
    data = []
    for t in trees:
        seen = [[names.setdefault(f, len(names)) for f in row] for row in observe(t, shape)]
        flat = np.array([f for row in seen for f in row], dtype=np.int64)
        rows = np.repeat(np.arange(len(seen)), [len(r) for r in seen])
        data.append((t.parent, flat, rows, np.array(truth(t), dtype=float)))
    w, squares = np.zeros(len(names) + 4), np.full(len(names) + 4, 1e-6)
    total = sum(len(d[0]) for d in data)
    for _ in range(rounds):
        gradient = -decay * w * total
        edge = [[w[-4], w[-3]], [w[-2], w[-1]]]
        for parent, flat, rows, states in data:
            unary = np.bincount(rows, weights=w[flat], minlength=len(parent))
            own, joint = marginals(parent, unary.tolist(), edge)
            gradient[:-4] += np.bincount(flat, weights=(states - np.array(own))[rows], minlength=len(names))
            up = states[np.array(parent[1:], dtype=np.int64)] if len(parent) > 1 else np.zeros(0)
            down = states[1:]
            seen = np.array([((1 - up) * (1 - down)).sum(), ((1 - up) * down).sum(), (up * (1 - down)).sum(), (up * down).sum()])
            gradient[-4:] += seen - np.array(joint[1:]).reshape(-1, 4).sum(axis=0)
        squares += gradient**2
        w += rate * gradient / np.sqrt(squares)
    return Model({f: float(w[i]) for f, i in names.items()}, [[float(w[-4]), float(w[-3])], [float(w[-2]), float(w[-1])]])


@lru_cache(maxsize=1)
def standard_model() -> Model:
    """Trained on the labelled pages of this package, with and without telling names."""
    model = train(labelled_pages(220))
    model.shape = train(labelled_pages(220, seed=2, untold=True), shape=True)
    return model


def main_text(page: str, model: Model) -> str:
    tree = parse(page)
    shape = model.shape is not None and not model.tells(tree)
    if shape:
        model = model.shape
    weight = model.unary.get
    unary = [sum([weight(f, 0.0) for f in row]) for row in observe(tree, shape)]
    own, _ = marginals(tree.parent, unary, model.edge)
    return "\n".join(t for t, p in zip(tree.text, own) if t is not None and p >= 0.5)


def extract(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """``pages`` with ``text`` and ``n_chars``."""
    model = model or standard_model()

    def make(batch: pa.RecordBatch) -> dict:
        texts = [main_text(h, model) if h else "" for h in batch.column(batch.schema.get_field_index("html")).to_pylist()]
        return {"text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())}

    return append(pages, make, "text string, n_chars long")


@query("op1_html_text")
def op1_html_text(spark, sf_dir):
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")
