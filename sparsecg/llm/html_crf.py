"""Main-text extraction by a linear-chain conditional random field over DOM leaf blocks.

A page is read into leaf blocks (html_blocks): stretches of text between block-level tags, each with the elements
around it. Features of a block are its ancestors' tags and the words of their class, id and role attributes, whether
it stands in a container of main text if the page has one, and properties of its text and of its parent's (length,
share of linked text, stops, marks). Texts count for themselves only on pages without such a container: where there is
one, what a block says must not outweigh where it stands. A block is `main` or `other`; weights of features and of the
transitions between neighbours are learned by gradient ascent on the conditional likelihood of labelled pages
(forward-backward), and pages are decoded by Viterbi. The labelled pages come from html_pages, which writes pages of
many layouts with known main text; train() takes any others.

Features are hashed to FEATURES places; training sees at most TRAINING_PAGES pages; each page is decoded whole.

Defined results: null or empty html and pages without main blocks give an empty text; repeated rows get the same
text; an empty table gives an empty result; other columns are carried on by the caller.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import html_pages
from .common import arrow_map, slices
from .html_blocks import Block, Node, Page, read

FEATURES = 1 << 14
TRAINING_PAGES = 1200
ROUNDS = 150
_MAIN_TAGS, _MAIN_NAMES = frozenset(("article", "main")), frozenset(html_pages.MAIN)
_OTHER_TAGS, _OTHER_NAMES = frozenset(("nav", "aside", "footer", "form")), frozenset(n for names in html_pages.PARTS.values() for n in names)


@functools.lru_cache(maxsize=100_000)
def _hash(s: str) -> int:
    return zlib.crc32(s.encode("utf-8", "replace")) % FEATURES


def _own_names(node: Node) -> list[str]:
    return [f"t:{node.tag}", *(f"w:{w}" for w in node.words)]


def _container(node: Node) -> int:
    """2 for a main element, 1 for a container named like one, else 0."""
    if node.tag in _MAIN_TAGS or "main" in node.words and "role" in node.words:
        return 2
    return int(not _MAIN_NAMES.isdisjoint(node.words))


def _standing(node: Node) -> tuple[int, bool]:
    """The best container that a node is in, itself included, and whether a part of another kind lies between."""
    best, other = node.parent.value[1:] if node.parent else (0, False)
    own = _container(node)
    if node.tag in _OTHER_TAGS or not own and not _OTHER_NAMES.isdisjoint(node.words):
        return best, True
    return (best, True) if other else (max(best, own), False)


class Features:
    """The features of a page's blocks. What depends on elements alone is worked out once for each element.

    An element's features are those that it adds to its ancestors', so that deep pages take no more than flat ones.
    """

    def __init__(self, page: Page):
        self.page = page
        texts: dict[int, list[int]] = {}  # code points, and linked ones, of the blocks of one parent
        for b in page.blocks:
            both = texts.setdefault(id(b.node.parent or b.node), [0, 0])
            both[0] += len(b.text)
            both[1] += min(b.linked, len(b.text))
        self.share = {k: linked / max(1, n) for k, (n, linked) in texts.items()}
        if not page.nodes:
            self._visit()
        self.best = max((b.node.value[1] for b in page.blocks), default=0)

    def _visit(self) -> None:
        """Notes at each element the features that it adds and the container that it is in."""
        on_path: dict[str, int] = {}
        path: list[tuple[Node, list[str]]] = []
        for b in self.page.blocks:
            new, node = [], b.node
            while node and not (node.depth < len(path) and path[node.depth][0] is node):
                new.append(node)
                node = node.parent
            keep = node.depth + 1 if node else 0
            for _, own in path[keep:]:
                for x in own:
                    on_path[x] -= 1
            del path[keep:]
            for node in reversed(new):
                own = _own_names(node)
                if node.value is None:
                    self.page.nodes.append(node)
                    node.value = (tuple(_hash(x) for x in dict.fromkeys(own) if not on_path.get(x)), *_standing(node))
                for x in own:
                    on_path[x] = on_path.get(x, 0) + 1
                path.append((node, own))

    def of_block(self, k: int) -> tuple[int, ...]:
        """Features of a block besides those of the elements around it."""
        b, page = self.page.blocks[k], self.page
        n = len(b.text)
        share = b.linked / max(n, 1)
        around = self.share[id(b.node.parent or b.node)]
        where = "none" if not self.best else "in" if b.node.value[1] == self.best else "out"
        where += " other" if b.node.value[2] else ""
        link = 0 if share == 0 else 1 if share < 0.6 else 2
        beside = 0 if around == 0 else 1 if around < 0.4 else 2
        names = ["bias", f"where:{where}", f"best:{self.best}{where}", f"p:{b.node.tag}", f"where:{where}:{b.node.tag}", *(f"pw:{w}" for w in b.node.words), f"link:{link}", f"beside:{beside}"]
        if not self.best:
            ends = b.text[-1] in ".!?…:\"'。"
            size = min(10, n.bit_length())
            names += [f"len:{size}", f"lenlink:{size}{link}", f"linkbeside:{link}{beside}", f"stop:{ends}{link}", f"dots:{min(3, b.text.count('. ') + b.text.count(', '))}", f"tag:{b.node.tag}{link}", f"taglen:{b.node.tag}{size}", f"edge:{k == 0}{k + 1 == len(page.blocks)}{min(size, 7)}{link}", f"sign:{b.text[0] in '©®|»«•·'}"]
        return tuple(map(_hash, names))

    def of_all(self) -> list[np.ndarray]:
        """All features of each block, those of the elements around it too."""
        return [np.array(sorted({*self.of_block(k), *(f for n in b.node.path() for f in n.value[0])})) for k, b in enumerate(self.page.blocks)]


class Crf:
    """Weights of the two labels: of features for `main` against `other`, and of transitions."""

    def __init__(self, w: np.ndarray, trans: np.ndarray, first: np.ndarray):
        self.w, self.trans, self.first = w, trans, first
        self._weights = w.tolist()

    def scores(self, page: Page) -> list[float]:
        """The score of each block for `main`."""
        w, features = self._weights, Features(page)
        around: dict[int, float] = {}
        for node in page.nodes:
            around[id(node)] = (around[id(node.parent)] if node.parent else 0.0) + sum([w[f] for f in node.value[0]])
        return [around[id(b.node)] + sum([w[f] for f in features.of_block(k)]) for k, b in enumerate(page.blocks)]

    def decode(self, scores: list[float]) -> list[bool]:
        """The likeliest labels by Viterbi."""
        if not scores:
            return []
        (oo, om), (mo, mm) = self.trans.tolist()
        back: list[tuple[bool, bool]] = []
        o, m = self.first.tolist()
        m += scores[0]
        for s in scores[1:]:
            to_o, to_m = (m + mo > o + oo), (m + mm > o + om)
            back.append((to_o, to_m))
            o, m = max(m + mo, o + oo), max(m + mm, o + om) + s
        label = m > o
        labels = [label]
        for to_o, to_m in reversed(back):
            label = to_m if label else to_o
            labels.append(label)
        return labels[::-1]


def train(pages: list[tuple[Page, list[bool]]], rounds: int = ROUNDS, rate: float = 0.5, ridge: float = 1e-2) -> Crf:
    """Gradient ascent (with adaptive steps) on the conditional log-likelihood of labelled pages, minus a ridge."""
    pages = [(p, y) for p, y in pages if p.blocks]
    feats = [f for p, _ in pages for f in Features(p).of_all()]
    flat, row = np.concatenate(feats), np.repeat(np.arange(len(feats)), [len(f) for f in feats])
    y = np.concatenate([np.array(l, int) for _, l in pages])
    size = np.array([len(p.blocks) for p, _ in pages])
    begin = np.cumsum(size) - size
    longest = int(size.max())
    w, trans, first = np.zeros(FEATURES), np.zeros((2, 2)), np.zeros(2)
    g2w, g2t, g2f = np.full(FEATURES, 1e-6), np.full((2, 2), 1e-6), np.full(2, 1e-6)
    inside = np.ones(len(y), bool)
    inside[begin] = False
    pairs = np.bincount(2 * y[np.flatnonzero(inside) - 1] + y[inside], minlength=4).reshape(2, 2).astype(float)
    starts = np.bincount(y[begin], minlength=2).astype(float)
    seen = np.bincount(flat, weights=y[row], minlength=FEATURES)
    for _ in range(rounds):
        s = np.zeros((len(y), 2))
        np.add.at(s[:, 1], row, w[flat])
        alpha, beta = np.full((len(size), longest, 2), -np.inf), np.zeros((len(size), longest, 2))
        at = lambda k: (size > k, begin[size > k] + k)
        alpha[:, 0] = first + s[begin]
        for k in range(1, longest):
            on, i = at(k)
            alpha[on, k] = np.logaddexp.reduce(alpha[on, k - 1][:, :, None] + trans, axis=1) + s[i]
        for k in range(longest - 2, -1, -1):
            on, i = at(k + 1)
            beta[on, k] = np.logaddexp.reduce(trans + (s[i] + beta[on, k + 1])[:, None, :], axis=2)
        z = np.logaddexp.reduce(alpha[np.arange(len(size)), size - 1], axis=1)
        p = np.zeros(len(y))
        expected = np.zeros((2, 2))
        for k in range(longest):
            on, i = at(k)
            p[i] = np.exp(alpha[on, k, 1] + beta[on, k, 1] - z[on])
            if k:
                expected += np.exp(alpha[on, k - 1][:, :, None] + trans + (s[i] + beta[on, k])[:, None, :] - z[on][:, None, None]).sum(0)
        p0 = p[begin]
        gw = seen - np.bincount(flat, weights=p[row], minlength=FEATURES) - ridge * w
        gt = pairs - expected - ridge * trans
        gf = starts - np.array([(1 - p0).sum(), p0.sum()]) - ridge * first
        for g, g2, x in ((gw, g2w, w), (gt, g2t, trans), (gf, g2f, first)):
            g2 += g * g
            x += rate * g / np.sqrt(g2)
    return Crf(w, trans, first)


def labelled(made: list[tuple[str, list[str]]]) -> list[tuple[Page, list[bool]]]:
    """Pages and labels of their blocks, from markup with the texts of the main blocks, aligned in page order."""
    out = []
    for markup, mains in made:
        page, k, labels = read(markup), 0, []
        for b in page.blocks:
            hit = k < len(mains) and b.text == mains[k]
            labels.append(hit)
            k += hit
        if k == len(mains):
            out.append((page, labels))
    return out


@functools.lru_cache(maxsize=1)
def default_model() -> Crf:
    return train(labelled(html_pages.pages(TRAINING_PAGES)))


def main_blocks(model: Crf, page: Page) -> list[Block]:
    return [b for b, main in zip(page.blocks, model.decode(model.scores(page)), strict=True) if main]


def extract(model: Crf, markup: str | None) -> str:
    return "\n".join(b.text for b in main_blocks(model, read(markup)))


def _extracted(w: np.ndarray, trans: np.ndarray, first: np.ndarray):
    models: list[Crf] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not models:
            models.append(Crf(w, trans, first))
        for b in batches:
            pages = b.column(2).to_pylist()
            for lo, hi in slices(pages):
                texts = [extract(models[0], p) for p in pages[lo:hi]]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return run


def main_text(pages: DataFrame, model: Crf | None = None) -> DataFrame:
    """page_id, url, text, n_chars for each row of pages(page_id, url, html)."""
    m = model or default_model()
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return arrow_map(rows, _extracted(m.w, m.trans, m.first), "page_id long, url string, text string, n_chars long")
