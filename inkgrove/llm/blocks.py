"""Block labeller: a bidirectional LSTM in numpy over the leaves of a document.

A leaf is a non-blank line. It is described by its tag path (the containers open above it: fence, formula, HTML
elements and comments, wiki tables and templates, LaTeX environments), a hashed bag of its words, hashed shapes of the
marks in it and the names of its tags. The network
reads all leaves of a document in both directions and gives each a label (text, heading, list, code, formula, table,
frontmatter) and the probability that it holds residue of each kind, so a mark inside code is judged by the fence that
opened lines before it. Weights are trained by ``blocks_train`` and kept beside this module.
"""

from __future__ import annotations

import os
import re
from dataclasses import dataclass
from zlib import crc32

import numpy as np

LABELS = ("text", "heading", "list", "code", "formula", "table", "frontmatter")
KINDS = ("html", "wiki", "latex", "markdown")
PATHS, WORDS, SHAPES = 64, 128, 1024
DIM = PATHS + WORDS + SHAPES
WEIGHTS = os.path.join(os.path.dirname(__file__), "block_weights.npz")

_MARKS = re.compile(r"[<&'={}\\\[\]!*_~`$#|+\-]")
_SHAPE = re.compile(
    r"</?!?[^\s<>]{0,6}|/?>|&#?\w{0,6};?|\w?'{2,}\S?|={2,}|\{\{|\{\||\}\}|\|\}|\\[^\w\s]\{|\w?\\[a-zA-Z]+\*?[\[{]?|:?\\[^\w\s]?|\[\[|\]\]|\[\w{0,5}:?|\]\(|!\[|\*+\w?|_+\w?|~~+|`+|\$+|(?m:^\s*#+ ?|^\s*[-*+] |^\s*\d+[.)] |^\s*[|:!])"
)
_LETTERS, _DIGITS = re.compile(r"[^\W\d_]+"), re.compile(r"\d+")
_WORD = re.compile(r"[^\W_]+")
_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})")
_OPEN_TAG = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9]*)\b[^<>]*?(/?)>")
_TAG_NAME = re.compile(r"(\w?)<(/?[A-Za-z][A-Za-z0-9]*)")
_SPANS = (("<!--", "-->"), ("{{", "}}"))
_CONTAINERS = frozenset("ul ol li table tr td th div p details summary pre code blockquote dl".split())
_ENV = re.compile(r"\\(begin|end)\{(\w+)\*?\}")
_HEAD = re.compile(r" {0,3}(#{1,6})\s")
_ITEM = re.compile(r"\s*(?:[-*+]|\d{1,3}[.)])\s")


@dataclass(slots=True)
class Leaf:
    line: int
    start: int
    end: int
    path: tuple[str, ...]
    text: str


def leaves(text: str) -> list[Leaf]:
    """The non-blank lines with their places and tag paths. Lines end at \\n."""
    out: list[Leaf] = []
    fence, math, front = "", False, False
    stack: list[str] = []
    at = 0
    for number, line in enumerate(text.split("\n")):
        start, at = at, at + len(line) + 1
        bare = line.strip()
        if not bare:
            stack = [s for s in stack if s[0] != "<" or s in ("<table", "<ul", "<ol", "<pre", "<!--")]
            continue
        path: list[str] = []
        if number == 0 and bare == "---":
            front = True
            path = ["front"]
        elif front:
            path, front = ["front"], bare not in ("---", "...")
        elif fence:
            path = ["fence"]
            if bare.startswith(fence) and not bare.strip(fence[0]):
                fence = ""
        elif bare[0] in "`~" and (m := _FENCE.match(line)):
            fence, path = m.group(1), ["fence", "fence-open"]
        elif math:
            path, math = ["math"], "$$" not in bare
        elif bare.startswith("$$"):
            path, math = ["math"], "$$" not in bare[2:]
        else:
            path = list(stack)
            if m := _HEAD.match(line):
                path.append("h" + str(len(m.group(1))))
            elif _ITEM.match(line):
                path.append("item")
            elif bare[0] == "|":
                path.append("row")
            for opens, closes in _SPANS:
                if opens in stack:
                    if closes in line and line.rfind(opens) < line.rfind(closes):
                        stack.remove(opens)
                elif opens in line and line.rfind(opens) > line.rfind(closes):
                    stack.append(opens)
                    path.append(opens)
            if bare.startswith("{|"):
                stack.append("{|")
            elif bare.startswith("|}") and "{|" in stack:
                stack.remove("{|")
            if "<" in line:
                for m in _OPEN_TAG.finditer(line):
                    name = "<" + m.group(2).lower()
                    if name[1:] in _CONTAINERS:
                        path.append(name)
                        if m.group(1):
                            if name in stack:
                                del stack[len(stack) - 1 - stack[::-1].index(name) :]
                        elif not m.group(3):
                            stack.append(name)
            if "\\" in line:
                for m in _ENV.finditer(line):
                    name = "\\" + m.group(2)
                    path.append(name)
                    if m.group(1) == "begin":
                        stack.append(name)
                    elif name in stack:
                        del stack[len(stack) - 1 - stack[::-1].index(name) :]
        out.append(Leaf(number, start, start + len(line), tuple(path), line))
    return out


_word_bucket: dict[str, int] = {}


def _bucket(word: str) -> int:
    b = _word_bucket.get(word)
    if b is None:
        if len(_word_bucket) > 200_000:
            _word_bucket.clear()
        b = _word_bucket[word] = PATHS + crc32(word.lower().encode()) % WORDS
    return b


def shapes(line: str) -> set[str]:
    """Marks of a line, letters and digits inside them reduced to one character each."""
    if not _MARKS.search(line):
        return set()
    found = {_DIGITS.sub("0", _LETTERS.sub("a", s)) for s in _SHAPE.findall(line)}
    return found | {("a<" if before else "<") + name.lower() for before, name in _TAG_NAME.findall(line)} if "<" in line else found


def features(docs: list[list[Leaf]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows, one per leaf: where each starts, its columns, their values (presence of path entries and shapes, share
    of words by bucket). No row is empty."""
    starts, cols, vals = [], [], []
    for doc in docs:
        for leaf in doc:
            starts.append(len(cols))
            hit = {crc32(p.encode()) % PATHS for p in leaf.path} | {PATHS + WORDS + crc32(s.encode()) % SHAPES for s in shapes(leaf.text)}
            words = [_bucket(w) for w in _WORD.findall(leaf.text)]
            cols += hit
            vals += [1.0] * len(hit)
            cols += words
            vals += [1.0 / max(4, len(words))] * len(words)
            if len(cols) == starts[-1]:
                cols.append(DIM - 1)
                vals.append(0.0)
    return np.asarray(starts, np.int64), np.asarray(cols, np.int64), np.asarray(vals, np.float32)


def dense(sparse: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    starts, cols, vals = sparse
    row = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(cols))))
    return np.bincount(row * DIM + cols, weights=vals, minlength=len(starts) * DIM).astype(np.float32).reshape(len(starts), DIM)


def project(sparse: tuple[np.ndarray, np.ndarray, np.ndarray], w: np.ndarray) -> np.ndarray:
    """``dense(sparse) @ w`` without the zeros, in slices that stay in cache."""
    starts, cols, vals = sparse
    out = np.empty((len(starts), w.shape[1]), np.float32)
    for a in range(0, len(starts), 256):
        lo, hi = starts[a], starts[a + 256] if a + 256 < len(starts) else len(cols)
        out[a : a + 256] = np.add.reduceat(w[cols[lo:hi]] * vals[lo:hi, None], starts[a : a + 256] - lo, axis=0)
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass
class Labeller:
    """``wx_*`` (DIM, 4H), ``wh_*`` (H, 4H), ``b_*`` (4H) for f(orward) and b(ackward); ``wo`` (2H, labels + kinds), ``bo``; gates in order i, f, o, g."""

    params: dict[str, np.ndarray]
    thresholds: np.ndarray

    @classmethod
    def load(cls, path: str = WEIGHTS) -> Labeller:
        with np.load(path) as z:
            return cls({k: z[k].astype(np.float32) for k in z.files if k != "thresholds"}, z["thresholds"].astype(np.float32))

    def save(self, path: str) -> None:
        np.savez_compressed(path, thresholds=self.thresholds.astype(np.float32), **{k: v.astype(np.float16) for k, v in self.params.items()})

    def _direction(self, x: np.ndarray, valid: np.ndarray, d: str) -> np.ndarray:
        """Hidden states (B, T, H); padding keeps the state."""
        p, (b, t, _) = self.params, x.shape
        h_size = p["wh_" + d].shape[0]
        h = np.zeros((b, h_size), np.float32)
        c = np.zeros_like(h)
        out = np.empty((b, t, h_size), np.float32)
        for k in range(t) if d == "f" else range(t - 1, -1, -1):
            z = x[:, k] + h @ p["wh_" + d]
            gates, g = _sigmoid(z[:, : 3 * h_size]), np.tanh(z[:, 3 * h_size :])
            new_c = gates[:, h_size : 2 * h_size] * c + gates[:, :h_size] * g
            new_h = gates[:, 2 * h_size :] * np.tanh(new_c)
            v = valid[:, k, None]
            c, h = np.where(v, new_c, c), np.where(v, new_h, h)
            out[:, k] = h
        return out

    def scores(self, docs: list[list[Leaf]]) -> list[np.ndarray]:
        """Per document an array (leaves, labels + kinds): label probabilities, then residue probabilities."""
        order = sorted((k for k in range(len(docs)) if docs[k]), key=lambda k: len(docs[k]))
        out: list[np.ndarray] = [np.zeros((0, len(LABELS) + len(KINDS)), np.float32)] * len(docs)
        a = 0
        while a < len(order):
            e = a + 1
            while e < len(order) and e - a < 1024 and (e + 1 - a) * len(docs[order[e]]) <= 20_000:
                e += 1
            group = [docs[k] for k in order[a:e]]
            sizes = np.array([len(d) for d in group])
            valid = np.arange(sizes.max())[None, :] < sizes[:, None]
            wide = project(features(group), np.concatenate([self.params["wx_f"], self.params["wx_b"]], axis=1))
            both = []
            for d, flat in zip("fb", np.split(wide, 2, axis=1), strict=True):
                x = np.zeros((*valid.shape, self.params["b_" + d].size), np.float32)
                x[valid] = flat + self.params["b_" + d]
                both.append(self._direction(x, valid, d)[valid])
            z = np.concatenate(both, axis=1) @ self.params["wo"] + self.params["bo"]
            label = np.exp(z[:, : len(LABELS)] - z[:, : len(LABELS)].max(axis=1, keepdims=True))
            prob = np.concatenate([label / label.sum(axis=1, keepdims=True), _sigmoid(z[:, len(LABELS) :])], axis=1)
            for k, part in zip(order[a:e], np.split(prob, np.cumsum(sizes)[:-1]), strict=True):
                out[k] = part
            a = e
        return out
