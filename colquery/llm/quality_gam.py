"""Quality classifier: a generalised additive model with pairwise interactions.

A text gives a dozen numbers. Each is cut into bins at quantiles of the
training rows. Boosting goes round the features in turn, each time fitting a
tree of at most four leaves on one feature's bins to the gradient and adding a
small step of it to that feature's lookup table. Pairs of features that still
explain residuals get two-way tables the same way. A score is the logistic of
an intercept plus one table value per feature and pair: binning and additions,
all vectorised.

Training takes at most ``MAX_TRAIN`` labelled rows (those of smallest hash; an
id counts once, and not at all if its labels disagree);
scoring covers every row. Null and empty texts have defined features (zeros)
and so a score. Null labels are left out. With no or one-sided labels the score
is the smoothed share of label 1. Repeated rows are scored alike.
"""

from __future__ import annotations

import itertools
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import labelled, map_batches, sigmoid, text_of

MAX_TRAIN, BINS, COARSE, ROUNDS, PAIR_ROUNDS, PAIRS, RATE, L2 = 12_000, 32, 8, 120, 60, 8, 0.1, 2.0
NAMES = ("log_words", "word_length", "upper", "digit", "symbol", "mark", "non_ascii", "distinct", "top_word", "dup_lines", "line_words", "stops", "capitals")

_UPPER, _DIGIT, _SYMBOL, _MARK, _HIGH, _SPACE, _STOP = range(7)
_CLASS = np.zeros((256, 7))
for _k, _chars in ((_UPPER, range(65, 91)), (_DIGIT, range(48, 58)), (_SYMBOL, b"#*$%&|<>"), (_MARK, b"!?;:\"'()[]{}=+/\\@^_~`-"), (_HIGH, range(128, 256)), (_SPACE, (9, 10, 11, 12, 13, 32)), (_STOP, b".,")):
    _CLASS[list(_chars), _k] = 1


def features(text: bytes) -> list[float]:
    """The numbers of NAMES, from the whole text."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(NAMES)
    c = np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ _CLASS
    chars = max(1.0, len(text) - c[_SPACE])
    counts = Counter(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    return [float(np.log1p(n)), chars / n, c[_UPPER] / chars, c[_DIGIT] / chars, c[_SYMBOL] / chars, c[_MARK] / chars, c[_HIGH] / chars,
            len(counts) / n, max(counts.values()) / n, 1 - len(set(lines)) / len(lines), float(np.log1p(n / len(lines))), c[_STOP] / n, c[_UPPER] / n]


def _cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """Best gain of cutting ordered bins in two, and the first bin of the right side (0: no cut)."""
    if len(g) < 2:
        return 0.0, 0
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = gl**2 / (hl + L2) + gr**2 / (hr + L2) - g.sum() ** 2 / (h.sum() + L2)
    gain[(hl < 1e-3) | (hr < 1e-3)] = 0
    k = int(gain.argmax())
    return (float(gain[k]), k + 1) if gain[k] > 1e-9 else (0.0, 0)


def _leaves(g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
    """Newton step per bin of a tree of the given depth over ordered bins."""
    _, k = _cut(g, h) if depth else (0.0, 0)
    if not k:
        return np.full(len(g), -g.sum() / (h.sum() + L2))
    return np.concatenate([_leaves(g[:k], h[:k], depth - 1), _leaves(g[k:], h[k:], depth - 1)])


def _leaves2(g: np.ndarray, h: np.ndarray, depth: int = 2) -> tuple[np.ndarray, float]:
    """The same over a grid, cutting along either axis; also the gain of the first cut."""
    best = max(((*_cut(g.sum(1 - a), h.sum(1 - a)), a) for a in (0, 1)), key=lambda x: x[0]) if depth else (0.0, 0, 0)
    gain, k, a = best
    if not k:
        return np.full(g.shape, -g.sum() / (h.sum() + L2)), 0.0
    parts = [_leaves2(x, y, depth - 1)[0] for x, y in zip(np.split(g, [k], a), np.split(h, [k], a), strict=True)]
    return np.concatenate(parts, axis=a), gain


@dataclass
class Gam:
    edges: list[np.ndarray]
    coarse: list[np.ndarray]
    base: float = 0.0
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    grids: list[np.ndarray] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        for j, t in enumerate(self.tables):
            z += t[np.searchsorted(self.edges[j], x[:, j], side="right")]
        for (i, j), t in zip(self.pairs, self.grids, strict=True):
            z += t[np.searchsorted(self.coarse[i], x[:, i], side="right"), np.searchsorted(self.coarse[j], x[:, j], side="right")]
        return sigmoid(z)


def _edges(x: np.ndarray, bins: int) -> list[np.ndarray]:
    return [np.unique(np.quantile(c, np.arange(1, bins) / bins)) if len(c) else np.zeros(0) for c in x.T]


def fit(x: np.ndarray, y: np.ndarray) -> Gam:
    model = Gam(_edges(x, BINS), _edges(x, COARSE))
    share = (y.sum() + 1) / (len(y) + 2)
    model.base = float(np.log(share / (1 - share)))
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    if len(y) == 0 or y.min() == y.max():
        return model
    codes = [np.searchsorted(e, c, side="right") for e, c in zip(model.edges, x.T, strict=True)]
    z = np.full(len(y), model.base)
    for _ in range(ROUNDS):
        for j, code in enumerate(codes):
            p = sigmoid(z)
            size = len(model.tables[j])
            step = RATE * _leaves(np.bincount(code, p - y, size), np.bincount(code, p * (1 - p), size))
            model.tables[j] += step
            z += step[code]
    wide = [np.searchsorted(e, c, side="right") for e, c in zip(model.coarse, x.T, strict=True)]
    shape = [len(e) + 1 for e in model.coarse]

    def grid(i, j, w):
        return np.bincount(wide[i] * shape[j] + wide[j], w, shape[i] * shape[j]).reshape(shape[i], shape[j])

    p = sigmoid(z)
    gains = {(i, j): _leaves2(grid(i, j, p - y), grid(i, j, p * (1 - p)))[1] for i, j in itertools.combinations(range(x.shape[1]), 2)}
    model.pairs = [k for k in sorted(gains, key=lambda k: -gains[k])[:PAIRS] if gains[k] > 0]
    model.grids = [np.zeros((shape[i], shape[j])) for i, j in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for k, (i, j) in enumerate(model.pairs):
            p = sigmoid(z)
            step = RATE * _leaves2(grid(i, j, p - y), grid(i, j, p * (1 - p)))[0]
            model.grids[k] += step
            z += step[wide[i], wide[j]]
    return model


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "label", max_rows: int = MAX_TRAIN) -> Gam:
    """At most ``max_rows`` labelled rows; repeated and null ids are taken care of in ``labelled``."""
    y, x = labelled(docs, labels, label_col, max_rows, lambda t: features(text_of(t)), "double", id_col=id_col, text_col=text_col)
    return fit(np.array(x, dtype=float).reshape(len(y), len(NAMES)), np.array(y, dtype=float))


def score(docs: DataFrame, model: Gam, *, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, score and the columns named in ``keep``."""
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}

    def run(c):
        x = np.array([features(text_of(t)) for t in c["__text"]]).reshape(-1, len(NAMES))
        return {"doc_id": c["__id"], "score": model.score(x)} | {k: c[k] for k in keep}

    schema = ", ".join([f"doc_id {kinds[id_col]}", "score double", *(f"`{k}` {kinds[k]}" for k in keep if k not in ("doc_id", "score"))])
    keep = tuple(k for k in keep if k not in ("doc_id", "score"))
    return map_batches(docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"), *keep), run, schema)
