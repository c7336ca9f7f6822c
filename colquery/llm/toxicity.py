"""Toxicity by a classifier chain.

Categories are predicted one after the other. Each has a linear (logistic)
model over the words of a text plus the probabilities of the categories before
it. For training, those probabilities are out of fold: each row's come from
models that haven't seen it, so later models don't learn to trust them more
than they deserve. At scoring, they come from the models fitted on all rows.

The labels know one kind of toxicity. The categories before it are its kinds as
the labelled texts themselves part: the toxic training rows are clustered by
the words that they use (spherical k-means from far seeds, ``KINDS`` clusters,
fewer where rows are few), and a text is an example of kind k if it is toxic
and in cluster k. The last category is toxicity itself.

Features are whole words and word beginnings of four to eight bytes, so that
inflected forms count; the ones that tell the classes apart best are chosen on
the training rows, ``MAX_FEATURES`` at most, by 32-bit id. A text counts each
once. The threshold is set on probabilities of models, kinds and features that
haven't seen the row: all three are chosen anew for each fold.

Training takes at most ``MAX_TRAIN`` rows of each class of the last category;
an id counts once, and not at all if its labels disagree.
Scoring covers every whole text. Null and empty texts have no features and
score the intercepts. With no or one-sided labels a category's probability is
its smoothed share. Repeated rows score alike.
"""

from __future__ import annotations

from dataclasses import dataclass
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import labelled, letters, map_batches, sigmoid, text_of

MAX_TRAIN, MAX_FEATURES, FOLDS, STEPS, L2 = 4_000, 384, 5, 200, 3e-4
MIN_TEXTS, MIN_CHI = 4, 15.0  # of a feature: training rows it occurs in, association beyond chance
CUT_FOLDS, BETA = 3, 0.5  # folds whose rows set the threshold; of the F measure that sets the threshold: clean texts matter more than toxic ones
BEGIN = range(4, 9)
MEMORY = 300_000

KINDS, KIND_ROWS, KIND_STEPS = 2, 20, 25  # clusters of toxic rows, rows a cluster needs on average, rounds


def grams(word: bytes) -> list[int]:
    """Ids of a word and its beginnings."""
    return [crc32(word), *(crc32(b"^" + word[:n]) for n in BEGIN if len(word) >= n)]


def text_grams(text: bytes) -> np.ndarray:
    return np.unique(np.fromiter((g for w in set(letters(text)) for g in grams(w)), np.uint32)).view(np.int32)


@dataclass
class Chain:
    names: tuple[str, ...]
    vocabulary: np.ndarray  # sorted feature ids
    weights: list[np.ndarray]  # per category: features, then earlier categories, then the intercept
    threshold: float = 0.5

    def predict(self, x: np.ndarray) -> np.ndarray:
        probs = np.zeros((len(x), 0))
        for w in self.weights:
            full = np.hstack([x, probs, np.ones((len(x), 1))])
            probs = np.hstack([probs, sigmoid(full @ w)[:, None]])
        return probs


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted L2 logistic regression by accelerated gradient steps; the last column is the intercept."""
    x, y, weight = (np.asarray(v, np.float32) for v in (x, y, weight))
    w = np.zeros(x.shape[1], np.float32)
    share = (weight @ y + 1) / (weight.sum() + 2)
    w[-1] = np.log(share / (1 - share))
    if len(y) == 0 or y.min() == y.max():
        return w
    total = weight.sum()
    norm = 1.0
    v = np.ones(x.shape[1], np.float32)
    for _ in range(8):  # largest curvature by power iteration
        v = x.T @ (weight * (x @ v)) / total
        norm = np.linalg.norm(v)
        v /= max(norm, 1e-12)
    rate, prev, momentum = np.float32(1 / (norm / 4 + L2)), w.copy(), w.copy()
    for t in range(STEPS):
        grad = x.T @ (weight * (sigmoid(x @ momentum) - y)) / total + np.float32(L2) * np.append(momentum[:-1], np.float32(0))
        w = momentum - rate * grad
        momentum, prev = w + np.float32(t / (t + 3)) * (w - prev), w
    return w.astype(float)


def choose(texts: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Sorted ids of features of enough texts, by how well they tell the classes apart (chi square), ties by id."""
    if not len(texts):
        return np.zeros(0, np.int32)
    ids, at = np.unique(np.concatenate(texts), return_inverse=True)
    n = np.bincount(at, minlength=len(ids))
    a = np.bincount(at, np.repeat(y, [len(t) for t in texts]), len(ids))
    share = min(max(y.mean(), 1e-6), 1 - 1e-6)
    e = n * share
    chi = np.maximum(np.abs(a - e) - 0.5, 0) ** 2 / (e * (1 - share) + 1)
    chi[n < MIN_TEXTS] = -1
    best = np.argsort(-chi, kind="stable")[:MAX_FEATURES]
    return np.sort(ids[best[chi[best] > MIN_CHI]])


def matrix(texts: list[np.ndarray], vocabulary: np.ndarray) -> np.ndarray:
    x = np.zeros((len(texts), len(vocabulary)))
    for i, g in enumerate(texts):
        x[i, np.isin(vocabulary, g)] = 1
    return x


def kinds(x: np.ndarray, count: int = KINDS) -> np.ndarray:
    """Cluster of each row of ``x`` (0/1 features): spherical k-means, deterministic; the largest cluster first."""
    count = min(count, len(x) // KIND_ROWS)
    if count < 2:
        return np.zeros(len(x), int)
    rare = x * np.log((1 + len(x)) / (1 + x.sum(0)))  # words that all share part nothing
    unit = rare / np.maximum(np.linalg.norm(rare, axis=1, keepdims=True), 1e-9)
    centre = unit.mean(0)
    seeds = [int((unit @ centre).argmax())]
    while len(seeds) < count:  # the row least like the seeds so far
        seeds.append(int((unit @ unit[seeds].T).max(1).argmin()))
    middle = unit[seeds]
    for _ in range(KIND_STEPS):
        of = (unit @ middle.T).argmax(1)
        sums = np.stack([unit[of == k].sum(0) if (of == k).any() else middle[k] for k in range(count)])
        middle = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
    of = (unit @ middle.T).argmax(1)
    order = np.argsort(-np.bincount(of, minlength=count), kind="stable")
    return np.argsort(order)[of]


def categories(x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """0/1 per category in chain order: the kinds that toxic rows part into, then toxicity."""
    of = np.full(len(y), -1)
    of[y == 1] = kinds(x[y == 1])
    return {f"kind{k}": (of == k).astype(float) for k in range(KINDS)} | {"toxic": y}


def links(x: np.ndarray, labels: dict[str, np.ndarray], weight: np.ndarray) -> list[np.ndarray]:
    """The chain's models; each is fitted with out-of-fold probabilities of the earlier categories."""
    folds = np.arange(len(weight)) % FOLDS
    models, out_of_fold = [], np.zeros((len(weight), 0))
    for name, y in labels.items():
        full = np.hstack([x, out_of_fold, np.ones((len(y), 1))])
        models.append(logistic(full, y, weight))
        if name != list(labels)[-1]:
            held = np.zeros(len(y))
            for k in range(FOLDS):
                rest = folds != k
                held[~rest] = sigmoid(full[~rest] @ logistic(full[rest], y[rest], weight[rest]))
            out_of_fold = np.hstack([out_of_fold, held[:, None]])
    return models


def fit(texts: list[np.ndarray], y: np.ndarray, weight: np.ndarray) -> Chain:
    """``texts`` as features, ``y`` toxicity as 0/1."""

    def chain(at: np.ndarray) -> Chain:
        some, toxic = [texts[i] for i in at], y[at]
        vocabulary = choose(some, toxic)
        x = matrix(some, vocabulary)
        labels = categories(x, toxic)
        return Chain(tuple(labels), vocabulary, links(x, labels, weight[at]))

    out = chain(np.arange(len(y)))
    if len(y) and 0 < y.sum() < len(y):  # the threshold of best F measure on rows that nothing was chosen on
        folds, p = (np.arange(len(y)) // 7) % CUT_FOLDS, np.zeros(len(y))
        for k in range(CUT_FOLDS):
            held = np.flatnonzero(folds == k)
            if len(held):
                part = chain(np.flatnonzero(folds != k))
                p[held] = part.predict(matrix([texts[i] for i in held], part.vocabulary))[:, -1]
        cuts, b = np.linspace(0.2, 0.9, 29), BETA**2
        f = [(1 + b) * (weight * y * (p >= c)).sum() / max(1e-9, (weight * (p >= c)).sum() + b * (weight * y).sum()) for c in cuts]
        out.threshold = float(cuts[int(np.argmax(f))])
    return out


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = MAX_TRAIN) -> Chain:
    sizes = {r["y"]: r["count"] for r in labels.groupBy(F.col(f"`{label_col}`").cast("int").alias("y")).count().where("y IN (0, 1)").collect()}
    y, texts = labelled(docs, labels, label_col, max_rows, lambda t: text_grams(text_of(t)), "int", id_col=id_col, text_col=text_col, per_class=True)
    y = np.array(y, dtype=float)
    seen = {c: max(1, int((y == c).sum())) for c in (0, 1)}
    weight = np.array([sizes.get(int(v), 0) / seen[int(v)] for v in y])  # classes weigh what they do among all labels
    weight = weight / max(1e-9, weight.mean()) if len(weight) else weight
    return fit(texts, y, weight)


def score(docs: DataFrame, chain: Chain, *, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, p_<category> for each, toxic (0/1) and the columns named in ``keep``."""
    made = [f"p_{n}" for n in chain.names]
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    keep = tuple(k for k in keep if k not in ("doc_id", "toxic", *made))
    memory: dict[bytes, tuple[int, ...]] = {}

    index = {int(np.int32(g)) & 0xFFFFFFFF: i for i, g in enumerate(chain.vocabulary)}

    def hits(word: bytes) -> tuple[int, ...]:
        return tuple(index[g] for g in grams(word) if g in index)

    def run(c):
        x = np.zeros((len(c["__id"]), len(chain.vocabulary)))
        for i, t in enumerate(c["__text"]):
            if len(memory) > MEMORY:
                memory.clear()
            for w in set(letters(text_of(t))):
                found = memory.get(w)
                if found is None:
                    found = memory[w] = hits(w)
                for k in found:
                    x[i, k] = 1
        p = chain.predict(x)
        return {"doc_id": c["__id"], "toxic": (p[:, -1] >= chain.threshold).astype(int)} | {n: p[:, j] for j, n in enumerate(made)} | {k: c[k] for k in keep}

    schema = ", ".join([f"doc_id {kinds[id_col]}", "toxic int", *(f"{n} double" for n in made), *(f"`{k}` {kinds[k]}" for k in keep)])
    return map_batches(docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"), *keep), run, schema)
