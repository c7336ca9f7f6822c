"""Language identification in two steps: the family, then the language within it.

A text is a vector of hashed byte n-grams (one to three bytes of its letters,
words set apart by spaces), square-rooted and normed. One-versus-rest linear
models tell families apart. Within a family, each pair of languages has a
linear support vector machine, and the languages vote; ties go to the larger
sum of margins.

Learned languages are the values seen in training; a language not in
``FAMILIES`` is a family of its own. Training takes at most ``MAX_TRAIN`` distinct
texts per language and ``MAX_TOTAL`` in all (131 MB of vectors). Null texts and texts without a letter are ``und`` with score 0.
With one language in training everything else is that language; with none
everything is ``und``. Repeated rows are predicted alike.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LETTERS, map_batches, sigmoid, text_of

MAX_TRAIN, MAX_TOTAL, DIMS, STEPS, C = 1_000, 16_000, 2_048, 150, 10.0

#: Families of language codes. Fixed values.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "fy", "lb"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "sl", "hr", "sr", "bs", "bg", "mk"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz"),
    "indic": ("hi", "bn", "mr", "ur", "pa", "gu", "ne"),
}
FAMILY_OF = {lang: name for name, langs in FAMILIES.items() for lang in langs}


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def vector(text: bytes) -> np.ndarray:
    """Unit vector of the whole text, counted in blocks of bounded size."""
    counts = np.zeros(DIMS)
    raw = np.frombuffer(b" " + b" ".join(text.translate(LETTERS).split()) + b" ", np.uint8)
    for at in range(0, max(1, len(raw) - 2), 1 << 20):
        b = raw[at : at + (1 << 20) + 2].astype(np.uint32)
        one, two = b, b[:-1] * 257 + b[1:]
        three = two[:-1] * 263 + b[2:] * 7
        for salt, codes in ((1, one[: 1 << 20]), (2, two[: 1 << 20]), (3, three)):
            h = (codes + np.uint32(salt * 0x51ED27)) * np.uint32(0x9E3779B1)
            counts += np.bincount(h >> np.uint32(32 - 11), minlength=DIMS)
    v = np.sqrt(counts)
    return v / max(1e-9, float(np.linalg.norm(v)))


def svm(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared-hinge linear SVM, y in -1, 1, classes weighing the same; the last weight is the intercept."""
    x = np.hstack([x, np.ones((len(x), 1))])
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    w = prev = np.zeros(x.shape[1])
    momentum, rate = w, 1 / (4 * C + 1)
    for t in range(STEPS):
        slack = np.maximum(0, 1 - y * (x @ momentum))
        grad = -2 * C * (x.T @ (weight * y * slack)) + np.append(momentum[:-1], 0)
        w = momentum - rate * grad
        momentum, prev = w + t / (t + 3) * (w - prev), w
    return w


@dataclass
class Model:
    families: list[str]
    langs: dict[str, list[str]]
    family_w: np.ndarray
    pair_w: dict[tuple[str, str], np.ndarray] = field(default_factory=dict)

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Languages and scores in 0..1: the family's and the winning pairs' squashed margins, multiplied."""
        full = np.hstack([x, np.ones((len(x), 1))])
        margins = full @ self.family_w.T
        best = margins.argmax(1)
        lang, score = np.empty(len(x), object), np.ones(len(x))
        if len(self.families) > 1:
            score = sigmoid(4 * margins.max(1))
        for f, family in enumerate(self.families):
            at = np.flatnonzero(best == f)
            names = self.langs[family]
            votes, sums, sure = np.zeros((len(at), len(names))), np.zeros((len(at), len(names))), np.ones((len(at), len(names)))
            for i, j in itertools.combinations(range(len(names)), 2):
                m = full[at] @ self.pair_w[names[i], names[j]]
                votes[:, i] += m >= 0
                votes[:, j] += m < 0
                sums[:, i] += m
                sums[:, j] -= m
                sure[:, i] = np.minimum(sure[:, i], sigmoid(4 * m))
                sure[:, j] = np.minimum(sure[:, j], sigmoid(-4 * m))
            win = np.lexsort((sums, votes), axis=1)[:, -1] if len(at) else np.zeros(0, int)
            lang[at] = np.array(names, object)[win]
            score[at] *= sure[np.arange(len(at)), win]
        return lang, score


def fit(x: np.ndarray, langs: list[str]) -> Model:
    known = sorted(set(langs))
    of = {n: FAMILY_OF.get(n, n) for n in known}
    families = sorted(set(of.values()))
    lang = np.array(langs, object)
    family = np.array([of[n] for n in langs], object)
    w = np.zeros((len(families), x.shape[1] + 1))
    if len(families) > 1:
        for k, f in enumerate(families):
            w[k] = svm(x, np.where(family == f, 1.0, -1.0))
    model = Model(families, {f: [n for n in known if of[n] == f] for f in families}, w)
    for names in model.langs.values():
        for a, b in itertools.combinations(names, 2):
            at = (lang == a) | (lang == b)
            model.pair_w[a, b] = svm(x[at], np.where(lang[at] == a, 1.0, -1.0))
    return model


def train(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", max_rows: int = MAX_TRAIN, max_total: int = MAX_TOTAL) -> Model | None:
    """Fitted on the distinct texts of smallest hash of every language: ``max_rows`` of each, fewer where languages are so many that the sum would pass ``max_total`` (but one at least).

    How many distinct texts a language has is estimated, and a hash below the
    level that this number sets is drawn in the scan, so no language meets in
    one task. Copies are drawn together and counted once.
    """
    spark = docs.sparkSession
    text, lang = F.col(f"`{text_col}`"), F.col(f"`{lang_col}`")
    rows = docs.where(lang.isNotNull() & text.isNotNull()).select(text.alias("text"), lang.cast("string").alias("lang"), F.xxhash64(F.lit(23), text).alias("mark"))
    sizes = {r["lang"]: max(1, r["n"]) for r in rows.groupBy("lang").agg(F.approx_count_distinct("mark").alias("n")).collect()}  # a row a language
    if not sizes:
        return None
    each = max(1, min(max_rows, max_total // len(sizes)))
    level = lambda n: (1 << 63) - 1 if n <= 2 * each else -(1 << 63) + (1 << 64) * (2 * each) // n
    levels = spark.createDataFrame([(name, level(n)) for name, n in sizes.items()], "__lang string, level long")
    drawn = rows.join(F.broadcast(levels), F.col("lang") == F.col("__lang")).where("mark <= level")
    marks: dict[str, list[int]] = {}
    for r in drawn.select("lang", "mark").distinct().toLocalIterator():  # about 2 * each rows a language
        marks.setdefault(r["lang"], []).append(r["mark"])
    cuts = spark.createDataFrame([(name, sorted(m)[:each][-1]) for name, m in marks.items()], "__lang string, level long")
    chosen = rows.join(F.broadcast(cuts), F.col("lang") == F.col("__lang")).where("mark <= level")
    seen: set[tuple] = set()  # a task measures copies once

    def run(c):
        at = [i for i, k in enumerate(zip(c["lang"], c["mark"], strict=True)) if not (k in seen or seen.add(k)) and has_letter(c["text"][i])]
        return {"lang": [c["lang"][i] for i in at], "mark": [c["mark"][i] for i in at], "x": [vector(text_of(c["text"][i])).astype(np.float32) for i in at]}

    got = map_batches(chosen.select("text", "lang", "mark"), run, "lang string, mark long, x array<float>").dropDuplicates(["lang", "mark"]).toArrow()
    if not got.num_rows:
        return None
    x = np.vstack([np.asarray(c.flatten()).reshape(-1, DIMS) for c in got.column("x").chunks if len(c)])
    langs, mark = got.column("lang").to_pylist(), got.column("mark").to_numpy()
    order = np.lexsort((mark, np.array(langs)))
    return fit(x[order], [langs[i] for i in order])


def identify(docs: DataFrame, model: Model | None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score."""

    def run(c):
        n = len(c["doc_id"])
        lang, score = np.array(["und"] * n, object), np.zeros(n)
        at = [i for i, t in enumerate(c["text"]) if t is not None and has_letter(t)] if model else []
        if at:
            lang[at], score[at] = model.predict(np.vstack([vector(text_of(c["text"][i])) for i in at]))
        return {"doc_id": c["doc_id"], "lang_pred": list(lang), "score": score}

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), run, f"doc_id {kind}, lang_pred string, score double")
