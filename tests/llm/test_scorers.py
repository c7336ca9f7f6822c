"""Scores by plain loops, and the verdict by an expectation-maximisation of its own."""

import math
from collections import defaultdict
from zlib import crc32

import numpy as np

from colquery.llm import language_id, quality_gam, quality_rules, toxicity
from colquery.llm.common import letters

TEXTS = [b"", b"A plain line of words, and another one.\nMore text here!", "Größe und Übung, ça va?".encode(), b"### $$$ buy now ||| <<<\n### $$$ buy now ||| <<<", b"word " * 50, b"x" * 500]


def logistic(z):
    return 1 / (1 + math.exp(-z))


def test_quality_scores_by_loops():
    rng = np.random.default_rng(0)
    x = rng.uniform(size=(600, len(quality_gam.NAMES)))
    model = quality_gam.fit(x, ((x[:, 0] > 0.5) ^ (x[:, 3] > 0.4)).astype(float))
    rows = np.array([quality_gam.features(t) for t in TEXTS] + x[:20].tolist())
    bin_of = lambda edges, v: sum(e <= v for e in edges)
    for row, score in zip(rows, model.score(rows), strict=True):
        z = model.base + sum(t[bin_of(e, v)] for t, e, v in zip(model.tables, model.edges, row, strict=True))
        z += sum(g[bin_of(model.coarse[i], row[i]), bin_of(model.coarse[j], row[j])] for (i, j), g in zip(model.pairs, model.grids, strict=True))
        assert math.isclose(score, logistic(z), rel_tol=1e-9)


def test_toxicity_scores_by_loops():
    rng = np.random.default_rng(1)
    words = [f"word{i}".encode() for i in range(40)]
    texts = [b" ".join(rng.choice(words, 12)) + (b" vile" if k % 3 == 0 else b" nasty" if k % 3 == 1 else b"") for k in range(240)]
    y = np.array([float(k % 3 < 2) for k in range(240)])
    chain = toxicity.fit([toxicity.text_grams(t) for t in texts], y, np.ones(240))
    p = chain.predict(toxicity.matrix([toxicity.text_grams(t) for t in texts], chain.vocabulary))
    for text, row in zip(texts, p, strict=True):
        grams = set()
        for w in letters(text):
            grams |= {crc32(w), *(crc32(b"^" + w[:n]) for n in range(4, 9) if len(w) >= n)}
        earlier = []
        for weights in chain.weights:
            here = [float((int(v) & 0xFFFFFFFF) in grams) for v in chain.vocabulary] + earlier + [1.0]
            earlier.append(logistic(max(-40, min(40, sum(a * b for a, b in zip(here, weights, strict=True))))))
        assert np.allclose(row, earlier, atol=1e-9)
    assert ((p[:, -1] >= chain.threshold) == y).all() and p[:, :2].max(axis=0).min() > 0.5  # both kinds are found


def test_language_vectors_by_loops():
    for text in TEXTS:
        counts = defaultdict(int)
        raw = b" " + b" ".join(letters(text)) + b" "
        for i in range(len(raw)):
            for salt, code in ((1, raw[i : i + 1]), (2, raw[i : i + 2]), (3, raw[i : i + 3])):
                if len(code) == salt:
                    value = code[0] if salt == 1 else code[0] * 257 + code[1] if salt == 2 else (code[0] * 257 + code[1]) * 263 + code[2] * 7
                    counts[((value + salt * 0x51ED27) * 0x9E3779B1 & 0xFFFFFFFF) >> 21] += 1
        want = np.zeros(language_id.DIMS)
        for k, n in counts.items():
            want[k] = math.sqrt(n)
        want /= max(1e-9, math.sqrt(sum(counts.values())))
        assert np.allclose(language_id.vector(text), want, atol=1e-9)


def test_language_votes_by_loops():
    rng = np.random.default_rng(2)
    langs = [n for n in ("en", "de", "nl", "fr", "es") for _ in range(12)]
    x = rng.normal(size=(60, 6)) * 0.3 + np.repeat(np.eye(6)[:5], 12, axis=0)
    model = language_id.fit(x, langs)
    got, score = model.predict(x)
    for row, lang, s in zip(x, got, score, strict=True):
        full = [*row, 1.0]
        dot = lambda w: sum(a * b for a, b in zip(full, w, strict=True))
        margins = [dot(w) for w in model.family_w]
        names = model.langs[model.families[margins.index(max(margins))]]
        votes, sums, sure = dict.fromkeys(names, 0), dict.fromkeys(names, 0.0), dict.fromkeys(names, 1.0)
        for (a, b), w in model.pair_w.items():
            if a in votes:
                m = dot(w)
                votes[a if m >= 0 else b] += 1
                sums[a] += m
                sums[b] -= m
                sure[a], sure[b] = min(sure[a], logistic(4 * m)), min(sure[b], logistic(-4 * m))
        best = max(names, key=lambda n: (votes[n], sums[n]))
        assert lang == best and math.isclose(s, logistic(4 * max(margins)) * sure[best], rel_tol=1e-9)


def test_verdicts_by_another_expectation_maximisation():
    """The same estimates row by row in numpy, where the operator counts patterns."""
    rng = np.random.default_rng(3)
    good = rng.random(4000) < 0.8
    votes = np.where(rng.random((4000, 6)) < 0.3, 0, np.where(rng.random((4000, 6)) < 0.85, 1, -1) * np.where(good, 1, -1)[:, None])
    counts = defaultdict(int)
    for v in votes.tolist():
        counts[tuple(v)] += 1
    post, share, *_ = quality_rules.expectation_maximisation(dict(counts))
    p, hit, miss = 0.8, np.full(6, 0.8), np.full(6, 0.8)
    for _ in range(100):
        a = np.log(p) + ((votes == 1) * np.log(hit) + (votes == -1) * np.log(1 - hit)).sum(1)
        b = np.log(1 - p) + ((votes == 1) * np.log(1 - miss) + (votes == -1) * np.log(miss)).sum(1)
        q = 1 / (1 + np.exp(b - a))
        p = (q.sum() + 16) / (len(votes) + 20)
        hit = np.minimum(1 - 1e-6, ((q[:, None] * (votes == 1)).sum(0) + 16) / ((q[:, None] * (votes != 0)).sum(0) + 20))
        miss = np.minimum(1 - 1e-6, (((1 - q)[:, None] * (votes == -1)).sum(0) + 16) / (((1 - q)[:, None] * (votes != 0)).sum(0) + 20))
    mine = np.array([post[tuple(v)] for v in votes.tolist()])
    assert np.allclose(mine, q, atol=1e-6) and math.isclose(share, p, rel_tol=1e-6) and ((mine >= 0.5) == (q >= 0.5)).all()
