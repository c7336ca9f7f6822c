"""Brute-force versions the operators are held against."""

import itertools
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD_TEXTS = [None, "", "   \n\t", "a", "same text here", "same text here", "ÀÉ ß 漢字 \x1c x", "word " * 3000, "x" * 50_000, "<|endoftext|> inside <|startoftext|>", " nbsp wide", "İ ǅ ﬁ é"]


def words(text):
    return WORD.findall(text or "")


def shingle_set(text, k=5):
    w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in words(text)]
    if not w:
        return set()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))}


def components(docs):
    """doc_id -> smallest reachable id, over all pairs; ``docs`` is a list of (id, text)."""
    sets = [shingle_set(t) for _, t in docs]
    parent = list(range(len(docs)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(docs)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
            parent[root(i)] = root(j)
    best = {}
    for i, (d, _) in enumerate(docs):
        r = root(i)
        if d is not None and (best.get(r) is None or d < best[r]):
            best[r] = d
    return [(d, len(s), best.get(root(i))) for i, ((d, _), s) in enumerate(zip(docs, sets, strict=True))]


def base_metrics(text):
    text = text or ""
    w = words(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    seen, dup = set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    windows = {}
    for i in range(len(w) - 7):
        windows.setdefault(tuple(w[i : i + 8]), []).append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(8)}
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(covered)
