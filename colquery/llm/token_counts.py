"""Token counts by overlap resynchronisation.

A text is encoded piece by piece, never as one unbounded string. A cut is
*proven stable* where white space ends: the tokenizer's pre-tokenizer drops
white space and matches no token across it, its normaliser composes no
character across it, and no special token contains it. So two encodings that
both start a token right after white space agree on everything that follows.

* A text up to ``chunk`` characters is one chunk.
* A longer one is encoded as chunks that overlap. Each pair of neighbours is
  spliced at the first common stable boundary of their overlap, found by the
  token offsets of both; where there is none, the overlap is doubled and the
  chunk encoded again, up to the rest of the text if need be.

Within a chunk, words between the two commonest spaces (0x20 and 0x0A, stable
by the same argument) are encoded once per worker and remembered. New words go
to the library many at a time, parted by a special token where it has one that
is matched as it stands: it cuts the text before anything else is done to it.

Null text counts as empty: 0 bytes, 0 tokens. Every input row gives one row;
rows are independent, so ties, repeats, empty tables and further columns need
no care.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches, text_of

CHUNK, OVERLAP, LIMIT = 32_768, 1_024, 2_048
#: Words remembered per worker; beyond it the memory starts anew.
MEMORY = 400_000
#: New words encoded as one text.
GROUP = 64
#: Characters that Unicode calls white space, as the tokenizer's pattern does. Fixed values.
SPACE = " \t\n\x0b\x0c\r\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


class Counter:
    """Counts tokens of whole texts with a ``tokenizers`` file."""

    def __init__(self, path: str, chunk: int = CHUNK, overlap: int = OVERLAP):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.chunk, self.overlap, self.known = chunk, overlap, {"": 0}
        self.widened = 0
        plain = {t.content: i for i, t in self.tok.get_added_tokens_decoder().items() if t.special and not (t.normalized or t.single_word or t.lstrip or t.rstrip)}
        self.mark, self.mark_id = min(plain.items(), default=(None, None), key=lambda kv: -kv[1])

    def offsets(self, text: str) -> list[tuple[int, int]]:
        return self.tok.encode(text, add_special_tokens=False).offsets

    def lengths(self, words: list[str]) -> list[int]:
        """Tokens of each of ``words``, which hold no white space that a word may be cut at."""
        encode = getattr(self.tok, "encode_batch_fast", self.tok.encode_batch)
        if self.mark is None:
            return [len(e.ids) for e in encode(words, add_special_tokens=False)]
        out: list[int] = []
        groups = [words[k : k + GROUP] for k in range(0, len(words), GROUP)]
        for group, e in zip(groups, encode([self.mark.join(g) + self.mark for g in groups], add_special_tokens=False), strict=True):
            ends = np.flatnonzero(np.array(e.ids) == self.mark_id)
            if len(ends) == len(group):
                out.extend((np.diff(ends, prepend=-1) - 1).tolist())
            else:  # a mark ran together with a word
                out.extend(len(e.ids) for e in encode(group, add_special_tokens=False))
        return out

    def learn(self, texts: list[list[str]]) -> None:
        """Encode the words of ``texts`` that are not remembered yet."""
        new = set().union(*texts).difference(self.known)
        if len(self.known) + len(new) > MEMORY:
            self.known = {"": 0}
            new = set().union(*texts).difference(self.known)
        with_mark = [w for w in new if self.mark is not None and self.mark in w]
        self.known.update((w, len(self.tok.encode(w, add_special_tokens=False).ids)) for w in with_mark)
        words = list(new.difference(with_mark))
        for at in range(0, len(words), 4096):
            part = words[at : at + 4096]
            self.known.update(zip(part, self.lengths(part), strict=True))

    def stable(self, text: str, base: int, offsets, low: int, high: int) -> set[int]:
        """Places in [low, high) of the text where a token starts right after white space."""
        return {base + s for s, _ in offsets if low <= base + s < high and base + s > 0 and text[base + s - 1] in SPACE}

    def long(self, text: str) -> int:
        """Splice overlapping chunks; tokens before the seam come from the left chunk, the others from the right one."""
        n, total, start, end = len(text), 0, 0, min(len(text), self.chunk)
        left = self.offsets(text[:end])
        begin = 0  # tokens of ``left`` count from here on
        while end < n:
            width = self.overlap
            while True:
                low = max(start + 1, end - width)
                stop = min(n, end + self.chunk)
                right = self.offsets(text[low:stop])
                common = self.stable(text, start, left, max(low + 1, begin), end) & self.stable(text, low, right, low + 1, end)
                if common:
                    seam = min(common)
                    total += sum(1 for s, _ in left if begin <= start + s < seam)
                    start, begin, left, end = low, seam, right, stop
                    break
                self.widened += 1
                if width >= end - max(start, begin):  # nothing of the left chunk is left: let it grow instead
                    end = min(n, end + max(self.chunk, end - start))
                    left = self.offsets(text[start:end])
                    if end == n:
                        break
                width *= 2
        return total + sum(1 for s, _ in left if start + s >= begin)

    def count(self, texts: list[str]) -> list[int]:
        """Slices of bounded size are learned together, then counted."""
        short = {i: t.replace("\n", " ").split(" ") for i, t in enumerate(texts) if len(t) <= self.chunk}
        self.learn(list(short.values()))
        known = self.known
        return [sum([known[w] for w in short[i]]) if i in short else self.long(t) for i, t in enumerate(texts)]


_counters: dict[tuple, Counter] = {}


def counter(path: str, chunk: int, overlap: int) -> Counter:
    key = (path, chunk, overlap)
    if key not in _counters:
        _counters[key] = Counter(*key)
    return _counters[key]


def count_tokens(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Per row: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit)."""

    def run(cols):
        c = counter(tokenizer, chunk, overlap)
        texts = ["" if t is None else t for t in cols["text"]]
        return {"doc_id": cols["doc_id"], "n_bytes": [len(text_of(t)) for t in texts], "n_tokens": c.count(texts)}

    kind = docs.schema[id_col].dataType.simpleString()
    out = map_batches(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), run, f"doc_id {kind}, n_bytes long, n_tokens long")
    over: Column = F.col("n_tokens") > limit
    return out.withColumn("over_limit", over)
