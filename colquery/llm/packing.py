"""Best-fit packing by repeated length patterns.

1. Texts become pieces of at most ``capacity`` token ids; a long text is cut
   into full pieces, the first one holding what is left over.
2. The histogram of piece lengths has at most ``capacity`` entries, whatever
   the input. Lengths are binned upwards, patterns of two to four bins that
   fill a sequence are enumerated, and non-negative least squares fits how
   often each is used. Counts are rounded down to what the histogram holds.
3. What remains goes by best-fit decreasing on exact lengths, into gaps of the
   patterns first and new sequences then.
4. The plan is a list of runs, one per (lengths, repeats), its size bounded by
   the histogram. Pieces are ranked within their length, in blocks of bounded
   size, and look their place up by (length, rank).

Null text is empty: it gives one piece, the closing id alone. Repeated rows
each give their pieces; an empty table gives no row.
"""

from __future__ import annotations

import bisect
import math
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_batches, materialize

CAPACITY, END_ID = 2_048, 0
BINS, MAX_PARTS, BLOCK_ROWS, HEAVY = 64, 4, 1_000, 16
Run = tuple[tuple[int, ...], int]  # lengths of the pieces of a sequence, how many such sequences


class Encoder:
    """Token ids as the ``tokenizers`` file gives them.

    The rank file holds the same vocabulary and merges for a faster encoder of
    the same algorithm; texts on which it gives up go to the library itself.
    """

    def __init__(self, path: str, ranks: str | None, pattern: str | None):
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        self.fast, self.special = None, {t.content for t in self.slow.get_added_tokens_decoder().values()}
        if ranks:
            import base64

            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if self.fast is not None and not any(s in text for s in self.special):
            try:
                return np.asarray(self.fast.encode_to_numpy(text, disallowed_special=()), dtype="<u4")
            except BaseException as e:  # the native encoder reports exhausted stacks as a panic
                if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
                    raise
        return np.asarray(self.slow.encode(text, add_special_tokens=False).ids, dtype="<u4")


_encoders: dict[tuple, Encoder] = {}


def encoder(*key) -> Encoder:
    if key not in _encoders:
        _encoders[key] = Encoder(*key)
    return _encoders[key]


def token_pieces(docs: DataFrame, tokenizer: tuple[str, str | None, str | None], *, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids (little-endian uint32 bytes)."""

    def run(cols):
        enc = encoder(*tokenizer)
        out = {k: [] for k in ("doc_id", "piece", "start", "length", "ids")}
        for doc, text in zip(cols["doc_id"], cols["text"], strict=True):
            ids = np.append(enc.ids(text or ""), np.uint32(end_id)).astype("<u4")
            first = (len(ids) - 1) % capacity + 1
            cuts = [0, *range(first, len(ids) + 1, capacity)]
            for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                for name, v in zip(out, (doc, k, a, b - a, ids[a:b].tobytes()), strict=True):
                    out[name].append(v)
        return out

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), run, f"doc_id {kind}, piece int, start long, length long, ids binary")


def patterns(bins: int, parts: int) -> list[tuple[int, ...]]:
    """Non-increasing tuples of 2 to ``parts`` bins that sum to ``bins``."""
    found: list[tuple[int, ...]] = []

    def grow(head: tuple[int, ...], left: int):
        if len(head) >= 1 and 0 < left <= head[-1]:
            found.append((*head, left))
        if len(head) < parts - 1:
            for b in range(min(left - 1, head[-1] if head else left), 0, -1):
                grow((*head, b), left - b)

    grow((), bins)
    return found


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 400) -> np.ndarray:
    """min |ax - b| with x >= 0 by an active set: the most promising column enters, negative ones leave."""
    x, active = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    tol = 1e-9 * max(1.0, float(np.abs(b).max(initial=0)))
    for _ in range(rounds):
        gain = a.T @ (b - a @ x)
        gain[active] = -np.inf
        j = int(gain.argmax())
        if gain[j] <= tol:
            break
        active[j] = True
        while True:
            at = np.flatnonzero(active)
            z = np.linalg.lstsq(a[:, at], b, rcond=None)[0]
            if (z > 0).all():
                x[:] = 0
                x[at] = z
                break
            bad = z <= 0
            step = np.min(np.where(bad, x[at] / np.maximum(x[at] - z, 1e-300), np.inf))
            x[at] += step * (z - x[at])
            active[at[(x[at] <= 1e-12) & bad]] = False
            x[~active] = 0
            if not active.any():
                break
    return x


def plan(histogram: dict[int, int], capacity: int = CAPACITY, bins: int = BINS, parts: int = MAX_PARTS) -> list[Run]:
    """Runs that place every piece of the histogram once."""
    width = max(1, math.ceil(capacity / bins))
    bins = capacity // width
    runs: list[Run] = []
    stock = {n: c for n, c in histogram.items() if c > 0}
    if capacity in stock:
        runs.append(((capacity,), stock.pop(capacity)))
    by_bin: dict[int, list[int]] = defaultdict(list)  # lengths, largest last
    for n in sorted(stock):
        by_bin[-(-n // width)].append(n)
    have = np.array([sum(stock[n] for n in by_bin.get(i, ())) for i in range(1, bins + 1)], float)
    shapes = [p for p in patterns(bins, parts) if all(have[i - 1] for i in p)]
    if shapes:
        a = np.zeros((bins, len(shapes)))
        for j, p in enumerate(shapes):
            for i in p:
                a[i - 1, j] += 1
        weight = np.sqrt(np.arange(1, bins + 1) / bins)  # a misfit of long pieces costs more
        x = nnls(a * weight[:, None], have * weight)
        for j in np.argsort(-x):
            want = int(x[j] + 1e-6)
            while want > 0:
                picked: list[int] = []
                for i in shapes[j]:  # the longest left of each bin, as often as the pattern has the bin
                    pool = next((n for n in reversed(by_bin[i]) if stock[n] > picked.count(n)), None)
                    if pool is None:
                        break
                    picked.append(pool)
                if len(picked) < len(shapes[j]):
                    break
                times = min(want, min(stock[n] // picked.count(n) for n in set(picked)))
                for n in picked:
                    stock[n] -= times
                for i in set(shapes[j]):
                    by_bin[i] = [n for n in by_bin[i] if stock[n]]
                runs.append((tuple(picked), times))
                want -= times
    gaps: dict[int, list[Run]] = defaultdict(list)
    closed: list[Run] = []
    for lengths, times in runs:
        (closed if sum(lengths) == capacity else gaps[capacity - sum(lengths)]).append((lengths, times))
    free = sorted(gaps)
    for n in sorted((n for n, c in stock.items() if c), reverse=True):
        left = stock[n]
        while left:
            k = bisect.bisect_left(free, n)
            if k == len(free):  # no gap is wide enough: new sequences, as full of this length as they can be
                each = min(capacity // n, left)
                lengths, times = (n,) * each, left // each
            else:
                lengths, times = gaps[free[k]].pop()
                if not gaps[free[k]]:
                    del gaps[free[k]]
                    room = free.pop(k)
                else:
                    room = free[k]
                each = min(room // n, left)
                used = min(times, left // each)
                if used < times:
                    if room not in gaps:
                        bisect.insort(free, room)
                    gaps[room].append((lengths, times - used))
                lengths, times = (*lengths, *(n,) * each), used
            left -= each * times
            room = capacity - sum(lengths)
            if not room:
                closed.append((lengths, times))
                continue
            if room not in gaps:
                bisect.insort(free, room)
            gaps[room].append((lengths, times))
    return closed + [r for g in sorted(gaps) for r in gaps[g]]


def places(runs: list[Run]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per length: first ranks, sequence ids and offsets of its stretches in the runs."""
    out: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    rank: dict[int, int] = defaultdict(int)
    base = 0
    for lengths, times in runs:
        at = 0
        for n in lengths:
            out[n].append((rank[n], base, at))
            rank[n] += times
            at += n
        base += times
    return {n: tuple(np.array(c, dtype=np.int64) for c in zip(*v, strict=True)) for n, v in out.items()}


def ranked(pieces: DataFrame, keys: list[str], total: int) -> DataFrame:
    """Adds ``rank`` (from 0) within equal length, by blocks of about BLOCK_ROWS rows and their running totals.

    Blocks are dealt out by the hash of ``keys``; where rows repeat in all of
    these so often that a block grows beyond HEAVY times its size, by the row's
    place in the written table (``__at``).
    """
    blocks = max(1, -(-total // BLOCK_ROWS))
    deal = lambda *by: pieces.withColumn("block", F.pmod(F.xxhash64(*by), F.lit(blocks)))
    sizes = lambda df: df.groupBy("length", "block").agg(F.count("*").alias("n"))
    blocked = deal(*keys)
    if (sizes(blocked).agg(F.max("n")).first()[0] or 0) > HEAVY * BLOCK_ROWS:
        blocked = deal("__at")
    starts = sizes(blocked).select("length", "block", (F.sum("n").over(Window.partitionBy("length").orderBy("block")) - F.col("n")).alias("before"))
    inner = F.row_number().over(Window.partitionBy("length", "block").orderBy(*keys, "__at")) - 1
    return blocked.withColumn("at", inner).join(starts, ["length", "block"]).withColumn("rank", F.col("before") + F.col("at")).drop("block", "before", "at")


def pack(spark: SparkSession, pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, start, length, anything else).

    ``pieces`` is written once; only the histogram, of at most ``capacity``
    rows, and the plan made of it pass through the driver.
    """
    kept = materialize(spark, pieces.withColumn("__at", F.monotonically_increasing_id()), "pieces")
    hist = {int(r["length"]): int(r["n"]) for r in kept.groupBy("length").agg(F.count("*").alias("n")).collect()}
    table = places(plan(hist, capacity))
    names = [c for c in kept.columns if c not in ("sequence_id", "offset", "__at")]
    keys = ["doc_id", "piece", "start", *(["ids_crc32"] if "ids_crc32" in names else [])]
    placed = ranked(kept.select(*names, "__at"), keys, sum(hist.values()))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.select(*names).schema) + ", sequence_id long, offset long"

    def run(cols):
        n, rank = np.array(cols["length"]), np.array(cols.pop("rank"))
        seq, off = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
        for length in np.unique(n):
            at = np.flatnonzero(n == length)
            first, base, offset = table[int(length)]
            k = np.searchsorted(first, rank[at], side="right") - 1
            seq[at], off[at] = base[k] + rank[at] - first[k], offset[k]
        return cols | {"sequence_id": seq, "offset": off}

    return map_batches(placed.select(*names, "rank"), run, schema)


def pack_documents(spark: SparkSession, docs: DataFrame, tokenizer, *, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """doc_id, piece, start, length, sequence_id, offset and ids, or their crc32 alone where ids aren't wanted."""
    pieces = token_pieces(docs, tokenizer, capacity=capacity, end_id=end_id).withColumn("ids_crc32", F.crc32("ids"))
    return pack(spark, pieces if with_ids else pieces.drop("ids"), capacity)
