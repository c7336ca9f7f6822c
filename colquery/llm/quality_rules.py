"""Quality rules by weak supervision. DataFrame operations only on the main path.

Each rule looks at a text's metrics and votes good (1), bad (-1) or abstains
(0). Texts are counted by vote pattern; there are 3 ** rules patterns at most,
whatever the corpus. Expectation-maximisation over the pattern counts estimates
how often each rule is right on good and on bad texts, and how common good
texts are. A text is kept if its posterior probability of being good is at
least one half. Texts that fail the base limits are never kept.

Null text has no words, fails the base limits and still votes. Repeated rows
count each; an empty table gives no row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize
from .native import words

WINDOW, MIN_WORDS, MAX_REPEAT = 8, 20, 30
SYMBOLS = r"[^#*$%&|<>]+"


def metrics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and, for the rules, n_lines, n_letters."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("doc_id"), text.alias("__t"), words(F.col(text_col)).alias("__w"))
    lines = F.filter(F.split("__t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    base = base.withColumn("__l", lines)
    long_enough = F.size("__w") >= WINDOW
    hashes = F.when(long_enough, F.transform(F.sequence(F.lit(1), F.greatest(F.size("__w") - WINDOW + 1, F.lit(1))), lambda i: F.xxhash64(F.slice("__w", i, WINDOW)))).otherwise(F.array().cast("array<bigint>"))
    base = base.select(
        "doc_id", F.size("__w").cast("long").alias("n_words"),
        F.aggregate("__w", F.lit(0), lambda a, x: a + F.length(x)).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("__t", SYMBOLS, "")).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace("__t", r"[^\p{L}]+", "")).cast("long").alias("n_letters"),
        F.size("__l").cast("long").alias("n_lines"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        hashes.alias("__h"),
    )
    # Only texts with an equal pair of windows sort them; neighbours in that order show which places repeat.
    repeats = F.size("__h") > F.size(F.array_distinct("__h"))
    base = base.withColumn("__s", F.when(repeats, F.array_sort(F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("p"))))))
    at = lambda i: F.col("__s")[i]["h"]
    same = F.filter("__s", lambda e, i: F.when(i > 0, at(i - 1) == e["h"]).otherwise(False) | F.when(i + 1 < F.size("__s"), at(i + 1) == e["h"]).otherwise(False))
    base = base.withColumn("__p", F.when(F.col("__s").isNotNull(), F.array_sort(F.transform(same, lambda e: e["p"]))))
    step = lambda p, i: F.when(i + 1 < F.size("__p"), F.least(F.lit(WINDOW), F.col("__p")[i + 1] - p)).otherwise(WINDOW)
    covered = F.aggregate(F.transform("__p", step), F.lit(0), lambda a, x: a + x)
    return base.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("__h", "__s", "__p")


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def votes() -> list[Column]:
    """The rules, each on metrics; a null ratio (no words) makes neither side true."""
    n, chars = F.col("n_words"), F.col("word_chars")
    per = lambda a, b: F.col(a) / F.when(b > 0, b)
    symbol, letter, dup, rep = per("n_symbols", chars), per("n_letters", chars), per("n_dup_lines", F.col("n_lines")), per("n_repeat_words", n)
    mean = per("word_chars", n)
    never = F.lit(False)
    return [
        _vote(never, n < 30),
        _vote(symbol < 0.02, symbol > 0.08),
        _vote(letter >= 0.90, letter < 0.78),
        _vote((dup == 0) & (F.col("n_lines") > 1), dup > 0.25),
        _vote(rep < 0.02, rep > 0.15),
        _vote(never, (mean < 2) | (mean > 14)),
    ]


def expectation_maximisation(counts: dict[tuple[int, ...], int], rounds: int = 100, prior: float = 0.8, right: float = 0.8, weight: float = 20.0):
    """Posterior per pattern, the share of good texts, and per rule how often it is right on good and on bad ones.

    ``prior`` and ``right`` count as ``weight`` observations, which keeps good
    and bad from changing places and rules that never vote defined.
    """
    rules = len(next(iter(counts))) if counts else 0
    share, on_good, on_bad = prior, [right] * rules, [right] * rules
    post: dict[tuple[int, ...], float] = {}
    total = sum(counts.values())
    for _ in range(rounds):
        for pattern in counts:
            a, b = math.log(share), math.log(1 - share)
            for v, g, h in zip(pattern, on_good, on_bad, strict=True):
                if v:
                    a += math.log(g if v > 0 else 1 - g)
                    b += math.log(1 - h if v > 0 else h)
            post[pattern] = 1 / (1 + math.exp(min(700, b - a)))
        good = {p: post[p] * c for p, c in counts.items()}
        bad = {p: (1 - post[p]) * c for p, c in counts.items()}
        share = (sum(good.values()) + prior * weight) / (total + weight)
        for j in range(rules):
            for out, mass, hit in ((on_good, good, 1), (on_bad, bad, -1)):
                voted = sum(m for p, m in mass.items() if p[j])
                out[j] = min(1 - 1e-6, (sum(m for p, m in mass.items() if p[j] == hit) + right * weight) / (voted + weight))
    return post, share, on_good, on_bad


def judge(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Metrics plus base_failed, posterior and kept."""
    rules = votes()
    measured = materialize(spark, metrics(docs, id_col, text_col), "metrics")
    names = [f"v{j}" for j in range(len(rules))]
    voted = measured.select("*", *[r.alias(n) for r, n in zip(rules, names, strict=True)])
    pattern = sum((F.col(n) + 1) * 3**j for j, n in enumerate(names)).cast("int")
    voted = voted.withColumn("pattern", pattern).drop(*names)
    found = voted.groupBy("pattern").agg(F.count("*").alias("n")).collect()  # 3 ** rules rows at most
    unpack = lambda p: tuple(p // 3**j % 3 - 1 for j in range(len(rules)))
    post, *_ = expectation_maximisation({unpack(r["pattern"]): r["n"] for r in found})
    rows = ", ".join(f"({r['pattern']}, {post[unpack(r['pattern'])]!r}D)" for r in sorted(found)) or "(0, 0.0D)"
    table = spark.sql(f"SELECT * FROM VALUES {rows} AS t(pattern, posterior)")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    return voted.join(F.broadcast(table), "pattern").withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("posterior") >= 0.5)).drop("pattern")
