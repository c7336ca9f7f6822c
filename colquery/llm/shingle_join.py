"""Near-duplicate join on word shingles with adaptive multi-match prefixes.

A document is the set of its 5-word shingles, each a 64-bit hash; two documents
link when their Jaccard similarity is at least 0.8. Documents of equal sets are
one *node* and are compared once.

Tokens have one global order: first by whether a token is hot (frequent among
prefixes), then by hash. The l-prefix lemma: of two sets that overlap in t
tokens or more, the first (size - t + l) tokens of each share at least l. So

1. each node's prefix is taken from the text; where hot tokens use up what was
   taken, the node's whole set is fetched and its prefix is completed;
2. prefix tokens with two nodes or more become lists;
3. each node chooses its own l (1 to ``MAX_MATCH``): longer prefixes cost more
   list entries but leave fewer candidates, estimated from the list lengths. A
   pair must share min(l of both) prefix tokens before it is verified;
4. lists are first joined with their ``LEADERS`` foremost nodes only - those
   whose rare tokens run out first, so the ones nearest to what the list has in
   common. Verified links are contracted to components. What remains is exact:
   in each list all pairs of different components, outside the list's largest
   component against all, pass length, prefix, position and match count filters
   and are verified. A large group of near copies thus costs its size times
   ``LEADERS``, not its square, and no link between components is missed. Of a
   pair the smaller set must hold the token in the shorter prefix that
   overlap with a set no smaller asks for (n - ceil(8/9 n) + l), checked before
   pairing, so texts that share a passage but not enough of it aren't paired.
   That side of a list is dealt out in blocks of ``LIST_ROWS`` rows;
5. verification intersects whole sets;
6. with ``links`` every link is counted. All links lie within components, and a
   component of up to two nodes holds just the known one. Of a larger one all
   pairs of nodes are compared, block by block of up to about ``LINK_ROWS``
   nodes or ``LINK_TOKENS`` tokens, as products of 0/1 matrices. This costs the
   square of the component's size in work, and its size times its blocks in rows.

The result has one row per input row: doc_id, n_shingles, component_id (the
smallest doc_id reachable, null only if all of the component are null), linked
(whether another document is in the component) and, with ``links``, n_links (how
many other rows it links with, copies included). Null text, empty text
and text without words give 0 shingles and link with nothing. Fewer than five
words are one shingle. Repeated rows and equal texts are in one component. Rows
with a null doc_id link like others. Ids may be repeated or null with different
texts: a row is known by the hash of its id and text, so each text is fetched
and decided on its own. Hash collisions (64 bits) aren't checked.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import discard, scratch
from .common import map_batches, materialize, one_thread, text_of

WORDS, MAX_MATCH, LEADERS, HOT, VERIFY_COST, SMALL = 5, 3, 3, 24, 8.0, 20
#: Rows of the smaller sets of a list that one task pairs with the list.
LIST_ROWS = 2048
_MIX, _FIN1, _FIN2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _finish(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _FIN1
    h = (h ^ (h >> np.uint64(27))) * _FIN2
    return h ^ (h >> np.uint64(31))


def shingles(text: bytes, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles, as int64."""
    from xxhash import xxh64_intdigest

    w = text.lower().split()
    if not w:
        return np.zeros(0, np.int64)
    h = np.fromiter(map(xxh64_intdigest, w), np.uint64, len(w))
    size = min(words, len(w))
    s = np.full(len(w) - size + 1, size, np.uint64)
    for k in range(size):
        s = (s ^ (s >> np.uint64(29))) * _MIX + h[k : len(h) - size + 1 + k]
    return np.unique(_finish(s).view(np.int64))


def node_of(tokens: np.ndarray) -> int:
    from xxhash import xxh64_intdigest

    return int(np.uint64(xxh64_intdigest(tokens.tobytes())).view(np.int64)) if len(tokens) else 0


def _probe(n):
    """Prefix length against smaller or equal sets: n - ceil(0.8 n) + 1."""
    return n - (4 * n + 4) // 5 + 1


def _sql_probe(n: str) -> str:
    return f"({n} - (4 * {n} + 4) div 5 + 1)"


def _sql_overlap(a: str, b: str) -> str:
    """Smallest overlap of a link: ceil(4/9 (a + b))."""
    return f"((4 * ({a} + {b}) + 8) div 9)"


def row_key(doc: Column, text: Column) -> Column:
    """One long for each distinct (id, text), nulls included."""
    return F.xxhash64(doc, doc.isNull(), text, text.isNull())


def signatures(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """doc_id, row, n, node, and the first tokens by hash: the prefix and some more in case of hot ones."""

    def run(c):
        out = {"doc_id": c["doc_id"], "row": c["row"], "n": [], "node": [], "toks": []}
        for t in c["text"]:
            s = shingles(text_of(t), words)
            p = _probe(len(s)) if len(s) else 0
            out["n"].append(len(s))
            out["node"].append(node_of(s))
            out["toks"].append(s[: p + MAX_MATCH - 1 + 6 + p // 8])
        return out

    kind = docs.schema[id_col].dataType.simpleString()
    doc, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    return map_batches(docs.select(doc.alias("doc_id"), row_key(doc, text).alias("row"), text.alias("text")), run, f"doc_id {kind}, row long, n int, node long, toks array<long>")


def whole_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """node, toks (all of them) for the wanted (node, rep): texts are fetched by their row key and hashed again, each once a task."""
    want = _side(wanted.select(F.col("rep").alias("__rep"), F.col("node").alias("__node")))
    doc, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    found = docs.select(row_key(doc, text).alias("__row"), text.alias("text")).join(want, F.col("__row") == F.col("__rep")).select("__node", "text")
    seen: set[int] = set()  # copies of one row; a task's own, as the function is sent to each

    def run(c):
        out = {"node": [], "toks": []}
        for node, t in zip(c["__node"], c["text"], strict=True):
            if node not in seen:
                seen.add(node)
                out["node"].append(node)
                out["toks"].append(shingles(text_of(t), words))
        return out

    return map_batches(found, run, "node long, toks array<long>").dropDuplicates(["node"])


#: Edges up to which a graph is finished in one task; a larger one is contracted first, round by round.
FINISH_EDGES = 1_000_000


def _finish_edges(edges: DataFrame) -> DataFrame:
    """(node, comp) of at most FINISH_EDGES counted edges: minimum labels with pointer jumping in one task's arrays."""

    def run(batches):
        import pyarrow as pa

        parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if not parts:
            return
        a, b = (np.concatenate(x) for x in zip(*parts, strict=True))
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        x, y = at[: len(a)], at[len(a) :]
        label = np.arange(len(nodes))
        while True:
            low = np.minimum(label[x], label[y])
            new = label.copy()
            np.minimum.at(new, label[x], low)
            np.minimum.at(new, label[y], low)
            while (new[new] != new).any():
                new = new[new]
            if (new == label).all():
                break
            label = new
        for k in range(0, len(nodes), 100_000):
            yield pa.RecordBatch.from_pydict({"node": nodes[k : k + 100_000], "comp": nodes[label[k : k + 100_000]]})

    return edges.select("a", "b").coalesce(1).mapInArrow(run, "node long, comp long")


def connected(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(node, comp) for all ends of ``edges`` (a, b).

    While there are more than FINISH_EDGES edges, each vertex moves to the
    vertex of smallest priority in its neighbourhood, priorities being drawn
    anew each round; edges and labels are written each round, so lineage stays
    short. Hubs are pre-aggregated minima. The contracted rest has a checked
    size and is finished in one task.
    """
    edges = materialize(spark, edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels, rounds = None, 0
    while edges.count() > FINISH_EDGES:
        if labels is None:
            labels = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("comp", F.col("node"))
        both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a")))
        near = both.groupBy("a").agg(F.min(F.xxhash64(F.lit(rounds), F.col("b"))).alias("h"))
        ends = both.select(F.col("b").alias("to"), F.xxhash64(F.lit(rounds), F.col("b")).alias("h")).distinct()
        own = F.xxhash64(F.lit(rounds), F.col("a"))
        moved = materialize(spark, near.withColumn("h", F.least("h", own)).join(ends, "h").select(F.col("a").alias("from"), "to"), "moved")
        step = edges.join(moved.withColumnRenamed("to", "a2"), F.col("a") == F.col("from")).drop("from")
        step = step.join(moved.withColumnRenamed("to", "b2"), F.col("b") == F.col("from"))
        edges = materialize(spark, step.where("a2 <> b2").select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct(), "edges")
        labels = labels.join(moved, F.col("comp") == F.col("from"), "left").select("node", F.coalesce("to", "comp").alias("comp"))
        labels = materialize(spark, labels, "labels")
        rounds += 1
    last = materialize(spark, _finish_edges(edges), "labels")
    if labels is None:
        return last
    last = last.select(F.col("node").alias("__at"), F.col("comp").alias("__to"))
    return materialize(spark, labels.join(last, F.col("comp") == F.col("__at"), "left").select("node", F.coalesce("__to", "comp").alias("comp")), "labels")


#: Rows (of a few longs each, so some tens of MB) up to which a counted side is broadcast; beyond it both sides are shuffled.
MAX_BROADCAST = 500_000


#: Characters of all strings of such a side.
MAX_BROADCAST_TEXT = 16 << 20


def _side(df: DataFrame) -> DataFrame:
    """A written table, broadcast if its counted rows, and the characters of its strings, allow it."""
    texts = [F.coalesce(F.length(f.name), F.lit(0)).cast("long") for f in df.schema if f.dataType.typeName() == "string"]
    got = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(sum(texts, F.lit(0).cast("long"))), F.lit(0)).alias("c")).first()
    return F.broadcast(df) if got["n"] <= MAX_BROADCAST and got["c"] <= MAX_BROADCAST_TEXT else df


def _prefix_lists(spark, docs, reps, id_col, text_col, words) -> DataFrame:
    """(tok, node, n, pos, df): prefixes in the global order as far as two nodes or more share a token.

    A prefix has MAX_MATCH - 1 tokens more than one match needs. Any set of hot
    tokens gives right results, a good one few candidates. It is found in two
    steps: tokens frequent among what signatures hold, then tokens frequent
    among the whole sets of nodes which those leave short. The tokens of
    signatures are shuffled once, to find the shared ones; all later steps work
    on those, on the few short nodes, or look a few tokens up in signatures.
    """
    taken = reps.select("node", "n", F.size("toks").alias("e"), F.posexplode("toks").alias("pos", "tok"))
    counts = taken.groupBy("tok").agg(F.count("*").cast("int").alias("df")).where("df > 1")
    shared = materialize(spark, taken.join(counts, "tok").select("tok", "node", "n", "e", "pos", (F.col("df") >= HOT).alias("hot")), "shared")
    need = F.expr(_sql_probe("n") + f" + {MAX_MATCH - 1}")
    rep_of = reps.select("node", "rep")

    def hot_places(hot_rows: DataFrame) -> DataFrame:
        """Per node the places of its hot tokens (at most its prefix) and whether what was taken is too short."""
        per = hot_rows.groupBy("node", "n", "e").agg(F.array_sort(F.collect_set("pos")).alias("hot_at"))
        return materialize(spark, per.withColumn("short", (F.col("e") < F.col("n")) & (F.col("e") - F.size("hot_at") < need)), "hot-places")

    def fetch(places: DataFrame, have: DataFrame | None) -> DataFrame:
        wanted = places.where("short").select("node")
        if have is not None:
            wanted = wanted.join(have.select("node"), "node", "left_anti")
        wanted = rep_of.join(_side(materialize(spark, wanted, "short")), "node")
        return materialize(spark, whole_sets(docs, materialize(spark, wanted, "short-reps"), id_col, text_col, words), "short-sets")

    hot_rows = shared.where("hot")
    places = hot_places(hot_rows)
    sets = fetch(places, None)
    hot = materialize(spark, hot_rows.select("tok").distinct(), "hot")
    common = sets.select(F.explode("toks").alias("tok")).groupBy("tok").agg(F.count("*").alias("c")).where(F.col("c") >= HOT).select("tok")
    hotter = materialize(spark, common.join(hot, "tok", "left_anti"), "hotter")
    if not hotter.isEmpty():
        more = taken.join(_side(hotter), "tok").select("tok", "node", "n", "e", "pos", F.lit(True).alias("hot"))
        places = hot_places(hot_rows.unionByName(more))
        sets = sets.unionByName(fetch(places, sets))
        hot = hot.unionByName(hotter)
    # Short nodes: the whole set in the global order.
    flagged = sets.select("node", F.size("toks").alias("n"), F.explode("toks").alias("tok")).join(hot.withColumn("h", F.lit(1)), "tok", "left")
    place = F.row_number().over(Window.partitionBy("node").orderBy(F.coalesce("h", F.lit(0)), "tok"))
    rest = materialize(spark, flagged.withColumn("pos", place).where(F.col("pos") <= need).select("tok", "node", "n", "pos"), "short-rows")
    # The others: cold tokens keep their order; hot ones follow where the set was taken whole, else lie beyond the prefix.
    extra = taken.join(_side(materialize(spark, rest.select("tok").distinct(), "short-toks")), "tok").select("tok", "node", "n", "e", "pos")
    ready = shared.drop("hot").unionByName(extra).distinct().join(places.select("node", "hot_at", "short"), "node", "left").where("short IS NULL OR NOT short")
    hots, before = F.coalesce(F.size("hot_at"), F.lit(0)), F.expr("size(filter(hot_at, h -> h < pos))")
    is_hot = F.expr("hot_at IS NOT NULL AND array_contains(hot_at, pos)")
    moved = F.when(F.col("hot_at").isNull(), F.col("pos") + 1).when(~is_hot, F.col("pos") + 1 - before).when(F.col("e") == F.col("n"), F.col("e") - hots + before + 1)
    ready = ready.withColumn("pos", moved).where(F.col("pos").isNotNull() & (F.col("pos") <= need)).select("tok", "node", "n", "pos")
    rows = materialize(spark, ready.unionByName(rest), "prefixes")
    counts = rows.groupBy("tok").agg(F.count("*").cast("int").alias("df")).where("df > 1")
    return materialize(spark, rows.join(counts, "tok"), "lists")


def _verified(spark, pairs: DataFrame, arrays: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough."""
    a = arrays.select(F.col("node").alias("a"), F.col("toks").alias("ta"))
    b = arrays.select(F.col("node").alias("b"), F.col("toks").alias("tb"))
    both = pairs.select("a", "b").join(a, "a").join(b, "b")
    inter = F.size(F.array_intersect("ta", "tb"))
    sizes = F.size("ta") + F.size("tb")
    return materialize(spark, both.where(inter * 180 >= sizes * 80).select("a", "b"), "links")


#: Nodes and tokens of a block, on average, when links within a component are counted, and tokens that are multiplied at a time.
LINK_ROWS, LINK_TOKENS, LINK_STEP = 512, 1 << 21, 4096


def _block_links(lo: int, hi: int, weight: np.ndarray, block: np.ndarray, sizes: np.ndarray, toks: np.ndarray) -> np.ndarray:
    """Per node the weight of those it links with, between the blocks ``lo`` and ``hi`` of one component."""
    _, tok, times = np.unique(toks, return_inverse=True, return_counts=True)
    common = times > 1
    row, tok = np.repeat(np.arange(len(sizes)), sizes)[common[tok]], (np.cumsum(common) - 1)[tok[common[tok]]]
    order = np.argsort(tok, kind="stable")
    row, tok = row[order], tok[order]
    left, right = np.flatnonzero(block == lo), np.flatnonzero(block == hi)
    both = np.zeros((len(left), len(right)), np.float32)
    width = int(common.sum())
    for at in range(0, width, LINK_STEP):
        a, b = np.searchsorted(tok, [at, at + LINK_STEP])
        ones = np.zeros((len(sizes), min(LINK_STEP, width - at)), np.float32)
        ones[row[a:b], tok[a:b] - at] = 1
        both += ones[left] @ ones[right].T
    link = 9 * both.astype(np.int64) >= 4 * (sizes[left][:, None] + sizes[right][None])
    out = np.zeros(len(sizes), np.int64)
    if lo == hi:
        np.fill_diagonal(link, False)
        out[left] = link @ weight[right]
    else:
        out[left], out[right] = link @ weight[right], weight[left] @ link
    return out


def _link_counts(spark: SparkSession, named: DataFrame, arrays: DataFrame) -> DataFrame:
    """(node, k) for the nodes of components of three nodes or more: the rows, other than one of its own, that each links with."""
    nodes = materialize(spark, named.where("comp IS NOT NULL").groupBy("comp", "node").agg(F.max("n").alias("n"), F.count("*").alias("c")), "link-nodes")
    large = nodes.groupBy("comp").agg(F.count("*").alias("m"), F.sum("n").alias("t")).where("m > 2")
    blocks = F.expr(f"least(m, greatest(ceil(m / {LINK_ROWS}), ceil(t / {LINK_TOKENS})))").alias("blocks")
    large = _side(materialize(spark, large.select(F.col("comp").alias("__comp"), blocks), "link-blocks"))
    nodes = materialize(spark, nodes.join(large, F.col("comp") == F.col("__comp")).select("comp", "node", "c", "blocks", F.expr("pmod(xxhash64(node), blocks)").alias("block")), "link-nodes")
    sets = arrays.join(_side(nodes), "node").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    sets = sets.select("comp", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "node", "c", "block", "toks")
    sets = sets.repartition("comp", "lo", "hi").sortWithinPartitions("comp", "lo", "hi")

    def run(batches):
        import pyarrow as pa

        one_thread()
        key, held = None, []

        def done():
            node, weight, block, sizes, toks = (np.concatenate(x) for x in zip(*held, strict=True))
            return pa.RecordBatch.from_pydict({"node": node, "k": _block_links(key[1], key[2], weight, block, sizes, toks)})

        for b in batches:
            comp, lo, hi, node, c, block = (b.column(i).to_numpy() for i in range(6))
            sizes, toks = b.column(6).value_lengths().to_numpy().astype(np.int64), b.column(6).flatten().to_numpy()
            ends = np.concatenate([[0], np.cumsum(sizes)])
            new = np.flatnonzero((comp[1:] != comp[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])) + 1
            for x, y in zip([0, *new], [*new, len(comp)], strict=True):
                if x == y:
                    continue
                at = (int(comp[x]), int(lo[x]), int(hi[x]))
                if held and at != key:
                    yield done()
                    held = []
                key = at
                held.append((node[x:y], c[x:y], block[x:y], sizes[x:y], toks[ends[x] : ends[y]]))
        if held:
            yield done()

    found = sets.mapInArrow(run, "node long, k long").groupBy("node").agg(F.sum("k").alias("k"))
    return materialize(spark, nodes.select("node", "c").join(found, "node").select("node", (F.col("k") + F.col("c") - 1).alias("k")), "link-counts")


def components(spark: SparkSession, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, links: bool = False, keys: bool = False) -> DataFrame:
    """One row per input row as said above; with ``keys`` also row (its id's and text's hash) and group (any id of the component, null for lone rows)."""
    with scratch(spark) as made:
        return _components(spark, made, docs, id_col, text_col, words, links, keys)


def _representatives(spark: SparkSession, sig: DataFrame) -> DataFrame:
    """One row per node: node, n, toks, rep (the row key by which its text can be fetched)."""
    some = sig.where("n > 0")
    copied = some.groupBy("node").agg(F.min("row").alias("rep"), F.count("*").alias("c")).where("c > 1").select(F.col("node").alias("__node"), "rep")
    copied = materialize(spark, copied, "copied")
    reps = some.join(_side(copied), F.col("node") == F.col("__node"), "left").where("__node IS NULL OR row = rep")
    if reps.where("__node IS NOT NULL").count() > copied.count():  # rows repeated in id and text
        again = reps.where("__node IS NOT NULL").dropDuplicates(["node"])
        reps = materialize(spark, reps.where("__node IS NULL").unionByName(again), "representatives")
    return reps.select("node", "n", "toks", F.col("row").alias("rep"))


def _open_pairs(lists: DataFrame, labels: DataFrame, match: DataFrame, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """What the leaders leave open: pairs (a, b) of different components that share enough prefix tokens; and the table to discard."""
    probe = F.expr(_sql_probe("n"))
    placed = lists.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node")).join(match, "node")
    placed = placed.where(F.col("pos") <= probe + F.col("l") - 1).select("tok", "node", "n", "pos", "comp", "l", F.expr("pos <= n - (8 * n + 8) div 9 + l").alias("small"))
    open_ = placed.groupBy("tok").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.max("small").alias("any")).where("x <> y AND any").select("tok")
    placed = materialize(spark, placed.join(open_, "tok"), "open")
    shares = placed.groupBy("tok", "comp").agg(F.count("*").alias("c"), F.count_if("small").alias("s"))
    blocks = F.ceil(F.sum("s") / LIST_ROWS).cast("int")
    main = shares.groupBy("tok").agg(F.max(F.struct("c", "comp")).alias("m"), F.greatest(blocks, F.lit(1)).alias("blocks")).select("tok", F.col("m.comp").alias("main"), "blocks")
    placed = placed.join(main, "tok").withColumn("outside", F.col("comp") != F.col("main"))
    side = lambda p: [F.col(c).alias(p + c) for c in ("node", "n", "pos", "comp", "l")]
    # Smaller sets outside the largest component meet all, those within it meet the others: never two of it.
    small = placed.where("small").select("tok", F.pmod(F.xxhash64("node"), F.col("blocks").cast("long")).cast("int").alias("block"), F.explode(F.expr("if(outside, array(true, false), array(true))")).alias("other"), *side("a_"))
    every = placed.select("tok", F.explode(F.expr("sequence(0, blocks - 1)")).alias("block"), F.col("outside").alias("other"), *side("b_"))
    room = f" - {_sql_overlap('a_n', 'b_n')} + least(a_l, b_l)"  # the lemma with the pair's own least overlap
    pairs = small.join(every, ["tok", "block", "other"]).where(
        "a_comp <> b_comp AND (a_n < b_n OR a_n = b_n AND a_node < b_node) AND 100 * a_n >= 80 * b_n AND "
        f"a_pos <= a_n{room} AND b_pos <= b_n{room}")  # fmt: skip
    pairs = pairs.groupBy("a_node", "b_node", "a_n", "b_n", "a_l", "b_l").agg(F.countDistinct("tok").alias("k"), F.min("a_pos").alias("pa"), F.min("b_pos").alias("pb"))
    pairs = pairs.where(f"k >= least(a_l, b_l) AND 1 + least(a_n - pa, b_n - pb) >= {_sql_overlap('a_n', 'b_n')}")
    return pairs.select(F.least("a_node", "b_node").alias("a"), F.greatest("a_node", "b_node").alias("b")), placed


def _components(spark, made, docs, id_col, text_col, words, links, keys) -> DataFrame:
    sig = materialize(spark, signatures(docs, id_col, text_col, words), "signatures")
    reps = _representatives(spark, sig)
    with scratch(spark) as within:
        lists = _prefix_lists(spark, docs, reps, id_col, text_col, words)
        within.keep(lists)

    # Adaptive match counts: per node the l whose entries plus expected verifications cost least.
    probe = F.expr(_sql_probe("n"))
    entries = [F.sum(F.when(F.col("pos") <= probe + k, F.col("df"))).alias(f"s{k + 1}") for k in range(MAX_MATCH)]
    cost = lists.groupBy("node", "n").agg(*entries)
    best, level = F.lit(None).cast("double"), F.lit(1)
    for k in range(1, MAX_MATCH + 1):
        c = F.coalesce(F.col(f"s{k}"), F.lit(0)) * (1 + VERIFY_COST / k)
        level = F.when(best.isNull() | (c < best), F.lit(k)).otherwise(level)
        best = F.when(best.isNull() | (c < best), c).otherwise(best)
    match = materialize(spark, cost.select("node", F.when(F.col("n") < SMALL, 1).otherwise(level).alias("l")), "match")

    # Leaders first.
    front = F.row_number().over(Window.partitionBy("tok").orderBy("pos", F.desc("n"), "node"))
    lead = lists.withColumn("r", front).where(F.col("r") <= LEADERS).select("tok", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("pos").alias("pb"))
    star = lists.select("tok", F.col("node").alias("a"), F.col("n").alias("na"), F.col("pos").alias("pa")).join(lead, "tok")
    room = F.expr(f"1 + least(na - pa, nb - pb) >= {_sql_overlap('na', 'nb')}")
    length = F.expr("100 * least(na, nb) >= 80 * greatest(na, nb)")
    star = star.where((F.col("a") != F.col("b")) & length & room).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    star = materialize(spark, star, "star")
    rep_of = reps.select("node", "rep")

    def arrays_for(pairs: DataFrame, have: DataFrame | None) -> DataFrame:
        nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        if have is not None:
            nodes = nodes.join(have.select("node"), "node", "left_anti")
        wanted = rep_of.join(_side(materialize(spark, nodes, "nodes")), "node")
        got = materialize(spark, whole_sets(docs, materialize(spark, wanted, "wanted"), id_col, text_col, words), "sets")
        return got if have is None else have.unionByName(got)

    arrays = arrays_for(star, None)
    found = _verified(spark, star, arrays)
    labels = connected(spark, found)

    # Then what they leave open.
    pairs, placed = _open_pairs(lists, labels, match, spark)
    pairs = materialize(spark, pairs.join(star, ["a", "b"], "left_anti"), "pairs")
    discard(spark, lists, match, star, placed)
    arrays = arrays_for(pairs, arrays)
    more = _verified(spark, pairs, arrays)
    labels = connected(spark, found.unionByName(more)) if not more.isEmpty() else labels

    named = sig.select("doc_id", "row", "n", "node").join(labels, "node", "left").withColumn("comp", F.when(F.col("n") > 0, F.coalesce("comp", "node")))
    named = materialize(spark, named, "named")
    discard(spark, sig)
    firsts = named.where("comp IS NOT NULL").groupBy("comp").agg(F.min("doc_id").alias("first"), F.count("*").alias("size"))
    # Written, so that a large component is a side of a join that can be split.
    many = materialize(spark, firsts.where("size > 1").withColumnRenamed("comp", "__comp"), "groups")
    made.keep(named, many)
    out = named.join(_side(many), F.col("comp") == F.col("__comp"), "left")
    alone = F.col("__comp").isNull()
    columns = ["doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(alone, F.col("doc_id")).otherwise(F.col("first")).alias("component_id"), (~alone).alias("linked")]
    if links:
        with scratch(spark) as within:
            counts = _link_counts(spark, named, arrays)
            within.keep(counts)
        made.keep(counts)
        out = out.join(_side(counts).withColumnRenamed("node", "__node"), F.col("node") == F.col("__node"), "left")
        columns.append(F.when(alone, F.lit(0)).otherwise(F.coalesce("k", F.col("size") - 1)).alias("n_links"))
    return out.select(*columns, *(["row", F.col("__comp").alias("group")] if keys else []))


def one_per_group(spark: SparkSession, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """``docs`` without the documents that link to one of smaller id.

    Of a component stays the row of smallest id (null ids last, then the
    smallest hash of id and text); of rows equal in id and text one stays. Rows
    that link to nothing all stay, whatever their id.
    """
    with scratch(spark) as made:
        found = materialize(spark, components(spark, docs, id_col=id_col, text_col=text_col, words=words, keys=True).where("linked"), "linked")
        place = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("row"))
        kept = materialize(spark, found.groupBy("group").agg(F.min(place).getField("row").alias("kept")).withColumnRenamed("group", "__group"), "kept")
        rows = found.join(_side(kept), F.col("group") == F.col("__group")).groupBy("row").agg(F.max(F.col("row") == F.col("kept")).alias("stays"), F.count("*").alias("c"))
        rows = materialize(spark, rows, "decided")
        made.keep(rows)
    names = {c: f"__c{i}" for i, c in enumerate(docs.columns)}
    doc, text = F.col(names[id_col]), F.col(names[text_col])
    all_ = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    gone = rows.where("NOT stays OR c > 1").select(F.col("row").alias("__row"))
    rest = all_.withColumn("__key", row_key(doc, text)).join(_side(gone), F.col("__key") == F.col("__row"), "left_anti").drop("__key")
    again = rows.where("stays AND c > 1").select(F.col("row").alias("__row"))
    if not again.isEmpty():
        one = all_.withColumn("__key", row_key(doc, text)).join(_side(again), F.col("__key") == F.col("__row"), "left_semi").dropDuplicates(["__key"]).drop("__key")
        rest = rest.unionByName(one)
    return rest.select(*[F.col(n).alias(c) for c, n in names.items()])
