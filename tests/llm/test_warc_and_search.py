"""Archives by round trip, neighbour search by brute force, the pipeline end to end."""

import numpy as np
import pytest

import corpus_pipeline
from colquery.llm import lsh_search, shingle_join, warc
from colquery.session import work_path

from .helpers import components

SF = "/root/testdata/sf0.001"


def test_archive_round_trip(spark):
    rows = [(1, "http://a/ b\n", "<p>same</p>"), (2, None, "<p>same</p>"), (3, "http://c", None), (4, "http://d", ""), (5, "http://é", "é\r\n\r\nWARC/1.1\r\n" * 50), (5, "http://é", "other"), (None, "u", "<p>same</p>"), (None, "v", "alone"), (2, None, "<p>same</p>")]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, sha int")
    path = work_path(spark, "warc-test")
    manifest = warc.write_archive(spark, pages, path, shard_bytes=200, roll_bytes=600)
    assert manifest.count() > 1 and manifest.agg({"records": "sum"}).first()[0] == len(rows)
    got = warc.read_archive(spark, path).collect()
    first = {"<p>same</p>": 1, "": 3, "alone": None, "other": 5, rows[4][2]: 5}
    for r in got:
        same = [x for x in rows if (x[2] or "").encode() and warc.digest((x[2] or "").encode()) == r.payload_digest] or [(0, 0, "")]
        text = same[0][2] or ""
        assert r.payload_bytes == len(text.encode())
        if r.record_type == "response":
            assert bytes(r.payload) == text.encode() and r.refers_to is None
        else:
            assert r.refers_to == first[text] and r.page_id != r.refers_to
    assert sorted((r.page_id or 0, r.record_type) for r in got if r.payload_digest == warc.digest(b"<p>same</p>")) == [(0, "revisit"), (1, "response"), (2, "revisit"), (2, "revisit")]


def test_archive_is_deterministic(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    sums = []
    for n in (1, 5):
        path = work_path(spark, "warc-test")
        sums.append(sorted(tuple(r) for r in warc.write_archive(spark, pages.repartition(n), path, shard_bytes=100_000, roll_bytes=20_000).collect()))
    assert sums[0] == sums[1] and len(sums[0]) > 3
    high = warc.read_archive(spark, path, payloads=False)
    assert high.count() == pages.count()


def shard_records(spark, rows, **options):
    path = work_path(spark, "warc-test")
    manifest = warc.write_archive(spark, spark.createDataFrame(rows, "page_id long, url string, html string"), path, **options).collect()
    got = warc.read_archive(spark, path).collect()
    by = {}
    for r in manifest:
        by[r.shard] = by.get(r.shard, 0) + r.records
    return by, sorted((r.page_id or -1, r.url or "", r.payload_bytes) for r in got)


def test_shards_are_even_however_ids_lie(spark):
    rows = [(i, f"http://h/{i}", f"page {i} " + "x" * 300) for i in range(2000)]
    even, _ = shard_records(spark, rows, shard_bytes=30_000)
    odd, got = shard_records(spark, rows + [(10**15, "http://far", "far")], shard_bytes=30_000)
    assert len(even) > 20 and max(even.values()) <= 1.2 * 2000 / len(even)
    assert abs(len(odd) - len(even)) <= 1 and max(odd.values()) <= max(even.values()) + 1 and len(got) == 2001


def test_shards_of_repeated_and_null_ids(spark):
    """Null ids part by digest and URL; records equal in everything are dealt out in blocks."""
    rows = [(None, f"http://n/{i}", f"page {i} " + "x" * 300) for i in range(500)] + [(7, "http://same", "y" * 300)] * 700 + [(None, f"http://m/{i}", "z" * 300) for i in range(300)] + [(3, None, "y" * 300), (9, "u", None)]
    by, got = shard_records(spark, rows, shard_bytes=40_000)
    assert got == sorted((i or -1, u or "", len(h or "")) for i, u, h in rows)
    assert len(by) > 20 and max(by.values()) <= 2 * len(rows) / len(by)
    path = work_path(spark, "warc-test")
    warc.write_archive(spark, spark.createDataFrame(rows, "page_id long, url string, html string"), path, shard_bytes=40_000)
    kinds = {}
    for r in warc.read_archive(spark, path).collect():
        kinds.setdefault((r.page_id, r.payload_digest), set()).add((r.record_type, r.refers_to))
    y, z = warc.digest(b"y" * 300), warc.digest(b"z" * 300)
    assert kinds[3, y] == {("response", None)} and kinds[7, y] == {("revisit", 3)} and kinds[None, z] == {("response", None)}


def test_min_revisit_and_empty(spark):
    pages = spark.createDataFrame([(1, "u", "abc"), (2, "v", "abc")], "page_id long, url string, html string")
    assert {r.record_type for r in warc.archive(spark, pages, min_revisit=4).collect()} == {"response"}
    assert warc.archive(spark, pages.limit(0)).count() == 0


def test_damage_is_noticed():
    raw = warc.record(1, "http://a", b"payload", None, False)
    assert warc.parse(raw)["payload"] == b"payload"
    with pytest.raises(ValueError, match="digest"):
        warc.parse(raw.replace(b"\r\n\r\npayload", b"\r\n\r\npayloaD"))


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16))
    x = centres[rng.integers(0, 12, 3000)] + 0.4 * rng.normal(size=(3000, 16))
    x[1000:1400] = x[1000]  # one very common vector
    return x


def exact(x, ids, q, top=20):
    s = (x * q[1]).sum(axis=1)
    s[ids == q[0]] = -np.inf
    order = np.lexsort((ids, -s))[:top]
    return list(ids[order]), s[order]


def test_search_recall_and_order(spark, clustered):
    ids = np.arange(len(clustered))
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, clustered, strict=True)], "vec_id long, embedding array<double>")
    got = {}
    for r in sorted(lsh_search.search(spark, df).collect()):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    hit = total = 0
    for q in range(0, 3000, 20):
        want, score = exact(clustered, ids, (q, clustered[q]))
        assert [s for _, s in got[q]] == sorted((s for _, s in got[q]), reverse=True)
        for v, s in got[q]:
            assert s == float((clustered[v] * clustered[q]).sum())
        hit += sum(s >= score[-1] for _, s in got[q])
        total += 20
    assert hit >= 0.9 * total


def test_search_odd_rows(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 1.0]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, [None, 1.0]), (7, [1.0]), (None, [1.0, 1.0]), (8, [0.5, 1.0]), (8, [0.5, 1.0]), (20, [0.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in lsh_search.search(spark, df).collect())
    assert got == [(0, 1, 1, 0.5), (0, 2, 8, 0.5), (0, 3, 20, 0.0), (20, 1, 1, 2.0), (20, 2, 8, 2.0), (20, 3, 0, 0.0)]
    assert lsh_search.search(spark, df.limit(0)).count() == 0


def test_search_splits_and_clashing_columns(spark, clustered, monkeypatch):
    """Parts and queries in many splits give the rows that whole ones give; further columns don't matter."""
    rows = [(int(i), v.tolist(), 1, 2) for i, v in enumerate(clustered[:1500])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, part int, codes int")
    whole = sorted(map(tuple, lsh_search.search(spark, df).collect()))
    monkeypatch.setattr(lsh_search, "PART_ROWS", 200)
    monkeypatch.setattr(lsh_search, "PART_QUERIES", 9)
    assert sorted(map(tuple, lsh_search.search(spark, df).collect())) == whole and len(whole) == 75 * 20


def test_buckets_come_by_falling_success():
    x = np.random.default_rng(1).normal(size=(400, 8))
    model = lsh_search.Hash(8, 400, x, 1, 1.0)
    for q, codes in zip(x[:40], model.visits(x[:40], 0), strict=True):
        assert len(codes) == len(set(codes.tolist())) == model.buckets(0)  # all of them, for the whole mass
        odds = [s[0] / u for s, u in zip(model.shares(q[None], 0), model.usual[0], strict=True)]
        value = np.ones(1)
        for o in odds:
            value = (value[:, None] * o[None]).ravel()
        assert np.allclose(value[codes], np.sort(value)[::-1])
    assert set(np.concatenate([model.bucket(x, 0)])) <= set(range(model.buckets(0)))


@pytest.mark.parametrize("n", [3, 15, 30, 90])
def test_search_fills_small_tables(spark, n):
    x = np.random.default_rng(n).normal(size=(n, 6))
    rows = [(20 * i, v.tolist()) for i, v in enumerate(x)] + [(20, (-x[1]).tolist())] * 3  # all are queries; one id has opposite vectors
    got = {}
    for r in lsh_search.search(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    for q in range(0, 20 * n, 20):
        found = got[q]
        assert len(found) == len(set(found)) == min(20, n - 1) and q not in found


def test_pipeline_stages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").selectExpr("*", "1 AS score", "2 AS size")
    labels = {r.doc_id: r for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "/root/testdata/sf0.01")
        if name == "packing":
            assert out.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
            break
        assert out.dtypes == docs.dtypes, name
        before, out_rows = docs.collect(), out.collect()
        after = {r.doc_id for r in out_rows}
        known = [(labels[r.doc_id], r.doc_id in after) for r in before if r.doc_id in labels]
        if name == "quality":
            assert np.mean([k for x, k in known if x.quality]) > 0.98 and np.mean([k for x, k in known if not x.quality]) < 0.1
        elif name == "toxicity":
            assert np.mean([k for x, k in known if not x.toxic]) > 0.98 and np.mean([k for x, k in known if x.toxic]) < 0.3
        elif name == "near_duplicates":
            some = [(r.doc_id, r.text) for r in before]
            assert sorted(after) == sorted({c for _, _, c in components(some)})
        docs = spark.createDataFrame(out_rows, docs.schema)


def test_small_pipeline_inputs(spark):
    docs = spark.createDataFrame([(1, None, None, "s", 0), (2, "", "en", None, 0), (3, "one two", "en", "s", 7), (3, "one two", "en", "s", 7)], "doc_id long, text string, lang string, source string, n_chars long")
    for frame in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, frame, SF).count() >= 0
    assert shingle_join.one_per_group(spark, docs).count() == 3
