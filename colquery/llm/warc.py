"""Deterministic sharded WARC archives: writer and reader.

Writing. Records are ranged by id, digest and URL and cut into shards of equal
bytes (``SHARD_BYTES`` at most, more where that would make over ``MAX_SHARDS``)
by running totals over the sorted keys, so shards are even however ids lie and
don't depend on how tasks run. A record repeated in id, payload and URL so
often that it fills shards is written by several, each so many times.
Each task sorts its shard's records, compresses record by record, starts
a new file when the current one has ``ROLL_BYTES`` compressed bytes, and
regenerates all headers and digests from the payload. Files are written under
temporary names and renamed when complete; a repeated task replaces its files
by equal ones. The manifest, written last, is the commit: readers open only
the files it lists.

Of records with equal payloads of at least ``min_revisit`` bytes, that with the
smallest id is the response and the others revisit it: their records hold the
response's headers and digest but no payload. Equal payloads are grouped by
digest, aggregated before the shuffle; the one decision per revisit reaches the
writer in the same shuffle as the pages, sorted right before its page.

Null html is an empty payload. Rows with a null id sort first, by digest and URL, and never are the
one that others refer to unless all of the group are null; then each is a
response. Repeated ids of equal payload that are the smallest are responses
each. URLs are percent-encoded where they hold spaces or control characters. An
empty table gives an empty archive.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import uuid
import zlib
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch, ship_package
from .common import arrow_schema, materialize, work_path

SHARD_BYTES, ROLL_BYTES, MAX_SHARDS, RECORD_BYTES, LEVEL, DATE = 16 << 20, 64 << 20, 20_000, 512, 6, "2000-01-01T00:00:00Z"
MAX_BROADCAST = 200_000  # rows of a counted side of digests and ids
KEY = ["page_id", "sha", "uh"]
MANIFEST = "file string, shard long, seq int, records long, bytes long, sha256 string"
RECORDS = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"
CRLF = b"\r\n"


def filesystem(path: str):
    from pyarrow.fs import FileSystem

    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return FileSystem.from_uri("file://" + path if "://" not in path else path)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id, sha: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{sha}')}>"


def _headers(pairs) -> bytes:
    return b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in pairs) + CRLF


def record(page_id, url: str | None, payload: bytes, refers_to, has_referee: bool) -> bytes:
    """One record; a revisit keeps the HTTP headers, and so the payload's length."""
    sha = digest(payload)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + f"Content-Length: {len(payload)}\r\n\r\n".encode()
    block = http if has_referee else http + payload
    target = quote(url if url is not None else f"urn:page:{page_id}", safe="!#$%&'()*+,/:;=?@[]~-._")
    pairs = [("WARC-Type", "revisit" if has_referee else "response"), ("WARC-Record-ID", record_id(page_id, sha)), ("WARC-Date", DATE), ("WARC-Target-URI", target),
             ("X-Page-ID", "" if page_id is None else page_id), ("X-No-URL", int(url is None)), ("WARC-Payload-Digest", f"sha1:{sha}"), ("WARC-Block-Digest", f"sha1:{digest(block)}")]
    if has_referee:
        pairs += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(refers_to, sha)), ("X-Refers-To-Page-ID", refers_to)]
    pairs += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", len(block))]
    return _headers(pairs) + block + CRLF + CRLF


class Roller:
    """Files of one shard: gzip members appended under a temporary name, renamed on close."""

    def __init__(self, path: str, shard: int, roll_bytes: int):
        self.fs, self.dir = filesystem(path)
        self.shard, self.roll, self.seq, self.done, self.out = shard, roll_bytes, 0, [], None

    def add(self, data: bytes) -> None:
        if self.out is None:
            self.name = f"part-{self.shard:08d}-{self.seq:05d}.warc.gz"
            self.temp = f"{self.dir}/.tmp-{self.name}-{uuid.uuid4().hex}"
            self.out, self.size, self.records, self.sha = self.fs.open_output_stream(self.temp, compression=None), 0, 0, hashlib.sha256()
            info = f"software: colquery\r\nshard: {self.shard}\r\nsequence: {self.seq}\r\n".encode()
            self._put(_headers([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(self.name, "")), ("WARC-Date", DATE), ("WARC-Filename", self.name),
                                ("Content-Type", "application/warc-fields"), ("Content-Length", len(info))]) + info + CRLF + CRLF)
        self._put(data)
        self.records += 1
        if self.size >= self.roll:
            self.close()

    def _put(self, data: bytes) -> None:
        member = gzip.compress(data, LEVEL, mtime=0)
        self.out.write(member)
        self.sha.update(member)
        self.size += len(member)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.fs.move(self.temp, f"{self.dir}/{self.name}")
            self.done.append((self.name, self.shard, self.seq, self.records, self.size, self.sha.hexdigest()))
            self.out, self.seq = None, self.seq + 1


def _side(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= MAX_BROADCAST else df


def decisions(spark: SparkSession, keys: DataFrame, min_revisit: int) -> DataFrame:
    """page_id, sha, uh, refers_to for every record that revisits another."""
    small = keys.where(F.col("size") >= min_revisit)
    firsts = small.groupBy("sha", "size").agg(F.min("page_id").alias("first"), F.count("*").alias("c")).where("c > 1 AND first IS NOT NULL")
    firsts = materialize(spark, firsts.select(F.col("sha").alias("__sha"), F.col("size").alias("__size"), F.col("first").alias("refers_to")), "first-pages")
    joined = small.join(_side(firsts), (F.col("sha") == F.col("__sha")) & (F.col("size") == F.col("__size")))
    return joined.where("NOT page_id <=> refers_to").select(*KEY, "refers_to").distinct()


def _renamed(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).alias(f"__{c}") for c in KEY], *[c for c in df.columns if c not in KEY])


def _same_key():
    return F.col("page_id").eqNullSafe(F.col("__page_id")) & (F.col("sha") == F.col("__sha")) & (F.col("uh") == F.col("__uh"))


def _not_on_key(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.join(F.broadcast(_renamed(right)), _same_key(), "left_anti")


def _on_key(left: DataFrame, right: DataFrame) -> DataFrame:
    """Join with a small table by key, nulls included; the key columns are left's."""
    return left.join(F.broadcast(_renamed(right)), _same_key()).drop(*[f"__{c}" for c in KEY])


class Shards:
    """Where keys go: the first key of each shard, and the blocks of records that fill shards by themselves."""

    def __init__(self, spark: SparkSession, keys: DataFrame, shard_bytes: int):
        groups = keys.groupBy(*KEY).agg(F.max("size").alias("size"), F.count("*").alias("n")).withColumn("w", (F.col("size") + RECORD_BYTES) * F.col("n"))
        order = [F.col("page_id").asc_nulls_first(), F.col("sha"), F.col("uh")]
        ranged = materialize(spark, groups.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ranged-keys")
        parts = sorted(tuple(r) for r in ranged.groupBy("part").agg(F.sum("w").alias("w")).collect())  # a row a partition
        total, starts = 0, []
        for part, w in parts:
            starts.append((part, total))
            total += w
        self.each = max(shard_bytes, -(-total // MAX_SHARDS))
        shards = max(1, -(-total // self.each))
        self.each = max(1, -(-total // shards))
        self.count = shards
        start = spark.createDataFrame(starts, "__part int, before long")
        own = F.coalesce(F.sum("w").over(Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        at = ranged.withColumn("own", own).join(F.broadcast(start), F.col("part") == F.col("__part")).withColumn("start", F.col("own") + F.col("before"))
        at = materialize(spark, at.withColumn("shard", F.floor(F.col("start") / F.lit(self.each)).cast("long")).select(*KEY, "size", "n", "w", "start", "shard"), "placed-keys")
        first = at.groupBy("shard").agg(F.min(F.struct(*KEY)).alias("k")).orderBy("shard").collect()  # MAX_SHARDS rows at most
        self.numbers = [r["shard"] for r in first]
        self.edges = [[r["k"]["page_id"], r["k"]["sha"], r["k"]["uh"]] for r in first]
        # Records that repeat beyond a shard: blocks of so many copies each.
        heavy = at.where((F.col("n") > 1) & (F.col("w") > self.each))
        fit = F.greatest(F.lit(1), F.floor(F.lit(self.each) / (F.col("size") + RECORD_BYTES))).cast("long")
        heavy = heavy.withColumn("fit", fit).withColumn("b", F.explode(F.expr("sequence(0L, (n - 1) div fit)")))
        place = F.least(F.lit(shards - 1), F.floor((F.col("start") + F.col("b") * F.col("fit") * (F.col("size") + RECORD_BYTES)) / F.lit(self.each))).cast("long")
        self.heavy = materialize(spark, heavy.select(*KEY, place.alias("shard"), F.expr("least(fit, n - b * fit)").alias("times")), "repeated")
        self.repeats = not self.heavy.isEmpty()

    def column(self):
        """The shard of a key: the last edge that isn't beyond it, by binary search in a constant array."""
        if len(self.edges) < 2:
            return F.lit(self.numbers[0] if self.numbers else 0).cast("long")
        edges = json.dumps([{"p": p, "s": s, "u": u} for p, s, u in self.edges])
        steps = ", ".join(str(1 << k) for k in reversed(range(len(self.edges).bit_length())))
        found = (f"aggregate(array({steps}), 0, (at, step) -> if(get(from_json('{edges}', 'array<struct<p:bigint,s:string,u:bigint>>'), at + step) "
                 "<= named_struct('p', page_id, 's', sha, 'u', uh), at + step, at))")  # fmt: skip
        return F.expr(f"get(from_json('{json.dumps(self.numbers)}', 'array<bigint>'), {found})")

    def records(self, pages: DataFrame, others: DataFrame) -> DataFrame:
        """``pages`` and ``others`` (decisions) with shard and times."""
        place = self.column()
        if not self.repeats:
            return others.unionByName(pages).withColumn("shard", place).withColumn("times", F.lit(1).cast("long"))
        full = self.heavy.select(*KEY).distinct()
        seldom = lambda df: _not_on_key(df, full).withColumn("shard", place).withColumn("times", F.lit(1).cast("long"))
        once = pages.join(F.broadcast(_renamed(full)), _same_key(), "left_semi").groupBy(*KEY).agg(*[F.first(c).alias(c) for c in pages.columns if c not in KEY])
        often = _on_key(once.unionByName(others), self.heavy)
        return seldom(others).unionByName(seldom(pages)).unionByName(often.select(*pages.columns, "shard", "times"))


def write_archive(spark: SparkSession, pages: DataFrame, path: str, *, min_revisit: int = 0, shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Write pages (page_id, url, html) under ``path`` and return the manifest."""
    with scratch(spark):
        return _write_archive(spark, pages, path, min_revisit, shard_bytes, roll_bytes)


def _write_archive(spark, pages, path, min_revisit, shard_bytes, roll_bytes) -> DataFrame:
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    url = F.col("url")
    sized = pages.select(F.col("page_id").cast("long").alias("page_id"), F.sha1(payload).alias("sha"), F.xxhash64(url, url.isNull()).alias("uh"), "url", F.coalesce("html", F.lit("")).alias("html"), F.length(payload).cast("long").alias("size"))
    keys = materialize(spark, sized.select(*KEY, "size"), "page-keys")
    shards = Shards(spark, keys, shard_bytes)
    # Decisions and pages come to the writer in one shuffle, a task a shard.
    null = lambda kind: F.lit(None).cast(kind)
    decided = decisions(spark, keys, min_revisit).select(*KEY, F.lit(0).alias("kind"), "refers_to", null("string").alias("url"), null("string").alias("html"))
    stream = shards.records(sized.select(*KEY, F.lit(1).alias("kind"), null("long").alias("refers_to"), "url", "html"), decided)
    stream = stream.select("shard", *KEY, "kind", "refers_to", "url", "html", "times").repartitionById(shards.count, F.col("shard").cast("int"))
    stream = stream.sortWithinPartitions("shard", F.col("page_id").asc_nulls_first(), "sha", "uh", "kind")
    ship_package(spark)
    fs, local = filesystem(path)
    fs.create_dir(f"{local}/data")
    data, out_schema = f"{path}/data", arrow_schema(MANIFEST)

    def write(batches):
        roller, known = None, {}
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for r in batch.slice(at, 256).to_pylist():
                    if roller is None or roller.shard != r["shard"]:
                        if roller:
                            roller.close()
                            yield _manifest(roller, out_schema)
                        roller, known = Roller(data, r["shard"], roll_bytes), {}
                    key = (r["page_id"], r["sha"])
                    if r["kind"] == 0:
                        known = {key: r["refers_to"]}
                    else:
                        raw = record(r["page_id"], r["url"], r["html"].encode("utf-8", "surrogatepass"), known.get(key), key in known)
                        for _ in range(r["times"]):
                            roller.add(raw)
        if roller:
            roller.close()
            yield _manifest(roller, out_schema)

    stream.mapInArrow(write, MANIFEST).write.parquet(f"{path}/manifest")
    return spark.read.parquet(f"{path}/manifest")


def _manifest(roller: Roller, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([dict(zip(schema.names, row, strict=True)) for row in roller.done], schema=schema)


def members(stream, size: int = 1 << 20):
    """Decompressed gzip members of a file, one at a time, read in bounded steps."""
    inflate, parts = zlib.decompressobj(31), []
    while chunk := stream.read(size):
        while chunk:
            parts.append(inflate.decompress(chunk))
            chunk = inflate.unused_data
            if inflate.eof:
                yield b"".join(parts)
                inflate, parts = zlib.decompressobj(31), []
    if any(parts):
        raise ValueError("the archive ends within a record")


def parse(data: bytes) -> dict | None:
    """A response or revisit record with its digests checked; None for other kinds."""
    head, _, rest = data.partition(CRLF + CRLF)
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    h = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    block = rest[: int(h["Content-Length"])]
    if len(block) != int(h["Content-Length"]) or rest[len(block) :] != CRLF + CRLF:
        raise ValueError("wrong record length")
    if h["WARC-Type"] not in ("response", "revisit"):
        return None
    if h["WARC-Block-Digest"] != f"sha1:{digest(block)}":
        raise ValueError("block digest differs")
    http, _, payload = block.partition(CRLF + CRLF)
    length = int(next(x.split(b":")[1] for x in http.split(CRLF) if x.lower().startswith(b"content-length:")))
    sha = h["WARC-Payload-Digest"].removeprefix("sha1:")
    response = h["WARC-Type"] == "response"
    if response and (len(payload) != length or digest(payload) != sha):
        raise ValueError("payload digest differs")
    number = lambda v: int(v) if v else None
    return {"page_id": number(h["X-Page-ID"]), "url": None if h["X-No-URL"] == "1" else h["WARC-Target-URI"], "payload": payload if response else None, "payload_bytes": length,
            "payload_digest": sha, "record_type": h["WARC-Type"], "refers_to": number(h.get("X-Refers-To-Page-ID"))}


def read_archive(spark: SparkSession, path: str, *, payloads: bool = True) -> DataFrame:
    """RECORDS of the files in the manifest; every file's checksum, record count and digests are checked."""
    ship_package(spark)
    files = spark.read.parquet(f"{path}/manifest")
    n = max(1, min(files.count(), 20_000))
    schema, data = arrow_schema(RECORDS), f"{path}/data"

    def read(batches):
        fs, d = filesystem(data)
        for batch in batches:
            for f in batch.to_pylist():
                out, held, count = [], 0, 0
                with fs.open_input_stream(f"{d}/{f['file']}", compression=None) as stream:
                    for raw in members(stream):
                        r = parse(raw)
                        if r is None:
                            continue
                        count += 1
                        held += len(raw)
                        if not payloads:
                            r["payload"] = None
                        out.append(r)
                        if held > 8 << 20 or len(out) >= 4_096:
                            yield pa.RecordBatch.from_pylist(out, schema=schema)
                            out, held = [], 0
                if count != f["records"]:
                    raise ValueError(f"{f['file']} has {count} records, the manifest says {f['records']}")
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=schema)

    return files.repartition(n, "file").mapInArrow(read, RECORDS)


def archive(spark: SparkSession, pages: DataFrame, **options) -> DataFrame:
    """Write to a fresh path in the shared folder and read back."""
    path = work_path(spark, "warc")
    write_archive(spark, pages, path, **options)
    return read_archive(spark, path, payloads=False)


#: The digest columns of the query in DuckDB's dialect, but for base32, which is spelt out from the hexadecimal SHA-1.
ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha1(h) AS x FROM p),
b AS (SELECT *, list_transform(range(0, 32), lambda i: (CAST('0x' || lpad(substr(x || '00', CAST((i * 5) // 4 + 1 AS INT), 2), 2, '0') AS INT) >> (3 - (i * 5) % 4)) & 31) AS v FROM d)
SELECT page_id, payload_bytes, array_to_string(list_transform(v, lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(k + 1 AS INT), 1)), '') AS payload_digest,
       CASE WHEN page_id = min(page_id) OVER (PARTITION BY x) THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = min(page_id) OVER (PARTITION BY x) THEN NULL ELSE min(page_id) OVER (PARTITION BY x) END AS refers_to
FROM b
"""
