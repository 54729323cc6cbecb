"""WARC archives with a two-level capture index.

Pages are range-sorted by their reversed-host URL key. Each task writes one archive, a gzip member for each record,
and beside it the captures' lines in compressed blocks of BLOCK lines; the directory has one row for each block: its
first and last key, where it lies and where its records lie. A lookup searches the directory, reads the block's bytes,
bisects its lines, and reads a record's byte range. Reading everything back goes block by block the same way.

Of records with equal payloads of `min_bytes` or more, that of the largest page_id is the response and the others are
revisits without a payload. Files go to the shared folder through pyarrow.fs (any scheme that it knows), under a name
of their own for each attempt, so a lost executor's task writes anew and the directory names only finished files.

Nulls: a null html is the empty payload, a null url the empty url; a null page_id never wins while others are there.
Equal rows are records of their own. An empty table writes no archive. Other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import uuid
import zlib
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks_join, bound_batches, new_path, partitions, stored
from .url_filter import host_key, host_of, path_of

BLOCK = 512
_DIRECTORY = "first_key string, last_key string, n int, index_path string, index_at long, index_bytes long, warc_path string, warc_at long, warc_bytes long"
_RECORD = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


def url_key(url: Column) -> Column:
    """Reversed host, `)`, path and query: `net.example.)/en/1?x`."""
    url = F.coalesce(url, F.lit(""))
    rest = F.when(F.instr(url, "?") > 0, F.substr(url, F.instr(url, "?"))).otherwise(F.lit(""))
    return F.concat(host_key(host_of(url)), F.lit(")"), path_of(url), rest)


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _header(value: str) -> str:
    """A header's value on one line of UTF-8."""
    return json.dumps(value, ensure_ascii=False)[1:-1]


def record_bytes(page_id, url: str, payload: bytes, refers_to, digest: str, revisit: bool) -> bytes:
    """One gzip member. A revisit keeps the digest and length of the full payload, not the payload."""
    body = b"" if revisit else payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url} {digest}')}>",
        "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {_header(url)}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Page-Id: {'' if page_id is None else page_id}", f"X-Payload-Length: {len(payload)}",
        *([f"X-Refers-To-Page: {'' if refers_to is None else refers_to}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] if revisit else []),
        "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}",
    ]
    return gzip.compress("\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + body + b"\r\n\r\n", 3, mtime=0)


def parse_record(data: bytes) -> dict:
    """What record_bytes wrote; raises ValueError if a response's payload hasn't the digest that its header names."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    h = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
    body = rest[: int(h["Content-Length"])]
    digest, kind = h["WARC-Payload-Digest"].removeprefix("sha1:"), h["WARC-Type"]
    if version != "WARC/1.1" or rest[len(body) :] != b"\r\n\r\n" or kind == "response" and base32_sha1(body) != digest:
        raise ValueError("damaged WARC record")
    number = lambda k: int(h[k]) if h.get(k) else None
    return {"page_id": number("X-Page-Id"), "url": json.loads(f'"{h["WARC-Target-URI"]}"'), "payload": body, "payload_bytes": number("X-Payload-Length"), "payload_digest": digest, "record_type": kind, "refers_to": number("X-Refers-To-Page")}


def _fs(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def _writer(folder: str):
    def run(batches):
        filesystem, base = _fs(folder)
        name = f"{base}/{uuid.uuid4().hex}"
        filesystem.create_dir(base, recursive=True)
        warc = cdx = None
        at = index_at = block_at = 0
        lines: list[tuple] = []
        found = {k: [] for k in ("first_key", "last_key", "n", "index_path", "index_at", "index_bytes", "warc_path", "warc_at", "warc_bytes")}

        def close_block():
            nonlocal lines, index_at, block_at
            packed = zlib.compress("\n".join(json.dumps(x, ensure_ascii=True) for x in lines).encode(), 6)
            cdx.write(packed)
            row = (lines[0][0], lines[-1][0], len(lines), f"{folder}/{name.rsplit('/', 1)[1]}.cdx", index_at, len(packed), f"{folder}/{name.rsplit('/', 1)[1]}.warc.gz", block_at, at - block_at)
            for k, v in zip(found, row, strict=True):
                found[k].append(v)
            index_at, block_at, lines = index_at + len(packed), at, []

        place, marks = None, {}  # of the page that comes next: digest -> the response that it repeats
        for batch in batches:
            for key, page_id, mark, url, html, keep, sha in zip(*(batch.column(k).to_pylist() for k in range(7)), strict=True):
                digest = base64.b32encode(sha).decode()
                if (key, page_id) != place:
                    place, marks = (key, page_id), {}
                if mark == 0:
                    marks[digest] = keep
                    continue
                if warc is None:
                    warc, cdx = (filesystem.open_output_stream(f"{name}.{kind}", compression=None) for kind in ("warc.gz", "cdx"))
                data = record_bytes(page_id, url, html, marks.get(digest), digest, digest in marks)
                warc.write(data)
                lines.append((key, page_id, at, len(data)))
                at += len(data)
                if len(lines) == BLOCK:
                    close_block()
        if lines:
            close_block()
        if warc is not None:
            warc.close()
            cdx.close()
            types = (pa.string(), pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(found.values(), types, strict=True)], names=list(found))

    return run


def write_archives(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Writes archives and index of page_id, url, html; returns the block directory, itself a stored table."""
    spark = pages.sparkSession
    bound_batches(spark)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("html"))
    rows = rows.withColumn("sha", F.unhex(F.sha1("html"))).withColumn("key", url_key(F.col("url")))
    large = rows.where(F.length("html") >= min_bytes)
    firsts = large.groupBy("sha").agg(F.max("page_id").alias("keep"), F.count(F.lit(1)).alias("n")).where("n > 1")
    copies = blocks_join(large.select("sha", "key", "page_id"), firsts, "sha", F.col("page_id")).where("n > 1").where(~F.col("page_id").eqNullSafe(F.col("keep")))
    # Payloads are moved once, by the sort. A mark with the same key sorts just before the page that is a revisit.
    none = F.lit(None)
    marks = copies.select("key", "page_id", F.lit(0).alias("mark"), none.cast("string").alias("url"), none.cast("binary").alias("html"), "keep", "sha").distinct()
    every = rows.select("key", "page_id", F.lit(1).alias("mark"), "url", "html", none.cast("long").alias("keep"), "sha").unionByName(marks)
    ordered = every.repartitionByRange(partitions(spark), "key", "page_id").sortWithinPartitions("key", "page_id", "mark")
    return stored(ordered.mapInArrow(_writer(new_path(spark, "warc")), _DIRECTORY), "directory")


def _block(open_file, row) -> list:
    """The lines of a block, by a range read of its bytes."""
    with open_file(row["index_path"]) as f:
        f.seek(row["index_at"])
        packed = f.read(row["index_bytes"])
    return [json.loads(x) for x in zlib.decompress(packed).decode().split("\n")]


def _opener():
    held: dict = {}

    def open_file(path: str):
        folder = path.rsplit("/", 1)[0]
        if folder not in held:
            held[folder] = _fs(folder)
        filesystem, base = held[folder]
        return filesystem.open_input_file(f"{base}/{path.rsplit('/', 1)[1]}")

    return open_file


def _batch(records: list[dict]):
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
    return pa.RecordBatch.from_pylist(records, schema=schema)


def read_archives(directory: DataFrame) -> DataFrame:
    """Every record, by way of the index: a block's lines, then the byte range that holds its records."""

    def run(batches):
        open_file = _opener()
        for batch in batches:
            for row in batch.to_pylist():
                lines = _block(open_file, row)
                with open_file(row["warc_path"]) as f:
                    out = []
                    for _, _, at, length in lines:  # records of a block lie side by side
                        f.seek(at)
                        out.append(parse_record(gzip.decompress(f.read(length))))
                        if len(out) == 64:
                            yield _batch(out)
                            out = []
                if out:
                    yield _batch(out)

    spread = directory.repartition(2 * partitions(directory.sparkSession), "warc_path", "index_at")
    return spread.mapInArrow(run, _RECORD)


def lookup(spark: SparkSession, directory: DataFrame, urls: list[str]) -> list[dict]:
    """Records of the given urls, in their order, all in one job: the wanted keys are bisected into each sorted stretch
    of the directory, then into the lines of the blocks found there, and only the records' bytes are read."""
    asked = spark.createDataFrame([(u,) for u in dict.fromkeys(urls)], "url string").select("url", url_key(F.col("url")).alias("key")).collect()
    wanted = sorted({r.key for r in asked})
    exact = {r.url for r in asked}

    def run(batches):
        open_file = _opener()
        for batch in batches:
            blocks = sorted(batch.to_pylist(), key=lambda r: (r["first_key"], r["last_key"]))
            lasts, out = [r["last_key"] for r in blocks], []
            for key in wanted:
                b = bisect_left(lasts, key)
                while b < len(blocks) and blocks[b]["first_key"] <= key:
                    lines = _block(open_file, blocks[b])
                    k = bisect_left(lines, key, key=lambda x: x[0])
                    with open_file(blocks[b]["warc_path"]) as f:
                        while k < len(lines) and lines[k][0] == key:
                            f.seek(lines[k][2])
                            record = parse_record(gzip.decompress(f.read(lines[k][3])))
                            out += [record] if record["url"] in exact else []
                            k += 1
                    b += 1
            if out:
                yield _batch(out)

    place = {u: k for k, u in enumerate(urls)}
    found = directory.repartitionByRange("first_key").mapInArrow(run, _RECORD).collect()
    return sorted((r.asDict() for r in found), key=lambda r: (place[r["url"]], r["page_id"] is not None, r["page_id"] or 0))
