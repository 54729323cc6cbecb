"""Exact dedup by a log-structured merge index over text digests.

Memtables (bounded by entries and bytes) take rows as they are scanned; a full one is flushed as a run sorted by
digest, with a Bloom filter of fixed geometry. Within a memtable a hit is compared byte by byte with the text held.
The runs' filters merge into one of the positions that two runs share: a digest outside it needs no compaction.
Compaction keeps the winning identifier and the count of each digest over all runs. Digests that several runs hold
get their representatives' texts compared; a digest with unlike texts is grouped by the texts themselves.

Nulls: a null text counts as empty; a null doc_id never wins while the group has another. Rows with equal doc_id and
text are one document, all of them kept or dropped together. Empty texts form a group as any other. An empty table
gives an empty result. Columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, text_of

FILTER_BITS = 1 << 23
_LOG = "run long, sha binary, digest binary, doc_id long, head boolean, n long, best long, clash boolean, filter binary"


def _slots(digests: list[bytes], bits: int) -> np.ndarray:
    """Two filter positions a digest, from its first bytes."""
    raw = np.frombuffer(b"".join((d * 8)[:8] for d in digests), dtype="<u4")
    return raw & np.uint32(bits - 1)


def _bitmap(slots: np.ndarray, bits: int) -> np.ndarray:
    out = np.zeros(bits >> 3, np.uint8)
    np.bitwise_or.at(out, slots >> 3, np.left_shift(1, slots & 7).astype(np.uint8))
    return out


def _log_writer(keep_max: bool, digest_bytes: int, entries: int, text_bytes: int, bits: int):
    def write(batches):
        task, seq, held, rows, mem = TaskContext.get().partitionId(), 0, 0, 0, {}

        def flush():
            nonlocal mem, held, rows, seq
            out = {k: [] for k in ("run", "sha", "digest", "doc_id", "head", "n", "best", "clash", "filter")}
            digests = sorted(mem)
            packed = zlib.compress(_bitmap(_slots(digests, bits), bits).tobytes(), 1)
            for digest in digests:
                for sha, _, ids in mem[digest]:
                    known = [i for i in ids if i is not None]
                    best = (max if keep_max else min)(known) if known else None
                    for k, i in enumerate(ids):
                        for name, value in zip(out, (task << 24 | seq, sha, digest, i, k == 0, len(ids), best, len(mem[digest]) > 1, packed), strict=True):
                            out[name].append(value)
                        packed = None
            mem, held, rows, seq = {}, 0, 0, seq + 1
            types = (pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.bool_(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types, strict=True)], names=list(out))

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = text.encode("utf-8", "surrogatepass")
                sha = hashlib.sha256(data).digest()
                variants = mem.setdefault(sha[:digest_bytes], [])
                for variant in variants:
                    if variant[1] == data:  # the digest hit; the bytes decide
                        variant[2].append(doc_id)
                        break
                else:
                    variants.append((sha, data, [doc_id]))
                    held += len(data)
                rows += 1
                if rows >= entries or held >= text_bytes:
                    yield flush()
        if rows:
            yield flush()

    return write


def _folded(parts, bits: int):
    """(once, twice) of several filters: what any has, and what two have."""
    once, twice = np.zeros(bits >> 3, np.uint8), np.zeros(bits >> 3, np.uint8)
    for a, b in parts:
        a = np.frombuffer(zlib.decompress(a), np.uint8)
        twice |= once & a
        if b is not None:
            twice |= np.frombuffer(zlib.decompress(b), np.uint8)
        once |= a
    return zlib.compress(once.tobytes(), 1), zlib.compress(twice.tobytes(), 1)


def _shared_positions(log: DataFrame, bits: int) -> np.ndarray:
    """Merges the runs' filters in a tree of fan-in 32; the driver gets at most 32 bitmaps of `bits` bits."""

    def fold(batches):
        parts = [p for b in batches for p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
        if parts:
            once, twice = _folded(parts, bits)
            yield pa.RecordBatch.from_arrays([pa.array([once], pa.binary()), pa.array([twice], pa.binary())], names=["once", "twice"])

    level = log.where(F.col("filter").isNotNull()).select(F.col("filter").alias("once"), F.lit(None).cast("binary").alias("twice")).mapInArrow(fold, "once binary, twice binary")
    wide = level.rdd.getNumPartitions()
    while wide > 32:
        wide = -(-wide // 32)
        level = level.repartition(wide).mapInArrow(fold, "once binary, twice binary")
    return np.frombuffer(zlib.decompress(_folded([(r.once, r.twice) for r in level.collect()], bits)[1]), np.uint8)


def exact_dedup(docs: DataFrame, keep: str = "max", digest_bytes: int = 32, memtable_rows: int = 50_000, memtable_bytes: int = 48 << 20, filter_bits: int = FILTER_BITS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row; keep is 'max' or 'min' of doc_id.

    filter_bits (a power of two) bounds what is broadcast; a filter that fills up costs work, never results.
    """
    rows = text_of(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    log = stored(rows.mapInArrow(_log_writer(keep == "max", digest_bytes, memtable_rows, memtable_bytes, filter_bits), _LOG), "runs")
    shared = docs.sparkSession.sparkContext.broadcast(_shared_positions(log, filter_bits))

    @F.pandas_udf("boolean")
    def in_two_runs(digest):
        import pandas as pd

        s = _slots(list(digest), filter_bits).reshape(-1, 2)
        hit = shared.value[s >> 3] >> (s & 7).astype(np.uint8) & 1
        return pd.Series(hit.all(axis=1))

    log = log.drop("filter").withColumn("maybe", (F.col("n") > 1) | F.col("clash") | in_two_runs("digest"))
    alone, rest = log.where(~F.col("maybe")), log.where("maybe")
    heads = rest.where("head")
    best = F.max("best") if keep == "max" else F.min("best")
    groups = stored(heads.groupBy("digest").agg(best.alias("keep_id"), F.sum("n").alias("group_size"), F.count_distinct("run").alias("runs"), F.max("clash").alias("clash")), "compacted")

    # Byte verification over runs: representatives' texts of each digest that several runs hold.
    crossing = groups.where("runs > 1").select("digest")
    wanted = heads.join(crossing, "digest", "left_semi").select("digest", F.col("doc_id").alias("at")).distinct()
    digest_of = F.substring(F.unhex(F.sha2("text", 256)), 1, digest_bytes)
    texts = rows.withColumn("digest", digest_of).where(in_two_runs("digest"))
    texts = texts.join(wanted, (texts.digest == wanted.digest) & texts.doc_id.eqNullSafe(wanted["at"]), "left_semi")
    unlike = texts.groupBy("digest").agg((F.min("text") != F.max("text")).alias("unlike")).where("unlike")
    bad = stored(unlike.select("digest").union(groups.where("clash").select("digest")).distinct(), "unlike")

    good = groups.join(bad, "digest", "left_anti").select("digest", "keep_id", "group_size")
    by_run = heads.select("run", "digest").distinct().join(good, "digest")  # a hot digest has one row a run here
    found = rest.select("run", "digest", "doc_id", "sha").join(by_run, ["run", "digest"]).select("doc_id", "keep_id", "group_size", "sha")
    out = alone.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "sha").unionByName(found)
    if not bad.isEmpty():
        odd = rows.withColumn("digest", digest_of).join(bad, "digest", "left_semi")
        kept = odd.groupBy("text").agg((F.max("doc_id") if keep == "max" else F.min("doc_id")).alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        out = out.unionByName(odd.join(kept, "text").select("doc_id", "keep_id", "group_size", F.unhex(F.sha2("text", 256)).alias("sha")))
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
