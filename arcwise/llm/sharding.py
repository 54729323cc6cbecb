"""Sharding by sampled splitters, DataFrame functions only.

Rows are ordered by (MD5 of the text, doc_id), so equal texts lie together. A size-weighted sample of keys gives
quantile boundaries; records are range-partitioned by them, and a text that fills whole ranges is subdivided by
doc_id; ranges that still hold over twice the mean are sampled anew and subdivided. Exact byte and row counts of each range then place every record on one global line, which is cut into shards
of near equal bytes. A cut falls on the edge of a group of equal texts unless the group is over 1/64 of a shard.

Law `bytes`: shard sizes differ from the mean by 1/64 of a shard or one record at most, whichever is larger. The
sample decides only which task does what, never the result.

Nulls: a null text has size 1 (none plus 1) and counts as the empty text; a null doc_id sorts first. Rows that are
equal in both have places of their own. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, stored, text_of

BUCKETS = 4096  # of three hexadecimal digits
ROUNDS = 4  # of subdivision


def _ranged(keys: DataFrame, cuts: list, low) -> DataFrame:
    # Range of a key: a small table has, by the key's first digits, the cuts that start alike and how many lie before.
    by: dict[str, list] = {}
    for cut in cuts:
        by.setdefault(cut[0][:3], []).append(cut)
    table, before = [], 0
    for head in (f"{b:03x}" for b in range(BUCKETS)):
        table.append((head, before, by.get(head, [])))
        before += len(by.get(head, []))
    lookup = keys.sparkSession.createDataFrame(table, "head string, before int, cuts array<struct<k:string,d:bigint>>").coalesce(1)
    # 4096 rows and at most `ranges` cuts: a fixed size
    placed = keys.withColumn("head", F.substring("key", 1, 3)).join(F.broadcast(lookup), "head")
    at = F.struct(F.col("key").alias("k"), low.alias("d"))
    return placed.select("doc_id", "size", "text_crc32", "key", (F.col("before") + F.size(F.filter("cuts", lambda c: c <= at))).alias("range"))


def sampled_shards(docs: DataFrame, shards: int = 8, ranges: int | None = None, per_range: int = 16, tolerance: int = 64) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard. At most about ranges * per_range sampled keys reach the driver."""
    spark = docs.sparkSession
    ranges = ranges or max(64, min(16_384, 8 * partitions(spark)))
    keys = text_of(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length("text") + 1).cast("long").alias("size"), F.crc32(F.encode("text", "UTF-8")).alias("text_crc32"), F.md5("text").alias("key"))
    keys = stored(keys, "keys")
    total = keys.agg(F.sum("size")).first()[0] or 0
    low = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)).cast("long"))
    chance = F.lit(float(ranges * per_range)) * F.col("size") / F.lit(float(max(total, 1)))
    dice = F.pmod(F.xxhash64("key", "doc_id", F.lit(17)), F.lit(1 << 30)) / float(1 << 30)
    sample = sorted((r.key, r.low) for r in keys.where(dice < chance).select("key", low.alias("low")).collect())
    step = max(1, len(sample) // ranges)
    cuts = sorted(set(sample[step::step]))
    # A cut stands at the edge of its text's group, unless the group holds several cuts: that group is subdivided.
    hot = sorted({a[0] for a, b in zip(cuts, cuts[1:], strict=False) if a[0] == b[0]})
    cuts = sorted({(k, d if k in set(hot) else -(1 << 63)) for k, d in cuts})

    def placed_by(cuts: list) -> DataFrame:
        """keys with their range."""
        return _ranged(keys, cuts, low)

    def sums_of(placed: DataFrame) -> dict:
        return {r.range: (r.rows, r.bytes) for r in placed.groupBy("range").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("bytes")).collect()}

    placed = placed_by(cuts)
    sums = sums_of(placed)
    # Ranges that came out over twice the mean are sampled anew, by their own sizes, and subdivided.
    for _ in range(ROUNDS):
        mean = total / (len(cuts) + 1)
        full = {r: b for r, (n, b) in sums.items() if n > 1 and b > 2 * mean}
        if not full:
            break
        weight = F.coalesce(*[F.when(F.col("range") == r, F.lit(float(per_range) / mean)) for r in sorted(full)])
        again = F.pmod(F.xxhash64("key", "doc_id", F.lit(18 + len(cuts))), F.lit(1 << 30)) / float(1 << 30)
        more: dict[int, list] = {}
        for r in placed.where(F.col("range").isin(sorted(full)) & (again < weight * F.col("size"))).select("range", "key", low.alias("low")).collect():
            more.setdefault(r.range, []).append((r.key, r.low))
        new = set(cuts)
        for r, found in more.items():
            parts = max(2, round(full[r] / mean))
            found.sort()
            new |= {found[len(found) * k // parts] for k in range(1, parts)}
        if new == set(cuts):  # one record, or equal ones, fill the range
            break
        cuts = sorted(new)
        hot = sorted({*hot, *(a[0] for a, b in zip(cuts, cuts[1:], strict=False) if a[0] == b[0])})
        cuts = sorted({(k, d if k in set(hot) else -(1 << 63)) for k, d in cuts})
        placed = placed_by(cuts)
        sums = sums_of(placed)

    base, rows, size = [], 0, 0
    for r in range(len(cuts) + 1):
        base.append((r, rows, size))
        rows, size = rows + sums.get(r, (0, 0))[0], size + sums.get(r, (0, 0))[1]
    bases = spark.createDataFrame(base, "range int, rows_before long, bytes_before long").coalesce(1)
    hot_keys = spark.createDataFrame([(k,) for k in hot], "key string").coalesce(1)  # fewer than the cuts
    big = keys.join(F.broadcast(hot_keys), "key").groupBy("key").agg(F.sum("size").alias("whole"))

    one, peers = Window.partitionBy("range").orderBy("key", "doc_id"), Window.partitionBy("range", "key")
    placed = placed.join(F.broadcast(bases), "range").join(F.broadcast(big), "key", "left")
    placed = placed.withColumn("own", F.col("bytes_before") + F.sum("size").over(one.rowsBetween(Window.unboundedPreceding, 0))).withColumn("idx", F.col("rows_before") + F.row_number().over(one) - 1)
    placed = placed.withColumn("last", F.max("own").over(peers)).withColumn("group", F.coalesce("whole", F.sum("size").over(peers)))
    end = F.when(F.col("group") * (shards * tolerance) <= total, F.col("last")).otherwise(F.col("own"))
    placed = placed.withColumn("end", end).withColumn("shard", F.least(F.lit(shards - 1), F.expr(f"(end - 1) * {shards} div {max(total, 1)}").cast("int")))
    placed = stored(placed.select("doc_id", "size", "text_crc32", "shard", "idx"), "placed")
    first = {r.shard: r.first for r in placed.groupBy("shard").agg(F.min("idx").alias("first")).collect()}
    start = F.lit(0).cast("long")
    for s, f in first.items():
        start = F.when(F.col("shard") == s, F.lit(f).cast("long")).otherwise(start)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("idx") - start).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))

