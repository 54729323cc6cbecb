"""URL rules by a sort-merge range join on reversed-host canonical keys.

A host's labels, reversed and each closed by a dot, make a host and its subdomains one interval of keys: `net.` up to
`net/`. Sampled splitters cut the key space (host, path, page_id) into ranges; rules go to every range their interval
meets, urls to one. Each task sorts its range and sweeps it once: rules open and close on a stack, nested as their
hosts are, and a url asks the open rules, innermost first, whose path its own starts with. The longest rule (host and
path together; of equals the longer host, then the lesser text) decides.

A hot host is cut by path and page_id like any other range. Memory of a task: the open rules and one batch.
Nulls: a null url, or one without `://`, has empty host and path and no rule; a null page_id sorts first. Rules with a
null host, path or verdict are left out. Repeated rules count once. Empty tables give an empty result or no matches.
Other columns are ignored.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import partitions

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first `://` up to / ? # or the end, A-Z lower-cased; empty without it."""
    rest = F.when(F.instr(url, "://") > 0, F.substring_index(F.substring_index(F.substring_index(_rest(url), "/", 1), "?", 1), "#", 1))
    return F.coalesce(F.translate(rest, UPPER, LOWER), F.lit(""))


def _rest(url: Column) -> Column:
    return F.substr(url, F.instr(url, "://") + 3)


def path_of(url: Column) -> Column:
    """What follows the host up to ? # or the end."""
    rest = F.substring_index(F.substring_index(_rest(url), "?", 1), "#", 1)
    return F.coalesce(F.when((F.instr(url, "://") > 0) & (F.instr(rest, "/") > 0), F.substr(rest, F.instr(rest, "/"))), F.lit(""))


def host_key(host: Column) -> Column:
    """`a.b.net` -> `net.b.a.`; subdomains of a host are the keys that start with its own."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


_OUT = "page_id long, host string, path string, rule string, verdict string"
_ROW = "part int, key string, kind int, path string, page_id long, host string, rule string, verdict string"


def _sweep(default: str):
    names = ["page_id", "host", "path", "rule", "verdict"]

    def run(batches):
        part, stack = None, []  # open rules: (end of the interval, size for the choice, path, rule, verdict), inner hosts last
        for batch in batches:
            out = {n: [] for n in names}
            cols = [batch.column(k).to_pylist() for k in range(8)]
            for p, key, kind, path, page_id, host, rule, verdict in zip(*cols, strict=True):
                if p != part:
                    part, stack = p, []
                while stack and not key.startswith(stack[-1][0]):
                    stack.pop()
                if kind == 0:
                    stack.append((key, (len(host) + len(path), len(host)), path, rule, verdict))
                    continue
                best = None
                for _, size, prefix, r, v in stack:
                    if path.startswith(prefix) and (best is None or size > best[0] or size == best[0] and r < best[1]):
                        best = (size, r, v)
                for n, value in zip(names, (page_id, host, path, best and best[1], best[2] if best else default), strict=True):
                    out[n].append(value)
            types = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types, strict=True)], names=names)

    return run


def url_filter(pages: DataFrame, rules: DataFrame, default: str = "allow", per_range: int = 40) -> DataFrame:
    """page_id, host, path, rule (host + path; null without one), verdict.

    rules: host, path (starting with /), verdict. About ranges * per_range sampled keys reach the driver.
    """
    spark = pages.sparkSession
    ranges = max(8, 2 * partitions(spark))
    urls = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    urls = urls.withColumn("key", F.when(F.col("host") == "", F.lit("")).otherwise(host_key(F.col("host"))))
    count = urls.count()
    dice = F.pmod(F.xxhash64("key", "path", "page_id", F.lit(5)), F.lit(1 << 30)) < F.lit(int(min(1.0, ranges * per_range / max(1, count)) * (1 << 30)))
    low = F.coalesce(F.col("page_id"), F.lit(-(1 << 63)).cast("long"))
    sample = sorted(tuple(r) for r in urls.where(dice).select("key", "path", low.alias("id")).collect())
    step = max(1, len(sample) // ranges)
    cuts = sorted(set(sample[step::step]))

    @F.pandas_udf("int")
    def range_of(key, path, ident):
        from bisect import bisect_right

        import pandas as pd

        return pd.Series([bisect_right(cuts, k) for k in zip(key, path, ident, strict=True)], dtype="int32")

    @F.pandas_udf("array<int>")
    def ranges_of(key):
        from bisect import bisect_left, bisect_right

        import pandas as pd

        # of the first place of the interval, and of the last
        return pd.Series([list(range(bisect_right(cuts, (k, "", -(1 << 63))), bisect_left(cuts, (k[:-1] + "/",)) + 1)) for k in key])

    urls = urls.select(range_of("key", "path", low).alias("part"), "key", F.lit(1).alias("kind"), "path", "page_id", "host", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"))
    laws = rules.select(F.translate("host", UPPER, LOWER).alias("host"), "path", "verdict").dropna().distinct().withColumn("key", host_key(F.col("host")))
    laws = laws.select(F.explode(ranges_of("key")).alias("part"), "key", F.lit(0).alias("kind"), "path", F.lit(None).cast("long").alias("page_id"), "host", F.concat("host", "path").alias("rule"), "verdict")
    both = urls.unionByName(laws).repartition(partitions(spark), "part").sortWithinPartitions("part", "key", "kind", F.length("path"))
    return both.mapInArrow(_sweep(default), _OUT)
