"""Near-duplicate classes by Order MinHash, verified by banded alignment.

A text is the sequence of its five-word shingles (lower-case words of letters and digits; a shorter text is one
shingle). Each shingle is labelled with its occurrence number, and each of ROWS * BANDS hash functions picks the two
least labelled shingles and keeps them in the order of the text, so a sketch value agrees only if content and order
do. ROWS values make a band; documents that share a band are candidates. A pair is a link if a banded alignment of the
two shingle sequences matches at least `similarity` of their union: aligned / (n + m - aligned). Order counts: texts
of the same shingles in another order don't align. A pair whose union matches 0.8 becomes a candidate with a
probability over 0.999.

Texts of equal words are one class before that and are represented by one row. In a band, members meet two leaders, not
each other; those of a component already found drop out. Texts whose bands still hold several components then meet
by exact prefix and position filtering on their labelled shingles, so no link between candidates is lost, and neither
copies nor a family of loosely alike texts make their square.
Components come from alternating large-star and small-star steps on written tables.
Rows of a hot bucket, shingle, leader or component are dealt over blocks, and what they meet goes to each block.

Nulls: a null text counts as empty; texts without words are one class. A null doc_id sorts first and can be a class's
id only if all are null. Rows equal in both get the same class. Empty tables give an empty result. Other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import re
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks_join, small_batches, stored, text_of

WORDS, KEEP, ROWS, BANDS = 5, 2, 3, 32
_WORD = re.compile(r"[^\W_]+")
_RNG = np.random.default_rng(20240229)
_MULT = _RNG.integers(1, 1 << 32, ROWS * BANDS, dtype=np.uint32) | np.uint32(1)
_XOR = _RNG.integers(0, 1 << 32, ROWS * BANDS, dtype=np.uint32)
_MIX = _RNG.integers(1, 1 << 63, WORDS, dtype=np.uint64) | np.uint64(1)


def _stir(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def text_id(words: list[str]) -> bytes:
    return hashlib.md5(" ".join(words).encode("utf-8", "surrogatepass")).digest()


def shingles(words: list[str], known: dict | None = None) -> np.ndarray:
    """64-bit hashes of the five-word shingles in the order of the text; `known` keeps words' hashes."""
    known = {} if known is None else known
    if len(known) > 50_000:
        known.clear()
    ids = np.empty(len(words), np.uint64)
    for i, w in enumerate(words):
        h = known.get(w)
        if h is None:
            h = known[w] = int.from_bytes(hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        ids[i] = h
    n = max(1, len(ids) - WORDS + 1)
    out = np.full(n, len(ids) if len(ids) < WORDS else WORDS, np.uint64)
    for k in range(min(WORDS, len(ids))):
        out = _stir(out + ids[k : k + n] * _MIX[k])
    return out


def labelled_shingles(s: np.ndarray) -> np.ndarray:
    """Hashes of the shingles with their occurrence numbers, in the order of the text."""
    order = np.argsort(s, kind="stable")
    ranked = s[order]
    start = np.r_[True, ranked[1:] != ranked[:-1]]
    first = np.maximum.accumulate(np.where(start, np.arange(len(s)), 0))
    label = np.empty(len(s), np.uint64)
    label[order] = (np.arange(len(s)) - first).astype(np.uint64)
    return _stir(s + label * np.uint64(0x9E3779B97F4A7C15))


def sketch(s: np.ndarray) -> list[int]:
    """BANDS values of ROWS ordered pairs of minimal labelled shingles each; 32 bits do for the order within a text."""
    labelled = labelled_shingles(s)
    short = labelled.astype(np.uint32)
    values = np.empty((ROWS * BANDS, KEEP), np.uint64)
    block = max(1, (1 << 18) // len(s))
    for a in range(0, ROWS * BANDS, block):
        h = (short[None, :] ^ _XOR[a : a + block, None]) * _MULT[a : a + block, None]
        rows = np.arange(len(h))
        one = h.argmin(axis=1)
        h[rows, one] = np.uint32(0xFFFFFFFF)
        two = h.argmin(axis=1) if len(s) > 1 else one
        lo, hi = np.minimum(one, two), np.maximum(one, two)
        values[a : a + block, 0], values[a : a + block, 1] = labelled[lo], labelled[hi]
    v = values.reshape(BANDS, ROWS * KEEP)
    out = np.full(BANDS, 0x51ED270B, np.uint64) + np.arange(BANDS, dtype=np.uint64)
    for k in range(v.shape[1]):
        out = (out ^ v[:, k]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out.astype(np.int64).tolist()


def aligned(a: np.ndarray, b: np.ndarray, similarity: float = 0.8) -> float:
    """aligned / (n + m - aligned) by an alignment within the band that `similarity` allows; 0 if it can't be reached.

    With n + m - 2 * aligned insertions and deletions, only diagonals that near count: the band loses nothing at or
    above the threshold. Rows of the table are bits of one number.
    """
    n, m = len(a), len(b)
    if min(n, m) < similarity * max(n, m):
        return 0.0
    if n == m and np.array_equal(a, b):
        return 1.0
    band = int((n + m) * (1 - similarity) / (1 + similarity))
    common = _multiset_common(a, b)
    if common < similarity * (n + m - common):
        return 0.0
    k = min(n, m)
    differs = np.flatnonzero(a[:k] != b[:k])
    head = int(differs[0]) if len(differs) else k
    k -= head
    differs = np.flatnonzero(a[n - k :][::-1] != b[m - k :][::-1]) if k else ()
    tail = int(differs[0]) if len(differs) else k
    x, y = a[head : n - tail].tolist(), b[head : m - tail].tolist()
    if x and y:
        places: dict[int, int] = {}
        for i, v in enumerate(x):
            places[v] = places.get(v, 0) | 1 << i
        full, row = (1 << len(x)) - 1, (1 << len(x)) - 1
        width = (1 << (2 * band + 1)) - 1
        for j, v in enumerate(y):
            near = places.get(v, 0) & (width << (j - band) if j >= band else width >> (band - j))
            u = row & near
            if u:
                row = (row + u | row - u) & full
        middle = len(x) - row.bit_count()
    else:
        middle = 0
    got = head + tail + middle
    return got / (n + m - got)


def _multiset_common(a: np.ndarray, b: np.ndarray) -> int:
    va, ca = np.unique(a, return_counts=True)
    vb, cb = np.unique(b, return_counts=True)
    _, ia, ib = np.intersect1d(va, vb, assume_unique=True, return_indices=True)
    return int(np.minimum(ca[ia], cb[ib]).sum())


def _sketcher():
    def run(batches):
        known: dict = {}
        for batch in batches:
            ids, keys, sizes, bands = [], [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words_of(text)
                ids.append(doc_id)
                keys.append(text_id(words))
                sizes.append(max(1, len(words) - WORDS + 1))
                bands.append(sketch(shingles(words, known)) if words else [])
            columns = [pa.array(ids, pa.int64()), pa.array(keys, pa.binary()), pa.array(sizes, pa.int32()), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "id", "size", "bands"])

    return run


def _shingler():
    def run(batches):
        known: dict = {}
        for batch in batches:
            ids, blobs = [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words_of(text)
                if key == text_id(words):  # else another text under the same doc_id
                    ids.append(key)
                    blobs.append(shingles(words, known).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.array(blobs, pa.binary())], names=["id", "s"])

    return run


def _verifier(similarity: float):
    def run(batches):
        for batch in batches:
            u, v, x, y = (batch.column(k) for k in range(4))
            keep = [aligned(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64), similarity) >= similarity for p, q in zip(x.to_pylist(), y.to_pylist(), strict=True)]
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([u.filter(mask), v.filter(mask)], names=["u", "v"])

    return run


def components(edges: DataFrame) -> DataFrame:
    """(id, root) of every node of edges(u, v), root the least of its component; alternating star steps on stored tables."""
    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    edges, mark = stored(edges, "edges"), None
    while True:
        # large star: each node's greater neighbours move to its least neighbour
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = blocks_join(both, least, "u", F.col("v")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = stored(large, "large")
        # small star: a node and its lesser neighbours move to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = blocks_join(large, least, "u", F.col("v")).select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        edges = stored(small, "edges")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())
        mark = now


def _labelled():
    """Shingles with their occurrence numbers, one row each."""

    def run(batches):
        for batch in batches:
            for i, root, data in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                toks = labelled_shingles(np.frombuffer(data, np.uint64)).astype(np.int64)
                m = len(toks)
                yield pa.RecordBatch.from_arrays([pa.array([i] * m, pa.binary()), pa.array([root] * m, pa.binary()), pa.array(np.full(m, m, np.int32)), pa.array(toks)], names=["id", "root", "n", "tok"])

    return run


def hot_keys(counted: DataFrame, key: str, count: str, rows: int = 256) -> DataFrame:
    """(key, blocks) of the keys with more than `rows` rows: a block for each `rows` of them."""
    return stored(counted.where(F.col(count) > rows).select(key, F.ceil(F.col(count) / rows).cast("int").alias("blocks")), "hot")


def split_join(left: DataFrame, right: DataFrame, key: str, spread: str, hot: DataFrame) -> DataFrame:
    """left join right by key, the rows that left has of a hot key dealt over its blocks by `spread`; right's rows of it go
    to each block. Keys that aren't hot are moved once, as in a plain join. Spark broadcasts `hot` by its size on disk;
    beyond the threshold it is joined by a shuffle of narrow rows."""
    blocks = F.coalesce("blocks", F.lit(1))
    left = left.join(hot, key, "left").withColumn("_aw_block", F.pmod(F.xxhash64(spread), blocks).cast("int")).drop("blocks")
    right = right.join(hot, key, "left").withColumn("_aw_block", F.explode(F.sequence(F.lit(0), blocks - 1))).drop("blocks")
    return left.join(right, [key, "_aw_block"]).drop("_aw_block")


def _prefix_pairs(nodes: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """(id, other) of all pairs of different root that can reach the similarity, by prefix and position.

    Two sets that do must share one of their (1 - similarity) * n + 1 rarest labelled shingles, and after the first
    one that they share both must have enough left. Shingles of one text only are never shared: a text with so many of
    them that they fill its prefix has no partner, which is what keeps a large family of loosely alike texts apart.
    """
    toks = stored(nodes.join(texts, "id").select("id", "root", "s").mapInArrow(_labelled(), "id binary, root binary, n int, tok long"), "labelled")
    often = stored(toks.groupBy("tok").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "often")
    lists = split_join(toks, often, "tok", "id", hot_keys(often, "tok", "df", 10_000)).groupBy("id", "root", "n").agg(F.sort_array(F.collect_list(F.struct("df", "tok"))).alias("x"))
    alone = F.col("n") - F.size("x")
    prefix = F.col("n") - F.ceil(F.col("n") * similarity - 1e-9).cast("int") + 1
    lists = lists.select("id", "root", "n", alone.alias("alone"), F.posexplode(F.slice("x", 1, F.greatest(F.lit(0), prefix - alone))).alias("k", "y"))
    lists = stored(lists.select("id", "root", "n", (F.col("alone") + F.col("k")).alias("i"), F.col("y.tok").alias("tok")), "prefixes")
    several = lists.groupBy("tok").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("df")).where("lo <> hi").select("tok", "df")
    several = stored(several, "several")
    hot = hot_keys(several, "tok", "df")
    lists = stored(split_join(lists, several.select("tok"), "tok", "id", hot), "prefixes")
    a = lists.select("tok", "id", "root", "n", "i")
    b = lists.select("tok", *[F.col(c).alias(f"{c}2") for c in ("id", "root", "n", "i")])
    share = similarity / (1 + similarity)
    enough = F.least(F.col("n") - F.col("i"), F.col("n2") - F.col("i2")) >= (F.col("n") + F.col("n2")) * share - 1e-9
    near = F.least("n", "n2") >= F.greatest("n", "n2") * similarity - 1e-9
    return split_join(a, b, "tok", "id", hot).where((F.col("root") < F.col("root2")) & enough & near).select("id", F.col("id2").alias("other")).distinct()


def near_duplicates(docs: DataFrame, similarity: float = 0.8, rounds: int = 1) -> DataFrame:
    """doc_id, class_id (least doc_id of the class), class_size, kept (doc_id is class_id) for every row."""
    with small_batches(docs.sparkSession):
        return _classes(docs, similarity, rounds)


def _classes(docs: DataFrame, similarity: float, rounds: int) -> DataFrame:
    rows = text_of(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # The MD5 of its words stands for a text.
    made = stored(rows.mapInArrow(_sketcher(), "doc_id long, id binary, size int, bands array<long>"), "sketches")
    unlike = made.groupBy("id").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n"), F.max("size").alias("size"), F.max("bands").alias("bands"))
    members = stored(unlike.where(F.size("bands") > 0).select("id", "n", "size", F.posexplode("bands").alias("band", "value")).select("id", "n", "size", F.xxhash64("band", "value").alias("bucket")), "bands")
    shared = stored(members.groupBy("bucket").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1"), "shared")
    hot = hot_keys(shared, "bucket", "rows")
    members = stored(split_join(members, shared.select("bucket"), "bucket", "id", hot), "members")

    # The texts that may be linked, as shingles, once.
    wanted = members.select("id").distinct().join(unlike.select("id", "rep"), "id")
    texts = rows.join(wanted, rows.doc_id.eqNullSafe(wanted.rep)).select("id", "text")
    texts = stored(texts.mapInArrow(_shingler(), "id binary, s binary").dropDuplicates(["id"]), "shingles")

    def linked(pairs: DataFrame) -> DataFrame:
        # A leader may be in a third of all pairs: each 256 of them get the leader's shingles in a task of their own.
        ends = []
        for end, other, name in (("u", "v", "x"), ("v", "u", "y")):
            hot = hot_keys(pairs.select(end).groupBy(end).agg(F.count(F.lit(1)).alias("rows")), end, "rows")
            ends.append((texts.select(F.col("id").alias(end), F.col("s").alias(name)), end, other, hot))
        return reduce(lambda got, right: split_join(got, *right), ends, pairs).select("u", "v", "x", "y").mapInArrow(_verifier(similarity), "u binary, v binary")

    spark = docs.sparkSession
    links = spark.createDataFrame([], "u binary, v binary")
    tried = links
    roots = None
    for turn in range(rounds + 1):
        state = members if roots is None else members.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
        if roots is None:
            state = state.withColumn("root", F.col("id"))
        else:  # buckets of several components
            open_ = state.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("bucket")
            state = split_join(state, open_, "bucket", "id", hot)
        state = stored(state, "state")
        if turn < rounds:
            # Each member meets two leaders of the bucket: the text with the most copies, and one drawn by hash.
            rank = F.struct(F.xxhash64("id", F.lit(turn)).alias("r"), "id", "root", "size")
            lead = state.groupBy("bucket").agg(F.array(F.max_by(rank, F.struct("n", "id")), F.min(rank)).alias("two"))
            pairs = split_join(state, lead, "bucket", "id", hot).select("id", "root", "size", F.explode("two").alias("l"))
            near = F.least("size", "l.size") >= F.greatest("size", "l.size") * similarity
            pairs = pairs.where((F.col("id") != F.col("l.id")) & (F.col("root") != F.col("l.root")) & near).select("id", F.col("l.id").alias("other"))
        else:
            # The exact rest, among texts whose buckets hold several components.
            pairs = _prefix_pairs(state.select("id", "root").distinct(), texts, similarity)
        pairs = pairs.select(F.greatest("id", "other").alias("u"), F.least("id", "other").alias("v")).distinct()
        pairs = stored(pairs.join(tried, ["u", "v"], "left_anti") if turn else pairs, "pairs")
        if pairs.isEmpty():
            break
        new = stored(linked(pairs), "links")
        tried = tried.unionByName(pairs)
        if not new.isEmpty():
            links = links.unionByName(new)
            roots = components(links)
    classes = unlike.select("id", "rep", "n")
    if roots is None:
        classes = classes.withColumn("root", F.col("id"))
    else:
        classes = classes.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    classes = stored(classes, "classes")
    named = classes.groupBy("root").agg(F.min("rep").alias("class_id"), F.sum("n").alias("class_size"))
    named = blocks_join(classes.select("id", "root"), named, "root", F.col("id")).select("id", "class_id", "class_size")
    out = blocks_join(made.select("doc_id", "id"), named, "id", F.col("doc_id"))
    return out.select("doc_id", "class_id", "class_size", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))
