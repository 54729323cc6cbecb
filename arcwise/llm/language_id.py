"""Multilingual language identification: a mixture of languages for each document by expectation-maximisation.

Trained on labelled texts: counts of letter trigrams (lower case, anything but letters is a word boundary) over all
rows, hashed into BUCKETS, give each language a smoothed distribution. A document's trigrams are taken as drawn from a
mixture of languages; EM estimates the proportions. Languages enter in the order of their proportions, and the set
with the best likelihood less a penalty of `penalty` * ln(trigrams) for each further language is kept. The answer is
the language with the largest proportion in that set, the score its proportion.

Nulls: a text that is null or has no letters is `und`, score 0. Rows with a null lang don't train; without any
labelled row all is `und`. Equal texts get equal answers. An empty table gives an empty result. Long texts are taken
whole, in bounded blocks of documents. Other columns aren't read.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches

BUCKETS = 1 << 17
BLOCK_CHARS = 1 << 21
UNDETERMINED = "und"


@cache
def _letters() -> np.ndarray:
    """Whether a code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _blocks(texts: list):
    """Documents in runs of at most BLOCK_CHARS characters, or one longer document."""
    at, size = 0, 0
    for k, t in enumerate(texts):
        n = len(t or "")
        if k > at and size + n > BLOCK_CHARS:
            yield at, texts[at:k]
            at, size = k, 0
        size += n
    if at < len(texts):
        yield at, texts[at:]


def trigrams(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each trigram, its document): trigrams around letters, with one boundary at a word's either end."""
    lowered = [(t or "").lower() for t in texts]
    joined = "\0" + "".join([t + "\0\0" for t in lowered])
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) + 2 for t in lowered])
    letter = _letters()[code]
    code = np.where(letter, code, np.uint32(32))
    middle = letter[1:-1]  # a trigram for each letter: it and its neighbours
    a, b, c = code[:-2][middle], code[1:-1][middle], code[2:][middle]
    h = a * np.uint32(0x9E3779B1) ^ b * np.uint32(0x85EBCA77) + c * np.uint32(0xC2B2AE3D)
    h ^= h >> np.uint32(15)
    h = h * np.uint32(0x2C1B3C6D)
    return (h >> np.uint32(15)).astype(np.int64), owner[: len(code) - 2][middle]


def train(docs: DataFrame, usable: Column | None = None) -> dict:
    """{'languages': [...], 'logp': float32 array of languages x BUCKETS}: a fixed size for each language label."""
    bound_batches(docs.sparkSession)
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.lit(True) if usable is None else usable)).select("lang", "text")

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for at, block in _blocks(texts):
                gram, owner = trigrams(block)
                names, code = np.unique(np.array(langs[at : at + len(block)], dtype=object).astype(str), return_inverse=True)
                part = np.bincount(code[owner] * BUCKETS + gram, minlength=len(names) * BUCKETS).reshape(-1, BUCKETS)
                for name, row in zip(names.tolist(), part, strict=True):
                    sums[name] = sums[name] + row if name in sums else row.copy()
        for name, row in sums.items():
            used = np.flatnonzero(row)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(used), pa.string()), pa.array(used, pa.int32()), pa.array(row[used], pa.int64())], names=["lang", "bucket", "n"])

    counts = rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    grouped = counts.groupBy("lang").agg(F.collect_list("bucket").alias("buckets"), F.collect_list("n").alias("ns")).orderBy("lang").collect()
    logp = np.zeros((len(grouped), BUCKETS), np.float32)
    for k, r in enumerate(grouped):
        n = np.full(BUCKETS, 0.1)
        n[r.buckets] += r.ns
        logp[k] = np.log(n / n.sum())
    return {"languages": [r.lang for r in grouped], "logp": logp}


def _em(p: np.ndarray, n: np.ndarray, steps: int = 40, tolerance: float = 1e-4) -> tuple[np.ndarray, float]:
    """Proportions and log-likelihood for likelihoods p (languages x trigrams) with counts n."""
    k, total = len(p), n.sum()
    if k == 1:
        return np.ones(1), float(n @ np.log(p[0]))
    w = np.full(k, 1 / k)
    for _ in range(steps):
        mixed = w @ p
        new = w * (p @ (n / mixed)) / total
        if np.abs(new - w).max() < tolerance:
            w = new
            break
        w = new
    return w, float(n @ np.log(w @ p))


def mixture(gram: np.ndarray, model: dict, penalty: float = 2.0) -> tuple[list[tuple[str, float]], float]:
    """[(language, proportion)], largest first, of one document's trigrams, and the log-likelihood."""
    if len(gram) < 8192:
        used, n = np.unique(gram, return_counts=True)
    else:
        n = np.bincount(gram)
        used = np.flatnonzero(n)
        n = n[used]
    n = n.astype(np.float64)
    logp = model["logp"][:, used].astype(np.float64)
    top = logp.max(axis=0)
    p, shift = np.exp(logp - top), float(n @ top)
    single = (logp @ n).argmax()
    cost = penalty * np.log(max(2.0, n.sum()))
    names = model["languages"]
    best = ([(names[single], 1.0)], _em(p[[single]], n)[1])
    # No mixture gains more than taking each trigram's best language: then nothing else can pay.
    if len(names) > 1 and -best[1] > cost:
        full, top_like = _em(p, n)
        if top_like - best[1] > cost:
            order = np.argsort(-full, kind="stable")
            score = best[1]
            for k in range(2, len(names) + 1):
                chosen = order[:k]
                if full[order[k - 1]] < 1e-6 or top_like - (k - 1) * cost <= score:
                    break  # a language without a share, or sets that cost more than any can gain
                w, like = _em(p[chosen], n)
                if like - (k - 1) * cost > score:
                    score = like - (k - 1) * cost
                    best = (sorted(((names[i], float(x)) for i, x in zip(chosen, w, strict=True)), key=lambda x: (-x[1], x[0])), like)
    return best[0], best[1] + shift


def predict(docs: DataFrame, model: dict, carry: list[str], penalty: float = 2.0, keep: float | None = None) -> DataFrame:
    """The carried columns with lang_pred, score, languages (name and proportion of each in the mixture).

    With `keep`, the carried columns alone, of the rows with a language that has such a score.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    kept = [F.col(f"`{c}`") for c in carry]
    names = [f"c{k}" for k in range(len(carry))]
    at_text = carry.index("text") if "text" in carry else len(carry)
    source = docs.select(*[c.alias(n) for c, n in zip(kept, names, strict=True)], *([F.col("text").alias("_aw_text")] if at_text == len(carry) else []))

    def run(batches):
        m = shared.value
        for batch in batches:
            texts = batch.column(at_text).to_pylist()
            found = [[] for _ in texts]
            for at, block in _blocks(texts) if m["languages"] else ():
                gram, owner = trigrams(block)
                ends = np.searchsorted(owner, np.arange(len(block) + 1))
                for k in range(len(block)):
                    if ends[k + 1] > ends[k]:
                        found[at + k] = mixture(gram[ends[k] : ends[k + 1]], m, penalty)[0]
            types = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))
            made = [pa.array([f[0][0] if f else UNDETERMINED for f in found], pa.string()), pa.array([min(1.0, f[0][1]) if f else 0.0 for f in found], pa.float64()), pa.array([[{"lang": x, "share": y} for x, y in f] for f in found], types)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(names))), *made], names=[*names, "lang_pred", "score", "languages"])

    schema = ", ".join([*(f"{n} {source.schema[n].dataType.simpleString()}" for n in names), "lang_pred string, score double, languages array<struct<lang:string,share:double>>"])
    out = source.mapInArrow(run, schema)
    carried = [F.col(n).alias(c) for n, c in zip(names, carry, strict=True)]
    if keep is not None:
        return out.where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= keep)).select(*carried)
    return out.select(*carried, "lang_pred", "score", "languages")


def held_out(doc_id: Column) -> Column:
    """crc32 of doc_id as text, mod 4, is 2; a null doc_id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def language_id(docs: DataFrame, penalty: float = 2.0) -> DataFrame:
    """doc_id, held_out, lang_pred, score, languages; learns from the rows that aren't held out."""
    model = train(docs, ~held_out(F.col("doc_id")))
    out = predict(docs, model, ["doc_id"], penalty)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "languages")


def keep_identified(docs: DataFrame, least: float = 0.4, penalty: float = 2.0) -> DataFrame:
    """docs without those that are `und` or in which no language has `least` of the letters; all columns stay."""
    model = train(docs, ~held_out(F.col("doc_id")))
    return predict(docs, model, docs.columns, penalty, keep=least)
