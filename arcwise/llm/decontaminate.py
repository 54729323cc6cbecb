"""Benchmark decontamination by spaced-seed hashing, DataFrame functions only.

Texts become lower-case tokens of letters and digits. Fixed masks over a span of positions ignore some of them; the
hashes of what is left are joined between benchmark items and documents, so substituted tokens don't hide a passage.
Around each hit the item is laid over the document at the hit's offset, and the best stretch is scored: +1 a matching
token, -2 a substituted one. A document holds an item if that score reaches min(12, 0.7 of the item's tokens, rounded up).

Items of `SHORT` tokens and more have the masks `MASKS`. A shorter item has one seed without gaps, as long as the run of
matches that every overlap of such an item must hold to reach its score (`core`), so none is missed. Items under
`min_tokens` tokens would match ordinary prose: a document holds one only if it has the same tokens and no others.

Nulls: a null text counts as empty and has no overlap; items without tokens are left out. Repeated rows, and rows that
share a doc_id, are judged each by their own text. An empty table or benchmark gives no overlaps. Other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, text_of

#: 1 counts, 0 is ignored.
MASKS = ("1101101101", "1110011011", "1011110101")
SPAN = 10
PIECE, LONGEST = 512, 512
SHORT = 14


def tokens(text: Column) -> Column:
    """Hashes of the lower-case tokens of letters and digits."""
    words = F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def needed(length: int) -> int:
    """The score that an item of so many tokens must reach."""
    return min(12, -(-length * 7 // 10))


def core(length: int) -> int:
    """The longest run of matches that every overlap of an item of `length` tokens that reaches its score has at least."""
    least = length
    for bits in product((1, -2), repeat=length):
        run = best = 0
        for b in bits:
            run = max(0, run + b)
            best = max(best, run)
        if best >= needed(length):
            least = min(least, max(map(len, "".join("x" if b > 0 else " " for b in bits).split())))
    return least


def _seed(mask: str, number: int) -> Column:
    at = [F.get("toks", F.col("pos") + k) for k, bit in enumerate(mask) if bit == "1"]
    return F.xxhash64(F.lit(number), *at)


def _whole(toks: str) -> Column:
    return F.xxhash64(F.lit(-1), toks)


def _again(masks: list[tuple[str, int]], before: Column) -> Column:
    """Whether a hit has a lesser one on its diagonal, which has the same overlap: of the same mask one token before
    (`before`: that token is looked at), or of an earlier mask at the same place. The least of a diagonal never has."""

    def same(mask: str, back: int) -> Column:
        at = [F.get("toks", F.col("pos") + (j - back)) == F.get("item", F.col("ipos") + (j - back)) for j, bit in enumerate(mask) if bit == "1"]
        return F.coalesce(reduce(Column.__and__, at), F.lit(False))

    out = F.lit(False)
    for n, (mask, k) in enumerate(masks):
        lesser = before & (F.col("ipos") > 0) & same(mask, 1)
        for other, j in masks[:n]:
            if j < len(MASKS) and k < len(MASKS):
                lesser = lesser | same(other, 0)
        out = F.when(F.col("mask") == k, lesser).otherwise(out)
    return out


def overlaps(docs: DataFrame, benchmark: DataFrame, min_tokens: int = 5, broadcast_seeds: int = 200_000) -> DataFrame:
    """doc_id, item_id, score, matched, item_tokens, doc_pos: the best overlap of each document and item that reach the threshold.

    Seeds of the benchmark are broadcast if they are `broadcast_seeds` at most (counted first), else joined by a shuffle.
    """
    return found_overlaps(docs, benchmark, min_tokens, broadcast_seeds).drop("digest")


def found_overlaps(docs: DataFrame, benchmark: DataFrame, min_tokens: int = 5, broadcast_seeds: int = 200_000) -> DataFrame:
    """overlaps with the digest of the document's text: a row for each doc_id, text and item."""
    items = text_of(benchmark, "item_id", "text").select("item_id", tokens(F.col("text")).alias("toks")).where(F.size("toks") > 0)
    items = stored(items, "items")
    lengths = sorted(r[0] for r in items.where(F.size("toks") < max(min_tokens, SHORT)).select(F.size("toks")).distinct().collect())  # under SHORT values
    tiny = any(n < min_tokens for n in lengths)
    cores: dict[int, list[int]] = {}
    for n in lengths:
        if min_tokens <= n < SHORT:
            cores.setdefault(core(n), []).append(n)
    masks = [(m, k, F.size("toks") >= SHORT) for k, m in enumerate(MASKS)] + [("1" * n, 100 + n, F.size("toks").isin(of)) for n, of in cores.items()]
    parts = []
    for mask, k, takes in masks:
        part = items.where(takes).select("item_id", "toks", F.explode(F.sequence(F.lit(0), F.size("toks") - len(mask))).alias("pos"))
        parts.append(part.select("item_id", F.col("toks").alias("item"), F.col("pos").alias("ipos"), F.lit(k).alias("mask"), _seed(mask, k).alias("seed")))
    if tiny:  # one seed of all tokens
        parts.append(items.where(F.size("toks") < min_tokens).select("item_id", F.col("toks").alias("item"), F.lit(0).alias("ipos"), F.lit(-1).alias("mask"), _whole("toks").alias("seed")))
    item_seeds = reduce(DataFrame.unionByName, parts)
    longest = items.agg(F.max(F.size("toks"))).first()[0] or 0
    small = longest <= LONGEST and item_seeds.limit(broadcast_seeds + 1).count() <= broadcast_seeds

    # Documents go in pieces of PIECE tokens with what an item may need on either side: a row stays small, however long the text.
    side = max(SHORT, longest) if small else SHORT
    # A text is split once: a filter on its tokens, or a second branch of the plan, would split all texts again.
    keyed = text_of(docs, "doc_id", "text").select("doc_id", F.md5("text").alias("digest"), tokens(F.col("text")).alias("all"))
    cut = F.transform(F.sequence(F.lit(0), F.size("all") - 1, F.lit(PIECE)), lambda i: F.struct(i.alias("at"), F.greatest(F.lit(0), i - side).alias("from"), F.slice("all", F.greatest(F.lit(0), i - side) + 1, F.least(i, F.lit(side)) + PIECE + side).alias("toks")))
    short = F.when(F.size("all") < min_tokens, _whole("all")) if tiny else F.lit(None).cast("long")
    pieces = keyed.select("doc_id", "digest", short.alias("short"), F.explode(F.when(F.size("all") > 0, cut)).alias("c")).select("doc_id", "digest", "short", F.col("c.at").alias("at"), F.col("c.from").alias("from"), F.col("c.toks").alias("toks"))
    here = F.col("at") - F.col("from")
    walked = pieces.select("doc_id", "digest", "short", "at", "from", "toks", F.explode(F.sequence(here, F.least(here + PIECE, F.size("toks")) - 1)).alias("pos"))
    seeds = [F.when(F.col("pos") + len(m) <= F.size("toks"), _seed(m, k)) for m, k, _ in masks]
    each = F.array(*seeds, *([F.when(F.col("pos") == 0, F.col("short"))] if tiny else []))
    if small:
        hits = walked.select("doc_id", "digest", "at", "from", "toks", "pos", F.explode(each).alias("seed")).join(F.broadcast(item_seeds), "seed")
        hits = hits.select("doc_id", "digest", "item_id", "item", "ipos", "pos", "from", "toks", F.explode(F.when(~_again([(m, k) for m, k, _ in masks], F.col("pos") > here), F.array(F.lit(0)))).alias("least"))
    else:  # positions travel without the tokens, and only documents with hits bring theirs
        found = walked.select("doc_id", "digest", (F.col("from") + F.col("pos")).alias("at"), F.explode(each).alias("seed")).join(item_seeds, "seed")
        found = found.select("doc_id", "digest", "item_id", "item", (F.col("at") - F.col("ipos")).alias("offset")).distinct()
        hits = found.join(keyed.dropDuplicates(["doc_id", "digest"]).select(F.col("doc_id").alias("d"), F.col("digest").alias("g"), "all"), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("digest") == F.col("g")))
        hits = hits.select("doc_id", "digest", "item_id", "item", F.lit(0).alias("from"), F.col("offset").alias("pos"), F.lit(0).alias("ipos"), F.col("all").alias("toks"))
    # The item laid over the document: element k of the item against element offset + k of the document.
    first = F.greatest(F.lit(0), F.col("ipos") - F.col("pos"))
    start = F.greatest(F.lit(0), F.col("pos") - F.col("ipos"))
    laid = hits.select("doc_id", "digest", "item_id", F.size("item").alias("item_tokens"), (F.col("from") + F.col("pos") - F.col("ipos")).alias("doc_pos"), F.slice("item", first + 1, F.size("item")).alias("a"), F.slice("toks", start + 1, F.size("item") - first).alias("b"))
    equal = F.zip_with("a", "b", lambda x, y: F.when(x == y, F.lit(1)).otherwise(F.lit(-2)))
    zero = F.struct(F.lit(0).alias("run"), F.lit(0).alias("best"), F.lit(0).alias("matched"), F.lit(0).alias("top"))

    def stretch(s: Column, x: Column) -> Column:
        run = F.greatest(F.lit(0), s["run"] + x)
        matched = F.when(run > 0, s["matched"] + (x > 0).cast("int")).otherwise(F.lit(0))
        better = run > s["best"]
        return F.struct(run.alias("run"), F.when(better, run).otherwise(s["best"]).alias("best"), matched.alias("matched"), F.when(better, matched).otherwise(s["top"]).alias("top"))

    # Exploded, since else Spark makes the score a condition of the join, which then isn't compiled and copies each seed's tokens.
    scored = laid.select("doc_id", "digest", "item_id", "item_tokens", "doc_pos", F.explode(F.array(F.aggregate(equal, zero, stretch))).alias("s"))
    need = F.least(F.lit(12), F.floor((F.col("item_tokens") * 7 + 9) / 10))
    scored = scored.where(F.col("s.best") >= need).select("doc_id", "digest", "item_id", "item_tokens", "doc_pos", "s.best", "s.top")
    best = F.max(F.struct(F.col("best").alias("score"), (-F.col("doc_pos")).alias("back"), F.col("top").alias("matched"), "item_tokens")).alias("m")
    best = scored.groupBy("doc_id", "digest", "item_id").agg(best)
    return best.select("doc_id", "digest", "item_id", F.col("m.score").alias("score"), F.col("m.matched").alias("matched"), F.col("m.item_tokens").alias("item_tokens"), (-F.col("m.back")).alias("doc_pos"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """docs without those that hold a benchmark item; all columns stay. A row goes by its own doc_id and text, so another
    row of the same doc_id, or one without any, stays unless its text holds an item too.

    What goes is stored first: Spark broadcasts it if its files are under the session's threshold, so that no text is
    shuffled, and else joins by a shuffle."""
    bad = found_overlaps(docs, benchmark, **options).select(F.col("doc_id").alias("_aw_bad"), F.col("digest").alias("_aw_text")).distinct()
    bad = stored(bad, "contaminated")
    own = F.md5(F.coalesce(docs["text"], F.lit("")))
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["_aw_bad"]) & (own == bad["_aw_text"]), "left_anti")
