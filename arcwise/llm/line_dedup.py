"""Line dedup by winnowing over line hashes, DataFrame functions only.

Each document is its sequence of lines. Grams of `gram` lines are hashed; of every `window` grams in a row the least
hash is a fingerprint (the rightmost of equals), so any two equal runs of gram + window - 1 lines share one. Every
fingerprint's occurrences meet its first one, in the order of (doc_id, line); each match is extended both ways, line
by line, as far as the next fingerprint can lie (window lines), where that one's own match takes over. The lines
matched are a repeated run: they go from the later place and stay at the first.

Guarantee: of a run of at least gram + window - 1 lines that stands earlier, all goes but for window - 1 lines at
either end. What goes always stands in full at an earlier place. Documents of fewer than `gram` lines stay whole.
With `alone`, each line of that many words, or five times as many characters (for scripts without spaces), also is a
fingerprint by itself: any that stands earlier goes, in documents of one line too. With window 1 every gram is one.
`whole_lines` takes both, so nothing is left of a run of two lines, or of one long line, that stands earlier.

Lines are compared by 60 bits and grams by 64 more, of another hash. A document is known by 128 bits of its doc_id and text.

Nulls: a null text counts as empty, one empty line; a null doc_id comes first. Rows equal in doc_id and text are one
document, deleted from alike. Very common lines or copies in thousands of documents meet one row, never each other.
An empty table gives an empty result. Other columns aren't
read here, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import blocks_join, hash60, text_of

GRAM, WINDOW = 2, 2
ALONE = 20


def _key(doc_id: Column, text: Column) -> Column:
    return F.unhex(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit("\n"), text)))


def _long(line: Column, alone: int) -> Column:
    return (F.length(line) >= 5 * alone) | (F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) >= alone - 1)


def repeated_runs(docs: DataFrame, gram: int = GRAM, window: int = WINDOW, alone: int | None = None) -> DataFrame:
    """row (128 bits of doc_id and text), lo, hi: ranges of line numbers, both ends included, that repeat earlier lines; they may overlap."""
    split = F.split("text", "\n")
    singles = F.filter(F.transform(split, lambda x, i: F.when(_long(x, alone), i)), lambda i: i.isNotNull()) if alone else F.array().cast("array<int>")
    base = text_of(docs, "doc_id", "text").select("doc_id", split.alias("said"), _key(F.col("doc_id"), F.col("text")).alias("row"), F.transform(split, hash60).alias("lines"), singles.alias("singles"))
    base = base.where((F.size("lines") >= gram) | (F.size("singles") > 0)).withColumn("last", F.size("lines") - gram)
    starts = F.when(F.col("last") >= 0, F.sequence(F.lit(0), F.greatest(F.lit(0), F.col("last")))).otherwise(F.array().cast("array<int>"))
    grams = F.transform(starts, lambda i: hash60(F.array_join(F.transform(F.slice("lines", i + 1, gram), lambda h: h.cast("string")), ",")))
    base = base.withColumn("grams", grams)
    least = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.col("last") - window + 1)), lambda j: F.array_min(F.transform(F.slice("grams", j + 1, window), lambda g, i: F.struct(g.alias("fp"), (-(i + j)).alias("back")))))
    found = F.transform(F.when(F.col("last") >= 0, F.array_distinct(least)).otherwise(F.array()), lambda p: F.struct(p["fp"].alias("fp"), p["back"].alias("back"), F.lit(False).alias("single")))
    if alone:  # fingerprints of grams aren't negative
        found = F.concat(found, F.transform("singles", lambda i: F.struct((-1 - F.get("lines", i)).alias("fp"), (-i).alias("back"), F.lit(True).alias("single"))))
    picks = base.select("doc_id", "row", "lines", "said", F.explode(found).alias("p"))
    pos, none = -F.col("p.back"), F.array().cast("array<bigint>")
    picks = picks.select(
        "doc_id", "row", F.col("p.fp").alias("fp"), pos.alias("pos"),
        F.xxhash64(F.array_join(F.slice("said", pos + 1, F.when(F.col("p.single"), 1).otherwise(gram)), "\n")).alias("check"),
        F.when(F.col("p.single"), none).otherwise(F.reverse(F.slice("lines", F.greatest(F.lit(1), pos - window + 2), F.least(pos, F.lit(window - 1))))).alias("left"),
        F.when(F.col("p.single"), none).otherwise(F.slice("lines", pos + gram + 1, window - 1)).alias("right"),
    )
    first = picks.groupBy("fp").agg(F.min(F.struct("doc_id", "row", "pos", "left", "right", "check")).alias("f"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    met = blocks_join(picks, first, "fp", F.struct("row", "pos")).where(F.col("f").isNotNull())
    met = met.where((F.col("check") == F.col("f.check")) & ~((F.col("row") == F.col("f.row")) & (F.col("pos") == F.col("f.pos"))))

    def reach(a: str, b: str) -> Column:
        same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
        return F.aggregate(same, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda s, e: F.struct((s["n"] + (s["on"] & e).cast("int")).alias("n"), (s["on"] & e).alias("on")), lambda s: s["n"])

    lo = F.col("pos") - reach("left", "f.left")
    hi = F.col("pos") + F.when(F.col("fp") < 0, 0).otherwise(gram - 1) + reach("right", "f.right")
    return met.select("row", lo.alias("lo"), hi.alias("hi")).distinct()


def line_dedup(docs: DataFrame, gram: int = GRAM, window: int = WINDOW, counts: bool = False, alone: int | None = None) -> DataFrame:
    """docs with later repeated runs of lines cut from the text; with `counts`, also n_lines and n_removed.

    A document whose lines all repeat has the empty text. Only documents with a cut are changed; the others, null texts
    included, come through as they are.
    """
    runs = repeated_runs(docs, gram, window, alone)
    by = Window.partitionBy("row").orderBy("lo", "hi")
    seen = F.coalesce(F.max("hi").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))
    kept = runs.withColumn("a", seen + 1)  # kept lines before this run: a to lo - 1
    kept = kept.groupBy("row").agg(F.sort_array(F.collect_list(F.when(F.col("lo") > F.col("a"), F.struct("a", (F.col("lo") - F.col("a")).alias("n"))))).alias("keep"), (F.max("hi") + 1).alias("tail"))
    # The columns go by their places, so no name of theirs can clash with ours.
    names = [f"c{k}" for k in range(len(docs.columns))]
    own = docs.toDF(*names)
    doc_id, mine = (F.col(names[docs.columns.index(c)]) for c in ("doc_id", "text"))
    text = F.coalesce(mine, F.lit(""))
    joined = own.withColumn("row", _key(doc_id, text)).join(kept, "row", "left")
    lines = F.split(text, "\n")
    parts = F.flatten(F.transform("keep", lambda s: F.slice(lines, s["a"] + 1, s["n"])))
    left = F.concat(parts, F.slice(lines, F.col("tail") + 1, F.size(lines)))
    out = joined.withColumn("left", F.when(F.col("tail").isNotNull() & mine.isNotNull(), left))
    new = F.when(F.col("left").isNull(), mine).otherwise(F.array_join("left", "\n"))
    columns = [new.alias("text") if c == "text" else F.col(n).alias(c) for c, n in zip(docs.columns, names, strict=True)]
    if counts:
        columns += [F.size(lines).cast("long").alias("n_lines"), F.coalesce(F.size(lines) - F.size("left"), F.lit(0)).cast("long").alias("n_removed")]
    return out.select(*columns)


def whole_lines(docs: DataFrame, counts: bool = False) -> DataFrame:
    """line_dedup that leaves no run of two lines and no long line that stands earlier."""
    return line_dedup(docs, GRAM, 1, counts, ALONE)
