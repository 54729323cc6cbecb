"""Measures on common neighbours. Candidates: sid, pid, oid with further columns, which are kept.

removal: 'as_coded' counts the candidate's own edge, 'effective' leaves the edge (sid, pid, oid) out of sid's side.
No neighbour set is gathered: sizes are degrees, the intersection is a join, so hubs cost rows, never arrays. Where most
subjects are asked with most objects the neighbours of either side meet by the neighbour, which makes a row for each
link that is shared; else each distinct (sid, oid) brings the neighbours of sid.

In all scoring methods a candidate with a null id has a null score, repeated candidates get the same score each, and
an empty table of candidates gives an empty result. A node that the graph doesn't have has no neighbours: with it, and
in an empty graph, Jaccard is null if neither side has any and else 0, the other measures here are 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..graph import KnowledgeGraph

KEYS = ["sid", "pid", "oid"]


def with_ids(candidates: DataFrame) -> DataFrame:
    """The distinct candidate facts, without those that lack an id."""
    return candidates.select(F.col("sid").cast("long").alias("sid"), F.col("pid").cast("int").alias("pid"), F.col("oid").cast("long").alias("oid")).dropna().distinct()


def own_edges(graph: KnowledgeGraph, facts: DataFrame) -> DataFrame:
    """The facts that are edges of the graph."""
    return facts.join(_into(graph, facts).select(F.col("s").alias("sid"), F.col("p").alias("pid"), "oid"), KEYS, "left_semi")


def _into(graph: KnowledgeGraph, facts: DataFrame) -> DataFrame:
    """s, p, oid: the edges into the objects of the facts, which a stored symmetric graph has side by side."""
    return graph.inward().select("s", "p", F.col("o").alias("oid")).join(facts.select("oid").distinct(), "oid", "left_semi")


def dense(facts: DataFrame) -> bool:
    """Whether the facts are about half or more of all (subject, object) pairs. Plans go by it, results don't."""
    n = facts.agg(F.approx_count_distinct("sid"), F.approx_count_distinct("oid"), F.approx_count_distinct(F.xxhash64("sid", "oid"))).first()
    return 2.2 * n[2] >= n[0] * n[1]


def _counted(graph: KnowledgeGraph, facts: DataFrame, removal: str, weight: Column | None = None) -> DataFrame:
    """Facts with ds and do, the numbers of distinct neighbours on either side, and common: the sum of `weight` (of the
    degree d; 1 if None) over common neighbours."""
    if removal not in ("as_coded", "effective"):
        raise ValueError(f"removal must be 'as_coded' or 'effective', not {removal!r}")
    near, pairs = graph.adjacency(), facts.select("sid", "oid").distinct()
    sized = lambda end, name: near.select(F.col("u").alias(end)).join(facts.select(end).distinct(), end, "left_semi").groupBy(end).agg(F.count(F.lit(1)).alias(name))
    if dense(facts):
        here = near.select(F.col("u").alias("sid"), "v").join(facts.select("sid").distinct(), "sid", "left_semi")
        met = here.join(near.select(F.col("u").alias("oid"), "v").join(facts.select("oid").distinct(), "oid", "left_semi"), "v")
    else:
        met = pairs.join(near.select(F.col("u").alias("sid"), "v"), "sid").join(near.select(F.col("u").alias("oid"), "v"), ["oid", "v"])
    if weight is not None:
        met = met.join(graph.degrees().select(F.col("node").alias("v"), "d"), "v")
    each, zero = weight if weight is not None else F.lit(1.0), F.lit(0.0)
    at_end = F.col("v") == F.col("oid")
    common = met.groupBy("sid", "oid").agg(F.sum(F.when(at_end, zero).otherwise(each)).alias("rest"), F.sum(F.when(at_end, each).otherwise(zero)).alias("end"))
    out = facts.join(sized("sid", "ds"), "sid", "left").join(sized("oid", "do"), "oid", "left").join(common, ["sid", "oid"], "left")
    out = out.select(*KEYS, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("ds", "do")], *[F.coalesce(c, zero).alias(c) for c in ("rest", "end")])
    if removal == "effective":  # the own edge matters where it is the only one between the two ends
        single = _into(graph, facts).groupBy(F.col("s").alias("sid"), "oid").agg(F.count(F.lit(1)).alias("m")).where("m = 1")
        lone = own_edges(graph, facts).join(single, ["sid", "oid"], "left_semi").withColumn("lone", F.lit(True))
        out = out.join(lone, KEYS, "left").withColumn("ds", F.col("ds") - F.when(F.col("lone"), 1).otherwise(0)).withColumn("end", F.when(F.col("lone"), zero).otherwise(F.col("end")))
    return out.select(*KEYS, "ds", "do", (F.col("rest") + F.col("end")).alias("common"))


def _scored(candidates: DataFrame, scores: DataFrame) -> DataFrame:
    return candidates.drop("score").join(scores.select(*KEYS, "score"), KEYS, "left")


def jaccard(graph: KnowledgeGraph, candidates: DataFrame, removal: str = "as_coded") -> DataFrame:
    """Common over all neighbours; null if neither side has any."""
    sized = _counted(graph, with_ids(candidates), removal)
    every = F.col("ds") + F.col("do") - F.col("common")
    return _scored(candidates, sized.withColumn("score", F.when(every > 0, F.col("common") / every)))


def adamic_adar(graph: KnowledgeGraph, candidates: DataFrame, removal: str = "as_coded") -> DataFrame:
    """Sum of 1/ln(degree) over common neighbours, 0 without any; a common neighbour of degree 1 gives infinity."""
    weight = F.when(F.col("d") > 1, 1.0 / F.ln(F.col("d").cast("double"))).otherwise(F.lit(float("inf")))
    return _scored(candidates, _counted(graph, with_ids(candidates), removal, weight).withColumnRenamed("common", "score"))


def degree_product(graph: KnowledgeGraph, candidates: DataFrame, removal: str = "as_coded") -> DataFrame:
    sized = _counted(graph, with_ids(candidates), removal)
    return _scored(candidates, sized.withColumn("score", (F.col("ds") * F.col("do")).cast("double")))
