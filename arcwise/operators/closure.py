"""Best path between the ends of a fact, for all facts at once.

The score of a path combines its edges' weights w by ab/(a + b - ab). That is additive in 1/w - 1, so the best path is
a shortest path with these costs and its score is 1/(1 + cost); 'ultrametric' takes the least weight instead.

Costs are held in whole billionths: equal paths are equal in whatever order they are summed. Ties go to the path of
fewest edges, then, from the subject on, to the least (next node, relation). A path that costs over 18 million, a score
under 1e-7, counts as none. There is no bound on a path's length.

Nulls and repeated candidates: as for the neighbourhood measures. An unknown node can't be reached: score 0, path
[oid], rpath [-1]; with sid = oid the score is 1 and the path [sid], whether the graph has the node or not.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import degree_weight
from ..graph import KnowledgeGraph
from ..storage import stored
from .neighborhood import KEYS, _into, own_edges, with_ids
from .search import NODE, Search
from .wide import groups_of, least_costs

_UNIT, _HOP, _MOST = 1_000_000_000, 256, 1.8e7


def _units(widest: bool) -> Callable:
    """The costs of weights, as closure has them."""

    def units(w: np.ndarray) -> np.ndarray:
        whole = np.floor(np.maximum(0.0, 1.0 / w - 1.0) * _UNIT + 0.5).astype(np.int64)
        return whole if widest else whole * _HOP + 1

    return units


def closure(graph: KnowledgeGraph, candidates: DataFrame, relsim: DataFrame | None = None, kind: str = "metric", weight: str = "logdegree", free_last_hop: bool | None = None, removal: str = "effective", paths: bool = True) -> DataFrame:
    """candidates with score and, with `paths`, path, rpath (leading -1), weights (of the edges, from the subject on).

    relsim (r1, r2, sim) multiplies an edge's weight by its similarity to the fact's predicate. free_last_hop (by
    default if relsim is given) takes the target's degree out of the last edge's weight. Edges of weight 0, null or NaN
    can't be used.
    """
    if kind not in ("metric", "ultrametric"):
        raise ValueError(f"kind must be 'metric' or 'ultrametric', not {kind!r}")
    free = relsim is not None if free_last_hop is None else free_last_hop
    widest = kind == "ultrametric"
    facts = stored(with_ids(candidates), "facts")
    apart = facts.where("sid <> oid")
    own = stored(own_edges(graph, apart), "own") if removal == "effective" else apart.limit(0)
    sims, top = None, 1.0
    if relsim is not None:
        sims = F.broadcast(stored(relsim.select(F.col("r1").alias("pid"), F.col("r2").alias("p"), "sim").where(~F.isnan("sim") & (F.col("sim") > 0)), "sims"))  # relations by relations
        top = max(1.0, sims.agg(F.max("sim")).first()[0] or 0.0)

    def cost(w):
        units = F.floor(F.greatest(F.lit(0.0), 1.0 / w - 1.0) * _UNIT + 0.5)  # round() of doubles goes through decimals
        return units if widest else units * _HOP + 1

    spec = degree_weight(F.col("d"), weight)

    def arcs_of(edges: DataFrame) -> DataFrame:
        rows = edges.join(graph.degrees(), F.col("o") == F.col("node")).select("s", "p", "o", spec.alias("spec"))
        return stored(rows.withColumn("low", cost(F.col("spec") * top)), "arcs")

    def priced(rows: DataFrame, with_spec: bool) -> DataFrame:
        if sims is not None:
            rows = rows.join(sims, ["pid", "p"])
        w = F.col("spec") if with_spec else F.lit(1.0)
        rows = rows.withColumn("w", w * F.col("sim") if sims is not None else w)
        return rows.where(F.col("w") > 1.0 / _MOST).withColumn("c", cost(F.col("w")))

    def search_of(arcs: DataFrame) -> Search:
        return Search(arcs, apart, own, lambda rows: priced(rows, True), lambda rows: priced(rows, not free), widest)

    groups = None if paths and widest else groups_of(apart)
    if groups is not None:
        near = arcs_of(_into(graph, apart).withColumnRenamed("oid", "o"))
        starts = search_of(near).last_arcs(paths)
        if not paths:
            starts = starts.groupBy(*NODE, "tag").agg(F.min("d").alias("d"))
        specs = graph.out_degrees().select("node").join(graph.degrees(), "node", "left").select("node", spec.alias("spec"))
        prices = None
        if sims is not None:
            prices = {}
            for r in sims.collect():  # relations by relations
                prices.setdefault(r.pid, {})[r.p] = r.sim
        found = least_costs(graph, specs, apart, starts, groups, prices, _units(widest), _MOST, widest, paths or not own.isEmpty(), paths)
    else:
        search = search_of(arcs_of(graph.edges))
        labels = search.costs()
        seconds = None if own.isEmpty() else search.second_costs(labels)
        best = stored(search.best(labels, seconds), "best")
        found = best
        if paths:
            traced = search.widest_paths(best) if widest else search.paths(best, labels, seconds)
            if traced is None:  # no fact has a path
                traced = best.limit(0).select(*KEYS, F.array("sid").alias("path"), F.array("pid").alias("rpath"), F.array().cast("array<double>").alias("weights"))
            found = best.join(traced, KEYS, "left")
    found = facts.join(found, KEYS, "left")
    units = F.col("best") if widest else F.floor(F.col("best") / _HOP)
    same = F.col("sid") == F.col("oid")
    score = F.when(same, F.lit(1.0)).when(F.col("best").isNull(), F.lit(0.0)).otherwise(1.0 / (1.0 + units / F.lit(float(_UNIT))))
    columns = [score.alias("score")]
    if paths:
        columns += [F.coalesce("path", F.array("oid")).alias("path"), F.coalesce("rpath", F.array(F.lit(-1))).alias("rpath"), F.coalesce("weights", F.array().cast("array<double>")).alias("weights")]
    return candidates.drop("score", "path", "rpath", "weights").join(found.select(*KEYS, *columns), KEYS, "left")


def klinker(graph: KnowledgeGraph, candidates: DataFrame, **options) -> DataFrame:
    """Best path under degree weights alone."""
    return closure(graph, candidates, None, **options)


def relklinker(graph: KnowledgeGraph, candidates: DataFrame, relsim: DataFrame, **options) -> DataFrame:
    """Best path with relations similar to the fact's own."""
    return closure(graph, candidates, relsim, **options)
