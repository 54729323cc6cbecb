"""The multi-relational graph: an edge table (s, p, o, w) and what is derived from it.

Edges are plain rows, distributed by Spark; nothing here collects. An undirected graph stores both directions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions.scalar import degree_weight
from .storage import stored_by


class KnowledgeGraph:
    """edges: s long, p int, o long, w double, distinct in (s, p, o)."""

    def __init__(self, edges: DataFrame, n_relations: int | None = None, symmetric: bool = False):
        self.edges = edges.select(F.col("s").cast("long").alias("s"), F.col("p").cast("int").alias("p"), F.col("o").cast("long").alias("o"), F.col("w").cast("double").alias("w"))
        self._n_relations = n_relations
        self.symmetric = symmetric  # known to hold every edge in both directions, with one value

    @classmethod
    def from_edges(cls, edges: DataFrame, symmetric: bool = True, n_relations: int | None = None, keep: bool = False) -> KnowledgeGraph:
        """From (s, p, o[, w]); symmetric adds the reverse edges. Equal edges of several values keep the largest.

        Rows with a null in s, p or o are left out. keep writes the table once, for graphs that many plans read; the
        edges out of a node lie in one bucket of it, so lookups, joins and groups by s move none of them.
        """
        w = F.col("w").cast("double") if "w" in edges.columns else F.lit(1.0)
        one = edges.select("s", "p", "o", w.alias("w")).dropna(subset=["s", "p", "o"])
        if keep:
            if symmetric:
                both = F.array(F.struct("s", "o"), F.struct(F.col("o").alias("s"), F.col("s").alias("o")))
                one = one.select("p", "w", F.explode(both).alias("e")).select("e.s", "p", "e.o", "w")
            ids = one.select(F.col("s").cast("long").alias("s"), F.col("p").cast("int").alias("p"), F.col("o").cast("long").alias("o"), "w")
            laid = ids.repartition(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), "s")
            return cls(stored_by(laid.groupBy("s", "p", "o").agg(F.max("w").alias("w")), "edges", "s", "p", "o"), n_relations, symmetric)
        if symmetric:  # both directions of a pair meet in one group, so edges are shuffled once
            pairs = one.groupBy(F.least("s", "o").alias("a"), F.greatest("s", "o").alias("b"), "p").agg(F.max("w").alias("w"))
            there, back = F.struct(F.col("a").alias("s"), F.col("b").alias("o")), F.struct(F.col("b").alias("s"), F.col("a").alias("o"))
            one = pairs.select("p", "w", F.explode(F.when(F.col("a") == F.col("b"), F.array(there)).otherwise(F.array(there, back))).alias("e")).select("e.s", "p", "e.o", "w")
        else:
            one = one.groupBy("s", "p", "o").agg(F.max("w").alias("w"))
        return cls(one, n_relations, symmetric)

    @property
    def n_relations(self) -> int:
        if self._n_relations is None:
            top = self.edges.agg(F.max("p")).first()[0]
            self._n_relations = 0 if top is None else top + 1
        return self._n_relations

    # Lookups. Predicates on s and p reach the scan of a stored graph.

    def value(self, s: int, o: int, p: int) -> DataFrame:
        """w of one edge; no row if there is none."""
        return self.edges.where((F.col("s") == s) & (F.col("o") == o) & (F.col("p") == p)).select("w")

    def objects(self, s: int, p: int) -> DataFrame:
        return self.edges.where((F.col("s") == s) & (F.col("p") == p)).select("o")

    def neighbors(self, s: int, p: int | None = None) -> DataFrame:
        rows = self.edges.where(F.col("s") == s)
        return (rows if p is None else rows.where(F.col("p") == p)).select("p", "o")

    def relation(self, p: int) -> DataFrame:
        """The slice of one relation."""
        return self.edges.where(F.col("p") == p).select("s", "o", "w")

    def outgoing_relations(self, s: int) -> DataFrame:
        return self.edges.where(F.col("s") == s).select("p")

    def updated(self, changes: DataFrame) -> KnowledgeGraph:
        """The graph with (s, p, o, w) of changes in place of its own values; new edges are added."""
        own = self.edges.join(changes.select("s", "p", "o"), ["s", "p", "o"], "left_anti")
        return KnowledgeGraph(own.unionByName(changes.select("s", "p", "o", F.col("w").cast("double").alias("w"))), self._n_relations)

    def without(self, removed: DataFrame) -> KnowledgeGraph:
        """The graph without the edges (s, p, o) of removed, in that direction only."""
        return KnowledgeGraph(self.edges.join(removed.select("s", "p", "o"), ["s", "p", "o"], "left_anti"), self._n_relations)

    def without_relation(self, p: int) -> KnowledgeGraph:
        return KnowledgeGraph(self.edges.where(F.col("p") != p), self._n_relations)

    # Derived tables.

    def degrees(self) -> DataFrame:
        """node, d: distinct neighbours on edges into the node, whatever the relation; a self-loop counts once."""
        ends = self.inward().select("s", "o").distinct()
        return ends.groupBy(F.col("o").alias("node")).agg(F.count(F.lit(1)).alias("d"))

    def inward(self) -> DataFrame:
        """The edges; those of a stored symmetric graph are turned round, so that the edges into a node lie in one bucket."""
        return self.edges.select(F.col("o").alias("s"), "p", F.col("s").alias("o"), "w") if self.symmetric else self.edges

    def adjacency(self) -> DataFrame:
        """u, v, m: distinct neighbour pairs with the number of relations between them."""
        return self.edges.groupBy(F.col("s").alias("u"), F.col("o").alias("v")).agg(F.count(F.lit(1)).alias("m"))

    def out_degrees(self) -> DataFrame:
        """node, n: edges out of the node, parallel relations apart."""
        return self.edges.groupBy(F.col("s").alias("node")).agg(F.count(F.lit(1)).alias("n"))

    def relation_histogram(self) -> DataFrame:
        """node, p, n: edges out of the node under each relation."""
        return self.edges.groupBy(F.col("s").alias("node"), "p").agg(F.count(F.lit(1)).alias("n"))

    def weighted_degrees(self, kind: str = "logdegree") -> DataFrame:
        return self.degrees().select("node", "d", degree_weight(F.col("d"), kind).alias("weight"))

    def edge_weights(self, kind: str = "logdegree") -> DataFrame:
        """s, p, o, weight: the weight of each edge is that of the node it points to."""
        return self.edges.join(self.weighted_degrees(kind), F.col("o") == F.col("node")).select("s", "p", "o", "weight")

    def where(self, condition: Column) -> KnowledgeGraph:
        return KnowledgeGraph(self.edges.where(condition), self._n_relations)
