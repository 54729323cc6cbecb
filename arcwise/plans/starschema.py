"""A knowledge graph of the star-schema tables: customers, suppliers, parts, nations and regions under six relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import KnowledgeGraph

TYPES = {"customer": 1, "supplier": 2, "part": 4, "nation": 5, "region": 6}
RELATIONS = ("livesIn", "locatedIn", "inRegion", "bought", "supplies", "buysFrom")


def node(kind: str, key: str) -> Column:
    return (F.lit(TYPES[kind] * 1_000_000_000) + F.col(key).cast("long")).cast("long")


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """s, p, o in one direction, an edge as often as the tables say it; the graph makes them distinct."""
    items, orders = _read(spark, sf_dir, "lineitem"), _read(spark, sf_dir, "orders")
    # One join gives the three edges of an item; without an order it has a supplier only, and the graph drops null ends.
    bought = items.select("l_orderkey", "l_partkey", "l_suppkey").join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"), "left")
    c, p, u = node("customer", "o_custkey"), node("part", "l_partkey"), node("supplier", "l_suppkey")
    three = F.array(*[F.struct(s.alias("s"), F.lit(r).alias("p"), o.alias("o")) for s, r, o in ((c, 3, p), (u, 4, p), (c, 5, u))])
    parts = [
        _read(spark, sf_dir, "customer").select(node("customer", "c_custkey").alias("s"), F.lit(0).alias("p"), node("nation", "c_nationkey").alias("o")),
        _read(spark, sf_dir, "supplier").select(node("supplier", "s_suppkey").alias("s"), F.lit(1).alias("p"), node("nation", "s_nationkey").alias("o")),
        _read(spark, sf_dir, "nation").select(node("nation", "n_nationkey").alias("s"), F.lit(2).alias("p"), node("region", "n_regionkey").alias("o")),
        bought.select(F.explode(three).alias("e")).select("e.s", "e.p", "e.o"),
    ]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every


_KEPT: dict[tuple, KnowledgeGraph] = {}


def graph(spark: SparkSession, sf_dir: str, symmetric: bool = True, keep: bool = True) -> KnowledgeGraph:
    """keep writes the edges, once for each session and folder: later plans read the stored graph, as a saved one."""
    if not keep:
        return KnowledgeGraph.from_edges(raw_edges(spark, sf_dir), symmetric=symmetric, n_relations=len(RELATIONS))
    key = (spark.sparkContext.applicationId, sf_dir, symmetric)
    if key not in _KEPT:
        _KEPT[key] = KnowledgeGraph.from_edges(raw_edges(spark, sf_dir), symmetric=symmetric, n_relations=len(RELATIONS), keep=True)
    return _KEPT[key]


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sid, pid, oid, class: every customer with every nation; class 1 for their own."""
    n = _read(spark, sf_dir, "nation").select("n_nationkey")
    pairs = _read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").crossJoin(F.broadcast(n))  # 25 nations at any scale
    return pairs.select(node("customer", "c_custkey").alias("sid"), F.lit(0).alias("pid"), node("nation", "n_nationkey").alias("oid"), (F.col("c_nationkey") == F.col("n_nationkey")).cast("int").alias("class"))


def region_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sid, pid, oid, class: every nation with every region."""
    pairs = _read(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey").crossJoin(F.broadcast(_read(spark, sf_dir, "region").select("r_regionkey")))
    return pairs.select(node("nation", "n_nationkey").alias("sid"), F.lit(2).alias("pid"), node("region", "r_regionkey").alias("oid"), (F.col("n_regionkey") == F.col("r_regionkey")).cast("int").alias("class"))


def named_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sub, pred, obj by name: who lives or is located where."""
    n = _read(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    c = _read(spark, sf_dir, "customer").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_name").alias("sub"), F.lit("livesIn").alias("pred"), F.col("n_name").alias("obj"))
    s = _read(spark, sf_dir, "supplier").join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_name").alias("sub"), F.lit("locatedIn").alias("pred"), F.col("n_name").alias("obj"))
    r = n.join(F.broadcast(_read(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("sub"), F.lit("inRegion").alias("pred"), F.col("r_name").alias("obj"))
    return c.unionByName(s).unionByName(r)
