"""Writers; each leaves a folder of part files, as Spark does."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import rendered
from ..graph import KnowledgeGraph


def write_dictionary(df: DataFrame, path: str) -> None:
    """Two columns as `id name` lines, in the order of the ids."""
    a, b = df.columns
    df.orderBy(a).select(F.concat_ws(" ", F.col(a).cast("string"), F.col(b))).write.mode("overwrite").text(path)


def write_graph(graph: KnowledgeGraph, path: str) -> None:
    """Edges by relation, ranges of subjects in files of their own, so that lookups by p and s skip what they can and a
    relation has only the files that its size asks for; and degrees."""
    graph.edges.repartitionByRange("p", "s").sortWithinPartitions("p", "s", "o").write.mode("overwrite").partitionBy("p").parquet(f"{path}/edges")
    graph.degrees().write.mode("overwrite").parquet(f"{path}/degrees")


def write_scores(df: DataFrame, path: str) -> None:
    """Scores as CSV with a header; arrays and structs as JSON. A path and rpath are also written out, as path_text."""
    if {"path", "rpath"} <= set(df.columns):
        df = df.withColumn("path_text", rendered(F.col("path"), F.col("rpath")))
    nested = [f.name for f in df.schema.fields if f.dataType.typeName() in ("array", "struct", "map")]
    df.select(*[F.to_json(F.col(c)).alias(c) if c in nested else F.col(f"`{c}`") for c in df.columns]).write.mode("overwrite").option("header", True).csv(path)


def write_flows(df: DataFrame, path: str) -> None:
    """One JSON line a candidate: sid, pid, oid, paths, relpaths, bottlenecks, costs, flows."""
    df.select("sid", "pid", "oid", "paths", "relpaths", "bottlenecks", "costs", "flows").write.mode("overwrite").json(path)


def write_matrix(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)
