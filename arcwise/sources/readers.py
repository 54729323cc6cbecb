"""Readers of triples, dictionaries, graphs and candidate facts; schemas are explicit, nothing is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import KnowledgeGraph


def read_triples(spark: SparkSession, path: str) -> DataFrame:
    """Abbreviated N-Triples, `sub pred obj [.]` without a header: sub, pred, obj. Quotes in names are taken literally."""
    parts = F.split(F.col("value"), " ", 4)
    lines = spark.read.text(path).where(F.size(parts) >= 3)
    return lines.select(*[parts[k].alias(n) for k, n in enumerate(("sub", "pred", "obj"))])


def read_dictionary(spark: SparkSession, path: str, id_name: str, value_name: str) -> DataFrame:
    """`id name` lines; the name may hold spaces."""
    parts = F.split(F.col("value"), " ", 2)
    return spark.read.text(path).select(parts[0].cast("long").alias(id_name), parts[1].alias(value_name))


def read_candidates(spark: SparkSession, path: str) -> DataFrame:
    """Candidate facts: CSV with a header; sid, pid, oid become long, int, long even if written 12.0, as does class.

    Rows without one of the three ids are dropped. Other columns are kept as strings.
    """
    df = spark.read.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    df = df.dropna(subset=["sid", "pid", "oid"])
    kinds = {"sid": "long", "pid": "int", "oid": "long", "class": "int"}
    return df.select(*[F.col(f"`{c}`").cast("double").cast(kinds[c]).alias(c) if c in kinds else F.col(f"`{c}`") for c in df.columns])


def read_graph(spark: SparkSession, path: str) -> KnowledgeGraph:
    """What write_graph wrote."""
    return KnowledgeGraph(spark.read.parquet(f"{path}/edges"))


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """A relation-by-relation table: r1, r2, value."""
    return spark.read.schema("r1 int, r2 int, value double").parquet(path)
