"""The corpus pipeline: language ID, line dedup, near-dedup, benchmark decontamination, byte-level BPE.

Each stage takes (spark, docs, sf_dir), docs being all that its predecessor kept, and returns a DataFrame; all but the
last return the columns of documents, with the order and types that they came in. Nulls, empty and repeated rows are
treated as the stages' operators say; an empty table runs through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcwise.llm.bpe import encode_public
from arcwise.llm.common import new_path
from arcwise.llm.decontaminate import decontaminate
from arcwise.llm.language_id import keep_identified
from arcwise.llm.line_dedup import whole_lines
from arcwise.llm.near_dedup import near_duplicates


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or of which no language has four tenths, go."""
    return keep_identified(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeats of runs of lines, and of single long lines, go from the texts; no document goes."""
    return whole_lines(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document with the least doc_id stays. Rows of one doc_id and class stay together."""
    out = near_duplicates(docs).where("kept").select(F.col("doc_id").alias("_aw_id")).distinct()
    return docs.join(out, docs["doc_id"].eqNullSafe(out["_aw_id"]), "left_semi")


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and digests of the ids and of what they decode to."""
    return encode_public(docs, with_ids=True)


STAGES = [("language_id", language), ("line_dedup", lines), ("near_dedup", near), ("decontaminate", benchmark), ("bpe", tokens)]

#: Language ID, order MinHash and BPE can't be put in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            path = new_path(spark, f"stage-{name}")
            docs.write.parquet(path)
            docs = spark.read.schema(docs.schema).parquet(path)
    return docs
