"""Scores micro-batches of candidate facts against a stored graph; each batch is one plan of the same operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..graph import KnowledgeGraph
from ..plans.methods import score


def score_stream(candidates: DataFrame, graph: KnowledgeGraph, method: str, out: str, checkpoint: str, relsim: DataFrame | None = None, **options) -> StreamingQuery:
    """candidates: a streaming sid, pid, oid. Each batch is written to its own folder of `out`, overwritten if replayed,
    so a restart leaves every batch once. The softmax is among the batch's candidates of a subject."""

    def write(batch: DataFrame, number: int) -> None:
        score(method, graph, batch, relsim, **options).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return candidates.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()
