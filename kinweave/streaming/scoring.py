"""Scoring a stream of records against a table (an extension; the batch operators do the work)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql.streaming import StreamingQuery

from kinweave.operators.pairs import candidate_pairs, id_names, score_pairs
from kinweave.operators.suggest import top_k


def score_stream(stream: DataFrame, table: DataFrame, spec, stream_id: str, table_id: str, block_on: list[tuple[str, str]], score: Column, sink: Callable[[DataFrame, int], None], k: int = 1, checkpoint: str | None = None) -> StreamingQuery:
    """For every micro-batch, the ``k`` best rows of ``table`` per new record go to ``sink``."""
    li, ri = id_names(stream_id, table_id)

    def each(batch: DataFrame, epoch: int) -> None:
        scored = score_pairs(candidate_pairs(batch, table, spec, stream_id, table_id, block_on, unique=False), spec).withColumn("prediction", score)
        sink(top_k(scored.select(li, ri, "prediction"), k, li, ri), epoch)

    writer = stream.writeStream.foreachBatch(each).trigger(availableNow=True)
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()
