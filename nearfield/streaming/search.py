"""Queries that arrive as a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from nearfield.plans.index import VectorIndex


def search_stream(index: VectorIndex, queries: DataFrame, sink: Callable[[DataFrame, int], None], k: int = 10, checkpoint: str | None = None, query_key: str = "vec_id", **trigger) -> StreamingQuery:
    """Search each micro-batch of ``queries`` and give the results and the batch's number to ``sink``.

    A batch that is run again after a failure has its number again, so a sink that overwrites by it has each result once.
    """

    def each(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            sink(index.search_batch(batch, k, query_key=query_key), number)

    writer = queries.writeStream.foreachBatch(each).trigger(**(trigger or {"availableNow": True}))
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()
