"""Streams of queries answered by the batch plans, one micro-batch at a time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame


def answer(stream: DataFrame, plan: Callable[[DataFrame], DataFrame], path: str, checkpoint: str):
    """Start a query that appends ``plan``'s answers to a Parquet table. The plans keep no state between batches;
    a batch that is retried replaces its own folder."""

    def write(batch: DataFrame, number: int) -> None:
        plan(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()
