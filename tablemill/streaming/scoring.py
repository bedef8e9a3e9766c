"""Scoring a stream: the batch chain is row-wise, so it runs unchanged in append mode."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tablemill.plans.scoring import Bundle, score_table


def score_stream(
    stream: DataFrame, bundle: Bundle, key: list[str], path: str, checkpoint: str
) -> StreamingQuery:
    """Score arriving rows to a parquet folder until the present input is used up."""
    return (
        score_table(stream, bundle, key)
        .writeStream.outputMode("append")
        .format("parquet")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(path)
    )
