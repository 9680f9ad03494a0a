"""Text rules on streams.

The reference has no streaming. The row-wise text operators are plain projections, so they run
unchanged on a streaming DataFrame; the corpus-level ones (topics, keywords, embedding, metrics)
aggregate, and run per micro-batch through ``foreachBatch``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators import text as X

ROW_WISE = {"sentiment": X.sentiment, "classification": X.classify, "entity_extraction": X.entities,
            "summarization": X.summary, "language_detection": X.language}


def text_stream(stream: DataFrame, key: str | Sequence[str], text: str, task: str) -> DataFrame:
    """A row-wise text task on a streaming DataFrame (no state, no watermark needed)."""
    if task not in ROW_WISE:
        raise ValueError(f"{task!r} aggregates over texts; use each_batch() for it")
    return ROW_WISE[task](stream, key, text)


def each_batch(stream: DataFrame, fn: Callable[[DataFrame], DataFrame], path: str, checkpoint: str,
               available_now: bool = True) -> StreamingQuery:
    """Apply a batch operator to every micro-batch and append its result as Parquet at ``path``.

    ``checkpoint`` must be a shared folder: it holds the stream's progress so a restarted job
    resumes where it stopped.
    """
    writer = (stream.writeStream.option("checkpointLocation", checkpoint)
              .foreachBatch(lambda batch, _id: fn(batch).write.mode("append").parquet(path)))
    writer = writer.trigger(availableNow=True) if available_now else writer
    return writer.start()
