"""Annotating a stream of passages, batch by batch.

Row-wise stages would run on a stream as they are; grouping spans of a passage is not tied to event
time, so every micro-batch runs the batch plan (a passage arrives whole in one batch) and appends its
mentions. A batch that is run again after a failure replaces its own output.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from termloom.plans.pipeline import Settings, annotate


def annotate_stream(passages: DataFrame, names: DataFrame, out: str, checkpoint: str, settings: Settings = Settings(), available_now: bool = True, each: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Writes mentions of a stream of passages below ``out``, a folder for every batch."""

    def batch(df: DataFrame, n: int) -> None:
        m = annotate(df, names, settings)
        (each(m) if each else m).write.mode("overwrite").parquet(f"{out}/batch={n}")

    w = passages.writeStream.option("checkpointLocation", checkpoint).foreachBatch(batch)
    return (w.trigger(availableNow=True) if available_now else w).start()
