"""Extension: a stream of changed files in which each content is analysed once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def once_per_content(changes: DataFrame, event_time: str = "ts", delay: str = "1 hour") -> DataFrame:
    """``changes(oid, language, ...)`` without repeats of (oid, language) that arrive within ``delay``; state older than that is dropped."""
    return changes.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["oid", "language"])


def gate(changes: DataFrame, check: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Runs ``check(batch, id)`` on every micro-batch of all changes that are available now."""
    return changes.writeStream.foreachBatch(check).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
