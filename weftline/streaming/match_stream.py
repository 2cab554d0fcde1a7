"""Matching a stream of queries against a catalog that stands still."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def match_stream(queries: DataFrame, match: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Run match on every micro-batch of queries and hand the result to sink with the batch's number.

    Each query is matched alone, so there is no state; a batch that is run again after a failure has the same number, by
    which a sink can write it once.
    """
    return queries.writeStream.foreachBatch(lambda batch, n: sink(match(batch), n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
