"""Peak queries over a stream of peaks: each micro-batch is queried whole, scans arriving in one batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..plans.compiler import run


def query_stream(peaks: DataFrame, query: str, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Run `query` on every micro-batch of an MS2 peak stream and hand the result to sink(df, batch_id)."""
    return peaks.writeStream.foreachBatch(lambda df, n: sink(run(query, None, df), n)).option("checkpointLocation", checkpoint).start()
