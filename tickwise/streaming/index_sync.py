"""T3 – triggered, incremental sync of a keyed index from a stream of change batches.

Each micro-batch rewrites the index buckets that it touches, as the next free
version. The manifest records the batch under the stream's own id (kept in its
checkpoint), so a replayed batch is recognised after a failure, and a new
checkpoint on an old index loses nothing.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame

from ..sinks.snapshots import sync_index


def _stream_id(spark, checkpoint: str) -> str:
    """The id that Spark gave the query when its checkpoint was created."""
    return json.loads(spark.read.text(f"{checkpoint.rstrip('/')}/metadata").first()[0])["id"]


def start_index_sync(changes_stream: DataFrame, index_root: str, key: str | list[str], checkpoint: str,
                     transform=None, available_now: bool = True):
    def apply(batch: DataFrame, batch_id: int) -> None:
        feed = _stream_id(batch.sparkSession, checkpoint)
        sync_index(batch.sparkSession, batch, index_root, key, transform=transform, batch=(feed, batch_id))

    w = changes_stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w
    return w.start()
