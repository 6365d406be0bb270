"""Continuous ingest: each micro-batch is a transaction named by its stream and batch id.

A batch that is run again after a failure writes its one folder anew, and one that was
committed before is left alone, so every row is there once.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..sources.ingest import FINISHED, STREAMS, Ingest


def stream_into(stream: DataFrame, ingest: Ingest, db: str, table: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append a stream to a table; trigger as for DataStreamWriter.trigger."""
    # ids of different streams lie apart by the hash of what they fill and where they keep their state
    first = STREAMS + (zlib.crc32(f"{table} {checkpoint}".encode()) << 28)

    def batch(rows: DataFrame, batch_id: int) -> None:
        t = ingest.begin(db, first + batch_id)
        if t.state != FINISHED:
            ingest._append(db, table, rows, t, None, 0)
            ingest.commit(t)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
