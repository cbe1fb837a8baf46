"""Keep a stored graph current from a stream of change notices."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..engine import Engine

# A notice names a file that was written or removed.
NOTICE = "path string, op string"


def change_stream(engine: Engine, notices: str) -> DataFrame:
    """Notices that appear as JSON files in a folder."""
    return engine.spark.readStream.schema(NOTICE).json(notices)


def maintain(engine: Engine, changes: DataFrame, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Apply every micro-batch of ``changes`` as one new version of the graph.

    A repeated batch writes the same rows again, so a restart is harmless.
    The work of a batch is the files it names plus the resolution of names.
    """
    def take(batch: DataFrame, _epoch: int) -> None:
        paths = batch.select("path").where(F.col("path").isNotNull())
        if not paths.isEmpty():
            engine.apply(paths)

    writer = changes.writeStream.foreachBatch(take).option("checkpointLocation", os.path.join(checkpoint, "notices"))
    return (writer.trigger(availableNow=True) if once else writer).start()
