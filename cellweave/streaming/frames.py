"""Frames that arrive: grid operators over a stream of cells with an image key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..grid import Grid


def frames(stream: DataFrame, size: tuple[int, ...], key: str, work: Callable[[Grid], DataFrame], sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Apply ``work`` to the frames of each micro-batch and hand its rows to ``sink`` with the batch's number.

    A frame must arrive in one batch, as a file of cells does. ``sink`` should
    be idempotent by the number, for batches that are run again after a failure.
    """

    def run(batch: DataFrame, number: int) -> None:
        sink(work(Grid(batch, size, (key,))), number)

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
