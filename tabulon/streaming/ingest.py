"""Streams into a store: each micro-batch is one commit."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.query import get_by_pk
from ..sources.store import Store


def appender(store: Store, type_id: int, position: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: new keys are inserted in the order of `position`; keys that are there are left, so a batch that Spark replays changes nothing."""

    def run(batch: DataFrame, _: int) -> None:
        with store.begin_write() as txn:
            t = txn.table(type_id)
            rows = batch.select(*t.otype.names, F.col(position).cast("bigint").alias("_pos"))
            seen = get_by_pk(t, rows.select(t.otype.pk)).select(t.otype.pk)
            txn.insert(type_id, rows.join(seen, t.otype.pk, "left_anti"))
            txn.commit()

    return run


def ingest(stream: DataFrame, store: Store, type_id: int, checkpoint: str, position: str) -> StreamingQuery:
    """Starts a query that takes what is available now and stops."""
    return stream.writeStream.foreachBatch(appender(store, type_id, position)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
