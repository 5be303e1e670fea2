"""Continuous ingest and incremental rollups with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..plans import rollup
from ..sources.store import Store


def ingest(source: DataFrame, store: Store, checkpoint: str, name: str = "ingest", available_now: bool = True) -> StreamingQuery:
    """Insert each micro-batch of ``source`` (uuid, time, value) and commit it. A batch that was committed before is
    skipped, so a restart adds nothing twice. No watermark: late points of any age are accepted."""

    def each(batch: DataFrame, number: int) -> None:
        store.insert(batch, batch_key=f"{name}-{number}", limit=None)
        store.flush()

    writer = source.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).queryName(name)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def refresh_rollup(store: Store, old: DataFrame, since: int, pw: int) -> DataFrame:
    """Partials of width 2 ** pw brought up to date with all that changed after version ``since``."""
    return rollup.refreshed(old, store.snapshot(), store.changes(None, since, None, pw), pw)
