"""Structured Streaming as the source of transactions: a micro-batch is a transaction."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .session import WEIGHT, StreamSession


def run_stream(session: StreamSession, table: str, stream: DataFrame, sink: Callable[[int, dict[str, DataFrame]], None], *, checkpoint: str, state: str | None = None, trigger: dict | None = None) -> StreamingQuery:
    """Feed a streaming DataFrame with the table's columns (and weights in ``_w``) to a session.

    ``sink(batch_id, changes)`` gets each transaction's changes.  The checkpoint keeps
    the source's position; with ``state``, the session is written there in turn to
    ``a`` and ``b`` before each batch counts as done, and ``StreamSession.restore`` from
    the later one continues after a restart.  A batch that the session has had is not
    taken in twice; it goes neither in nor to the sink.
    """

    def batch(df: DataFrame, batch_id: int) -> None:
        if batch_id <= session.fed.get(table, -1):
            return
        before, had = session.state(), session.fed.get(table, -1)
        try:
            sink(batch_id, session.step({table: df}))
            if state:
                session.fed[table] = batch_id
                session.checkpoint(f"{state}/{'ab'[batch_id % 2]}")
        except Exception:
            session.reset(before)
            session.fed[table] = had
            raise
        session.fed[table] = batch_id

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def kafka_rows(raw: DataFrame, schema: str, *, partition_as: str, offset_as: str) -> DataFrame:
    """Rows of a Kafka source whose values are ``insert_delete`` JSON, with partition and offset columns filled from the log.

    The rows of one message share its offset.
    """
    body = F.from_json(F.col("value").cast("string"), f"insert struct<{schema}>, delete struct<{schema}>")
    rows = raw.select(body.alias("m"), "partition", "offset")
    kept = rows.where("m.insert IS NOT NULL OR m.delete IS NOT NULL")
    row = F.coalesce("m.insert", "m.delete")
    return kept.select(row.alias("r"), F.when(F.col("m.insert").isNotNull(), 1).otherwise(-1).alias(WEIGHT), F.col("partition").cast("long").alias(partition_as), F.col("offset").alias(offset_as)).select("r.*", WEIGHT, partition_as, offset_as)
