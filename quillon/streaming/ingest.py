"""Streams into tables, and event counts over time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillon.sources.store import Database


def into_table(stream: DataFrame, database: Database, table: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Appends each micro-batch of a stream to a table in one commit.

    A batch that is delivered again after a failure is recognised by its number, which the table
    `<table>_batches` records in the same transaction, so every row is appended once.
    """
    marks = f"{table}_batches"
    session = database.session()
    if marks not in session.tables():
        session.create_table(marks, "batch bigint")

    def append(rows: DataFrame, batch: int) -> None:
        with database.session() as s:
            if not s.table(marks).where(F.col("batch") == batch).isEmpty():
                return
            s.insert(table, rows)
            s.insert(marks, [(batch,)])

    writer = stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def windowed_counts(events: DataFrame, time: str, keys: list[str], width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(start, end, keys..., n) by tumbling windows of event time; on a stream, rows later than `late` are left out and state is let go."""
    stamp = F.col(time).cast("timestamp")
    grouped = events.withColumn("_at", stamp).withWatermark("_at", late) if events.isStreaming else events.withColumn("_at", stamp)
    out = grouped.groupBy(F.window("_at", width).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")
