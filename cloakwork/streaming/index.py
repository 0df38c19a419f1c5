"""Storing scanned streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cloakwork.operators.filters import route
from cloakwork.operators.scan import scan_documents
from cloakwork.policy import SENSITIVE_TYPES, Policy


def _start(writer, checkpoint: str, interval: str | None) -> StreamingQuery:
    writer = writer.option("checkpointLocation", checkpoint)
    # Without an interval: everything there is now, in bounded batches, then stop.
    writer = writer.trigger(availableNow=True) if interval is None else writer.trigger(processingTime=interval)
    return writer.start()


def stream_to_index(
    stream: DataFrame, table: str, checkpoint: str, *, interval: str | None = None
) -> StreamingQuery:
    """Append a scanned stream to a Parquet table, each document exactly once.

    The file sink's own log decides which files count, so a batch that is run
    again after a failure does not store its documents twice.
    """
    writer = stream.writeStream.format("parquet").option("path", table).outputMode("append")
    return _start(writer, checkpoint, interval)


def stream_to_routes(
    stream: DataFrame,
    table: str,
    checkpoint: str,
    *,
    sensitive=SENSITIVE_TYPES,
    interval: str | None = None,
) -> StreamingQuery:
    """Append a scanned stream, each route in a folder of its own."""
    writer = (
        stream.withColumn("route", route(sensitive))
        .writeStream.format("parquet")
        .partitionBy("route")
        .option("path", table)
        .outputMode("append")
    )
    return _start(writer, checkpoint, interval)


def write_batch(path: str) -> Callable[[DataFrame, int], None]:
    """A batch writer that may run twice: each batch owns one folder it overwrites."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def stream_dual_write(
    stream: DataFrame,
    restricted: str,
    shared: str,
    checkpoint: str,
    policy: Policy | None = None,
    *,
    key: str = "doc_id",
    summary: str | None = None,
    interval: str | None = None,
) -> StreamingQuery:
    """Originals to a restricted table and scanned documents to a shared one.

    With `summary`, also one row ``scanned, flagged`` per micro-batch, counted
    from the rows the batch wrote.
    """
    to_restricted, to_shared = write_batch(restricted), write_batch(shared)

    def write(batch: DataFrame, batch_id: int) -> None:
        to_restricted(batch, batch_id)
        to_shared(scan_documents(batch, policy, key=key), batch_id)
        if summary is not None:
            stored = batch.sparkSession.read.parquet(f"{shared}/batch={batch_id}")
            counts = stored.agg(
                F.count("*").alias("scanned"), F.count_if(F.col("pii_flag")).alias("flagged")
            )
            write_batch(summary)(counts, batch_id)

    return _start(stream.writeStream.foreachBatch(write), checkpoint, interval)
