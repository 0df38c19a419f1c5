"""Streams of new documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cloakwork.operators.scan import scan_documents
from cloakwork.policy import Policy

# Files of one micro-batch; what is over waits for the next one.
FILES_PER_BATCH = 1_000


def stream_new_documents(
    spark: SparkSession,
    directory: str,
    schema: T.StructType | str,
    *,
    prefix: str = "",
    suffix: str = ".json",
    files_per_batch: int | None = FILES_PER_BATCH,
    source_column: str | None = None,
) -> DataFrame:
    """JSON files as they land, an object or an array each.

    Only names that begin with `prefix` and end with `suffix` are read.
    `source_column` names a column to add for the file a document came from.
    """
    stream = (
        spark.readStream.schema(schema)
        .option("multiLine", True)
        .option("pathGlobFilter", f"{prefix}*{suffix}")
        .option("recursiveFileLookup", True)
    )
    if files_per_batch:
        stream = stream.option("maxFilesPerTrigger", files_per_batch)
    documents = stream.json(directory)
    if source_column is None:
        return documents
    return documents.withColumn(source_column, F.col("_metadata.file_path"))


def stream_raw_documents(
    spark: SparkSession, directory: str, *, files_per_batch: int | None = FILES_PER_BATCH, skip_json: bool = True
) -> DataFrame:
    """Files that are not JSON as they land, each one document ``source_key, body``."""
    stream = spark.readStream.option("recursiveFileLookup", True)
    if files_per_batch:
        stream = stream.option("maxFilesPerTrigger", files_per_batch)
    files = stream.text(directory, wholetext=True).select(
        F.col("_metadata.file_path").alias("source_key"), F.col("value").alias("body")
    )
    return files.where(~F.col("source_key").endswith(".json")) if skip_json else files


def stream_table(
    spark: SparkSession, directory: str, schema: T.StructType | str, *, glob: str = "*.parquet", files_per_batch: int | None = FILES_PER_BATCH
) -> DataFrame:
    """Parquet files of documents as they land.

    `directory` may be a pattern, for folders or files; then subfolders give no partition columns.
    """
    stream = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if files_per_batch:
        stream = stream.option("maxFilesPerTrigger", files_per_batch)
    return stream.parquet(directory)


def stream_scan(stream: DataFrame, policy: Policy | None = None, *, key: str = "doc_id") -> DataFrame:
    """A stream of documents with the scan applied.

    The scan is a projection, so the stream keeps no state.  The ``source_key`` of
    raw documents is scanned like other text unless it is the key; the scan time
    is the micro-batch's.
    """
    return scan_documents(stream, policy, key=key)
