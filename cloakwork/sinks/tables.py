"""Writing scanned tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cloakwork.functions.text import quoted
from cloakwork.sources.shared import fresh_dir

METADATA_SCHEMA = T.StructType(
    [
        T.StructField("pii_flag", T.BooleanType()),
        T.StructField("pii_count", T.IntegerType()),
        T.StructField("pii_types", T.ArrayType(T.StringType())),
        T.StructField("pii_scanned_at", T.TimestampType()),
        T.StructField("pii_scan_status", T.StringType()),
    ]
)


def index_schema(fields: T.StructType) -> T.StructType:
    """Document fields followed by the metadata columns."""
    own = [f for f in fields.fields if f.name not in METADATA_SCHEMA.names]
    return T.StructType([*own, *METADATA_SCHEMA.fields])


def create_index(
    spark: SparkSession,
    name: str,
    fields: T.StructType,
    *,
    key: str = "doc_id",
    buckets: int | None = None,
    partition_by: str | None = None,
) -> bool:
    """Create a Parquet table for documents unless it exists; True if created.

    With `buckets` it is clustered by key, and joins on the key (`replace_by_id`,
    `update_by_id`) leave its rows where they are.
    """
    if spark.catalog.tableExists(name):
        return False
    ident = ".".join(f"`{part}`" for part in name.split("."))
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in index_schema(fields).fields)
    partitioned = f" PARTITIONED BY (`{partition_by}`)" if partition_by else ""
    clustered = f" CLUSTERED BY (`{key}`) INTO {int(buckets)} BUCKETS" if buckets else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {ident} ({columns}) USING parquet{partitioned}{clustered}")
    return True


def append_documents(df: DataFrame, table: str, key: str = "doc_id") -> None:
    """Add documents to a table, given as a path or a catalog name.

    A key column that the documents lack is filled with new ids; appending the
    same documents twice stores them twice.
    """
    if key not in df.columns:
        df = df.select(F.uuid().alias(key), "*")
    if "/" in table:
        df.write.mode("append").parquet(table)
        return
    spark = df.sparkSession
    target = spark.table(table)
    missing = [f for f in target.schema.fields if f.name not in df.columns]
    full = df.withColumns({f.name: F.lit(None).cast(f.dataType) for f in missing})
    full.select(*(quoted(c) for c in target.columns)).write.insertInto(table)


def overwrite_partitions(df: DataFrame, path: str, partition_by: Sequence[str]) -> None:
    """Replace only the partitions that occur in `df`, which must hold them whole.

    For tables too large to rewrite: partition by ingest day, say, and a scan of
    today's documents writes today's partition.  The rows are staged in the shared
    folder first because they come from the partitions they replace; running the
    second step again after a failure gives the same table.
    """
    spark = df.sparkSession
    staging = fresh_dir(spark, "staged-partitions")
    df.write.partitionBy(*partition_by).parquet(staging)
    staged = spark.read.schema(df.schema).parquet(staging)
    staged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)
