"""Reading documents from files and tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

JSON_SUFFIX = ".json"


def read_json_documents(
    spark: SparkSession, path: str | Sequence[str], schema: T.StructType | str, *, glob: str | None = None
) -> DataFrame:
    """JSON files holding one object or an array of objects: a row per object.

    The schema is declared.  Inference would read everything twice and would list
    fields alphabetically, while a combined text follows field order.
    """
    reader = spark.read.schema(schema).option("multiLine", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.json(path)


def read_ragged_documents(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """JSON files whose objects share no schema: ``source_key, position, document``.

    `document` is a variant.  `ragged_text_fields` picks its strings.
    """
    raw = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("source_key"), F.parse_json("value").alias("v")
    )
    # A file with one object becomes an array of one.
    as_list = F.when(F.schema_of_variant("v").startswith("ARRAY"), F.col("v")).otherwise(
        F.parse_json(F.concat(F.lit("["), F.to_json("v"), F.lit("]")))
    )
    listed = raw.select("source_key", as_list.alias("v"))
    return listed.lateralJoin(spark.tvf.variant_explode(F.col("v").outer())).select(
        "source_key", F.col("pos").alias("position"), F.col("value").alias("document")
    )


def ragged_text_fields(df: DataFrame, min_chars: int = 20) -> DataFrame:
    """The text fields of variant documents: ``source_key, position, field, text``.

    Only strings count; a number is no text however long.  Fields come in
    alphabetical order, the order variants keep.
    """
    spark = df.sparkSession
    fields = df.lateralJoin(spark.tvf.variant_explode(F.col("document").outer()).toDF("p", "field", "v"))
    text = F.when(
        F.schema_of_variant("v") == "STRING", F.try_variant_get("v", "$", "string")
    )
    return fields.select("source_key", "position", "field", text.alias("text")).where(F.length("text") > min_chars)


def read_raw_documents(spark: SparkSession, path: str | Sequence[str], *, skip_json: bool = True) -> DataFrame:
    """Any other file as one document ``source_key, body``.

    Files ending in ``.json``, in that spelling, belong to `read_json_documents`.
    """
    files = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("source_key"), F.col("value").alias("body")
    )
    return files.where(~F.col("source_key").endswith(JSON_SUFFIX)) if skip_json else files


def scan_index(spark: SparkSession, table: str) -> DataFrame:
    """All documents of a table, given as a path or a catalog name."""
    return spark.read.parquet(table) if "/" in table else spark.table(table)


def payload_documents(df: DataFrame, fields: T.StructType | None = None) -> DataFrame:
    """Direct payloads as documents, with the flag whether to store them.

    A payload carries its document in a ``document`` struct or is the document
    itself; ``index`` says whether to store it and defaults to true.  `fields`
    are the document's fields, by default those of ``document`` followed by the
    payload's own.  The flag is returned as ``to_index``.
    """
    inner = [] if "document" not in df.columns else df.schema["document"].dataType.names
    outer = [c for c in df.columns if c not in ("document", "index")]
    names = fields.names if fields is not None else [*inner, *(c for c in outer if c not in inner)]

    def value(name: str) -> Column:
        own = F.col(f"`{name}`") if name in outer else F.lit(None)
        if name not in inner:
            return (own if not inner else F.when(F.col("document").isNull(), own)).alias(name)
        return (
            F.when(F.col("document").isNotNull(), F.col("document").getField(name)).otherwise(own).alias(name)
        )

    keep = F.coalesce(F.col("index"), F.lit(True)) if "index" in df.columns else F.lit(True)
    return df.select(*(value(n) for n in names), keep.alias("to_index"))
