"""Reading what a batch detector wrote."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakwork.functions import spans

OUTPUT_SCHEMA = (
    "id string, File string, "
    "Entities array<struct<Type:string,Score:double,BeginOffset:int,EndOffset:int>>"
)


def normalised_entities(entities: Column) -> Column:
    """Detector entities in this package's own shape."""
    renamed = F.transform(
        entities,
        lambda e: F.struct(
            e["Type"].alias("type"),
            e["Score"].alias("score"),
            e["BeginOffset"].alias("begin"),
            e["EndOffset"].alias("end"),
        ),
    )
    return F.coalesce(renamed, spans.no_entities())


def read_detector_output(spark: SparkSession, path: str, *, glob: str = "*.out") -> DataFrame:
    """JSON lines of a detector as ``id, entities``, all files that match `glob`.

    A line is about the document named by its own ``id``; lines without one are
    known by their file name less ``.jsonl``.  No entity list means no entities.
    """
    lines = (
        spark.read.schema(OUTPUT_SCHEMA)
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", True)
        .json(path)
    )
    by_file = F.replace(F.coalesce("File", F.lit("")), F.lit(".jsonl"), F.lit(""))
    return lines.select(
        F.coalesce("id", by_file).alias("id"), normalised_entities(F.col("Entities")).alias("entities")
    )
