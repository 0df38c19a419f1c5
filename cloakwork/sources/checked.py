"""Reading files that may be malformed: nothing is dropped, and nothing malformed is read as clean.

Readers return one row for everything they find, with a `reason` where it cannot be used.
`accepted` and `rejected` split them, `counting` counts both while the rows are used.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from cloakwork.functions.text import object_fields
from cloakwork.sources.detector_output import OUTPUT_SCHEMA, normalised_entities

NOT_UTF8, EMPTY, NOT_JSON, NOT_AN_OBJECT = "not UTF-8", "empty", "not JSON", "not an object"
NOT_AS_DECLARED, NO_ID, BAD_ENTITY = "not of the declared shape", "no id", "an entity lacks type, score or offsets"
REJECT_COLUMNS = ("source_key", "position", "reason", "raw")


def _files(spark: SparkSession, path: str | Sequence[str], glob: str | None, whole: bool) -> DataFrame:
    reader = spark.read.option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.text(path, wholetext=whole)


def strictly_parsed(value: Column) -> Column:
    """The text as a variant; null unless it is one JSON value and nothing else.

    Spark's parser ignores what follows the value.  Between two names of an object nothing
    can follow, and no text holds its own checksum as the second name.
    """
    mark = F.md5(value)
    whole = F.try_parse_json(F.concat(F.lit('{"d":'), value, F.lit(',"'), mark, F.lit('":0}')))
    names = F.map_keys(object_fields(whole))
    alone = (F.size(names) == 2) & F.array_contains(names, mark) & F.array_contains(names, F.lit("d"))
    return F.when(F.is_valid_utf8(value) & alone, F.try_variant_get(whole, "$.d", "variant"))


def check_json_documents(spark: SparkSession, path: str | Sequence[str], *, glob: str | None = None) -> DataFrame:
    """JSON files of one object or a list of objects: ``source_key, position, document, reason, raw``.

    A file that cannot be parsed is one row without a position; names that occur twice in
    an object count as that.  What a list holds beside objects is a row of its own.  An
    empty list holds nothing.  `document` is a variant, `raw` the text that was rejected.
    """
    files = _files(spark, path, glob, whole=True).select(F.col("_metadata.file_path").alias("source_key"), "value")
    parsed = strictly_parsed(F.col("value"))
    files = files.select("source_key", "value", parsed.alias("v")).withColumn(
        "fault",
        F.when(~F.is_valid_utf8("value"), NOT_UTF8)
        .when(~F.rlike("value", F.lit(r"\S")), EMPTY)
        .when(F.col("v").isNull(), NOT_JSON),
    )
    listed = F.coalesce(F.try_variant_get("v", "$", "array<variant>"), F.array("v"))
    held = F.when(F.col("fault").isNull(), listed).otherwise(F.array(F.lit(None).cast("variant")))
    elements = files.select("source_key", "value", "fault", F.posexplode(held).alias("position", "document"))
    found = F.col("fault").isNotNull()
    reason = F.when(found, F.col("fault")).when(object_fields(F.col("document")).isNull(), NOT_AN_OBJECT)
    return elements.select(
        "source_key",
        F.when(~found, F.col("position")).alias("position"),
        F.when(reason.isNull(), F.col("document")).alias("document"),
        reason.alias("reason"),
        F.when(found, F.col("value")).when(reason.isNotNull(), F.to_json("document")).alias("raw"),
    )


def check_detector_output(spark: SparkSession, path: str | Sequence[str], *, glob: str = "*.out") -> DataFrame:
    """JSON lines of a detector: ``source_key, id, entities, reason, raw`` and where the line is read.

    Blank lines are no lines.  A line is known by its ``id`` or else its file name; one
    without either, one of another shape, or one with an entity that lacks its type, score
    or offsets (an end before the beginning is none) is rejected whole.
    """
    lines = _files(spark, path, glob, whole=False).select(
        F.col("_metadata.file_path").alias("source_key"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
        "value",
    )
    parsed = F.from_json(
        "value", f"{OUTPUT_SCHEMA}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    )
    lines = lines.where(F.rlike("value", F.lit(r"\S"))).withColumn("p", parsed)
    by_file = F.nullif(F.replace(F.col("p.File"), F.lit(".jsonl"), F.lit("")), F.lit(""))
    own_id = F.coalesce(F.nullif(F.col("p.id"), F.lit("")), by_file)
    entities = normalised_entities(F.col("p.Entities"))
    whole = F.forall(
        entities,
        lambda e: F.coalesce(
            e["type"].isNotNull() & e["score"].isNotNull() & (e["begin"] >= 0) & (e["end"] >= e["begin"]), F.lit(False)
        ),
    )
    reason = (
        F.when(~F.is_valid_utf8("value"), NOT_UTF8)
        .when(strictly_parsed(F.col("value")).isNull(), NOT_JSON)
        .when(F.col("p").isNull() | F.col("p._bad").isNotNull(), NOT_AS_DECLARED)
        .when(own_id.isNull(), NO_ID)
        .when(~whole, BAD_ENTITY)
    )
    good = reason.isNull()
    return lines.select(
        "source_key",
        "block",
        "at",
        F.when(good, own_id).alias("id"),
        F.when(good, entities).alias("entities"),
        reason.alias("reason"),
        F.when(~good, F.col("value")).alias("raw"),
    )


def line_numbers(spark: SparkSession, path: str | Sequence[str], rejects: DataFrame, *, glob: str = "*.out") -> DataFrame:
    """Rejects of `check_detector_output` as ``source_key, position, reason, raw``; lines count from 0.

    Lines are counted per split of a file, as the reader deals them, and only the counts
    and the rejects are joined.
    """
    lines = _files(spark, path, glob, whole=False).select(
        F.col("_metadata.file_path").alias("source_key"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
    )
    blocks = lines.groupBy("source_key", "block").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("source_key").orderBy("block")) - F.col("n")
    blocks = blocks.select("source_key", "block", "first", before.alias("before"))
    position = (F.col("at") - F.col("first") + F.col("before")).alias("position")
    return rejects.join(blocks, ["source_key", "block"]).select("source_key", position, "reason", "raw")


def accepted(df: DataFrame) -> DataFrame:
    return df.where(F.col("reason").isNull()).drop("reason", "raw", "block", "at")


def rejected(df: DataFrame) -> DataFrame:
    """What could not be used, and why."""
    return df.where(F.col("reason").isNotNull())


def counting(df: DataFrame) -> tuple[DataFrame, Observation]:
    """The frame, and what it counts when an action has run over it: ``read, accepted, rejected``."""
    seen = Observation()
    bad = F.col("reason").isNotNull()
    counts: list[Column] = [F.count("*").alias("read"), F.count_if(~bad).alias("accepted"), F.count_if(bad).alias("rejected")]
    return df.observe(seen, *counts), seen
