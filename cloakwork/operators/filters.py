"""Row choices over a scanned table.

All of these read the metadata columns only, so over Parquet the text columns of
rows that do not qualify are not decoded when the writer clustered by them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakwork.functions.text import quoted, text_columns, text_or_null
from cloakwork.policy import DEFAULT_MIN_CHARS, SENSITIVE_TYPES
from cloakwork.sources.shared import ensure_checkpoint_dir

IN_PROGRESS = "in_progress"
COMPLETE = "complete"

# The n-th key is looked for among so many at most.
KEYS_PER_RANGE = 1_000_000


def unscanned(df: DataFrame) -> DataFrame:
    """Documents no scan has looked at."""
    return df.where(F.col("pii_flag").isNull())


def scanned(df: DataFrame) -> DataFrame:
    return df.where(F.col("pii_flag").isNotNull())


def flagged(df: DataFrame) -> DataFrame:
    """Documents a scan found something in."""
    return df.where(F.col("pii_flag"))


def is_awaiting_export(df: DataFrame) -> Column:
    """True for unscanned documents that are not already out with a batch detector."""
    due = F.col("pii_flag").isNull()
    if "pii_scan_status" not in df.columns:
        return due
    return due & F.coalesce(F.col("pii_scan_status") != IN_PROGRESS, F.lit(True))


def awaiting_export(df: DataFrame) -> DataFrame:
    return df.where(is_awaiting_export(df))


def _literals(values: Sequence[str]) -> Column:
    return F.array(*(F.lit(v) for v in values))


def with_any_type(df: DataFrame, types: Sequence[str]) -> DataFrame:
    """Flagged documents holding at least one of `types`."""
    return flagged(df).where(F.arrays_overlap("pii_types", _literals(types)))


def shared_types(types: Sequence[str], column: str = "pii_types") -> Column:
    """Which of `types` a document holds, sorted."""
    return F.array_sort(F.array_intersect(F.col(column), _literals(types)))


def high_risk(df: DataFrame, n: int = 3, by: str = "entities") -> DataFrame:
    """Documents with at least `n` entities, or with ``by="types"`` distinct types."""
    if by not in ("entities", "types"):
        raise ValueError("by must be 'entities' or 'types'")
    return df.where((F.col("pii_count") if by == "entities" else F.size("pii_types")) >= n)


def route(sensitive: Sequence[str] = SENSITIVE_TYPES) -> Column:
    """``restricted``, ``standard`` or ``open`` by the types a document holds."""
    return (
        F.when(F.arrays_overlap("pii_types", _literals(sensitive)), "restricted")
        .when(F.col("pii_flag"), "standard")
        .otherwise("open")
    )


def route_by_sensitivity(df: DataFrame, sensitive: Sequence[str] = SENSITIVE_TYPES) -> DataFrame:
    return df.withColumn("route", route(sensitive))


def preview(
    df: DataFrame,
    key: str | Sequence[str] = "doc_id",
    fields: int = 2,
    chars: int = 120,
    min_chars: int = DEFAULT_MIN_CHARS,
) -> Column:
    """The beginnings of a document's first text fields, as ``name: text...``."""
    shown = [
        F.when(
            text_or_null(quoted(name), min_chars).isNotNull(),
            F.concat(F.lit(f"{name}: "), F.substring(quoted(name), 1, chars), F.lit("...")),
        )
        for name in text_columns(df, key)
    ]
    if not shown:
        return F.array().cast("array<string>")
    return F.slice(F.array_compact(F.array(*shown)), 1, fields)


def cap_documents(df: DataFrame, max_docs: int | None, key: str | Sequence[str] = "doc_id") -> DataFrame:
    """The first `max_docs` documents by key, nulls first; all of them for 0 or None.

    Only keys are sorted: the key that the last document has is found first, and
    documents are then taken by comparing with it.  Of several documents with that key
    any are taken, as many as fit.
    """
    if not max_docs:
        return df
    ordered, last, before, upto = _place_of(df, max_docs, key)
    if upto <= max_docs:
        return df.where(ordered <= last)
    return df.where(ordered < last).unionByName(df.where(ordered == last).limit(max_docs - before))


def numbered(df: DataFrame, column: str) -> DataFrame:
    """The rows of a table with a number of their own, the same whenever the table's files are read.

    The number counts rows where they are read, so nothing is shuffled, and filters that
    come after it do not change it.
    """
    return df.withColumn(column, F.monotonically_increasing_id())


def within_cap(df: DataFrame, max_docs: int, key: str | Sequence[str] = "doc_id") -> Column:
    """True for the rows `cap_documents` takes, as a condition.

    A condition cannot tell rows of one key apart, so the key has to be unique for the cap
    to be exact; else the rows of the last key are taken if all of them fit, or if there is
    no smaller key (for a run must get on).  `numbered` makes any key unique.
    """
    ordered, last, before, upto = _place_of(df, max_docs, key)
    taken = ordered <= last if upto <= max_docs or not before else ordered < last
    return F.coalesce(taken, F.lit(False))


def _place_of(df: DataFrame, n: int, key: str | Sequence[str]) -> tuple[Column, Column, int, int]:
    """The keys as a column, the n-th smallest of them (or the largest, if there are fewer), and how many
    keys are smaller than it, and not greater.

    Range-partitions the keys, counts each range, and ranks only inside the range the
    n-th key falls in; the same for every n.  The checkpoint pins the ranges: they come
    from sampling and must not move between the reads.
    """
    keys = [key] if isinstance(key, str) else list(key)
    # A struct orders null keys as well.
    ordered = F.struct(*(quoted(k) for k in keys))
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n // KEYS_PER_RANGE + 1)
    ids = df.select(ordered.alias("k")).repartitionByRange(shards, "k")
    ranged = ids.withColumn("shard", F.spark_partition_id()).checkpoint()
    counts = [(r.shard, r["count"]) for r in ranged.groupBy("shard").count().orderBy("shard").collect()]
    if not counts:
        # No key is smaller than the null one, and nothing is taken either way.
        return ordered, F.lit(None).cast(df.select(ordered.alias("k")).schema["k"].dataType), 0, 0
    before = 0
    for shard, count in counts[:-1]:
        if before + count >= n:
            break
        before += count
    else:
        shard = counts[-1][0]
    inside = ranged.where(F.col("shard") == shard)
    last = inside.orderBy("k").limit(max(1, n - before)).agg(F.max("k").alias("k"))
    # A scalar subquery: one value, found before the documents are read.
    found = last.scalar()
    sides = inside.agg(F.count_if(F.col("k") < found).alias("less"), F.count_if(F.col("k") <= found).alias("upto")).first()
    return ordered, found, before + sides["less"], before + sides["upto"]
