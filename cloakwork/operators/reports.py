"""Counts, breakdowns and top lists over a scanned table.

Aggregates are combined before the shuffle, so a value that holds a third of all
rows sends one row per task like any other.  Only the metadata columns are read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cloakwork.functions.text import combine_text, in_utc, quoted, tail_chars, text_columns, truncate_text
from cloakwork.operators.filters import flagged, high_risk, preview
from cloakwork.operators.scan import contains_pii
from cloakwork.policy import Policy

# Price of one unit of text, in USD, and the size of a unit.
UNIT_CHARS = 100
TIER1_PRICE = 0.000025
TIER2_PRICE = 0.0001
BATCH_PRICE = 0.00005


def count_all(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("total"))


def coverage(df: DataFrame) -> DataFrame:
    """Total, scanned and flagged documents, in one pass."""
    return df.agg(
        F.count("*").alias("total"),
        F.count("pii_flag").alias("scanned"),
        F.count_if(F.col("pii_flag")).alias("flagged"),
    )


def run_summary(df: DataFrame) -> DataFrame:
    """What a run did, over the rows it wrote."""
    return df.agg(F.count("*").alias("scanned"), F.count_if(F.col("pii_flag")).alias("flagged"))


def type_breakdown(df: DataFrame, k: int | None = 20) -> DataFrame:
    """Documents per entity type, the `k` most frequent (None: all); equal counts by type name."""
    # The outer form: the plain one has the optimizer test every array beforehand.
    types = df.select(F.explode_outer("pii_types").alias("type")).where(F.col("type").isNotNull())
    counts = types.groupBy("type").agg(F.count("*").alias("docs")).orderBy(F.desc("docs"), "type")
    return counts if k is None else counts.limit(k)


def status_breakdown(df: DataFrame) -> DataFrame:
    """Documents per flag value; documents without a flag are in no group."""
    return df.where(F.col("pii_flag").isNotNull()).groupBy("pii_flag").agg(F.count("*").alias("docs"))


def scanned_per_day(df: DataFrame, ts: str = "pii_scanned_at", fill_gaps: bool = False) -> DataFrame:
    """Documents scanned per UTC day; with `fill_gaps`, days without any show zero."""
    # A time without a zone is taken as it is.
    zoned = isinstance(df.schema[ts].dataType, T.TimestampType)
    day = F.to_date(in_utc(quoted(ts)) if zoned else quoted(ts))
    daily = (
        df.where(quoted(ts).isNotNull())
        .groupBy(day.alias("day"))
        .agg(F.count("*").alias("docs"))
    )
    if not fill_gaps:
        return daily
    span = daily.agg(F.min("day").alias("first"), F.max("day").alias("last"))
    days = span.where(F.col("first").isNotNull()).select(
        F.explode(F.sequence("first", "last")).alias("day")
    )
    return days.join(daily, "day", "left").select("day", F.coalesce("docs", F.lit(0)).alias("docs"))


def scan_rate(
    df: DataFrame, ts: str = "pii_scanned_at", flag: str = "pii_flag", window: str = "1 hour"
) -> DataFrame:
    """Documents scanned and share flagged per time window."""
    return (
        df.where(quoted(ts).isNotNull())
        .groupBy(F.window(quoted(ts), window).alias("w"))
        .agg(F.count("*").alias("docs"), F.avg(quoted(flag).cast("int")).alias("flagged_share"))
        .select(F.col("w.start").alias("window_start"), "docs", "flagged_share")
    )


def units(text: Column) -> Column:
    """Started units of text."""
    return F.ceil(F.length(text) / F.lit(UNIT_CHARS)).cast("long")


def scan_units_report(
    df: DataFrame,
    policy: Policy | None = None,
    *,
    key: str | Sequence[str] = "doc_id",
    fields: Sequence[str] | None = None,
    tier1_price: float = TIER1_PRICE,
    tier2_price: float = TIER2_PRICE,
) -> DataFrame:
    """Text volume per tier, its price, and what the first tier saves.

    Tier 1 reads every combined text.  Tier 2 reads the fields of the documents
    tier 1 lets through; without tier 1 it would read those of all.
    """
    policy = policy or Policy()
    names = text_columns(df, key, fields)
    combined = truncate_text(combine_text(names, policy.min_chars), policy.max_chars)
    per_field = [
        F.when(
            F.length(quoted(n)) > policy.min_chars,
            units(truncate_text(quoted(n), policy.max_chars)),
        ).otherwise(F.lit(0))
        for n in names
    ]
    all_fields = sum(per_field[1:], per_field[0]) if per_field else F.lit(0)
    row = df.select(combined.alias("combined"), all_fields.cast("long").alias("tier2_if_all")).select(
        units(F.col("combined")).alias("tier1"),
        "tier2_if_all",
        F.when(contains_pii(F.col("combined"), policy), F.col("tier2_if_all"))
        .otherwise(F.lit(0))
        .alias("tier2"),
    )
    total = row.agg(
        *(F.coalesce(F.sum(c), F.lit(0)).alias(f"{c}_units") for c in ("tier1", "tier2", "tier2_if_all"))
    )
    cost = F.col("tier1_units") * tier1_price + F.col("tier2_units") * tier2_price
    full = F.col("tier2_if_all_units") * tier2_price
    return total.select(
        "tier1_units",
        "tier2_units",
        "tier2_if_all_units",
        F.round(cost, 6).alias("cost"),
        F.round(full, 6).alias("cost_without_tier1"),
        F.round(F.when(full > 0, 1 - cost / full), 6).alias("saved_share"),
    )


def view_flagged(
    df: DataFrame, limit: int = 10, *, key: str = "doc_id", fields: int = 2, chars: int = 120
) -> DataFrame:
    """The newest flagged documents with the beginnings of their texts.

    Previews are cut before the sort: what each task hands on is a few short
    strings per row and never a whole text.
    """
    short = flagged(df).select(
        quoted(key), "pii_types", "pii_count", "pii_scanned_at", preview(df, key, fields, chars).alias("preview")
    )
    return short.orderBy(F.desc("pii_scanned_at"), quoted(key)).limit(limit)


def top_risk(df: DataFrame, k: int = 20, n: int = 3, *, key: str = "doc_id") -> DataFrame:
    """The documents with most entities, of those with at least `n`."""
    risky = high_risk(df, n).select(quoted(key), "pii_count", "pii_types", "pii_scanned_at")
    return risky.orderBy(F.desc("pii_count"), quoted(key)).limit(k)


def audit_rows(
    df: DataFrame,
    policy: Policy | None = None,
    *,
    key: str | Sequence[str] = "doc_id",
) -> DataFrame:
    """One row per scanned document: key, findings and time, never a value.

    ``tail_chars`` counts what the policy's `max_chars` left unscanned.
    """
    policy = policy or Policy()
    keys = [key] if isinstance(key, str) else list(key)
    tails = [tail_chars(quoted(n), policy.max_chars) for n in text_columns(df, keys)]
    tail = F.lit(0) if policy.max_chars is None or not tails else sum(tails[1:], tails[0])
    return df.where(F.col("pii_flag").isNotNull()).select(
        *(quoted(k) for k in keys),
        "pii_flag",
        "pii_types",
        "pii_count",
        "pii_scanned_at",
        tail.cast("long").alias("tail_chars"),
        F.to_date(in_utc(F.col("pii_scanned_at"))).alias("scan_date"),
    )
