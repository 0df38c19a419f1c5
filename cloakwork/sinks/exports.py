"""Hand-over files, audit trail and split writes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakwork.functions.text import combine_text, quoted, text_columns, truncate_text
from cloakwork.operators.filters import route_by_sensitivity
from cloakwork.operators.reports import audit_rows
from cloakwork.policy import DEFAULT_MIN_CHARS, SENSITIVE_TYPES, Policy

LINES_PER_FILE = 1_000
LINE_SCHEMA = "id string, text string"


def export_lines(
    df: DataFrame,
    *,
    key: str = "doc_id",
    fields: Sequence[str] | None = None,
    min_chars: int = DEFAULT_MIN_CHARS,
    max_chars: int | None = None,
) -> DataFrame:
    """One JSON line ``{"id", "text"}`` per document that has text.

    `max_chars` cuts the combined text for detectors that take no more
    (`policy.REMOTE_EXPORT_CHARS`).
    """
    combined = combine_text(text_columns(df, key, fields), min_chars)
    rows = df.select(quoted(key).cast("string").alias("id"), truncate_text(combined, max_chars).alias("text"))
    return rows.where(F.col("text") != "").select(F.to_json(F.struct("id", "text")).alias("value"))


def export_jsonl(
    df: DataFrame,
    path: str,
    *,
    key: str = "doc_id",
    fields: Sequence[str] | None = None,
    min_chars: int = DEFAULT_MIN_CHARS,
    max_chars: int | None = None,
    lines_per_file: int = LINES_PER_FILE,
) -> None:
    """Write `export_lines` as text files of at most `lines_per_file` lines."""
    lines = export_lines(df, key=key, fields=fields, min_chars=min_chars, max_chars=max_chars)
    lines.write.option("maxRecordsPerFile", lines_per_file).text(path)


def audit_log(df: DataFrame, path: str, policy: Policy | None = None, *, key: str = "doc_id") -> None:
    """Append `audit_rows` to a table partitioned by scan date."""
    audit_rows(df, policy, key=key).write.mode("append").partitionBy("scan_date").parquet(path)


def dual_write(original: DataFrame, redacted: DataFrame, restricted_path: str, shared_path: str) -> None:
    """Originals to a restricted table, redacted documents to a shared one.

    Two appends over one lineage.  The input is read twice rather than cached:
    keeping every text around costs more than reading it again.
    """
    original.write.mode("append").parquet(restricted_path)
    redacted.write.mode("append").parquet(shared_path)


def write_routes(df: DataFrame, path: str, sensitive: Sequence[str] = SENSITIVE_TYPES) -> None:
    """Write each route's documents to a folder of its own."""
    route_by_sensitivity(df, sensitive).write.mode("append").partitionBy("route").parquet(path)
