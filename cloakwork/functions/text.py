"""Choosing, joining and cleaning text."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cloakwork.policy import DEFAULT_MIN_CHARS

METADATA_COLUMNS = ("pii_flag", "pii_count", "pii_types", "pii_scanned_at", "pii_scan_status")

# Text form of a scan time; 20 characters long, so never taken for text.
SCANNED_AT_FORMAT = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def quoted(name: str) -> Column:
    """The top-level column `name`, dots and all."""
    return F.col(f"`{name.replace('`', '``')}`")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` computed once, however often `body` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def hold(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """`df` with columns that are computed once, whatever is filtered afterwards.

    The optimizer moves a filter on a projected column below the projection and
    computes the column there a second time, which for a search through every
    text doubles the job.  It does not move filters below a generator, so the
    values pass through one that yields exactly one row.
    """
    values = F.struct(*(value.alias(name) for name, value in columns.items()))
    return df.select("*", F.inline_outer(F.array(values)))


def text_columns(df: DataFrame, key: str | Sequence[str] = (), fields: Sequence[str] | None = None) -> list[str]:
    """Names of the columns that may hold text, in column order.

    String columns other than the key and the scan metadata; `fields` narrows
    the choice.  Nested values are never looked into.
    """
    keys = {key} if isinstance(key, str) else set(key)
    found = [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, T.StringType) and f.name not in keys and f.name not in METADATA_COLUMNS
    ]
    if fields is None:
        return found
    unknown = [f for f in fields if f not in found]
    if unknown:
        raise ValueError(f"not text columns: {unknown}; text columns are {found}")
    return [f for f in found if f in set(fields)]


def is_text(value: Column, min_chars: int = DEFAULT_MIN_CHARS) -> Column:
    """True for strings longer than `min_chars` code points, false for null."""
    return F.coalesce(F.length(value) > min_chars, F.lit(False))


def text_or_null(value: Column, min_chars: int = DEFAULT_MIN_CHARS) -> Column:
    return F.when(F.length(value) > min_chars, value)


def combine_text(names: Sequence[str], min_chars: int = DEFAULT_MIN_CHARS) -> Column:
    """The text fields of a row joined with one space, in the given order."""
    if not names:
        return F.lit("")
    return F.concat_ws(" ", *(text_or_null(quoted(n), min_chars) for n in names))


def object_fields(document: Column) -> Column:
    """The fields of a variant object as ``map<string,variant>``; null for any other value."""
    return F.try_variant_get(document, "$", "map<string,variant>")


def truncate_text(value: Column, max_chars: int | None) -> Column:
    """The first `max_chars` code points; the whole text when it is None."""
    return value if max_chars is None else F.substring(value, 1, max_chars)


def tail_chars(value: Column, max_chars: int | None) -> Column:
    """How many characters a limit of `max_chars` leaves unseen."""
    if max_chars is None:
        return F.lit(0)
    return F.greatest(F.coalesce(F.length(value), F.lit(0)) - max_chars, F.lit(0))


def clean_utf8(raw: Column) -> Column:
    """Bytes as text, without the bytes that are not UTF-8.

    `make_valid_utf8` puts U+FFFD where bytes are wrong.  A U+FFFD that was in
    the input must survive, so it is written as an escape before and restored
    after; U+FDD0, a code point reserved for internal use, leads the escape and
    is itself escaped.
    """
    esc, mark = "\ufdd0", "\ufffd"
    text = raw.cast("string")
    escaped = F.replace(F.replace(text, F.lit(esc), F.lit(esc + "0")), F.lit(mark), F.lit(esc + "1"))
    valid = F.replace(F.make_valid_utf8(escaped), F.lit(mark), F.lit(""))
    restored = F.replace(F.replace(valid, F.lit(esc + "1"), F.lit(mark)), F.lit(esc + "0"), F.lit(esc))
    return F.when(F.is_valid_utf8(text), text).otherwise(restored)


def in_utc(ts: Column) -> Column:
    """A time as the UTC wall clock shows it, whatever the session's zone."""
    return F.to_utc_timestamp(ts, F.current_timezone())


def scanned_at_text(ts: Column) -> Column:
    """A scan time as JSON exports write it, in UTC."""
    return F.date_format(in_utc(ts), SCANNED_AT_FORMAT)
