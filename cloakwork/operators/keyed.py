"""Changes to a table by document id.

Plain Parquet has no MERGE, so these return the table as it should be;
`sinks.tables` puts it in place.  No join is hinted: Spark broadcasts the update
side when its size allows and otherwise sorts and merges, splitting skewed
partitions.  A table bucketed by its key is not shuffled (`create_index`).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakwork.functions.text import quoted
from cloakwork.operators.filters import COMPLETE, IN_PROGRESS


def _keys(key: str | Sequence[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def latest_by_id(df: DataFrame, key: str | Sequence[str], order: Column | None = None) -> DataFrame:
    """One row per id: the one greatest by `order`.

    An aggregate and not a ranking, so an id with very many rows is reduced
    where it is read.  Equal orders are settled by the other columns.
    """
    keys = _keys(key)
    others = [c for c in df.columns if c not in keys]
    rank = F.lit(0) if order is None else order
    whole = F.struct(rank.alias("__order"), *(quoted(c) for c in others))
    rows = df.select(*(quoted(k) for k in keys), whole.alias("__row"))
    picked = rows.groupBy(*(quoted(k) for k in keys)).agg(F.max("__row").alias("__row"))
    return picked.select(
        *(quoted(c) if c in keys else F.col("__row").getField(c).alias(c) for c in df.columns)
    )


def replace_by_id(target: DataFrame, updates: DataFrame, key: str | Sequence[str] = "doc_id") -> DataFrame:
    """`updates` in place of the target rows with their ids; new ids are added.

    Ids in `updates` must be unique (`latest_by_id`).
    """
    kept = target.join(updates.select(*_keys(key)), _keys(key), "left_anti")
    return kept.unionByName(updates, allowMissingColumns=True)


def update_by_id(
    target: DataFrame,
    updates: DataFrame,
    key: str | Sequence[str] = "doc_id",
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Set the named columns of matching rows; ids the target lacks are ignored.

    Ids in `updates` must be unique.  Columns the target lacks are added, null
    where nothing matches.
    """
    keys = _keys(key)
    columns = list(columns) if columns is not None else [c for c in updates.columns if c not in keys]
    changes = updates.select(
        *(quoted(k) for k in keys),
        F.struct(*(quoted(c) for c in columns)).alias("__new"),
        F.lit(True).alias("__matched"),
    )
    joined = target.join(changes, keys, "left")

    def value(name: str) -> Column:
        old = quoted(name) if name in target.columns else F.lit(None)
        return F.when(F.col("__matched"), F.col("__new").getField(name)).otherwise(old).alias(name)

    names = [*target.columns, *(c for c in columns if c not in target.columns)]
    return joined.select(*(value(n) if n in columns else quoted(n) for n in names))


def _with_status(target: DataFrame, ids: DataFrame, key: str | Sequence[str], status: str) -> DataFrame:
    marks = ids.select(*_keys(key)).distinct().withColumn("pii_scan_status", F.lit(status))
    return update_by_id(target, marks, key, ["pii_scan_status"])


def mark_in_progress(target: DataFrame, ids: DataFrame, key: str | Sequence[str] = "doc_id") -> DataFrame:
    """Note on the rows with these ids that a batch detector has them."""
    return _with_status(target, ids, key, IN_PROGRESS)


def mark_complete(target: DataFrame, ids: DataFrame, key: str | Sequence[str] = "doc_id") -> DataFrame:
    return _with_status(target, ids, key, COMPLETE)
