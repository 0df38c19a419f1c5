"""What the operators of this subpackage share: tables, staged results, column names."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

import cloakwork
from cloakwork.sources.shared import fresh_dir


def let_workers_import(spark: SparkSession) -> None:
    """Add this package's place to the path of Python workers, for where it isn't installed."""
    root = str(Path(cloakwork.__file__).resolve().parent.parent)
    path = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in path.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, (path, root)))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    let_workers_import(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def staged(df: DataFrame, purpose: str) -> DataFrame:
    """The rows written once to the shared folder and read again.

    Cuts lineage: what follows is computed from the files, also after an executor
    is lost.
    """
    path = fresh_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, base: str) -> str:
    """A column name that the frame does not have yet."""
    taken = {name.lower() for name in df.columns}
    while base.lower() in taken:
        base = f"_{base}"
    return base


def with_struct(df: DataFrame, value: Column, fields: dict[str, str]) -> DataFrame:
    """The frame with fields of one computed struct as columns, which replace columns so named.

    `fields` names the column for each field.  The struct is computed once.
    """
    name = free_name(df, "computed")
    gone = {column.lower() for column in fields.values()}
    held = df.withColumn(name, value)
    return held.select(
        *(held[f"`{c}`"] for c in df.columns if c.lower() not in gone),
        *(held[name][field].alias(column) for field, column in fields.items()),
    )


def smallest_by_hash(df: DataFrame, n: int, key: str, per: str | None = None, seed: int = 42) -> DataFrame:
    """Up to `n` rows (of each value of `per`) in the order of a hash of the key.

    With `per`, whose values must be few, rows over a bound of the hash that some 2n
    rows of a value are under are left out first, so a value that most rows have sends
    no more rows to its task than another.  Null values of `per` have no rows.
    """
    at, rank, bound = free_name(df, "hash"), free_name(df, "rank"), free_name(df, "bound")
    hashed = df.withColumn(at, F.xxhash64(F.col(key).cast("string"), F.lit(seed)))
    if per is None:
        return hashed.orderBy(at, key).limit(n).drop(at)
    share = F.least(F.lit(1.0), F.lit(2.0 * n + 100) / F.count("*"))
    bounds = df.groupBy(F.col(per).alias(bound)).agg(share.alias("share"))
    placed = F.pmod(F.col(at), F.lit(1 << 31)) / F.lit(float(1 << 31))
    under = hashed.join(F.broadcast(bounds), F.col(per) == F.col(bound)).where(placed <= F.col("share"))
    window = Window.partitionBy(per).orderBy(at, key)
    ranked = under.select(*(hashed[f"`{c}`"] for c in hashed.columns), F.row_number().over(window).alias(rank))
    return ranked.where(F.col(rank) <= n).drop(at, rank)
