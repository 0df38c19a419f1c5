"""A table of documents whose scans write only what they change."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cloakwork.functions.text import quoted
from cloakwork.sinks.tables import METADATA_SCHEMA
from cloakwork.sources.shared import fresh_dir

#: Partitions: of documents, the append they came with; of states, the run that wrote them.
PART, RUN = "__part", "__run"
BUCKETS = 16
METADATA = METADATA_SCHEMA.names


class DocumentStore:
    """Documents in one table, what is known of them in another, both clustered by key.

    A run appends narrow rows to the states, one per document it has looked at; the latest
    of a key counts.  Both tables have as many buckets, so documents meet their states, and
    states of a key one another, without an exchange and without sorting texts.  Documents
    are written again only when their text changes, and then the partitions that hold them.

    A key names a document.  Rows of one key share a state; a null key is refused.  One
    writer at a time.  `buckets` should leave the states of a bucket, some 100 bytes a
    document, well within a task's memory.
    """

    def __init__(self, spark: SparkSession, name: str, key: str = "doc_id") -> None:
        self.spark, self.name, self.key = spark, name, key

    @classmethod
    def create(
        cls,
        spark: SparkSession,
        fields: T.StructType,
        *,
        name: str | None = None,
        folder: str | None = None,
        key: str = "doc_id",
        buckets: int = BUCKETS,
    ) -> DocumentStore:
        """A new store in `folder`, or one that the catalog knows by its name."""
        name = name or f"store_{uuid.uuid4().hex}"
        folder = folder or fresh_dir(spark, "store")
        own = [f for f in fields.fields if f.name not in METADATA]
        states = [f for f in own if f.name == key] + METADATA_SCHEMA.fields
        for table, columns, part in ((name, own, PART), (f"{name}_state", states, RUN)):
            listed = ", ".join(f"{_ident(f.name)} {f.dataType.simpleString()}" for f in columns)
            spark.sql(
                f"CREATE TABLE IF NOT EXISTS {_ident(table)} ({listed}, {part} BIGINT) USING parquet "
                f"PARTITIONED BY ({part}) CLUSTERED BY ({_ident(key)}) INTO {int(buckets)} BUCKETS "
                f"LOCATION '{folder}/{'states' if part == RUN else 'documents'}'"
            )
        return cls(spark, name, key)

    @classmethod
    def reopen(cls, spark: SparkSession, fields: T.StructType, folder: str, **more) -> DocumentStore:
        """The store that another session left in `folder`; arguments as for `create`."""
        store = cls.create(spark, fields, folder=folder, **more)
        for table in (store.name, f"{store.name}_state"):
            spark.sql(f"MSCK REPAIR TABLE {_ident(table)}")
        return store

    # -- reading ----------------------------------------------------------------

    def documents(self) -> DataFrame:
        return self.spark.table(_ident(self.name))

    def states(self) -> DataFrame:
        """The latest state of each key that has one."""
        rows = self.spark.table(_ident(f"{self.name}_state"))
        latest = F.max_by(F.struct(*METADATA), RUN).alias("latest")
        return rows.groupBy(quoted(self.key)).agg(latest).select(quoted(self.key), "latest.*")

    def read(self) -> DataFrame:
        """The documents with their metadata."""
        return self.placed().drop(PART)

    def placed(self, parts: Sequence[int] | None = None) -> DataFrame:
        """The same with the partition each document is in; only those given."""
        docs = self.documents() if parts is None else self.documents().where(F.col(PART).isin(list(parts)))
        # Built from the narrow side, so texts are not sorted.
        joined = docs.join(self.states().hint("shuffle_hash"), self.key, "left")
        return joined.select(*(quoted(c) for c in docs.columns if c != PART), *METADATA, PART)

    def places(self) -> DataFrame:
        """Key, partition and metadata of all documents; no other column is read."""
        return self.placed().select(quoted(self.key), PART, *METADATA)

    # -- writing ----------------------------------------------------------------

    def next_run(self) -> int:
        """A number above those of all runs and appends so far."""
        taken = [0]
        for table in (self.name, f"{self.name}_state"):
            listed = self.spark.sql(f"SHOW PARTITIONS {_ident(table)}").collect()
            taken += [int(r[0].split("=")[1]) for r in listed]
        return max(taken) + 1

    def append(self, df: DataFrame) -> int:
        """Add documents, with the metadata they bring; returns their partition."""
        part = self.next_run()
        known = F.coalesce(quoted(self.key), F.raise_error(F.lit(f"a document has no {self.key}")))
        names = [c for c in self.documents().columns if c != PART]
        missing = {c: F.lit(None) for c in names if c not in df.columns}
        rows = df.withColumns({self.key: known, **missing}).select(*(quoted(c) for c in names), F.lit(part).alias(PART))
        # One file per bucket: the only time that texts are moved.
        buckets = int(self._detail("Num Buckets"))
        rows.repartition(buckets, quoted(self.key)).write.insertInto(_ident(self.name))
        if "pii_flag" in df.columns:
            brought = df.withColumns({c: F.lit(None) for c in METADATA if c not in df.columns})
            self.log(brought.where("pii_flag IS NOT NULL OR pii_scan_status IS NOT NULL"), part)
        return part

    def log(self, rows: DataFrame, run: int) -> None:
        """Append the states of a run: the key and the metadata columns of `rows`, a row per key."""
        kinds = {f.name: f.dataType for f in METADATA_SCHEMA.fields}
        values = [
            (F.col(c) if c in rows.columns else F.lit(None)).cast(kind).alias(c) for c, kind in kinds.items()
        ]
        one = rows.select(quoted(self.key), *values).groupBy(quoted(self.key)).agg(F.max(F.struct(*METADATA)).alias("s"))
        one.select(quoted(self.key), "s.*", F.lit(run).alias(RUN)).write.insertInto(_ident(f"{self.name}_state"))

    def logged(self, run: int) -> DataFrame:
        return self.spark.table(_ident(f"{self.name}_state")).where(F.col(RUN) == run).drop(RUN)

    def overwrite(self, df: DataFrame) -> None:
        """Put the rows in place of the partitions they name; `df` must not read the store itself."""
        names = self.documents().columns
        with _dynamic_overwrite(self.spark):
            df.select(*(quoted(c) for c in names)).write.mode("overwrite").insertInto(_ident(self.name))

    def replace(self, updates: DataFrame) -> None:
        """`updates` in place of the documents with their ids, new ids appended; all become unscanned.

        Ids in `updates` must be unique.  Only partitions that hold a replaced document are
        written again.
        """
        key, run = self.key, self.next_run()
        fresh = fresh_dir(self.spark, "store-updates")
        updates.write.parquet(fresh)
        updates = self.spark.read.schema(updates.schema).parquet(fresh)
        ids = updates.select(quoted(key))
        held = self.documents().select(quoted(key), PART).join(ids, key, "left_semi")
        home = held.groupBy(quoted(key)).agg(F.min(PART).alias(PART))
        parts = [r[0] for r in held.select(PART).distinct().collect()]
        if parts:
            touched = self.documents().where(F.col(PART).isin(parts)).join(ids, key, "left_anti")
            staged = fresh_dir(self.spark, "store-staged")
            touched.unionByName(updates.join(home, key), allowMissingColumns=True).write.parquet(staged)
            self.log(home, run)
            self.overwrite(self.spark.read.schema(touched.schema).parquet(staged))
        new = updates.join(self.documents().select(quoted(key)), key, "left_anti")
        self.append(new.drop(*METADATA))

    def _detail(self, name: str) -> str:
        rows = self.spark.sql(f"DESCRIBE FORMATTED {_ident(self.name)}").where(F.col("col_name") == name)
        return rows.first().data_type


def _ident(name: str) -> str:
    return f"`{name.replace('`', '``')}`"


@contextmanager
def _dynamic_overwrite(spark: SparkSession) -> Iterator[None]:
    setting = "spark.sql.sources.partitionOverwriteMode"
    was = spark.conf.get(setting)
    spark.conf.set(setting, "dynamic")
    try:
        yield
    finally:
        spark.conf.set(setting, was)


def is_unfinished(status: Column) -> Column:
    """True for documents whose redaction was begun and not confirmed."""
    return F.coalesce(status == REDACTING, F.lit(False))


REDACTING = "redacting"
