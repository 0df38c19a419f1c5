"""Jobs that scan a table or files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cloakwork.functions.text import quoted
from cloakwork.operators.filters import cap_documents, numbered, unscanned, within_cap
from cloakwork.operators.ragged import scan_ragged_documents
from cloakwork.operators.reports import coverage, run_summary, type_breakdown, view_flagged
from cloakwork.operators.scan import scan_documents
from cloakwork.policy import Policy
from cloakwork.sinks.store import PART, REDACTING, DocumentStore, is_unfinished
from cloakwork.sinks.tables import METADATA_SCHEMA, append_documents, overwrite_partitions
from cloakwork.sources.checked import REJECT_COLUMNS, accepted, check_json_documents, counting, rejected
from cloakwork.sources.documents import read_json_documents
from cloakwork.sources.shared import fresh_dir

# Fixed value: documents of one round of a bounded scheduled run.
SCHEDULED_BATCH = 25
ROW_NUMBER, DUE, BEFORE = "__row", "__due", "__before"


def with_metadata(df: DataFrame) -> DataFrame:
    """`df` with null metadata columns where it has none: nothing is scanned yet."""
    return df.withColumns(
        {f.name: F.lit(None).cast(f.dataType) for f in METADATA_SCHEMA.fields if f.name not in df.columns}
    )


def scan_pending(
    df: DataFrame,
    policy: Policy | None = None,
    max_docs: int | None = None,
    *,
    key: str | Sequence[str] = "doc_id",
    fields: Sequence[str] | None = None,
    scanned_at=None,
) -> DataFrame:
    """The whole table with its unscanned documents scanned, at most `max_docs`.

    Reading, scanning and writing back by id would join.  Here scanned and
    unscanned rows sit in the same splits, so a projection with a condition does
    all of it.  Exactly `max_docs` are scanned if there are so many, also where keys
    repeat: rows are told apart by where they are read.
    """
    due = F.col("pii_flag").isNull()
    if not max_docs:
        return scan_documents(df, policy, key=key, fields=fields, scanned_at=scanned_at, only=due)
    keys = [key] if isinstance(key, str) else list(key)
    rows = numbered(df, ROW_NUMBER)
    due = due & within_cap(unscanned(rows), max_docs, [*keys, ROW_NUMBER])
    return scan_documents(rows, policy, key=key, fields=fields, scanned_at=scanned_at, only=due).drop(ROW_NUMBER)


def scan_unscanned(
    store: DocumentStore,
    policy: Policy | None = None,
    max_docs: int | None = None,
    *,
    scanned_at=None,
) -> DataFrame:
    """Scan a store's unscanned documents; returns the run's summary, one row ``scanned, flagged``.

    A run that only flags reads the texts of partitions with unscanned documents and appends
    states.  One that redacts also writes those partitions again: the rows are staged, their
    states are logged as unfinished, the partitions are replaced, and the states are confirmed.
    After a failure the next run finishes the redaction and keeps what was found before.
    """
    policy = policy or Policy()
    spark, key = store.spark, store.key
    pending = F.col("pii_flag").isNull() | is_unfinished(F.col("pii_scan_status"))
    places = store.places().where(pending)
    if max_docs:
        keys = places.select(quoted(key)).distinct()
        pending = pending & within_cap(keys, max_docs, key)
        places = places.where(pending)
    parts = [r[0] for r in places.select(PART).distinct().collect()]
    if not parts:
        return run_summary(store.states().limit(0))
    run = store.next_run()
    rows = store.placed(parts).withColumn(DUE, pending)
    before = F.when(is_unfinished(F.col("pii_scan_status")), F.struct("pii_flag", "pii_count", "pii_types", "pii_scanned_at"))
    rows = rows.withColumn(BEFORE, before)
    scanned = scan_documents(rows, policy, key=key, scanned_at=scanned_at, only=F.col(DUE))
    if not policy.redacts:
        store.log(_kept(scanned.where(DUE)), run)
        return run_summary(store.logged(run))
    folder = fresh_dir(spark, "store-staged")
    scanned.write.parquet(folder)
    staged = spark.read.schema(scanned.schema).parquet(folder)
    done = _kept(staged.where(DUE))
    store.log(done.withColumn("pii_scan_status", F.lit(REDACTING)), run)
    store.overwrite(staged)
    store.log(done, run + 1)
    return run_summary(store.logged(run + 1))


def _kept(scanned: DataFrame) -> DataFrame:
    """The scanned rows, with the metadata of an unfinished run where there was one."""
    names = ("pii_flag", "pii_count", "pii_types", "pii_scanned_at")
    values = {n: F.when(F.col(BEFORE).isNotNull(), F.col(BEFORE)[n]).otherwise(F.col(n)) for n in names}
    return scanned.withColumns({**values, "pii_scan_status": F.lit(None).cast("string")})


def scan_unscanned_partitions(
    spark: SparkSession,
    path: str,
    partition_by: str,
    policy: Policy | None = None,
    max_docs: int | None = None,
    *,
    key: str | Sequence[str] = "doc_id",
    scanned_at=None,
) -> int:
    """Scan a partitioned table in place, rewriting only partitions that need it.

    Returns how many partitions were rewritten.
    """
    table = spark.read.parquet(path)
    due = cap_documents(unscanned(table), max_docs, key)
    # One row per partition directory; finding them reads keys and flags only.
    parts = due.select(quoted(partition_by).alias("__part")).distinct()
    count = parts.count()
    if count:
        # Holds every document due, so the cap falls on the same ones again.  Broadcast: a
        # shuffle would bring a partition's texts to one task.
        touched = table.join(F.broadcast(parts), quoted(partition_by).eqNullSafe(F.col("__part")), "left_semi")
        scanned = scan_pending(touched, policy, max_docs, key=key, scanned_at=scanned_at)
        overwrite_partitions(scanned, path, [partition_by])
    return count


def scheduled_scan(
    store: DocumentStore,
    policy: Policy | None = None,
    *,
    rounds: int | None = None,
    batch: int = SCHEDULED_BATCH,
    scanned_at=None,
) -> DataFrame:
    """A scheduled run over all unscanned documents.

    With `rounds` a bounded one: at most `rounds` times `batch`, the rest next time.
    """
    most = None if rounds is None else rounds * batch
    return scan_unscanned(store, policy, most, scanned_at=scanned_at)


def process_file(
    spark: SparkSession,
    path: str | Sequence[str],
    schema: T.StructType | str,
    table: str,
    policy: Policy | None = None,
    *,
    key: str = "doc_id",
    scanned_at=None,
) -> DataFrame:
    """Read JSON documents, scan them, append them to a table; returns the summary.

    The rows are counted as they are written, so no text is searched a second time.
    """
    documents = read_json_documents(spark, path, schema)
    scanned = scan_documents(documents, policy, key=key, scanned_at=scanned_at)
    seen = Observation()
    counts = (F.count("*").alias("scanned"), F.count_if(F.col("pii_flag")).alias("flagged"))
    append_documents(scanned.observe(seen, *counts), table, key)
    return spark.createDataFrame([(seen.get["scanned"], seen.get["flagged"])], "scanned long, flagged long")


def process_ragged_files(
    spark: SparkSession,
    path: str | Sequence[str],
    table: str,
    rejects: str,
    policy: Policy | None = None,
    *,
    glob: str | None = None,
    scanned_at=None,
) -> DataFrame:
    """Scan JSON documents of any shape and append them to a table; what is malformed goes to `rejects`.

    Both are folders of Parquet files.  Returns the summary, one row ``read, scanned,
    flagged, rejected``, counted while the documents are written.
    """
    every = check_json_documents(spark, path, glob=glob)
    counted, seen = counting(every)
    found = Observation()
    scanned = scan_ragged_documents(accepted(counted), policy, scanned_at=scanned_at)
    scanned = scanned.observe(found, F.count("*").alias("scanned"), F.count_if(F.col("pii_flag")).alias("flagged"))
    scanned.write.mode("append").parquet(table)
    rejected(every).select(*REJECT_COLUMNS).write.mode("append").parquet(rejects)
    row = (seen.get["read"], found.get["scanned"], found.get["flagged"], seen.get["rejected"])
    return spark.createDataFrame([row], "read long, scanned long, flagged long, rejected long")


def coverage_report(
    store: DocumentStore, policy: Policy | None = None, *, limit: int = 10, scanned_at=None
) -> dict[str, DataFrame]:
    """Coverage, a scan, coverage again, then what was found."""
    spark = store.spark
    before = spark.createDataFrame([tuple(coverage(store.places()).first())], "total long, scanned long, flagged long")
    scan_unscanned(store, policy, scanned_at=scanned_at)
    after = store.read()
    return {
        "before": before,
        "after": coverage(store.places()),
        "types": type_breakdown(store.places(), None),
        "flagged": view_flagged(after, limit, key=store.key),
    }
