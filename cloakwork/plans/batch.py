"""The batch path: export lines, have them searched, import the findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakwork.functions import spans
from cloakwork.functions.text import is_text, quoted, text_columns
from cloakwork.operators.entities import metadata_from_lists
from cloakwork.operators.filters import COMPLETE, IN_PROGRESS, is_awaiting_export, within_cap
from cloakwork.operators.keyed import latest_by_id, update_by_id
from cloakwork.policy import Policy
from cloakwork.sinks.exports import LINE_SCHEMA, export_jsonl
from cloakwork.sinks.store import DocumentStore
from cloakwork.sources.detector_output import read_detector_output
from cloakwork.sources.shared import fresh_dir


def to_export(
    df: DataFrame, max_docs: int | None = None, *, key: str = "doc_id", min_chars: int = 20
) -> Column:
    """True for the documents a batch run takes.

    Those that are unscanned, not out already, and have text; at most `max_docs`,
    if that is given.
    """
    has_text = F.lit(False)
    for name in text_columns(df, key):
        has_text = has_text | is_text(quoted(name), min_chars)
    due = is_awaiting_export(df) & has_text
    return due & within_cap(df.where(due), max_docs, key) if max_docs else due


def documents_to_export(
    df: DataFrame, max_docs: int | None = None, *, key: str = "doc_id", min_chars: int = 20
) -> DataFrame:
    return df.where(to_export(df, max_docs, key=key, min_chars=min_chars))


def detect_lines(lines: DataFrame, policy: Policy | None = None) -> DataFrame:
    """Detector output for exported lines: ``id, File, Entities``, unfiltered."""
    policy = policy or Policy()
    entities = F.transform(
        spans.find_entities(F.col("text"), policy.all_rules()),
        lambda e: F.struct(
            e["type"].alias("Type"),
            e["score"].alias("Score"),
            e["begin"].alias("BeginOffset"),
            e["end"].alias("EndOffset"),
        ),
    )
    return lines.select("id", F.concat("id", F.lit(".jsonl")).alias("File"), entities.alias("Entities"))


def import_results(
    target: DataFrame,
    output: DataFrame,
    policy: Policy | None = None,
    *,
    key: str = "doc_id",
    redact_field: str | None = None,
    scanned_at=None,
) -> DataFrame:
    """The target with metadata from detector output; text stays as it is.

    `output` has ``id, entities`` (`read_detector_output`).  Updated rows get
    status ``complete``; ids the target lacks are ignored.  The entities of several
    answers about one id are taken together.  `redact_field` names
    the field the lines were made of, when that was one field alone and whole:
    offsets then fit it, and it is redacted too.
    """
    policy = policy or Policy()
    answers = output.groupBy("id").agg(F.collect_list(F.coalesce("entities", spans.no_entities())).alias("entities"))
    output = answers.select("id", F.array_distinct(F.flatten("entities")).alias("entities"))
    found = metadata_from_lists(F.col("entities"), policy, scanned_at)
    key_type = target.schema[key].dataType
    if redact_field is not None:
        found["__entities"] = spans.filter_entities(F.col("entities"), policy.accepted_types(), policy.threshold)
    updates = output.select(
        F.col("id").try_cast(key_type).alias(key),
        *(column.alias(name) for name, column in found.items()),
        F.lit(COMPLETE).alias("pii_scan_status"),
    ).where(quoted(key).isNotNull())
    # Ids that differ as text may be one key, such as 7 and 07.
    done = update_by_id(target, latest_by_id(updates, key), key)
    if redact_field is None:
        return done
    old, entities = quoted(redact_field), F.col("__entities")
    new = F.when(entities.isNotNull(), spans.redact_spans(old, entities)).otherwise(old)
    return done.withColumn(redact_field, new).drop("__entities")


def import_answers(
    store: DocumentStore, output: DataFrame, policy: Policy | None = None, *, scanned_at=None
) -> int:
    """Log what a detector answered (``id, entities``) as states of a store; returns the run.

    As `import_results`, without reading a text: answers meet the keys of documents only.
    """
    policy = policy or Policy()
    kind = store.documents().schema[store.key].dataType
    known = store.documents().select(quoted(store.key))
    ids = output.select(F.col("id").try_cast(kind).alias(store.key), "entities")
    ids = ids.join(known, store.key, "left_semi")
    answers = ids.groupBy(quoted(store.key)).agg(F.collect_list(F.coalesce("entities", spans.no_entities())).alias("entities"))
    answers = answers.withColumn("entities", F.array_distinct(F.flatten("entities")))
    found = metadata_from_lists(F.col("entities"), policy, scanned_at)
    run = store.next_run()
    store.log(answers.select(quoted(store.key), *(c.alias(n) for n, c in found.items()), F.lit(COMPLETE).alias("pii_scan_status")), run)
    return run


def run_batch(
    store: DocumentStore,
    policy: Policy | None = None,
    max_docs: int | None = None,
    *,
    max_chars: int | None = None,
    work_dir: str | None = None,
    scanned_at=None,
) -> DataFrame | None:
    """Export, detect and import in one job; the store's documents, or None if none is due.

    Each step leaves files the next one reads, so a detector of one's own can take the
    place of `detect_lines`.  Marking documents and importing answers append states; no
    document is written again.  After a failed run `reset_batch` makes its documents due.
    """
    spark, key = store.spark, store.key
    policy = policy or Policy()
    work = work_dir or fresh_dir(spark, "batch")
    start = store.read()
    due = to_export(start, max_docs, key=key, min_chars=policy.min_chars)
    export_jsonl(start.where(due), f"{work}/input", key=key, min_chars=policy.min_chars, max_chars=max_chars)
    lines = spark.read.schema(LINE_SCHEMA).json(f"{work}/input")
    if lines.isEmpty():
        return None
    kind = store.documents().schema[key].dataType
    out = lines.select(F.col("id").cast(kind).alias(key), F.lit(IN_PROGRESS).alias("pii_scan_status"))
    store.log(out, store.next_run())
    detect_lines(lines, policy).write.json(f"{work}/output")
    output = read_detector_output(spark, f"{work}/output", glob="*.json")
    import_answers(store, output, policy, scanned_at=scanned_at)
    return store.read()


def reset_batch(store: DocumentStore, run: int | None = None) -> int:
    """Make documents due again that a batch run took and gave no answer for; how many.

    Of one run, by its number, or of all.
    """
    stuck = store.states().where(F.col("pii_scan_status") == IN_PROGRESS).select(quoted(store.key))
    if run is not None:
        stuck = stuck.join(store.logged(run).select(quoted(store.key)), store.key, "left_semi")
    reset = store.next_run()
    store.log(stuck, reset)
    return store.logged(reset).count()
