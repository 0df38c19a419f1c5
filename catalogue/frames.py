"""Registered queries, one function per entry.

Each takes a session and a folder of Parquet tables and returns a DataFrame over
whole tables.  Arrays come back joined with commas, times as text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakwork import corpus
from cloakwork.functions import spans
from cloakwork.functions.language import detect_language
from cloakwork.functions.text import (
    clean_utf8,
    combine_text,
    scanned_at_text,
    tail_chars,
    text_columns,
    truncate_text,
)
from cloakwork.operators import entities as ents
from cloakwork.operators import filters, keyed, ragged, reports, scan
from cloakwork.plans import batch, scans
from cloakwork.policy import (
    FLAG,
    PRESETS,
    REMOTE_EXPORT_CHARS,
    REMOTE_LANGUAGE_CHARS,
    REMOTE_SCAN_CHARS,
    Policy,
)
from cloakwork.rules import FIRST_NAMES, Rule
from cloakwork.sinks import exports, tables
from cloakwork.sinks.store import PART, DocumentStore
from cloakwork.sources import checked, detector_output, documents
from cloakwork.sources.shared import fresh_dir, spread, spread_rows
from cloakwork.streaming import stream_new_documents, stream_scan, stream_table, stream_to_index
from cloakwork.streaming.index import stream_dual_write

SCANNED_AT = "2025-05-15T01:30:00Z"
# The e-mail, phone and card rules cover the personal data in `documents`.
DOCUMENT_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


def joined(column: str) -> Column:
    return F.array_join(column, ",").alias(column)


def when_scanned() -> Column:
    """A scan time per document, spread by text length."""
    return F.timestamp_seconds(F.lit(1_747_272_600) + F.col("n_chars"))


def scanned_docs(spark: SparkSession, sf_dir: str, mode: str = FLAG) -> DataFrame:
    return scan.scan_documents(docs(spark, sf_dir), Policy(mode=mode), scanned_at=when_scanned())


def partly_scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, the English ones not yet scanned."""
    return scan.scan_documents(
        scans.with_metadata(docs(spark, sf_dir)),
        Policy(mode=FLAG),
        scanned_at=when_scanned(),
        only=F.col("lang") != "en",
    )


def metadata(df: DataFrame, *extra: str) -> DataFrame:
    return df.select("doc_id", *extra, "pii_flag", "pii_count", joined("pii_types"))


def state(df: DataFrame, *extra: str) -> DataFrame:
    """Metadata of a table some of whose documents are unscanned, without nulls."""
    columns = [
        F.coalesce(F.col("pii_flag").cast("string"), F.lit("unscanned")).alias("pii_flag"),
        F.coalesce("pii_count", F.lit(-1)).alias("pii_count"),
        F.coalesce(F.array_join("pii_types", ","), F.lit("")).alias("pii_types"),
    ]
    if "pii_scan_status" in df.columns:
        columns.append(F.coalesce("pii_scan_status", F.lit("none")).alias("pii_scan_status"))
    return df.select("doc_id", *extra, *columns)


def generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document with known content for every order."""
    keys = spread_rows(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id")))
    return corpus.generate_documents(keys)


def supplier_documents(spark: SparkSession, sf_dir: str, seed: int = 0, offset: int = 0) -> DataFrame:
    keys = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("doc_id"))
    made = corpus.generate_documents(keys, seed=seed)
    return made.select((F.col("doc_id") + offset).alias("doc_id"), "title", "body")


FILE_SCHEMA = "doc_id long, title string, body string"
SECOND_OFFSET = 10_000_000


#: Keys of a file's documents; the files grow in number with the tables.
KEYS_PER_FILE = 100
#: Files that one task writes.
FILES_PER_TASK = 250


def file_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, pair`` for every supplier, an array of two generated documents."""
    first = supplier_documents(spark, sf_dir)
    second = supplier_documents(spark, sf_dir, seed=1).toDF("doc_id", "title2", "body2")
    pair = F.array(
        F.struct("doc_id", "title", "body"),
        F.struct(
            (F.col("doc_id") + SECOND_OFFSET).alias("doc_id"),
            F.col("title2").alias("title"),
            F.col("body2").alias("body"),
        ),
    )
    return first.join(second, "doc_id").select("doc_id", pair.alias("pair"))


def supplier_tasks(spark: SparkSession, sf_dir: str, keys_per_task: int) -> int:
    """A task for so many suppliers, one per core at least."""
    keys = table(spark, sf_dir, "supplier").count()
    return max(spark.sparkContext.defaultParallelism, -(-keys // keys_per_task))


def write_small_files(spark: SparkSession, lines: DataFrame, path: str, tasks: int) -> str:
    """A file for every row, written by many tasks at once.

    On a local disk Hadoop starts a process for each mode it sets, of files and of checksum
    files.  These are scratch files without checksums, and tasks move their own into place.
    """
    writer = lines.repartition(tasks).write.option("maxRecordsPerFile", 1)
    writer = writer.option("mapreduce.fileoutputcommitter.algorithm.version", 2)
    writer = writer.option("fs.file.impl", "org.apache.hadoop.fs.RawLocalFileSystem")
    writer.option("fs.file.impl.disable.cache", True).text(path)
    return path


def write_pair_files(spark: SparkSession, sf_dir: str) -> str:
    """A JSON file for every supplier, an array of two generated documents."""
    lines = file_pairs(spark, sf_dir).select(F.to_json("pair"))
    return write_small_files(spark, lines, fresh_dir(spark, "json-files"), supplier_tasks(spark, sf_dir, FILES_PER_TASK))


def write_json_files(spark: SparkSession, sf_dir: str) -> str:
    """JSON files, each an array of two generated documents for every supplier of a range of keys."""
    pairs = file_pairs(spark, sf_dir).withColumn("file", F.floor(F.col("doc_id") / KEYS_PER_FILE))
    tasks = supplier_tasks(spark, sf_dir, KEYS_PER_FILE * FILES_PER_TASK)
    files = pairs.repartition(tasks, "file").groupBy("file").agg(F.flatten(F.collect_list("pair")).alias("rows"))
    path = fresh_dir(spark, "json-files")
    files.select(F.to_json("rows")).write.option("maxRecordsPerFile", 1).text(path)
    return path


def label_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two outside entities for every label, scored by what the label says."""

    def one(kind: str, score: Column, begin: int, end: int) -> Column:
        return F.struct(
            F.lit(kind).alias("type"), score.alias("score"), F.lit(begin).alias("begin"), F.lit(end).alias("end")
        )

    both = F.array(
        one("NAME", 0.5 + 0.4 * F.col("quality"), 0, 10),
        one("SSN", 0.4 + 0.5 * F.col("toxic"), 20, 25),
    )
    return table(spark, sf_dir, "labels").select("doc_id", both.alias("entities"))


def label_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as rows."""
    answers = label_answers(spark, sf_dir)
    return answers.select("doc_id", F.lit("text").alias("field"), F.inline("entities"))


def as_lines(entities: str | Column) -> Column:
    return F.array_join(
        F.transform(entities, lambda e: F.concat_ws(":", e["type"], e["begin"].cast("string"), e["end"].cast("string"))),
        ",",
    )


def by_policy() -> dict[str, Policy]:
    return {
        "en": Policy(types=["EMAIL", "PHONE"]),
        "fr": Policy(types=["CREDIT_DEBIT_NUMBER"], threshold=0.8),
        "de": PRESETS["financial_only"].with_options(mode=FLAG),
    }


# -- sources ------------------------------------------------------------------


@query
def scan_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = documents.scan_index(spark, f"{sf_dir}/documents.parquet")
    return index.select("doc_id", "text", "lang", "source", "n_chars")


@query
def read_json_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = write_json_files(spark, sf_dir)
    return documents.read_json_documents(spark, path, FILE_SCHEMA)


@query
def read_raw_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    bodies, tasks = supplier_documents(spark, sf_dir).select("body"), supplier_tasks(spark, sf_dir, FILES_PER_TASK)
    path = write_small_files(spark, bodies, fresh_dir(spark, "raw-files"), tasks)
    return documents.read_raw_documents(spark, path).select("body")


@query
def read_ragged_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = write_pair_files(spark, sf_dir)
    fields = documents.ragged_text_fields(documents.read_ragged_documents(spark, path))
    return fields.select("position", "field", "text")


def write_ragged_files(spark: SparkSession, sf_dir: str, malformed: bool) -> str:
    """JSON lists that hold documents and conversation rows, objects without a common schema.

    When `malformed`, every third file lacks its end, and some objects are plain strings.
    """
    texts = docs(spark, sf_dir).select(
        F.lit(0).alias("kind"),
        F.col("doc_id").alias("id"),
        F.lit(0).cast("long").alias("turn"),
        F.to_json(
            F.struct("doc_id", "text", "n_chars", "lang", F.struct("source", F.col("text").alias("note")).alias("meta"))
        ).alias("json"),
    )
    turns = table(spark, sf_dir, "conversations").select(
        F.lit(1).alias("kind"),
        F.col("conv_id").alias("id"),
        F.col("turn").cast("long").alias("turn"),
        F.to_json(F.struct("conv_id", "turn", "role", F.col("text").alias("said"))).alias("json"),
    )
    rows = texts.unionByName(turns).withColumn("file", F.floor(F.col("id") / KEYS_PER_FILE))
    if malformed:
        plain = F.concat(F.lit('"item '), F.col("id"), F.lit('"'))
        rows = rows.withColumn("json", F.when(F.col("id") % 7 == 3, plain).otherwise(F.col("json")))
    files = rows.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("kind", "id", "turn", "json"))).alias("rows"))
    body = F.concat(F.lit("["), F.array_join(F.col("rows")["json"], ",\n"), F.lit("]"))
    if malformed:
        body = F.when(F.col("file") % 3 == 1, F.substr(body, F.lit(1), F.length(body) - 1)).otherwise(body)
    path = fresh_dir(spark, "ragged-files")
    files.select(body.alias("body")).write.option("maxRecordsPerFile", 1).text(path)
    return path


def of_ragged(df: DataFrame, *extra: str) -> DataFrame:
    """Which given row a ragged document is of, some of its fields, and its metadata."""

    def field(path: str, kind: str) -> Column:
        return F.try_variant_get("document", path, kind)

    return df.select(
        F.coalesce(field("$.doc_id", "long"), field("$.conv_id", "long")).alias("id"),
        F.coalesce(field("$.turn", "long"), F.lit(-1)).alias("turn"),
        F.coalesce(field("$.text", "string"), field("$.said", "string")).alias("text"),
        F.coalesce(field("$.n_chars", "long"), F.lit(-1)).alias("n_chars"),
        F.coalesce(F.md5(field("$.meta.note", "string")), F.lit("")).alias("nested"),
        *extra,
        "pii_flag",
        "pii_count",
        joined("pii_types"),
    )


@query
def scan_ragged_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects of two shapes scanned and redacted as they are; strings inside nested values stay."""
    path = write_ragged_files(spark, sf_dir, malformed=False)
    rows = checked.accepted(checked.check_json_documents(spark, path))
    return of_ragged(ragged.scan_ragged_documents(rows, scanned_at=SCANNED_AT), "position")


@query
def process_ragged_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is stored of files some of which are malformed."""
    path, store, rejects = (write_ragged_files(spark, sf_dir, malformed=True), *(fresh_dir(spark, n) for n in ("ragged", "rejects")))
    scans.process_ragged_files(spark, path, store, rejects, scanned_at=SCANNED_AT)
    return of_ragged(spark.read.parquet(store), "position")


@query
def read_malformed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every object and every fault of malformed files, with its place."""
    every = checked.check_json_documents(spark, write_ragged_files(spark, sf_dir, malformed=True))
    own = F.coalesce(F.try_variant_get("document", "$.doc_id", "long"), F.try_variant_get("document", "$.conv_id", "long"))
    in_raw = F.regexp_extract("raw", r'(?:_id":|item )(\d+)', 1).cast("long")
    return every.select(
        F.coalesce("reason", F.lit("accepted")).alias("reason"),
        F.coalesce("position", F.lit(-1)).alias("position"),
        F.coalesce(own, in_raw).alias("id"),
    )


@query
def read_malformed_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detector lines of all documents, some malformed: how many entities are accepted, and the rejects' line numbers."""
    lines = docs(spark, sf_dir).select(F.col("doc_id").cast("string").alias("id"), "text")
    key = F.col("id").cast("long")
    found = batch.detect_lines(lines).withColumns({"key": key, "json": F.to_json(F.struct("id", "File", "Entities"))})
    faulty = (
        F.when(F.col("key") % 11 == 5, F.substr("json", F.lit(1), F.length("json") - 2))
        .when(F.col("key") % 13 == 6, F.to_json(F.struct("Entities")))
        .when(F.col("key") % 17 == 3, F.to_json(F.struct("id", F.lit("none").alias("Entities"))))
        .otherwise(F.col("json"))
    )
    files = found.groupBy(F.floor(F.col("key") / KEYS_PER_FILE).alias("file")).agg(
        F.sort_array(F.collect_list(F.struct("key", faulty.alias("line")))).alias("lines")
    )
    path = fresh_dir(spark, "malformed-answers")
    files.select(F.array_join(F.col("lines")["line"], "\n")).write.option("maxRecordsPerFile", 1).text(path)
    every = checked.check_detector_output(spark, path, glob="*.txt")
    good = checked.accepted(every).select(
        F.lit("accepted").alias("reason"), F.col("id").cast("long").alias("place"), F.size("entities").alias("entities")
    )
    bad = checked.line_numbers(spark, path, checked.rejected(every), glob="*.txt")
    return good.unionByName(bad.select("reason", F.col("position").alias("place"), F.lit(-1).alias("entities")))


@query
def read_detector_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_dir(spark, "detector-output")
    lines = docs(spark, sf_dir).select(F.col("doc_id").cast("string").alias("id"), "text")
    batch.detect_lines(lines).write.json(path)
    output = detector_output.read_detector_output(spark, path, glob="*.json")
    return output.select(F.col("id").cast("long").alias("doc_id"), as_lines("entities").alias("entities"))


@query
def payload_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as direct payloads: some wrapped, some bare, some not to be stored."""
    pages = table(spark, sf_dir, "pages")
    wrapped = F.length("url") > 40
    payloads = pages.select(
        F.when(wrapped, F.struct("page_id", "url", "html")).alias("document"),
        F.when(~wrapped, F.col("page_id")).alias("page_id"),
        F.when(~wrapped, F.col("url")).alias("url"),
        F.when(~wrapped, F.col("html")).alias("html"),
        F.when(F.col("url").startswith("https"), F.lit(False)).alias("index"),
    )
    plain = documents.payload_documents(payloads)
    scanned = scan.scan_documents(plain, Policy(mode=FLAG), key="page_id")
    return scanned.where("to_index").select("page_id", "url", "pii_flag", "pii_count", joined("pii_types"))


@query
def stream_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, out = write_json_files(spark, sf_dir), fresh_dir(spark, "stream")
    stream = stream_new_documents(spark, path, FILE_SCHEMA, prefix="part-", suffix=".txt")
    running = stream_dual_write(
        stream, f"{out}/restricted", f"{out}/shared", f"{out}/checkpoint"
    )
    running.awaitTermination()
    return metadata(spark.read.parquet(f"{out}/shared"), "title", "body")


@query
def stream_scan_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fresh_dir(spark, "stream")
    # The table may be one file or a folder of them; a stream's path may be a file only as a pattern.
    stream = stream_table(spark, f"{sf_dir}/{{documents.parquet}}", DOCUMENT_SCHEMA)
    running = stream_to_index(stream_scan(stream), f"{out}/index", f"{out}/checkpoint")
    running.awaitTermination()
    return metadata(spark.read.parquet(f"{out}/index"), "text")


# -- sinks and keyed changes --------------------------------------------------


@query
def append_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and benchmark items in one table; the second lot gets ids."""
    path = fresh_dir(spark, "index")
    tables.append_documents(docs(spark, sf_dir).select(F.col("doc_id").cast("string"), "text"), path)
    tables.append_documents(table(spark, sf_dir, "benchmark").select("text"), path)
    stored = spark.read.parquet(path)
    return stored.select(F.md5("text").alias("text_md5"), (F.length("doc_id") == 36).alias("new_id"))


def _updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    changed = docs(spark, sf_dir).join(good, "doc_id", "left_semi").withColumn("source", F.lit("updated"))
    added = table(spark, sf_dir, "benchmark").select(
        (F.col("item_id") + SECOND_OFFSET).alias("doc_id"),
        "text",
        F.lit("en").alias("lang"),
        F.lit("benchmark").alias("source"),
        F.length("text").cast("long").alias("n_chars"),
    )
    return changed.unionByName(added)


@query
def replace_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _stored(docs(spark, sf_dir))
    store.replace(_updates(spark, sf_dir))
    return store.documents().drop(PART)


@query
def update_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").withColumn("source", F.lit("labelled"))
    changed = keyed.update_by_id(docs(spark, sf_dir), labels)
    known = (F.coalesce(c, F.lit(-1)).alias(c) for c in ("quality", "toxic"))
    return changed.select("doc_id", "text", "lang", "source", *known)


@query
def latest_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return keyed.latest_by_id(turns, "conv_id", F.col("turn")).select("conv_id", "turn", "role", "text")


@query
def mark_in_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = keyed.mark_in_progress(docs(spark, sf_dir), table(spark, sf_dir, "labels"))
    return marked.select("doc_id", F.coalesce("pii_scan_status", F.lit("none")).alias("pii_scan_status"))


@query
def mark_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    started = keyed.mark_in_progress(docs(spark, sf_dir), table(spark, sf_dir, "labels"))
    done = table(spark, sf_dir, "labels").where("quality = 1")
    marked = keyed.mark_complete(started, done)
    return marked.select("doc_id", F.coalesce("pii_scan_status", F.lit("none")).alias("pii_scan_status"))


@query
def export_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_dir(spark, "export")
    exports.export_jsonl(docs(spark, sf_dir), path)
    return spark.read.schema(exports.LINE_SCHEMA).json(path)


@query
def export_lines_limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hand-over format of a detector that takes limited texts."""
    path = fresh_dir(spark, "export")
    exports.export_jsonl(table(spark, sf_dir, "pages"), path, key="page_id", max_chars=REMOTE_EXPORT_CHARS)
    return spark.read.schema(exports.LINE_SCHEMA).json(path)


@query
def dual_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, original = fresh_dir(spark, "dual"), docs(spark, sf_dir)
    redacted = scan.scan_documents(original, Policy())
    exports.dual_write(original, redacted, f"{out}/restricted", f"{out}/shared")
    vault = spark.read.parquet(f"{out}/restricted").select("doc_id", F.col("text").alias("original"))
    shared = spark.read.parquet(f"{out}/shared").select("doc_id", F.col("text").alias("redacted"))
    return vault.join(shared, "doc_id")


def audited(spark: SparkSession, sf_dir: str, policy: Policy) -> DataFrame:
    """The audit log of a run over all documents, written and read again."""
    out = fresh_dir(spark, "audit")
    done = scan.scan_documents(docs(spark, sf_dir), policy, scanned_at=when_scanned())
    exports.audit_log(done, out, policy)
    log = spark.read.parquet(out)
    return log.select(
        "doc_id",
        "pii_flag",
        "pii_count",
        joined("pii_types"),
        scanned_at_text(F.col("pii_scanned_at")).alias("pii_scanned_at"),
        "tail_chars",
        F.col("scan_date").cast("string").alias("scan_date"),
    )


@query
def audit_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Under a remote detector's limit; the log counts what lies past it."""
    return audited(spark, sf_dir, Policy(mode=FLAG, max_chars=REMOTE_EXPORT_CHARS))


@query
def audit_whole_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audited(spark, sf_dir, Policy(mode=FLAG))


@query
def write_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fresh_dir(spark, "routes")
    exports.write_routes(scanned_docs(spark, sf_dir), out)
    return spark.read.parquet(out).select("doc_id", "route")


# -- text and filters ---------------------------------------------------------


@query
def text_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    names = text_columns(pages, "page_id")
    held = F.concat_ws(",", *(F.when(F.length(n) > 20, F.lit(n)) for n in names))
    return pages.select("page_id", held.alias("fields"))


@query
def combine_text_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", combine_text(text_columns(pages, "page_id")).alias("combined"))


@query
def combine_text_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = docs(spark, sf_dir)
    return every.select("doc_id", combine_text(text_columns(every, "doc_id")).alias("combined"))


@query
def no_text_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts hold short strings only: nothing to scan, so all are clean."""
    parts = scan.scan_documents(table(spark, sf_dir, "part"), Policy(), key="p_partkey")
    return parts.select("p_partkey", "p_name", "pii_flag", "pii_count", joined("pii_types"))


@query
def truncate_text_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return docs(spark, sf_dir).select(
        "doc_id",
        F.length(truncate_text(text, REMOTE_EXPORT_CHARS)).alias("export_chars"),
        tail_chars(text, REMOTE_EXPORT_CHARS).alias("export_tail"),
        tail_chars(text, REMOTE_SCAN_CHARS).alias("scan_tail"),
        F.md5(truncate_text(text, REMOTE_LANGUAGE_CHARS)).alias("head_md5"),
    )


@query
def clean_utf8_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text with stray bytes worked into it comes back as it was."""
    broken = F.concat(
        F.substring("text", 1, 3).cast("binary"),
        F.unhex(F.lit("FF")),
        F.expr("substring(text, 4)").cast("binary"),
        F.unhex(F.lit("C3")),
    )
    return docs(spark, sf_dir).select("doc_id", clean_utf8(broken).alias("text"))


@query
def unscanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.unscanned(partly_scanned(spark, sf_dir)).select("doc_id")


@query
def scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.scanned(partly_scanned(spark, sf_dir)).select("doc_id", "pii_flag")


@query
def flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.flagged(partly_scanned(spark, sf_dir)).select("doc_id")


@query
def with_any_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = filters.with_any_type(scanned_docs(spark, sf_dir), ["EMAIL", "PHONE"])
    return found.select("doc_id", joined("pii_types"))


@query
def shared_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared = F.array_join(filters.shared_types(["CREDIT_DEBIT_NUMBER", "EMAIL", "SSN"]), ",")
    return scanned_docs(spark, sf_dir).select("doc_id", shared.alias("shared"))


@query
def high_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.high_risk(scan.scan_documents(generated(spark, sf_dir).drop("truth")), 4).select(
        "doc_id", "pii_count"
    )


@query
def high_risk_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.high_risk(scanned_docs(spark, sf_dir), 2, by="types").select("doc_id", joined("pii_types"))


@query
def route_by_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.route_by_sensitivity(scanned_docs(spark, sf_dir)).select("doc_id", "route")


@query
def preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", F.array_join(filters.preview(pages, "page_id"), "|").alias("preview"))


@query
def cap_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    capped = filters.cap_documents(filters.unscanned(partly_scanned(spark, sf_dir)), 100)
    return capped.select("doc_id")


@query
def cap_documents_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hundred lines by quantity: a key that very many lines have."""
    lines = table(spark, sf_dir, "lineitem").select("l_quantity", "l_returnflag")
    nulls = lines.withColumn("l_quantity", F.when(F.col("l_quantity") > 1, F.col("l_quantity")))
    taken = filters.cap_documents(nulls, 5_000, "l_quantity")
    return taken.groupBy("l_quantity").agg(F.count("*").alias("lines"))


# -- detection and redaction --------------------------------------------------


@query
def contains_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", scan.contains_pii(F.col("text"), Policy()).alias("has_pii"))


@query
def contains_pii_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return turns.select("conv_id", "turn", scan.contains_pii(F.col("text"), Policy()).alias("has_pii"))


def _entities_of(kind: str, source: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        policy = Policy(types=[kind])
        if source == "documents":
            return scan.detected_entities(docs(spark, sf_dir), policy, fields=["text"]).drop("field")
        made = generated(spark, sf_dir).select("doc_id", "body")
        return scan.detected_entities(made, policy).drop("field")

    return run


# Types that occur in `documents`, and the others on generated documents.
for _kind in ("EMAIL", "PHONE", "CREDIT_DEBIT_NUMBER"):
    QUERIES[f"entities_{_kind.lower()}"] = _entities_of(_kind, "documents")
for _kind in ("NAME", "SSN", "ADDRESS", "DATE_TIME", "BANK_ACCOUNT_NUMBER"):
    QUERIES[f"entities_{_kind.lower()}"] = _entities_of(_kind, "generated")


@query
def detected_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All types at once, over two fields."""
    made = generated(spark, sf_dir).select("doc_id", "title", "body")
    return scan.detected_entities(made)


@query
def explain_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.explain_entities(docs(spark, sf_dir))


@query
def name_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = spark.createDataFrame([(n,) for n in FIRST_NAMES], "name string")
    made = generated(spark, sf_dir).select("doc_id", "body")
    return ents.name_entities(made, names).drop("field")


@query
def filter_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outside entities against a stricter policy, and labels likewise."""
    rows = label_answers(spark, sf_dir)
    kept = spans.filter_entities(F.col("entities"), ["SSN", "EMAIL"], 0.9)
    named = F.transform("entities", lambda e: F.struct(e["type"].alias("name"), e["score"].alias("score")))
    return rows.select(
        "doc_id",
        as_lines(kept).alias("kept"),
        spans.filter_labels(named, ["NAME", "SSN"], 0.9).alias("qualifies"),
    )


@query
def redact_email(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata(scan.scan_documents(docs(spark, sf_dir), Policy(types=["EMAIL"])), "text")


@query
def flag_email(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata(scan.scan_documents(docs(spark, sf_dir), Policy(types=["EMAIL"], mode=FLAG)), "text")


@query
def scan_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = scan.scan_documents(docs(spark, sf_dir), Policy(), scanned_at=SCANNED_AT)
    stamp = scanned_at_text(F.col("pii_scanned_at")).alias("pii_scanned_at")
    return done.select("doc_id", "text", "lang", "pii_flag", "pii_count", joined("pii_types"), stamp)


@query
def scan_generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every built-in type in one scan of two fields."""
    return metadata(scan.scan_documents(generated(spark, sf_dir).drop("truth")), "title", "body")


@query
def scan_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = scan.scan_documents(table(spark, sf_dir, "pages"), Policy(), key="page_id")
    return done.select("page_id", "url", "html", "pii_flag", "pii_count", joined("pii_types"))


@query
def scan_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    done = scan.scan_documents(turns, Policy(), key=["conv_id", "turn"])
    return done.select("conv_id", "turn", "role", "text", "pii_flag", "pii_count", joined("pii_types"))


@query
def scan_limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A remote detector's limit: what lies past it is dropped, not left raw."""
    limited = Policy(max_chars=REMOTE_EXPORT_CHARS, drop_tail=True)
    return metadata(scan.scan_documents(docs(spark, sf_dir), limited), "text")


@query
def custom_rule_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record pattern of one's own, with a cue that stays readable."""
    token = Rule("ACCESS_TOKEN", "[0-9a-f]{40}", 0.9, cue='token = "', starts="t", needs="token")
    policy = Policy(types=["EMAIL"], custom_rules=[token])
    return metadata(scan.scan_documents(docs(spark, sf_dir), policy), "text")


@query
def custom_rule_ip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata(scan.scan_documents(docs(spark, sf_dir), Policy(types=["IP_ADDRESS"])), "text")


@query
def scan_by_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = scan.scan_by_policy(docs(spark, sf_dir), "lang", by_policy(), Policy(types=["EMAIL"]))
    return metadata(done, "lang", "text")


@query
def preset_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line of business reads its share of the generated documents."""
    made = generated(spark, sf_dir).drop("truth")
    desk = F.element_at(F.split("title", " "), 1)
    presets = {"Loan": PRESETS["loans"], "Insurance": PRESETS["claims"], "Lost": PRESETS["clinical"]}
    done = scan.scan_by_policy(
        made.withColumn("desk", desk), "desk", presets, PRESETS["contracts"], fields=["body"]
    )
    return metadata(done, "body")


@query
def entities_from(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain = docs(spark, sf_dir).select("doc_id", "text")
    attached, held = ents.entities_from(plain, label_entities(spark, sf_dir), policy=Policy())
    return metadata(scan.scan_with_entities(attached, held), "text")


@query
def metadata_from_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata(ents.metadata_from_entities(label_entities(spark, sf_dir)))


@query
def detect_language_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", detect_language(F.col("text")).alias("language"))


@query
def language_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = docs(spark, sf_dir).select("lang", detect_language(F.col("text")).alias("language"))
    return found.groupBy("lang", "language").agg(F.count("*").alias("docs"))


@query
def multilingual_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata(scan.scan_multilingual(docs(spark, sf_dir), fields=["text"]), "pii_language", "text")


# -- reports ------------------------------------------------------------------


@query
def count_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.count_all(docs(spark, sf_dir))


@query
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.coverage(partly_scanned(spark, sf_dir))


@query
def type_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.type_breakdown(scanned_docs(spark, sf_dir))


@query
def type_breakdown_generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.type_breakdown(scan.scan_documents(generated(spark, sf_dir).drop("truth"), Policy(mode=FLAG)))


@query
def status_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.status_breakdown(partly_scanned(spark, sf_dir))


@query
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.run_summary(scanned_docs(spark, sf_dir))


@query
def scanned_per_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = reports.scanned_per_day(table(spark, sf_dir, "events"), "ts")
    return daily.select(F.col("day").cast("string").alias("day"), "docs")


@query
def scanned_per_day_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    daily = reports.scanned_per_day(orders, "o_orderdate", fill_gaps=True)
    return daily.select(F.col("day").cast("string").alias("day"), "docs")


@query
def scan_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("flag", F.col("event_type") == "error")
    rate = reports.scan_rate(events, "ts", "flag")
    return rate.select(
        F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"),
        "docs",
        F.round("flagged_share", 6).alias("flagged_share"),
    )


@query
def scan_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.scan_units_report(docs(spark, sf_dir))


@query
def view_flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = reports.view_flagged(scanned_docs(spark, sf_dir), 10)
    return top.select(
        "doc_id",
        joined("pii_types"),
        "pii_count",
        scanned_at_text(F.col("pii_scanned_at")).alias("pii_scanned_at"),
        F.array_join("preview", "|").alias("preview"),
    )


@query
def top_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = reports.top_risk(scan.scan_documents(generated(spark, sf_dir).drop("truth"), Policy(mode=FLAG)))
    return top.select("doc_id", "pii_count", joined("pii_types"))


# -- whole jobs ---------------------------------------------------------------


def _stored(df: DataFrame) -> DocumentStore:
    store = DocumentStore.create(df.sparkSession, df.schema)
    store.append(df)
    return store


def _store(spark: SparkSession, sf_dir: str) -> DocumentStore:
    return _stored(partly_scanned(spark, sf_dir))


@query
def scan_unscanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _store(spark, sf_dir)
    scans.scan_unscanned(store, Policy())
    return metadata(store.read(), "text")


@query
def scan_unscanned_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.scan_unscanned(_store(spark, sf_dir), Policy())


@query
def scheduled_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _store(spark, sf_dir)
    scans.scheduled_scan(store, Policy(), rounds=10)
    return state(store.read().drop("pii_scan_status"), "text")


@query
def scan_unscanned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the partition with unscanned documents is written again."""
    path = f"{fresh_dir(spark, 'partitioned')}/index"
    partly_scanned(spark, sf_dir).write.partitionBy("lang").parquet(path)
    scans.scan_unscanned_partitions(spark, path, "lang", Policy())
    return metadata(spark.read.parquet(path), "lang", "text")


@query
def process_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = f"{fresh_dir(spark, 'processed')}/index"
    scans.process_file(spark, write_json_files(spark, sf_dir), FILE_SCHEMA, out)
    return metadata(spark.read.parquet(out), "title", "body")


@query
def run_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = batch.run_batch(_stored(docs(spark, sf_dir)), Policy(), max_docs=None)
    return state(done, "text")


@query
def import_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_dir(spark, "detector-output")
    answers = label_answers(spark, sf_dir).select(
        F.concat("doc_id", F.lit(".jsonl")).alias("File"),
        F.transform(
            "entities",
            lambda e: F.struct(
                e["type"].alias("Type"),
                e["score"].alias("Score"),
                e["begin"].alias("BeginOffset"),
                e["end"].alias("EndOffset"),
            ),
        ).alias("Entities"),
    )
    answers.write.json(path)
    output = detector_output.read_detector_output(spark, path, glob="*.json")
    target = scans.with_metadata(docs(spark, sf_dir))
    return state(batch.import_results(target, output))


@query
def import_results_many_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A detector that answers in a line for each finding, and one more without any."""
    answers = label_answers(spark, sf_dir).select(F.col("doc_id").cast("string").alias("id"), "entities")
    lines = answers.select("id", F.explode("entities").alias("e")).select("id", F.array("e").alias("entities"))
    none = answers.select("id", F.filter("entities", lambda _: F.lit(False)).alias("entities"))
    target = scans.with_metadata(docs(spark, sf_dir))
    return state(batch.import_results(target, lines.unionByName(none)))


@query
def import_results_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of a batch detector applied to the text they were made on."""
    output = label_answers(spark, sf_dir).select(F.col("doc_id").cast("string").alias("id"), "entities")
    target = scans.with_metadata(docs(spark, sf_dir).select("doc_id", "text"))
    return state(batch.import_results(target, output, redact_field="text"), "text")


@query
def coverage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = scans.coverage_report(_store(spark, sf_dir))
    before = report["before"].withColumn("stage", F.lit("before"))
    return before.unionByName(report["after"].withColumn("stage", F.lit("after")))


# -- generated documents ------------------------------------------------------


@query
def generate_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    truth = F.transform("truth", lambda e: F.concat_ws(":", e["type"], e["begin"].cast("string"), e["end"].cast("string")))
    return generated(spark, sf_dir).select("doc_id", "title", "body", F.array_join(truth, ",").alias("truth"))


@query
def rule_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.rule_recall(generated(spark, sf_dir))
