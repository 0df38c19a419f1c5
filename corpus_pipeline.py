"""From raw documents to packed training sequences.

`STAGES` are applied in order; each takes what the one before kept and returns the
columns of documents, but for the last, which returns the packed pieces.

Null and empty texts: not toxic, without a language (so they go at that stage, as all
texts without a letter do; those with one have a language of those known, and stay, also
where no row names a language and none can be learned).  Repeated
rows and ids are rows of their own until near copies are removed, of which one row
stays.  An empty table gives no rows at every stage.  Columns that documents have beyond
the usual ones are kept until the last stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakwork.llm import language, order_minhash, packing, secret_scan, toxicity
from cloakwork.llm.shared import free_name, let_workers_import, read, staged


#: Rows that are handed to a Python worker at once, on either side of the hand-over: whole
#: texts are kilobytes each, and Spark's default of 10,000 rows is tens of megabytes a task.
ROWS_AT_ONCE, ROWS_SETTING = 1_000, "spark.sql.execution.arrow.maxRecordsPerBatch"


def _prepare(spark: SparkSession) -> None:
    let_workers_import(spark)
    if not 0 < int(spark.conf.get(ROWS_SETTING)) <= ROWS_AT_ONCE:
        spark.conf.set(ROWS_SETTING, str(ROWS_AT_ONCE))


def _own_columns(docs: DataFrame, df: DataFrame) -> DataFrame:
    return df.select(*(df[f"`{c}`"] for c in docs.columns))


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not called toxic, by a scorer fitted on the labelled ones."""
    _prepare(spark)
    labels = read(spark, sf_dir, "labels").select("doc_id", "toxic")
    scorer = toxicity.fit(docs, labels)
    score, predicted = free_name(docs, "toxic_score"), free_name(docs, "toxic_predicted")
    scored = toxicity.score(docs, scorer, score_as=score, predicted_as=predicted)
    return _own_columns(docs, scored.where(F.col(predicted) == 0))


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is one of those known; texts without any letter go."""
    _prepare(spark)
    names = [free_name(docs, n) for n in ("found_lang", "found_score", "found_share")]
    net = language.fit(docs)
    if net is None:
        return docs.where(F.rlike("text", F.lit(r"\p{L}")))
    found = language.predict(docs, net, lang_as=names[0], score_as=names[1], share_as=names[2])
    return _own_columns(docs, found.where(F.col(names[0]) != language.UNDETERMINED))


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    _prepare(spark)
    names = [free_name(docs, n) for n in ("copy_class", "copy_size", "copy_kept")]
    classed = order_minhash.near_duplicates(docs, class_as=names[0], size_as=names[1], kept_as=names[2])
    return _own_columns(docs, classed.where(F.col(names[2])))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced, and the number of characters put right."""
    _prepare(spark)
    name = free_name(docs, "found_secrets")
    clean = secret_scan.redact(secret_scan.scan(docs, out=name), secrets=name)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        changed = F.size(name) > 0
        clean = clean.withColumn("n_chars", F.when(changed, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return _own_columns(docs, clean)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 2048 tokens."""
    _prepare(spark)
    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    return packing.pack(docs, vocabulary, public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", remove_toxic),
    ("language", keep_languages),
    ("near_copies", remove_near_copies),
    ("secrets", redact_secrets),
    ("packing", pack_sequences),
]

#: The models and the linear program are nothing that SQL expresses; the tests hold the
#: stages against the operators' own brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents after all stages, each stage's result written and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
