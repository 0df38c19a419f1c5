"""Entities that come as rows: from another detector, or from a name list."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloakwork.functions import spans
from cloakwork.functions.text import let, quoted, text_columns, text_or_null
from cloakwork.operators.scan import scan_time
from cloakwork.policy import Policy
from cloakwork.rules import EDGE_BEFORE


# Name tables up to this many bytes are sent to every executor.
MAX_BROADCAST_BYTES = 8_000_000


def accepts(policy: Policy) -> Column:
    """Whether an entity row has a wanted type and enough score."""
    ok = F.col("type").isin(*policy.accepted_types()) & (F.col("score") >= policy.threshold)
    return F.coalesce(ok, F.lit(False))


def entities_from(
    docs: DataFrame,
    entities: DataFrame,
    *,
    key: str = "doc_id",
    fields: Sequence[str] | None = None,
    policy: Policy | None = None,
) -> tuple[DataFrame, dict[str, str]]:
    """Attach entity rows ``(key, field, type, score, begin, end)`` to documents.

    Returns the documents with one entity array per text field and the mapping
    `scan_with_entities` takes.  Entities of a document end up in its row, as its
    text does; a row per document and not per field is shuffled.  Given the
    policy, entities it rejects are left out before the shuffle.
    """
    if policy is not None:
        entities = entities.where(accepts(policy))
    names = text_columns(docs, key, fields)
    held = {name: f"__found_{i}" for i, name in enumerate(names)}
    one = F.struct(
        F.col("type"),
        F.col("score").cast("double").alias("score"),
        F.col("begin").cast("int").alias("begin"),
        F.col("end").cast("int").alias("end"),
    )
    # Sorted, so that spans with equal begins have an order of their own.
    gathered = entities.groupBy(quoted(key)).agg(
        *(
            F.array_sort(F.collect_list(F.when(F.col("field") == name, one))).alias(column)
            for name, column in held.items()
        )
    )
    return docs.join(gathered, key, "left"), held


def metadata_from_entities(
    entities: DataFrame,
    policy: Policy | None = None,
    *,
    key: str = "doc_id",
    scanned_at=None,
) -> DataFrame:
    """Scan metadata per id from entity rows, by aggregates alone.

    Counts and type sets are combined before the shuffle, so no list of entities
    is gathered.  An id all of whose entities are rejected is clean.
    """
    policy = policy or Policy()
    ok = accepts(policy)
    return entities.groupBy(quoted(key)).agg(
        (F.count_if(ok) > 0).alias("pii_flag"),
        F.count_if(ok).cast("int").alias("pii_count"),
        F.array_sort(F.collect_set(F.when(ok, F.col("type")))).alias("pii_types"),
        F.first(scan_time(scanned_at)).alias("pii_scanned_at"),
    )


def metadata_from_lists(entities: Column, policy: Policy, scanned_at=None) -> dict[str, Column]:
    """The metadata columns for one array of entities."""
    kept = F.coalesce(
        spans.filter_entities(entities, policy.accepted_types(), policy.threshold), spans.no_entities()
    )
    types = F.transform(kept, lambda e: e["type"])
    return {
        "pii_flag": F.size(kept) > 0,
        "pii_count": F.size(kept),
        "pii_types": F.array_sort(F.array_distinct(types)),
        "pii_scanned_at": scan_time(scanned_at),
    }


def name_entities(
    docs: DataFrame,
    names: DataFrame,
    *,
    key: str = "doc_id",
    fields: Sequence[str] | None = None,
    score: float = 0.9,
    min_chars: int = Policy.min_chars,
    salts: int = 16,
    broadcast_bytes: int = MAX_BROADCAST_BYTES,
) -> DataFrame:
    """NAME entities by joining word pairs with a name table, for lists of any size.

    Emits every capitalised word followed by another one as a candidate, with its
    offsets, and keeps those whose first word is in ``names.name``.  Lists of up to
    `broadcast_bytes`, measured first, go to every executor.  Longer ones are
    shuffled, and a frequent first word is then spread over `salts` tasks.
    Candidates that share a word are resolved from the left, as the NAME rule does.
    """
    known = names.select("name").distinct()
    size = known.agg(F.sum(F.octet_length("name") + 16)).first()[0] or 0
    per_field = []
    for field in text_columns(docs, key, fields):
        per_field.append(
            docs.select(
                quoted(key),
                F.lit(field).alias("field"),
                F.explode_outer(_word_pairs(text_or_null(quoted(field), min_chars))).alias("c"),
            ).where(F.col("c").isNotNull())
        )
    candidates = per_field[0]
    for more in per_field[1:]:
        candidates = candidates.unionByName(more)
    candidates = candidates.select(
        quoted(key),
        "field",
        F.col("c.first").alias("name"),
        F.col("c.begin").alias("begin"),
        F.col("c.end").alias("end"),
    )
    if size <= broadcast_bytes:
        hits = candidates.join(F.broadcast(known), "name", "left_semi")
    else:
        salt = F.pmod(F.xxhash64(quoted(key), "begin"), F.lit(salts)).cast("int")
        every_salt = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
        hits = candidates.withColumn("salt", salt).join(
            known.withColumn("salt", every_salt), ["name", "salt"], "left_semi"
        )
    # Pairs that share a word form runs; of a run every second pair is taken.
    in_text = Window.partitionBy(quoted(key), "field").orderBy("begin")
    parted = F.coalesce(F.col("begin") >= F.lag("end").over(in_text), F.lit(True))
    runs = hits.withColumn("parted", parted.cast("int")).withColumn("run", F.sum("parted").over(in_text))
    place = F.row_number().over(Window.partitionBy(quoted(key), "field", "run").orderBy("begin"))
    return (
        runs.withColumn("place", place)
        .where(F.col("place") % 2 == 1)
        .select(
            quoted(key), "field", F.lit("NAME").alias("type"), F.lit(score).alias("score"), "begin", "end"
        )
    )


def _word_pairs(text: Column) -> Column:
    """Neighbouring capitalised words as ``struct<first,begin,end>``."""
    word = EDGE_BEFORE + "[A-Z][a-z]+(?![0-9A-Za-z_])"
    found = F.struct(
        F.regexp_extract_all(text, F.lit(word), F.lit(0)).alias("words"), F.split(text, word, -1).alias("gaps")
    )

    def located(found: Column) -> Column:
        gaps = F.slice(found["gaps"], 1, F.size(found["words"]))
        lengths = F.zip_with(gaps, found["words"], lambda gap, word: F.length(gap) + F.length(word))
        named = F.zip_with(gaps, found["words"], lambda gap, word: F.struct(gap.alias("gap"), word.alias("word")))
        placed = F.zip_with(
            named,
            spans.running_sum(lengths),
            lambda x, end: F.struct(
                x["word"].alias("word"),
                x["gap"].alias("gap"),
                (end - F.length(x["word"])).alias("begin"),
                end.alias("end"),
            ),
        )
        return let(placed, _neighbours)

    return F.when(text.isNotNull(), let(found, located))


def _neighbours(located: Column) -> Column:
    pairs = F.zip_with(
        located,
        F.slice(located, 2, F.greatest(F.size(located) - 1, F.lit(0))),
        lambda a, b: F.when(
            b["gap"] == " ",
            F.struct(a["word"].alias("first"), a["begin"].alias("begin"), b["end"].alias("end")),
        ),
    )
    return F.filter(pairs, lambda p: p.isNotNull())
