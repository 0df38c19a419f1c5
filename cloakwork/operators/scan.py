"""The scan: detect, redact or flag, add the metadata columns.

A scan is a projection.  It moves no row between tasks whatever the policy, so a
table of any size is scanned where its splits are read.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakwork.functions import spans
from cloakwork.functions.language import detect_language
from cloakwork.functions.text import (
    combine_text,
    hold,
    is_text,
    let,
    quoted,
    text_columns,
    text_or_null,
    truncate_text,
)
from cloakwork.policy import Policy

# A policy for the rows where a condition holds; the last one has no condition.
Variants = Sequence[tuple[Column | None, Policy]]


def _choose(variants: Variants, value: Callable[[Policy], Column]) -> Column:
    chosen = None
    for condition, policy in variants[:-1]:
        chosen = F.when(condition, value(policy)) if chosen is None else chosen.when(condition, value(policy))
    last = value(variants[-1][1])
    return last if chosen is None else chosen.otherwise(last)


def scan_time(scanned_at: datetime | str | Column | None) -> Column:
    """One time stamp for a whole run, in whole seconds."""
    if isinstance(scanned_at, Column):
        return scanned_at
    now = F.current_timestamp() if scanned_at is None else F.lit(scanned_at).cast("timestamp")
    return F.date_trunc("second", now)


def contains_pii(text: Column, policy: Policy) -> Column:
    """The cheap yes/no check over a whole (combined) text.

    The detector's own patterns, stopping at the first hit, so a text the
    detector would find something in is never called clean.
    """
    return spans.contains_match(truncate_text(text, policy.max_chars), policy.rules())


def detect_pii(text: Column, policy: Policy) -> Column:
    """Entities a policy accepts in one text, with offsets."""
    found = spans.find_entities(truncate_text(text, policy.max_chars), policy.rules())
    if any(r.min_score < policy.threshold for r in policy.rules()):
        found = F.filter(found, lambda e: e["score"] >= policy.threshold)
    return found


def redacted_text(old: Column, found: Column, policy: Policy) -> Column:
    """A text with the matches found in it written as the policy says; short ones stay."""
    if not policy.redacts:
        return old
    seen = truncate_text(old, policy.max_chars)
    new = spans.redact_matches(seen, found, policy.rules(), policy.threshold)
    if policy.max_chars is None:
        return new
    if not policy.drop_tail:
        new = F.concat(new, F.substring(old, F.lit(policy.max_chars + 1), F.length(old)))
    return F.when(F.length(old) > F.greatest(F.lit(policy.min_chars), F.lit(0)), new).otherwise(old)


def _scan(
    df: DataFrame,
    variants: Variants,
    key: str | Sequence[str],
    fields: Sequence[str] | None,
    scanned_at: datetime | str | Column | None,
    only: Column | None,
) -> DataFrame:
    names = text_columns(df, key, fields)

    def matches(name: str) -> Column:
        def under(policy: Policy) -> Column:
            text = truncate_text(quoted(name), policy.max_chars)
            found = spans.find_matches(text, policy.rules())
            return F.when(is_text(quoted(name), policy.min_chars), found).otherwise(spans.no_strings())

        found = _choose(variants, under)
        return found if only is None else F.when(only, found).otherwise(spans.no_strings())

    def types(found: Column) -> Column:
        return _choose(variants, lambda p: spans.match_types(found, p.rules(), p.threshold))

    def new_text(name: str, found: Column) -> Column:
        old = quoted(name)

        def under(policy: Policy) -> Column:
            return redacted_text(old, found, policy)

        changed = _choose(variants, under)
        return changed if only is None else F.when(only, changed).otherwise(old)

    held = {name: f"__matches_{i}" for i, name in enumerate(names)}
    out = hold(df, {column: matches(name) for name, column in held.items()}) if held else df
    all_types = F.concat(spans.no_strings(), *(types(F.col(column)) for column in held.values()))
    out = hold(out, {"__types": all_types})

    redacting = any(policy.redacts for _, policy in variants)
    stamp = scan_time(scanned_at)
    metadata = {
        "pii_flag": F.size("__types") > 0,
        "pii_count": F.size("__types"),
        "pii_types": F.array_sort(F.array_distinct("__types")),
        "pii_scanned_at": stamp,
    }
    if only is not None:
        metadata = {
            name: F.when(only, value).otherwise(quoted(name) if name in df.columns else F.lit(None))
            for name, value in metadata.items()
        }
    columns = []
    for name in df.columns:
        if name in metadata:
            continue
        text = redacting and name in held
        columns.append(new_text(name, F.col(held[name])).alias(name) if text else quoted(name))
    return out.select(*columns, *(value.alias(name) for name, value in metadata.items()))


def scan_documents(
    df: DataFrame,
    policy: Policy | None = None,
    *,
    key: str | Sequence[str] = "doc_id",
    fields: Sequence[str] | None = None,
    scanned_at: datetime | str | Column | None = None,
    only: Column | None = None,
) -> DataFrame:
    """Scan every document under one policy.

    Text columns are searched field by field; with mode REDACT they come back
    redacted.  Adds ``pii_flag, pii_count, pii_types, pii_scanned_at`` (replacing
    older ones).  With `only`, rows where it is false keep text and metadata.
    """
    return _scan(df, [(None, policy or Policy())], key, fields, scanned_at, only)


def scan_by_policy(
    df: DataFrame,
    column: str,
    policies: Mapping[object, Policy],
    default: Policy | None = None,
    *,
    key: str | Sequence[str] = "doc_id",
    fields: Sequence[str] | None = None,
    scanned_at: datetime | str | Column | None = None,
) -> DataFrame:
    """Scan with the policy a column's value asks for, in one pass.

    Values without a policy of their own get `default`.  Values with equal
    policies share one branch of the plan.
    """
    values: dict[Policy, list] = {}
    for value, policy in policies.items():
        values.setdefault(policy, []).append(value)
    variants = [
        (F.coalesce(quoted(column).isin(*same), F.lit(False)), policy) for policy, same in values.items()
    ]
    return _scan(df, [*variants, (None, default or Policy())], key, fields, scanned_at, None)


# Each policy of a table becomes a branch of the plan, so the table is bounded.
MAX_TABLE_POLICIES = 1_000


def policies_from(rows: DataFrame, column: str) -> dict[object, Policy]:
    """Policies kept as a table: one row per value of `column`.

    Other columns are named after `Policy` fields (``types, threshold, mode,
    min_chars, language``); absent ones and nulls take the defaults.
    """
    known = [c for c in ("types", "threshold", "mode", "min_chars", "language") if c in rows.columns]
    taken = rows.select(quoted(column).alias("__value"), *known).take(MAX_TABLE_POLICIES + 1)
    if len(taken) > MAX_TABLE_POLICIES:
        raise ValueError(f"more than {MAX_TABLE_POLICIES} policies; give groups of values one policy each")
    return {r["__value"]: Policy(**{c: r[c] for c in known if r[c] is not None}) for r in taken}


def scan_multilingual(
    df: DataFrame,
    policy: Policy | None = None,
    *,
    key: str | Sequence[str] = "doc_id",
    fields: Sequence[str] | None = None,
    scanned_at: datetime | str | Column | None = None,
    language_chars: int | None = None,
) -> DataFrame:
    """Detect each document's language, then scan with that language's rules.

    Adds ``pii_language``.  Documents without text are English.
    """
    from cloakwork.rules import LANGUAGES

    policy = policy or Policy()
    names = text_columns(df, key, fields)
    combined = combine_text(names, policy.min_chars)
    spoken = hold(df.drop("pii_language"), {"pii_language": detect_language(combined, language_chars)})
    others = [
        (F.col("pii_language") == language, policy.with_options(language=language))
        for language in LANGUAGES
        if language != "en"
    ]
    return _scan(
        spoken,
        [*others, (None, policy.with_options(language="en"))],
        key,
        names,
        scanned_at,
        None,
    )


def scan_with_entities(
    df: DataFrame,
    entities: Mapping[str, str],
    policy: Policy | None = None,
    *,
    labels: str | None = None,
    key: str | Sequence[str] = "doc_id",
    scanned_at: datetime | str | Column | None = None,
) -> DataFrame:
    """Scan with entities found elsewhere instead of the built-in rules.

    `entities` maps text columns to columns holding their entity arrays; `labels`
    optionally names a column of document-level labels, and a document none of
    whose labels qualifies is clean.  The entity and label columns are dropped.
    """
    policy = policy or Policy()
    names = text_columns(df, (key, *entities.values()) if isinstance(key, str) else (*key, *entities.values()), list(entities))

    def accepted(name: str) -> Column:
        kept = spans.filter_entities(quoted(entities[name]), policy.accepted_types(), policy.threshold)
        found = is_text(quoted(name), policy.min_chars)
        if labels is not None:
            found = found & spans.filter_labels(quoted(labels), policy.accepted_types(), policy.threshold)
        return F.when(found, F.coalesce(kept, spans.no_entities())).otherwise(spans.no_entities())

    held = {name: f"__entities_{i}" for i, name in enumerate(names)}
    out = df.withColumns({column: accepted(name) for name, column in held.items()})
    types = F.concat(
        spans.no_strings(), *(F.transform(F.col(c), lambda e: e["type"]) for c in held.values())
    )
    out = out.withColumn("__types", types)
    metadata = {
        "pii_flag": F.size("__types") > 0,
        "pii_count": F.size("__types"),
        "pii_types": F.array_sort(F.array_distinct("__types")),
        "pii_scanned_at": scan_time(scanned_at),
    }
    dropped = {*entities.values(), *metadata, *([labels] if labels else [])}
    columns = []
    for name in df.columns:
        if name in dropped:
            continue
        if policy.redacts and name in held:
            columns.append(spans.redact_spans(quoted(name), F.col(held[name])).alias(name))
        else:
            columns.append(quoted(name))
    return out.select(*columns, *(value.alias(name) for name, value in metadata.items()))


def explain_entities(
    df: DataFrame,
    policy: Policy | None = None,
    *,
    key: str | Sequence[str] = "doc_id",
    fields: Sequence[str] | None = None,
) -> DataFrame:
    """Every entity any rule finds, one per row, with score and offsets.

    Neither types nor threshold filter, so a missed entity shows why it was
    missed.  The text of an entity is not part of the result.
    """
    policy = policy or Policy()
    return list_entities(df, lambda text: spans.find_entities(text, policy.all_rules()), policy, key, fields)


def detected_entities(
    df: DataFrame,
    policy: Policy | None = None,
    *,
    key: str | Sequence[str] = "doc_id",
    fields: Sequence[str] | None = None,
) -> DataFrame:
    """The entities a policy accepts, one per row: ``key, field, type, score, begin, end``."""
    policy = policy or Policy()
    return list_entities(df, lambda text: detect_pii(text, policy), policy, key, fields)


def list_entities(
    df: DataFrame,
    detect: Callable[[Column], Column],
    policy: Policy,
    key: str | Sequence[str],
    fields: Sequence[str] | None,
) -> DataFrame:
    keys = [key] if isinstance(key, str) else list(key)
    names = text_columns(df, keys, fields)
    if not names:
        raise ValueError("no text columns to search")

    def in_field(name: str) -> Column:
        def located(text: Column) -> Column:
            return F.transform(
                F.coalesce(detect(text), spans.no_entities()),
                lambda e: F.struct(F.lit(name).alias("field"), *(e[f].alias(f) for f in ("type", "score", "begin", "end"))),
            )

        return let(text_or_null(quoted(name), policy.min_chars), located)

    per_field = [in_field(name) for name in names]
    everything = F.concat(*per_field) if len(per_field) > 1 else per_field[0]
    # The outer explode with a null test runs the patterns once; the plain one
    # would have the optimizer repeat them in a filter it infers.
    exploded = df.select(*(quoted(k) for k in keys), F.explode_outer(everything).alias("e"))
    return exploded.where(F.col("e").isNotNull()).select(
        *(quoted(k) for k in keys), "e.field", "e.type", "e.score", "e.begin", "e.end"
    )
