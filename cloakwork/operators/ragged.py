"""Scanning documents that share no schema.

A document is a variant that holds an object.  Its strings are picked out, searched and
put back in the row itself; all other values keep their types, and no row moves.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakwork.functions import spans
from cloakwork.functions.text import hold, object_fields, quoted, scanned_at_text, truncate_text
from cloakwork.operators.scan import redacted_text, scan_time
from cloakwork.policy import Policy

#: The metadata that a scan adds, in the order of `scan_documents`.
METADATA = ("pii_flag", "pii_count", "pii_types", "pii_scanned_at")


def string_fields(fields: Column, min_chars: int) -> Column:
    """The strings among an object's own fields that are longer than `min_chars`, as ``map<string,string>``."""
    strings = F.transform_values(
        fields, lambda _, v: F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))
    )
    return F.map_filter(strings, lambda _, text: F.coalesce(F.length(text) > min_chars, F.lit(False)))


def scan_ragged_documents(
    df: DataFrame,
    policy: Policy | None = None,
    *,
    column: str = "document",
    scanned_at: datetime | str | Column | None = None,
) -> DataFrame:
    """`df` with its variant documents scanned, and the metadata columns.

    Text is what the scan of a table takes for it: strings of the document itself longer
    than the policy's least length.  Strings inside nested values are not looked into and
    stay as they are.  What is no object (a list, a number, null) has no fields, so it is
    clean and stays.  Fields come back in alphabetical order, the order variants keep.
    """
    policy = policy or Policy()
    rules, threshold = policy.rules(), policy.threshold
    held = hold(df, {"__fields": object_fields(quoted(column))})
    held = hold(held, {"__texts": string_fields(F.col("__fields"), policy.min_chars)})
    matches = F.transform_values(
        "__texts", lambda _, text: spans.find_matches(truncate_text(text, policy.max_chars), rules)
    )
    held = hold(held, {"__matches": matches})
    types = F.flatten(F.transform(F.map_values("__matches"), lambda m: spans.match_types(m, rules, threshold)))
    held = hold(held, {"__types": F.coalesce(types, spans.no_strings())})

    def field(name: Column, value: Column) -> Column:
        found = F.element_at("__matches", name)
        new = redacted_text(F.element_at("__texts", name), found, policy)
        return F.when(F.size(found) > 0, new.cast("variant")).otherwise(value)

    document = quoted(column)
    if policy.redacts:
        changed = F.to_variant_object(F.transform_values("__fields", field))
        document = F.when(F.size("__types") > 0, changed).otherwise(document)
    metadata = {
        "pii_flag": F.size("__types") > 0,
        "pii_count": F.size("__types"),
        "pii_types": F.array_sort(F.array_distinct("__types")),
        "pii_scanned_at": scan_time(scanned_at),
    }
    columns = [document.alias(c) if c == column else quoted(c) for c in df.columns if c not in metadata]
    return held.select(*columns, *(value.alias(name) for name, value in metadata.items()))


def with_metadata_inside(df: DataFrame, column: str = "document") -> Column:
    """The scanned documents with the metadata as fields of their own, as JSON text.

    They replace fields of those names, as in an index whose documents carry their metadata.
    """
    values = {
        "pii_flag": F.col("pii_flag").cast("variant"),
        "pii_count": F.col("pii_count").cast("variant"),
        "pii_types": F.col("pii_types").cast("variant"),
        "pii_scanned_at": scanned_at_text(F.col("pii_scanned_at")).cast("variant"),
    }
    own = F.create_map(*(x for name, value in values.items() for x in (F.lit(name), value)))
    kept = F.map_filter(object_fields(quoted(column)), lambda name, _: ~name.isin(*METADATA))
    whole = F.to_json(F.to_variant_object(F.map_concat(kept, own)))
    return F.coalesce(whole, F.to_json(quoted(column)))
