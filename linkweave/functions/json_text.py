"""Strict JSON reading as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_strict(text: Column) -> Column:
    """The text as a variant; null unless it is exactly one JSON value.

    try_parse_json stops after the first value, whatever follows.  Followed by anything, a value
    cannot parse both as a member of an object and as a member of an array.
    """
    in_object = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    in_array = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    return F.when(in_array.isNotNull(), F.try_variant_get(in_object, "$.v", "variant"))


def members(value: Column) -> Column:
    """The members of a JSON array; empty for anything else."""
    is_array = F.coalesce(F.schema_of_variant(value).startswith("ARRAY"), F.lit(False))
    empty = F.array().cast("array<variant>")
    return F.when(is_array, value.cast("array<variant>")).otherwise(empty)


def strings(values: Column) -> Column:
    """Those members of an array of variants that are JSON strings, as strings."""
    texts = F.filter(values, lambda v: F.coalesce(F.schema_of_variant(v) == "STRING", F.lit(False)))
    return F.transform(texts, lambda v: v.cast("string"))
