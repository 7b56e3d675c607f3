"""Casts that take what logs really hold, and never fail a row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def lenient_count(text: Column) -> Column:
    """A non-negative whole number, or text of one with spaces around; anything else is 0.

    Too large a number stops at the largest long.
    """
    digits = F.regexp_extract(text, r"^\s*\+?0*([0-9]+)\s*$", 1)
    value = F.when(F.length(digits) > 19, F.lit(9223372036854775807)).otherwise(F.coalesce(digits.try_cast("bigint"), F.when(digits != "", F.lit(9223372036854775807))))
    return F.coalesce(value, F.lit(0).cast("bigint"))


def json_count(variant: Column) -> Column:
    """A whole number of a JSON value; strings, floats and negatives are 0."""
    kind = F.regexp_extract(F.schema_of_variant(variant), "^[A-Z]+", 0)
    value = F.try_variant_get(variant, "$", "bigint")
    return F.coalesce(F.when((kind == "BIGINT") & (value >= 0), value), F.lit(0).cast("bigint"))


def lenient_double(text: Column) -> Column:
    return text.try_cast("double")


def non_empty(text: Column) -> Column:
    """Trimmed text, null if nothing is left."""
    return F.nullif(F.trim(text), F.lit(""))


def first_present(*columns: Column) -> Column:
    """The first non-null of several spellings."""
    return F.coalesce(*columns)


def parses_strictly(raw: Column) -> Column:
    """Whether raw is JSON without repeated keys."""
    return F.try_parse_json(raw).isNotNull()


def embedded(text: Column, schema: str) -> Column:
    """JSON inside a JSON string."""
    return F.from_json(text, schema)


def sound_elements(array_text: Column, schema: str) -> Column:
    """The elements of a JSON array that fit schema; others are left out."""
    parts = F.from_json(array_text, "array<string>")
    return F.filter(F.transform(parts, lambda p: F.from_json(p, schema)), lambda e: e.isNotNull())
