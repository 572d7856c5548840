"""Lenient numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_int(value: Column, kind: str = "bigint") -> Column:
    """A whole number written as text, null for anything else (fractions too)."""
    return F.when(F.trim(value).rlike(r"^[+-]?\d{1,18}$"), F.trim(value).try_cast(kind))


def safe_int_of_number(value: Column, kind: str = "bigint") -> Column:
    """A number cut to its whole part."""
    return value.try_cast("double").try_cast(kind)


def truthy(value: Column) -> Column:
    """Whether a text counts as given."""
    return value.isNotNull() & (value != "")
