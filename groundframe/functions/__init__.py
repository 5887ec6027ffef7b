"""Text and value normalisation as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_id(value: Column, fallback: str = "item") -> Column:
    """Lower-cased, other than letters and digits as single underscores, none at the ends; prefixed before a digit (FN-01)."""
    text = F.trim(F.regexp_replace(F.lower(F.coalesce(value, F.lit(""))), r"[^\p{L}\p{N}]+", "_"), F.lit("_"))
    text = F.when(text == "", F.lit(fallback)).otherwise(text)
    return F.when(text.rlike("^[0-9]"), F.concat(F.lit(f"{fallback}_"), text)).otherwise(text)


def header_key(value: Column) -> Column:
    """A column heading's key: trimmed, lower-cased, spaces and hyphens as underscores (FN-02)."""
    return F.translate(F.lower(F.trim(value)), " -", "__")


def first_filled(*columns: Column) -> Column:
    """The first that isn't null or blank (FN-03)."""
    return F.coalesce(*(F.when(F.trim(c) != "", c) for c in columns))


def strict_double(value: Column) -> Column:
    """A number, null for blank; anything else fails (FN-04)."""
    return F.when(F.trim(value) != "", F.trim(value).cast("double"))


def source_type(value: Column) -> Column:
    """Trimmed, lower-cased, hyphens as underscores (SRC-26)."""
    return F.translate(F.lower(F.trim(value)), "-", "_")


def quantised(value: Column, digits: int) -> Column:
    """Rounded to digits, halves to even (FN-20)."""
    return F.bround(value, digits)


def overlap(a0: Column, a1: Column, b0: Column, b1: Column, tolerance: float = 0.0) -> Column:
    """Whether intervals overlap by more than -tolerance (FN-21)."""
    return F.least(a1, b1) - F.greatest(a0, b0) > -tolerance


def stable_hash(*columns: Column, length: int = 12) -> Column:
    """The first `length` hex digits of the SHA-1 of the columns' texts, null apart from blank (FN-09, FN-10)."""
    text = F.concat_ws("\x1f", *(F.coalesce(c.cast("string"), F.lit("\x00")) for c in columns))
    return F.substring(F.sha1(text), 1, length)
