"""Text column helpers. All native expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from tracehold.functions import fixed_values as fv


def blank_to_null(column: Column) -> Column:
    """NULL for the two blanks (empty, one space); anything else unchanged."""
    return F.when(~column.isin(*fv.BLANKS), column)


def or_default(column: Column, default: str) -> Column:
    """The text, or the default where it is NULL or empty."""
    return F.coalesce(F.when(column != "", column), F.lit(default))


def strip(column: Column) -> Column:
    """Drop white space of every kind at both ends (Spark's trim drops spaces only)."""
    return F.regexp_replace(column, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")


def strip_fences(column: Column) -> Column:
    """Drop Markdown code fences, then strip."""
    bare = reduce(
        lambda text, fence: F.replace(text, F.lit(fence), F.lit("")), fv.CODE_FENCES, column
    )
    return strip(bare)


def bytes_to_text(column: Column) -> Column:
    """Binary as UTF-8 text where it is valid UTF-8, as lower-case hex otherwise."""
    return F.when(
        F.is_valid_utf8(column.cast("string")), column.cast("string")
    ).otherwise(F.lower(F.hex(column)))


def contains_any(column: Column, words, whole_words: bool = False) -> Column:
    """True where the lower-cased text holds one of the words; NULL text holds none."""
    form = r"(?<!\w)\Q{}\E(?!\w)" if whole_words else r"\Q{}\E"
    pattern = "|".join(form.format(word) for word in words)
    return F.lower(F.coalesce(column, F.lit(""))).rlike(pattern)


def once(column: Column) -> Column:
    """The value as a generated column, computed once per row.

    The optimizer copies an expensive expression into every filter and column
    that uses it, but never through a generator. Only for use in ``select``.
    """
    return F.explode(F.array(column))


def two_decimals(column: Column) -> Column:
    """The number with two decimals, as text, rounded by its exact binary value."""
    return F.call_function("format_number", column, F.lit("0.00"))
