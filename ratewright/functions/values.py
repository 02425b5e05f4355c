"""Parsing, coding and labelling of single values."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

_DIGITS = "[0-9]+(_[0-9]+)*"
_NUMBER = rf"^\s*[+-]?({_DIGITS}(\.({_DIGITS})?)?|\.{_DIGITS})([eE][+-]?[0-9]+)?\s*$"


def reads_as_integer(text: Column) -> Column:
    """Whether a lenient cast makes a BIGINT of the text: any number within range, decimals
    and exponents included, since those are rounded."""
    plain = F.regexp_replace(text, r"[\s_]", "")
    value = plain.try_cast("double")
    in_bounds = (value >= -(2.0**63)) & (value < 2.0**63)
    return text.rlike(_NUMBER) & (plain.try_cast("bigint").isNotNull() | in_bounds)


def as_filed_time(text: Column, day_format: str = "M/d/yyyy") -> Column:
    """Timestamp of a day written as ``day_format``; a plain timestamp text also counts."""
    by_day = F.try_to_timestamp(text, F.lit(day_format))
    return F.coalesce(by_day, text.try_cast("timestamp")).cast("timestamp_ntz")


def is_blank(text: Column) -> Column:
    return F.trim(text) == ""


def is_missing_or_not(column: Column, expected: Column) -> Column:
    """True for NULL, where a plain ``!=`` would be NULL and the row would slip through."""
    return column.isNull() | (column != expected)


def in_range(column: Column, low: float | None, high: float | None) -> Column:
    """Closed range; ``None`` leaves that side open."""
    test = F.lit(True)
    if low is not None:
        test = test & (column >= low)
    if high is not None:
        test = test & (column <= high)
    return test


def legend(code: Column, meanings: Mapping[object, str], otherwise: str) -> Column:
    """Code to text; NULL and unlisted codes read ``otherwise``."""
    if not meanings:
        return F.lit(otherwise)
    text = None
    for value, meaning in meanings.items():
        hit = code == F.lit(value)
        text = F.when(hit, F.lit(meaning)) if text is None else text.when(hit, F.lit(meaning))
    return text.otherwise(F.lit(otherwise))


def banded(column: Column, edges: Sequence[float], results: Sequence[object]) -> Column:
    """``results[i]`` for the first edge the value lies below; the last result is the rest."""
    if len(results) != len(edges) + 1:
        raise ValueError("one result per edge plus one for the rest")
    out = None
    for edge, result in zip(edges, results):
        hit = column < edge
        out = F.when(hit, F.lit(result)) if out is None else out.when(hit, F.lit(result))
    return out.otherwise(F.lit(results[-1]))
