"""Scalar helpers for codes, labels and keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_number(label: Column) -> Column:
    """Label to double; text that is no number becomes missing."""
    return label.cast("string").try_cast("double")


def last_digit(code: Column) -> Column:
    """Last digit of a code; a code that does not end in a digit is returned unchanged."""
    return F.regexp_replace(code, ".*([0-9]$)", "$1")


def paste(*parts: Column, sep: str = " ") -> Column:
    """Join texts with a separator; a missing part shows as the text NA."""
    return F.concat_ws(sep, *[F.coalesce(p.cast("string"), F.lit("NA")) for p in parts])


def _tenths(size: Column) -> Column:
    """Nearest whole number of tenths of a number from 0 to 1e13, judged on its binary value; ties go to the even one.

    The number is cut in two parts whose products by 20 are exact, so its distance to the middle of two tenths has the right sign.
    """
    high = size * 134217729.0 - (size * 134217729.0 - size)
    low = F.floor(size * 20.0 / 2.0).cast("double")
    beyond = (high * 20.0 - (2.0 * low + 1.0)) + (size - high) * 20.0
    up = (beyond > 0) | ((beyond == 0) & (low % 2.0 == 1.0))
    return F.when(up, low + 1.0).otherwise(low)


def percent_change_label(ratio: Column) -> Column:
    """A ratio of 1.25 becomes the text 25.0%; rounded as C printf does: by the binary value, ties to the even digit, small losses to -0.0%."""
    change = 100.0 * (ratio - 1.0)
    text = F.format_string("%.1f%%", _tenths(F.abs(change)) / 10.0)
    signed = F.when(change < 0, F.concat(F.lit("-"), text)).otherwise(text)
    return F.when(F.abs(change) < 1e13, signed).otherwise(F.format_string("%.1f%%", F.bround(change, 1)))


def percent_change(ratio: Column) -> Column:
    return 100.0 * (ratio - 1.0)


def display_name(name: Column) -> Column:
    """First underscore to a space."""
    return F.regexp_replace(name, "^([^_]*)_", "$1 ")


def effect_class(lower: Column, upper: Column) -> Column:
    """Direction of a ratio interval; missing bounds count as no effect."""
    return F.when(lower > 1, "Positive").when(upper < 1, "Negative").otherwise("None")
