"""Scores out of model replies, and rounding rules shared by all score maths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from contextmill.functions.text import strip

# Plain decimal numbers, infinities and NaN. Narrower than the JVM's own grammar,
# which also takes forms such as 0.5d and 0x1p-1.
NUMBER = r"(?i)\A[+-]?((\d+(\.\d*)?|\.\d+)(e[+-]?\d+)?|inf(inity)?|nan)\z"

SIMILARITY_PLACES = 9
SCORE_PLACES = 12


def clamp01(value: Column) -> Column:
    """Cut to [0, 1]. NaN becomes 1, as with max(0, min(1, nan)) in Python."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))


def parse_reply(reply: Column, fallback: Column) -> Column:
    """The score in a raw reply; the fallback for a missing or unreadable one."""
    trimmed = strip(reply)
    number = F.when(trimmed.rlike(NUMBER), trimmed.try_cast("double"))
    # greatest/least skip NULL, so the test for a bad reply must come first.
    return F.when(number.isNull(), fallback).otherwise(clamp01(number))


def round_score(value: Column) -> Column:
    return F.round(value, SCORE_PLACES)


def not_nan(value: Column) -> Column:
    return F.when(~F.isnan(value), value)
