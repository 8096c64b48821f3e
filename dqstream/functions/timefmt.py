"""Timestamp text formats as column expressions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The ISO 8601 grammar. Field ranges, month lengths and leap days
# are in the pattern, so that one match settles all but week 53.
_YEAR = r"(?!0000)\d{4}"
_LEAP = r"(?!0000)(?:\d\d(?:0[48]|[2468][048]|[13579][26])|(?:[02468][048]|[13579][26])00)"
_31 = r"(?:0[1-9]|[12]\d|3[01])"
_30 = r"(?:0[1-9]|[12]\d|30)"
_28 = r"(?:0[1-9]|1\d|2[0-8])"


def _calendar(dash: str) -> str:
    month_days = rf"(?:(?:0[13578]|1[02]){dash}{_31}|(?:0[469]|11){dash}{_30}|02{dash}{_28})"
    return rf"(?:{_YEAR}{dash}{month_days}|{_LEAP}{dash}02{dash}29)"


_WEEK = r"(?:0[1-9]|[1-4]\d|5[0-2])"
_SECONDS = r"[0-5]\d(?:[.,]\d+)?"
_HOUR = r"(?:[01]\d|2[0-3])"
_CLOCK = rf"(?:{_HOUR}(?::[0-5]\d(?::{_SECONDS})?)?|{_HOUR}[0-5]\d(?:{_SECONDS})?)"
_REST = rf"(?:.{_CLOCK}(?:[+-]{_CLOCK})?)?"
_WEEKDATE = rf"{_YEAR}(?:-W{_WEEK}(?:-[1-7])?|W{_WEEK}[1-7]?)"
_ISO = rf"(?s)\A(?:{_calendar('-')}|{_calendar('')}|{_WEEKDATE}){_REST}\z"
_ISO_WEEK_53 = rf"(?s)\A{_YEAR}(?:-W53(?:-[1-7])?|W53[1-7]?){_REST}\z"

# Epoch milliseconds from year 1 to year 9999, as middle and half
# width; both are exact in a double.
_EPOCH_MIDDLE = (253_402_300_799_999 - 62_135_596_800_000) / 2
_EPOCH_HALF = (253_402_300_799_999 + 62_135_596_800_000) / 2
_EPOCH_TEXT = r"\A\s*[+-]?\d+(?:_\d+)*\s*\z"


def is_iso8601(text: Column) -> Column:
    """ISO 8601 date or date and time, `Z` read as `+00:00`."""
    plain = F.replace(text, F.lit("Z"), F.lit("+00:00"))
    # 28 December is always in the last week of its year.
    last_week = F.weekofyear(F.concat(F.substring(text, 1, 4), F.lit("-12-28")).try_cast("date"))
    return F.coalesce(plain.rlike(_ISO) | (plain.rlike(_ISO_WEEK_53) & (last_week == 53)), F.lit(False))


def is_epoch_millis(text: Column) -> Column:
    """Text of an integer in the range of datetime; `_` may part digits."""
    number = F.regexp_replace(text, r"[\s_]", "").try_cast("double")
    near = F.abs(number - F.lit(_EPOCH_MIDDLE)) <= F.lit(_EPOCH_HALF)
    return F.coalesce(text.rlike(_EPOCH_TEXT) & near, F.lit(False))


_KNOWN = {"iso8601": is_iso8601, "epoch_millis": is_epoch_millis}


def format_column(text: Column, formats: Sequence[str]) -> Column:
    """True when any of the formats fits; unknown formats never do."""
    return reduce(lambda a, b: a | b, [_KNOWN[f](text) for f in formats if f in _KNOWN], F.lit(False))
