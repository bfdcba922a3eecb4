"""Whitespace or separator fields of a log message, and conditions on them.

`field(3).gt(10) & field(0).matches("eth")` builds a condition; `.on(text)` turns it into a Column.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from logquarry.functions.text import any_case, field_number, fields, trimmed

# Date, time, month and severity words in front of a message.
MONTHS = "jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec"
SEVERITIES = (
    "critical|high|medium|low|informational|info|debug|warn|warning|error|err|notice|alert|emerg"
)
DATE = r"\d{4}[-/]\d{2}[-/]\d{2}(?:T[^ \t\r]*)?"
CLOCK = r"\d{1,2}:\d{2}(?::\d{2})?(?:[.,]\d+)?"
BARE_WORD = r"[A-Za-z_-][A-Za-z0-9_-]*"

GAP = r"[ \t\r]*"
END = r"(?=[ \t\r]|\z)" + GAP
DAY_STAMP = rf"(?:{DATE}{END}|(?:(?iu){MONTHS}){END}\d{{1,2}}{END})"
CLOCK_STAMP = rf"(?:{CLOCK}{END})"
LABELS = rf"(?:(?:(?iu){SEVERITIES}){END}(?:{BARE_WORD}{END})?)?"
MESSAGE_PREFIX = rf"(?d)^{GAP}(?:(?:{DAY_STAMP}{CLOCK_STAMP}?|{CLOCK_STAMP}){LABELS})?"


def message(text: Column) -> Column:
    """Text after the timestamp and, only if there was one, after a severity and one bare word."""
    return F.regexp_replace(text, MESSAGE_PREFIX, "")


def separator_pattern(separator: str) -> str:
    """One character is literal, space and tab mean whitespace runs, longer is a regex or else literal."""
    if separator in (" ", "\t"):
        return r"\s+"
    if len(separator) == 1:
        return re.escape(separator)
    try:
        re.compile(separator)
        return separator
    except re.error:
        return re.escape(separator)


def message_fields(text: Column, separator: str | None = None) -> Column:
    """Fields of the message: whitespace runs, or trimmed parts of an explicit separator with empties kept."""
    if separator is None:
        return fields(message(text))
    body = message(text)
    parts = F.transform(F.split(body, separator_pattern(separator), -1), trimmed)
    return F.when(body == "", F.array().cast("array<string>")).otherwise(parts)


@dataclass(frozen=True)
class FieldCondition:
    build: Callable[[Column], Column]

    def on(self, text: Column) -> Column:
        return self.build(text)

    def __and__(self, other: FieldCondition) -> FieldCondition:
        return FieldCondition(lambda t: self.build(t) & other.build(t))

    def __or__(self, other: FieldCondition) -> FieldCondition:
        return FieldCondition(lambda t: self.build(t) | other.build(t))


@dataclass(frozen=True)
class Field:
    """Field number of the message, 1-based; 0 is the whole line."""

    number: int
    separator: str | None = None

    def value(self, text: Column) -> Column:
        if self.number == 0:
            return text
        return F.get(message_fields(text, self.separator), self.number - 1)

    def _test(self, compare: Callable[[Column], Column]) -> FieldCondition:
        return FieldCondition(lambda t: F.coalesce(compare(self.value(t)), F.lit(False)))

    def matches(self, pattern: str) -> FieldCondition:
        return self._test(lambda v: v.rlike(any_case(pattern)))

    def not_matches(self, pattern: str) -> FieldCondition:
        return self._test(lambda v: ~v.rlike(any_case(pattern)))

    def compare(self, op: str, right: str | float) -> FieldCondition:
        """Numeric when the right side is a number (a non-numeric field then fails), else lower-case text."""
        test = {
            ">": operator.gt,
            ">=": operator.ge,
            "<": operator.lt,
            "<=": operator.le,
            "=": operator.eq,
            "==": operator.eq,
            "!=": operator.ne,
        }[op]
        number = leading_number(str(right))
        if number is not None:
            return self._test(lambda v: test(field_number(v), F.lit(number)))
        return self._test(lambda v: test(F.lower(v), F.lit(str(right).lower())))


def leading_number(text: str) -> float | None:
    """The same reading of a number as for fields, for the right side of a comparison."""
    head = re.match(r"[0-9.+-]+", text.strip())
    try:
        return float(head.group().rstrip(".+-")) if head else None
    except ValueError:
        return None


def field(number: int, separator: str | None = None) -> Field:
    return Field(number, separator)
