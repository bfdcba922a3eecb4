"""String helpers: trimming, field splitting, number reading, naming and clipping."""

from __future__ import annotations

import re
from collections.abc import Iterable

from py4j.protocol import Py4JJavaError
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

WHITESPACE = " \t\n\x0b\f\r"
#: Separates parts of a text: a code point that is never a character.
MARK = "\uffff"
NUMBER = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"


def unix(pattern: str) -> str:
    """Prefix a pattern so that only a newline ends a line and `.` matches a carriage return."""
    return "(?d)" + ascii_boundaries(pattern)


def any_case(pattern: str) -> str:
    """As `unix`, ignoring case for all letters."""
    return "(?iud)" + ascii_boundaries(pattern)


def ascii_boundaries(pattern: str) -> str:
    r"""Spell out `\b`, whose letters beyond ASCII differ between Java releases."""
    word = "[A-Za-z0-9_]"
    edge = f"(?:(?<={word})(?!{word})|(?<!{word})(?={word}))"
    return re.sub(r"\\(.)", lambda m: edge if m.group(1) == "b" else m.group(0), pattern, flags=re.S)


def first_case(cases: Iterable[tuple[Column, Column]], default: Column | None = None) -> Column:
    """One CASE over (condition, value) pairs, the first that holds wins."""
    (condition, value), *rest = cases
    chain = F.when(condition, value)
    for condition, value in rest:
        chain = chain.when(condition, value)
    return chain if default is None else chain.otherwise(default)


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def extract(text: Column, pattern: str, group: int = 1) -> Column:
    """Group of the first match, null when the pattern does not match."""
    return F.when(text.rlike(unix(pattern)), F.regexp_extract(text, unix(pattern), group))


def groups(text: Column, pattern: str, count: int) -> Column:
    """All groups of a pattern anchored at both ends as one array, null without a match."""
    joined = F.regexp_replace(text, unix(pattern), MARK.join(f"${g + 1}" for g in range(count)))
    return F.when(text.rlike(unix(pattern)), F.split(joined, MARK, -1))


def rows_where(condition: Column, *fields: Column) -> Column:
    """Generator of one row of fields where the condition holds and none elsewhere.

    It filters and projects in one step, so an expensive expression is not repeated in a pushed-down filter.
    """
    return F.inline(F.when(condition, F.array(F.struct(*fields))))


def computed(*fields: Column) -> Column:
    """Columns computed once per row: later filters and constraints see plain columns, not the expressions."""
    return F.inline(F.array(F.struct(*fields)))


def fields(text: Column) -> Column:
    """Whitespace-separated fields; an empty array for a blank string."""
    clean = trimmed(text)
    return F.when(clean == "", F.array().cast("array<string>")).otherwise(F.split(clean, r"\s+"))


def number(text: Column) -> Column:
    """Double when the whole trimmed string is a number, else null."""
    clean = trimmed(text)
    return F.when(clean.rlike(NUMBER), clean.try_cast("double"))


def number_or_zero(text: Column) -> Column:
    return F.coalesce(number(text), F.lit(0.0))


def field_number(text: Column) -> Column:
    """Leading number of a field with a unit (`78%`, `42ms`); an address such as 10.1.1.2 is null."""
    head = F.regexp_extract(trimmed(text), r"^[0-9.+-]+", 0)
    return number(F.rtrim(head, F.lit(".+-")))


def sanitise(text: Column) -> Column:
    """Lower-case name with every run of other characters turned into one underscore."""
    return F.btrim(F.regexp_replace(F.lower(trimmed(text)), "[^a-z0-9]+", "_"), F.lit("_"))


def clip(text: Column, limit: int | None = None) -> Column:
    """Right-strip carriage returns and, if a limit is named, cut to that many characters with an ellipsis."""
    clean = F.rtrim(text, F.lit("\r"))
    if limit is None:
        return clean
    return F.when(F.length(clean) > limit, F.concat(F.substring(clean, 1, limit), F.lit("…"))).otherwise(clean)


def _variants() -> tuple[str, str]:
    """Lower-case letters whose upper-case form has another lower-case form, and that form."""
    pairs = [(c, c.upper().lower()) for c in map(chr, range(128, 0x10000)) if c == c.lower() and len(c.upper()) == 1]
    pairs = [(c, d) for c, d in pairs if c != d and len(d) == 1]
    return "".join(c for c, _ in pairs), "".join(d for _, d in pairs)


VARIANTS, VARIANT_FORMS = _variants()


def fold(text: Column) -> Column:
    """Case folding that also joins letters sharing one upper-case form.

    Nested `upper` and `lower` would do, but the optimizer keeps only the outer one of them.
    """
    return F.translate(F.lower(text), VARIANTS, VARIANT_FORMS)


def folded(text: str) -> str:
    """`fold` of a string known beforehand."""
    return text.lower().translate(str.maketrans(VARIANTS, VARIANT_FORMS))


def normal_path(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^\./", ""), "^/", "")


def base_name(path: Column) -> Column:
    return F.lower(F.substring_index(normal_path(path), "/", -1))


def trim_zeros(value: Column) -> Column:
    """At most two decimals without trailing zeros; negative zero prints as 0."""
    text = F.regexp_replace(F.format_string("%.2f", value.cast("double")), r"\.?0+$", "")
    return F.when(text.isin("", "-", "-0"), F.lit("0")).otherwise(text)


def as_gb(kilobytes: Column) -> Column:
    return F.concat(trim_zeros(kilobytes / 1024 / 1024), F.lit(" GB"))


def valid_regex(pattern: str) -> str:
    """The pattern itself when the engine that will run it compiles it, else its literal form."""
    session = SparkSession.getActiveSession()
    try:
        if session is None:
            re.compile(pattern)
        else:
            session.sparkContext._jvm.java.util.regex.Pattern.compile(any_case(pattern))
        return pattern
    except (re.error, Py4JJavaError, IllegalArgumentException):
        return re.escape(pattern)
