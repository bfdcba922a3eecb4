"""Boolean text conditions built from Python objects: `term("err") & ~phrase("retry ok")`.

A condition is turned into a Column by naming what one term means: a test on a line, or a
group-level flag. It also reports the literals a matching text must contain, for pruning.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from logquarry.functions.text import any_case, valid_regex

META = re.compile(r"[.\[\]()+?^$|{}\\*]")
MAX_LITERAL_GROUPS = 32
MIN_QUERY_LENGTH = 2


@dataclass(frozen=True)
class Condition:
    """A term, or `and` / `or` / `not` over other conditions."""

    kind: str
    text: str = ""
    parts: tuple[Condition, ...] = ()

    def __and__(self, other: Condition) -> Condition:
        return Condition("and", parts=(self, other))

    def __or__(self, other: Condition) -> Condition:
        return Condition("or", parts=(self, other))

    def __invert__(self) -> Condition:
        return Condition("not", parts=(self,))

    def terms(self) -> list[Condition]:
        if self.kind in ("regex", "literal"):
            return [self]
        found = list(itertools.chain.from_iterable(p.terms() for p in self.parts))
        return list(dict.fromkeys(found))

    def column(self, test: Callable[[Condition], Column]) -> Column:
        if self.kind in ("regex", "literal"):
            return test(self)
        columns = [p.column(test) for p in self.parts]
        if self.kind == "not":
            return ~columns[0]
        return columns[0] & columns[1] if self.kind == "and" else columns[0] | columns[1]

    def on(self, text: Column) -> Column:
        """Test one text; case is ignored."""
        return self.column(lambda t: line_test(t, text))

    def literal_groups(self) -> list[tuple[str, ...]] | None:
        """Alternatives, each a set of literals a match must contain; None when nothing is certain."""
        if self.kind == "not":
            return None
        if self.kind in ("regex", "literal"):
            plain = self.kind == "literal" or not META.search(self.text)
            return [(self.text,)] if plain else None
        left, right = (p.literal_groups() for p in self.parts)
        if self.kind == "or":
            if left is None or right is None or len(left) + len(right) > MAX_LITERAL_GROUPS:
                return None
            return left + right
        if left is None or right is None:
            return right if left is None else left
        if len(left) * len(right) > MAX_LITERAL_GROUPS:
            return left
        return [a + b for a in left for b in right]


def term(pattern: str) -> Condition:
    """Case-insensitive regular expression; an invalid one is taken literally."""
    _check(pattern)
    return Condition("regex", valid_regex(pattern))


def phrase(text: str) -> Condition:
    """Case-insensitive literal substring."""
    _check(text)
    return Condition("literal", text)


def _check(text: str) -> None:
    if len(text.strip()) < MIN_QUERY_LENGTH:
        raise ValueError(f"a search needs at least {MIN_QUERY_LENGTH} characters")


def line_test(part: Condition, text: Column) -> Column:
    if part.kind == "literal":
        return F.lower(text).contains(F.lower(F.lit(part.text)))
    return F.lower(text).rlike(any_case(part.text))
