"""URL filters: pattern rules, each indexed by its rarest literal token.

A rule is (action, rule, pattern): `rule` is its name and precedence (longer names win, then the smaller
name, then block over allow), `pattern` a regular expression over `host + path`. Each pattern names the
literal tokens (runs of letters and digits) that every url it fits must contain. The rule is filed under
the one of them that the fewest urls of the table contain; a url's own tokens fetch the rules filed under
them, and only those run their expression. Rules without a literal token are tried on every url.

Defined results: a null url, or one without `://`, has empty host and path and gets the default verdict
unless a rule without tokens fits the empty text; repeated rows are judged alike; an empty table gives no
rows; other columns are kept, those named like a result column are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logquarry.llm.common import put_back, set_apart

ALLOW, BLOCK = "allow", "block"
#: Rules held by every task; a longer list is judged by a shuffled join of tokens.
TASK_RULES = 100_000
#: Tokens of urls and rules.
TOKEN = r"[0-9A-Za-z]+"


@dataclass(frozen=True)
class Rule:
    action: str
    name: str
    pattern: str
    tokens: tuple[str, ...]


def path_rule(action: str, host: str, path: str) -> Rule:
    """Fits the host and its subdomains where the path starts with `path`; the last token of a path may go on in the url."""
    whole = re.findall(TOKEN, host) + [m[0] for m in re.finditer(TOKEN, path) if m.end() < len(path)]
    return Rule(action, host + path, rf"^(?:[^/]*\.)?{re.escape(host)}{re.escape(path)}", tuple(dict.fromkeys(whole)))


#: The rules of `op2_url_filter`.
RULES = (
    path_rule(BLOCK, "com", "/en/"),
    path_rule(ALLOW, "example.com", "/en/7"),
    path_rule(ALLOW, "net", "/de/"),
    path_rule(BLOCK, "example.net", "/de/8"),
    path_rule(BLOCK, "org", "/es/"),
)


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty if there is none."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _tokens(subject: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(subject, F.lit(f"({TOKEN})"), 1))


def rarest_tokens(subjects: DataFrame, rules: Iterable[Rule]) -> list[str | None]:
    """For each rule the literal token that the fewest rows of `subjects` contain; null for a rule without tokens."""
    rules = list(rules)
    named = subjects.sparkSession.createDataFrame([(t,) for r in rules for t in r.tokens], "token string").distinct()
    seen = subjects.select(F.explode(_tokens(F.col("_subject"))).alias("token")).groupBy("token").count()
    # one row for each token that a rule names
    counts = {r["token"]: r["count"] or 0 for r in named.join(seen, "token", "left").collect()}
    return [min(r.tokens, key=lambda t: (counts[t], t)) if r.tokens else None for r in rules]


def _better(rule: Rule) -> tuple:
    return -len(rule.name), rule.name, rule.action != BLOCK


class Index:
    """Rules by the token they are filed under."""

    def __init__(self, rules: Iterable[Rule], filed: Iterable[str | None]):
        self.by_token: dict[str | None, list[tuple]] = {}
        for rule, token in zip(rules, filed, strict=True):
            self.by_token.setdefault(token, []).append((_better(rule), re.compile(rule.pattern), rule.name, rule.action))
        for listed in self.by_token.values():
            listed.sort(key=lambda x: x[0])

    def judge(self, subject: str) -> tuple[str | None, str | None]:
        """(rule, action) of the best rule that fits."""
        best = None
        for token in (None, *dict.fromkeys(re.findall(TOKEN, subject))):
            for rank, pattern, name, action in self.by_token.get(token, ()):
                if best is not None and rank >= best[0]:
                    break
                if pattern.search(subject):
                    best = (rank, name, action)
                    break
        return (best[1], best[2]) if best else (None, None)


def judged(pages: DataFrame, rules: Iterable[Rule] = RULES, url: str = "url", default: str = ALLOW, task_rules: int = TASK_RULES) -> DataFrame:
    """`pages` with host, path, rule and verdict."""
    rules = sorted(rules, key=_better)
    pages, names = set_apart(pages, url)
    parts = pages.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    parts = parts.withColumn("_subject", F.concat("host", "path"))
    filed = rarest_tokens(parts, rules)
    parts = _by_index(parts, rules, filed) if len(rules) <= task_rules else _by_join(parts, rules, filed)
    return put_back(parts.withColumns({"rule": F.col("_found.rule"), "verdict": F.coalesce("_found.verdict", F.lit(default))}).drop("_subject", "_found"), names)


def _by_index(parts: DataFrame, rules: list[Rule], filed: list[str | None]) -> DataFrame:
    """The whole index in every task: its size is bounded by `TASK_RULES`."""

    @F.pandas_udf("rule string, verdict string")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        index = Index(rules, filed)
        for subjects in batches:
            yield pd.DataFrame([index.judge(s) for s in subjects], columns=["rule", "verdict"])

    return parts.withColumn("_found", find("_subject"))


def _by_join(parts: DataFrame, rules: list[Rule], filed: list[str | None]) -> DataFrame:
    """Tokens of the distinct subjects meet the rules in a shuffled join; both sides are exchanged, so a hot token can be split."""
    listed = [(token, i, r.pattern, r.name, r.action) for i, (r, token) in enumerate(zip(rules, filed, strict=True))]
    table = parts.sparkSession.createDataFrame(listed, "token string, rank int, pattern string, rule string, verdict string")
    subjects = parts.select("_subject").distinct()
    tokens = subjects.select("_subject", F.explode(F.concat(F.array(F.lit(None).cast("string")), _tokens(F.col("_subject")))).alias("token"))
    fits = tokens.join(table, tokens.token.eqNullSafe(table.token)).where(F.expr("_subject rlike pattern"))
    best = fits.groupBy("_subject").agg(F.min_by(F.struct("rule", "verdict"), "rank").alias("_found"))
    return parts.join(best, "_subject", "left")
