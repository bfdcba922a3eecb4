"""Mixing sources to target weights by iterative proportional fitting, in DataFrame functions only.

Documents fall into cells of (source, lang, topic). A cell's weight starts as its share of all tokens and is
raked: for each margin in turn, the weights of a margin's value are scaled to the value's target share, for
a fixed number of rounds. A document of a cell is then drawn with the cell's calibrated probability
`min(1, scale * weight / tokens)`; the scale is the one that makes the expected tokens meet the budget when
probabilities end at 1. The draw is a hash of the id, so a lost task draws the same documents again.

Only the cells, one row for each combination of values, are windowed; no document is. Up to `TASK_CELLS`
cells are kept in one task and sent to every executor; beyond that they are dealt out and joined by shuffle.

Targets not given by the caller are the tokens' shares to the power `temper`, which lifts small values.

Defined results: a null source or lang counts as the empty text, a null text as an empty one (no tokens,
topic `general`); documents without tokens have the probability of their cell, cells without tokens have
weight 0 and probability 0; values that have no target get weight 0; repeated rows are drawn alike; a null
id is drawn as the empty text; an empty table gives no rows; other columns are kept, those named like a
result column are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logquarry.llm.common import put_back, saved, set_apart

MARGINS = ("source", "lang", "topic")
#: (topic, mark): the first mark that a text holds names its topic.
TOPICS = (("contact", "@"), ("legal", "icense"), ("table", " | "), ("emphasis", "!!"))
GENERAL = "general"
WORD = r"[^\x20\x09-\x0D]+"
ROUNDS, TEMPER, BUDGET = 12, 0.5, 0.5
TASK_CELLS = 10_000
DIGITS = 9


def topic_of(text: Column) -> Column:
    found = F.lit(GENERAL)
    for topic, mark in reversed(TOPICS):
        found = F.when(F.contains(text, F.lit(mark)), F.lit(topic)).otherwise(found)
    return found


def described(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with topic and n_tokens."""
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.withColumns({"topic": topic_of(whole), "n_tokens": F.regexp_count(whole, F.lit(WORD)).cast("long")})


def _value(margin: str) -> Column:
    return F.coalesce(F.col(margin).cast("string"), F.lit(""))


def _share(total: Column) -> Column:
    return F.sum(total).over(Window.partitionBy(F.lit(1)))


def cells_of(described_docs: DataFrame) -> DataFrame:
    """(source, lang, topic, tokens): one row for each combination that occurs."""
    return described_docs.groupBy(*[_value(m).alias(m) for m in MARGINS]).agg(F.sum("n_tokens").alias("tokens"))


def _targets(cells: DataFrame, margin: str, temper: float, given: dict[str, float] | None) -> DataFrame:
    """(margin, target): shares that add up to one over the values that occur."""
    values = cells.groupBy(margin).agg(F.sum("tokens").cast("double").alias("tokens")).where("tokens > 0")
    if given is None:
        values = values.select(margin, F.pow("tokens", F.lit(temper)).alias("raw"))
    else:
        listed = cells.sparkSession.createDataFrame(sorted(given.items()), f"{margin} string, raw double")
        values = values.select(margin).join(listed, margin)
    return values.select(margin, (F.col("raw") / _share(F.col("raw"))).alias("target"))


def raked(cells: DataFrame, targets: dict[str, dict[str, float]] | None = None, rounds: int = ROUNDS, temper: float = TEMPER) -> DataFrame:
    """`cells` with `weight`, fitted to the targets of each margin; weights add up to one."""
    for margin in MARGINS:
        cells = cells.join(_targets(cells.select(*MARGINS, "tokens"), margin, temper, (targets or {}).get(margin)).withColumnRenamed("target", f"target_{margin}"), margin, "left")
    cells = saved(cells)
    if cells.count() <= TASK_CELLS:
        cells = cells.coalesce(1)
    cells = cells.withColumn("weight", F.col("tokens").cast("double"))
    for _ in range(rounds):
        for margin in MARGINS:
            held = F.sum("weight").over(Window.partitionBy(margin))
            cells = cells.withColumn("weight", F.when(held > 0, F.col("weight") * F.coalesce(f"target_{margin}", F.lit(0.0)) / held).otherwise(0.0))
    whole = _share(F.col("weight"))
    return cells.withColumn("weight", F.when(whole > 0, F.col("weight") / whole).otherwise(0.0)).select(*MARGINS, "tokens", "weight")


def calibrated(cells: DataFrame, budget: float = BUDGET) -> DataFrame:
    """`cells` with `probability`; `budget` is a share of all tokens.

    A cell ends at probability 1 where the scale reaches tokens / weight. In that order, the scale is what is
    left of the budget over the weight that is left, from the first cell that does not end below it.
    """
    end = F.when(F.col("weight") > 0, F.col("tokens") / F.col("weight"))
    ordered = Window.orderBy(F.col("end"), *MARGINS)
    above = ordered.rowsBetween(Window.unboundedPreceding, -1)
    rest = ordered.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    live = cells.withColumn("end", end).where("end is not null")
    total = cells.agg(F.sum("tokens").alias("all"))
    scales = live.crossJoin(total).select(
        "end", ((F.lit(budget) * F.col("all") - F.coalesce(F.sum("tokens").over(above), F.lit(0))) / F.sum("weight").over(rest)).alias("scale")
    )
    scale = scales.where("scale <= end").agg(F.min_by("scale", "end").alias("scale"))
    chance = F.when(F.col("scale").isNull() & (F.col("weight") > 0), 1.0).when(F.col("weight") > 0, F.least(F.lit(1.0), F.col("scale") * F.col("weight") / F.col("tokens"))).otherwise(0.0)
    return cells.crossJoin(scale).select(*MARGINS, "tokens", "weight", chance.alias("probability"))


def draw(key: Column) -> Column:
    """A number from 0 to 1 that depends on the id alone."""
    digest = F.sha2(F.coalesce(key.cast("string"), F.lit("")).cast("binary"), 256)
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def sampled(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, budget: float = BUDGET, rounds: int = ROUNDS, temper: float = TEMPER, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents drawn, with topic, n_tokens, weight (of their cell) and probability."""
    docs, names = set_apart(docs.drop("topic", "n_tokens", "weight", "probability"), key, text)
    named = described(docs, text)
    cells = saved(calibrated(raked(cells_of(named), targets, rounds, temper), budget)).drop("tokens")
    keys = cells.select(*[F.col(m).alias(f"_{m}") for m in MARGINS], F.round("weight", DIGITS).alias("weight"), "probability")
    few = cells.count() <= TASK_CELLS
    found = named.join(F.broadcast(keys) if few else keys, [_value(m) == F.col(f"_{m}") for m in MARGINS])
    found = found.where(draw(F.col(key)) < F.col("probability")).drop(*[f"_{m}" for m in MARGINS])
    return put_back(found.withColumn("probability", F.round("probability", DIGITS)), names)


def oracle(rounds: int = ROUNDS, temper: float = TEMPER, budget: float = BUDGET) -> str:
    """The same in DuckDB SQL, for `select doc_id, source, lang, topic, n_tokens, weight, probability`."""
    topic = "case " + " ".join(f"when contains(coalesce(text, ''), '{mark}') then '{name}'" for name, mark in TOPICS) + f" else '{GENERAL}' end"
    steps = [
        f"named as (select doc_id, source, lang, {topic} as topic, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as n_tokens from documents)",
        "cells as (select coalesce(source, '') as source, coalesce(lang, '') as lang, topic, sum(n_tokens)::double as tokens from named group by all)",
    ]
    for m in MARGINS:
        steps.append(f"t_{m} as (select {m}, raw / sum(raw) over () as target from (select {m}, pow(sum(tokens), {temper}) as raw from cells group by {m} having sum(tokens) > 0))")
    steps.append("w0 as (select cells.*, tokens as weight, " + ", ".join(f"coalesce(t_{m}.target, 0) as target_{m}" for m in MARGINS) + " from cells " + " ".join(f"left join t_{m} using ({m})" for m in MARGINS) + ")")
    last = 0
    for _ in range(rounds):
        for m in MARGINS:
            held = f"sum(weight) over (partition by {m})"
            steps.append(f"w{last + 1} as materialized (select * replace (case when {held} > 0 then weight * target_{m} / {held} else 0 end as weight) from w{last})")
            last += 1
    steps += [
        f"fitted as (select source, lang, topic, tokens, weight / sum(weight) over () as weight from w{last})",
        "live as (select *, tokens / weight as stop from fitted where weight > 0)",
        f"scales as (select stop, ({budget} * (select sum(tokens) from fitted) - coalesce(sum(tokens) over (order by stop, source, lang, topic rows between unbounded preceding and 1 preceding), 0)) / sum(weight) over (order by stop, source, lang, topic rows between current row and unbounded following) as scale from live)",
        "chosen as (select arg_min(scale, stop) as scale from scales where scale <= stop)",
        "chances as (select source, lang, topic, weight, case when weight > 0 and scale is null then 1.0 when weight > 0 then least(1.0, scale * weight / tokens) else 0 end as probability from fitted, chosen)",
    ]
    return (
        "with " + ", ".join(steps) + " select n.doc_id, n.source, n.lang, n.topic, n.n_tokens, round(c.weight, 9) as weight, round(c.probability, 9) as probability "
        "from named n join chances c on coalesce(n.source, '') = c.source and coalesce(n.lang, '') = c.lang and n.topic = c.topic "
        "where ('0x' || substr(sha256(coalesce(n.doc_id::varchar, '')), 1, 13))::bigint / 4503599627370496.0 < c.probability"
    )
