"""Gateway selection of the endpoint agent: candidates of the last round, scores, choice and notes."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logquarry.functions.text import any_case, computed, first_case, trimmed, unix
from logquarry.operators.agentlogs import PLACE, place, service_lines
from logquarry.operators.ordered import by_lines, settle

# Line shapes, tried in this order.
KINDS = (
    ("round", any_case(r"Parse gateway list for user (\S+)")),
    ("entry", unix(r"Gateway (\S+?)\(([^)]*)\): ipv4 (\S*), ipv6 (\S*), FQDN (\w+)")),
    ("priority", any_case(r"One (external|internal) gateway (\S+?), priority=(-?\d+), manual is (\d)")),
    ("mismatch", any_case(r"One (?:external|internal) gateway and the priority is (-?\d+), region does not match")),
    ("region", unix(r"REGION-PRIO, gateway \d+\(([^)]*)\).*?region = (\S+), priority = (-?\d+), portalRegion=(\S+)")),
    ("tcp", any_case(r"tcp connection time is (\d+)")),
    ("type", any_case(r"Gateway selection type is (\w+)")),
    ("best", any_case(r"m_pBestGateway=\w+ \(gateway=([^)]+)\)")),
    ("count", any_case(r"gateway count is (\d+), cutoff time is (\d+)")),
    ("internal", any_case(r"Gateway count is (\d+) for internal network")),
    ("score", any_case(r"Gateway selection\(Priority-TCP-SSL-Weight\):\s*(.+)")),
    ("empty", any_case(r"gateway list is empty")),
)
SCORE_ENTRY = r"([^(,]+?)\s*\((\d+)-(\d+)-(\d+)-(\d+)\)"
NOTES = {
    "region_mismatch": "gateways lie outside the client's region, which scores them -2 and removes them",
    "all_negative": "every gateway scored below zero, so none was eligible",
    "empty_list": "the agent logged an empty gateway list at least once",
    "several_gateways": "priority and response time both count between several gateways",
    "weighted": "the lowest weight, a mix of priority and response times, wins",
}

FACTS = ("name", "ipv4", "ipv6", "priority", "manual", "internal", "region_match", "tcp_ms", "ssl_ms", "weight")
ROUND = ("file_id", "round_at")


def gateway_lines(lines: DataFrame) -> DataFrame:
    """Recognised lines with their kind, groups and round (null before the first gateway list)."""
    low = F.lower("text")
    rows = service_lines(lines).where(low.contains("gateway") | low.contains("tcp connection time"))
    rows = rows.withColumn("kind", first_case([(F.col("text").rlike(p), F.lit(k)) for k, p in KINDS]))
    rows = rows.where(F.col("kind").isNotNull())

    def group(number: int) -> Column:
        return first_case(
            [(F.col("kind") == k, F.regexp_extract("text", p, number)) for k, p in KINDS if _group_count(p) >= number]
        )

    rows = rows.select("file_id", *PLACE, computed(F.col("kind"), *[group(i).alias(f"g{i}") for i in (1, 2, 3, 4)]))
    marks = {
        "_round": F.when(F.col("kind") == "round", place()),
        "_tcp": F.when(F.col("kind") == "tcp", F.struct(*PLACE, F.col("g1").cast("int").alias("ms"))),
        "_priority": F.when(F.col("kind") == "priority", place()),
    }
    rows = rows.select("*", *[c.alias(n) for n, c in marks.items()])
    ordered = by_lines(rows, ("file_id",), PLACE).carry({"round_at": "_round"}, above={"tcp": "_tcp", "used": "_priority"})
    rows = ordered.rows()
    tcp_at = F.struct(*[F.col(f"tcp.{c}").alias(c) for c in PLACE])
    fresh = (F.col("used").isNull() | (tcp_at > F.col("used"))) & (F.col("round_at").isNull() | (tcp_at > F.col("round_at")))
    attached = F.when((F.col("kind") == "priority") & F.col("tcp").isNotNull() & fresh, F.col("tcp.ms"))
    first_round = F.struct(*[F.lit(-(2**31)).cast(t).alias(c) for c, t in zip(PLACE, ("int", "long", "long"))])
    at = F.coalesce(F.struct(*[F.col(f"round_at.{c}").cast(t).alias(c) for c, t in zip(PLACE, ("int", "long", "long"))]), first_round)
    at = F.when(F.col("round_at").isNotNull(), at).otherwise(first_round)
    return rows.select("file_id", *PLACE, "kind", "g1", "g2", "g3", "g4", at.alias("round_at"), attached.alias("tcp_ms"))


def _group_count(pattern: str) -> int:
    return re.compile(pattern.replace("(?iud)", "").replace("(?d)", "")).groups


def scores(rows: DataFrame) -> DataFrame:
    """Entries of every score line, matched to the round's gateways by display name."""
    lists = [F.regexp_extract_all("g1", F.lit(SCORE_ENTRY), i + 1).alias(n) for i, n in enumerate("nptsw")]
    lines = rows.where(F.col("kind") == "score").select(*ROUND, *PLACE, F.posexplode(F.arrays_zip(*lists)).alias("idx", "s"))
    entries = lines.select(
        *ROUND, *PLACE, "idx", trimmed(F.col("s.n")).alias("shown"),
        *[F.col(f"s.{k}").cast("int").alias(c) for k, c in zip("ptsw", ("priority", "tcp_ms", "ssl_ms", "weight"))],
    ).where(F.col("shown") != "")
    named = rows.where((F.col("kind") == "entry") & (F.col("g2") != "")).groupBy(*ROUND, F.lower("g2").alias("key"), F.col("g1").alias("match"))
    named = named.agg(F.min(place()).alias("named_at"))
    joined = entries.withColumn("key", F.lower("shown")).join(named, [*ROUND, "key"], "left")
    known = F.when(F.col("named_at") < place(), F.struct("named_at", "match"))
    columns = ["shown", "priority", "tcp_ms", "ssl_ms", "weight"]
    best = joined.groupBy(*ROUND, *PLACE, "idx", *columns).agg(F.max(known).alias("known"))
    return best.select(
        *ROUND, *PLACE, "idx", F.coalesce("known.match", "shown").alias("fqdn"),
        F.when(F.col("known").isNull(), F.col("shown")).alias("name"), *columns[1:],
    )


def gateway_facts(rows: DataFrame, scored: DataFrame) -> DataFrame:
    """One row per fact about a gateway, in log order; a region mismatch belongs to the gateway added last."""
    kind = F.col("kind")
    empty = {f: F.lit(None) for f in FACTS}

    def facts(source: DataFrame, fqdn: Column, index: Column, **values: Column) -> DataFrame:
        types = {"name": "string", "ipv4": "string", "ipv6": "string", "manual": "boolean", "internal": "boolean", "region_match": "boolean"}
        columns = [({**empty, **values})[f].cast(types.get(f, "int")).alias(f) for f in FACTS]
        return source.select(*ROUND, *PLACE, index.cast("int").alias("idx"), fqdn.alias("fqdn"), *columns)

    zero = F.lit(0)
    entry = facts(rows.where(kind == "entry"), F.col("g1"), zero, name=F.col("g2"), ipv4=F.col("g3"), ipv6=F.col("g4"))
    priority = facts(
        rows.where(kind == "priority"), F.col("g2"), zero,
        priority=F.col("g3").try_cast("int"), manual=F.col("g4") == "1", internal=F.lower("g1") == "internal",
        region_match=F.lit(True), tcp_ms=F.col("tcp_ms"),
    )
    score = facts(
        scored, F.col("fqdn"), F.col("idx"), name=F.col("name"),
        **{c: F.col(c) for c in ("priority", "tcp_ms", "ssl_ms", "weight")},
    )
    named = entry.unionByName(priority).unionByName(score)
    order = (*PLACE, "idx")
    added = named.groupBy(*ROUND, "fqdn").agg(F.min(F.struct(*order)).alias("p"))
    added = added.select("file_id", "round_at", *[F.col(f"p.{c}").alias(c) for c in order], F.struct("round_at", "fqdn").alias("_added"))
    bad = rows.where(kind == "mismatch").select("file_id", "round_at", *PLACE, F.lit(-1).alias("idx"), F.col("g1").try_cast("int").alias("priority"))
    mixed = added.unionByName(bad, allowMissingColumns=True)
    marked = by_lines(mixed, ("file_id",), order).carry({"latest": "_added"}).rows()
    hit = marked.where((F.col("idx") == -1) & (F.col("latest.round_at") == F.col("round_at")))
    return named.unionByName(facts(hit, F.col("latest.fqdn"), zero, priority=F.col("priority"), region_match=F.lit(False)))


def gateway_rounds(facts: DataFrame) -> DataFrame:
    """Latest value of every fact per gateway and round."""
    order = F.struct(*PLACE, "idx")
    return facts.groupBy(*ROUND, "fqdn").agg(
        F.min(order).alias("added"), *[F.max_by(f, F.when(F.col(f).isNotNull(), order)).alias(f) for f in FACTS]
    )


def selection(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(gateways of the last round, selection summary) of every archive."""
    rows = settle(gateway_lines(lines))
    scored = settle(scores(rows))
    at, kind = place(), F.col("kind")

    def last(value: Column, name: str) -> Column:
        return F.max_by(value, F.when(kind == name, at))

    summary = rows.groupBy("file_id").agg(
        F.max("round_at").alias("last_round"),
        last(F.lower("g1"), "type").alias("type"),
        last(F.col("g1"), "best").alias("explicit"),
        last(F.col("g1").try_cast("int"), "count").alias("external_count"),
        last(F.col("g2").try_cast("int"), "count").alias("cutoff_secs"),
        last(F.col("g1").try_cast("int"), "internal").alias("internal_count"),
        F.max(kind == "empty").alias("saw_empty"),
    )
    per_line = scored.groupBy("file_id", *PLACE).agg(F.min_by("fqdn", F.struct("weight", "idx")).alias("fqdn"))
    first_score = per_line.groupBy("file_id").agg(F.min_by("fqdn", at).alias("scored_best"))
    summary = summary.join(first_score, "file_id", "left").withColumn("best", F.coalesce("explicit", "scored_best"))
    regions = rows.where(kind == "region").groupBy("file_id", F.col("g1").alias("name")).agg(F.max_by("g2", at).alias("region"))
    found = gateway_rounds(gateway_facts(rows, scored))
    head = summary.select("file_id", F.col("last_round").alias("round_at"), "best")
    found = found.join(head, list(ROUND)).join(regions, ["file_id", "name"], "left")
    found = found.withColumn("selected", F.coalesce(F.lower("best") == F.lower("fqdn"), F.lit(False)))
    gateways = found.select("file_id", "fqdn", *FACTS, "region", "selected", "added")
    return gateways, summary.select("file_id", "type", "best", "cutoff_secs", "external_count", "internal_count", "saw_empty")


def gateway_notes(gateways: DataFrame, summary: DataFrame) -> DataFrame:
    """(file_id, ord, note, text) of the rules that apply."""
    counts = gateways.groupBy("file_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(~F.col("region_match")).alias("mismatch"),
        F.count_if(F.col("priority") < 0).alias("negative"),
        F.count_if(F.col("weight").isNotNull()).alias("scored"),
    )
    rows = summary.select("file_id", "saw_empty").join(counts, "file_id", "left").fillna(0)
    applies = {
        "region_mismatch": F.col("mismatch") > 0,
        "all_negative": (F.col("negative") > 0) & (F.col("negative") == F.col("n")),
        "empty_list": F.col("saw_empty"),
        "several_gateways": F.col("n") > 1,
        "weighted": F.col("scored") > 1,
    }
    notes = F.array_compact(
        F.array(
            *[
                F.when(c, F.struct(F.lit(i).alias("ord"), F.lit(k).alias("note"), F.lit(NOTES[k]).alias("text")))
                for i, (k, c) in enumerate(applies.items())
            ]
        )
    )
    return rows.select("file_id", F.inline(notes))


def in_order(gateways: DataFrame) -> DataFrame:
    """Gateways with their position in first-seen order."""
    window = Window.partitionBy("file_id").orderBy("added")
    return gateways.withColumn("ord", F.row_number().over(window))
