"""Sections of a command-line dump: command bodies, system information, application table and licences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logquarry.functions.text import any_case, computed, extract, fields, number, trimmed, unix
from logquarry.operators.ordered import by_lines

# File name, command echoes, keys and row shapes.
DUMP_FILE = r"(?:^|/)tmp/cli/[^/]+\.txt$"
COMMAND_ECHO = r"^>\s+(.*\S)\s*$"
APP_STATS_COMMAND = r"^show running application statistics"
LICENCE_COMMAND = r"^request license info"
SYSTEM_INFO_COMMAND = r"\bshow\s+system\s+info\b"
SYSTEM_PAIR = r"^([A-Za-z0-9_-]+):\s*(.*)$"
SYSTEM_FIRST_KEY = "hostname"
SYSTEM_LAST_KEY = "device-certificate-status"
SYSTEM_MIN_PAIRS = 3
VSYS_LINE = r"^Vsys:\s*(\S+)"
LICENCE_ENTRY = r"^License entry:"
LICENCE_PAIR = r"^([A-Za-z][A-Za-z0-9 ?/_-]*?):\s*(.*)$"
LICENCE_KEYS = {
    "feature": ("feature",), "description": ("description",), "serial": ("serial",), "authcode": ("authcode",),
    "issued": ("issued",), "expires": ("expires",), "expired": ("expired?", "expired"), "base_license": ("base license",),
}

FILE = ("file_id", "entry_ord", "path")


def _first_file(rows: DataFrame) -> DataFrame:
    """Rows of the first file of each archive that has any."""
    first = rows.groupBy("file_id").agg(F.min("entry_ord").alias("entry_ord"))
    return rows.join(first, ["file_id", "entry_ord"], "left_semi")


def command_body(lines: DataFrame, command: str) -> DataFrame:
    """Lines below the first echo of a command, up to the next echo, from the first file with such a body."""
    dump = lines.where(F.col("path").rlike(DUMP_FILE))
    text = F.rtrim(F.col("text"), F.lit("\r"))
    echo = extract(trimmed(text), COMMAND_ECHO)
    rows = dump.select(*FILE, "line_no", computed(text.alias("text"), echo.alias("echo")))
    wanted = rows.where(F.col("echo").rlike(any_case(command)))
    first = wanted.groupBy(*FILE).agg(F.min("line_no").alias("command_at"))
    mark = F.when(F.col("echo").isNotNull(), F.col("line_no"))
    ordered = by_lines(rows.withColumn("_echo_at", mark)).carry({"command_at": "_echo_at"}).rows()
    body = ordered.where(F.col("echo").isNull()).join(first, [*FILE, "command_at"], "left_semi")
    return _first_file(body.select(*FILE, "line_no", "text"))


def system_info(lines: DataFrame) -> DataFrame:
    """(file_id, ord, key, value) pairs of the system-information block."""
    clean = trimmed(F.col("text"))
    rows = lines.where(F.col("path").rlike(DUMP_FILE)).select(*FILE, "line_no", clean.alias("text"))
    key = extract(F.col("text"), SYSTEM_PAIR)
    rows = rows.select("*", computed(key.alias("key")))

    def first(source: DataFrame, after: str | None, condition: Column, name: str) -> DataFrame:
        kept = source.where(condition if after is None else condition & (F.col("line_no") > F.col(after)))
        return kept.groupBy(*FILE).agg(F.min("line_no").alias(name))

    asked = rows.join(first(rows, None, F.col("text").rlike(unix(SYSTEM_INFO_COMMAND)), "asked_at"), list(FILE))
    opened = rows.join(first(asked, "asked_at", F.col("key") == SYSTEM_FIRST_KEY, "from_line"), list(FILE))
    other = first(opened, "from_line", F.col("key").isNull() & (F.col("text") != ""), "stop_at")
    last = first(opened, "from_line", F.col("key") == SYSTEM_LAST_KEY, "last_at")
    bounded = opened.join(other, list(FILE), "left").join(last, list(FILE), "left")
    inside = F.col("key").isNotNull() & (F.col("line_no") >= F.col("from_line"))
    inside = inside & (F.col("stop_at").isNull() | (F.col("line_no") < F.col("stop_at")))
    inside = inside & (F.col("last_at").isNull() | (F.col("line_no") <= F.col("last_at")))
    pairs = bounded.where(inside)
    ended = F.max((F.col("key") == SYSTEM_LAST_KEY).cast("int")) == 1
    whole = pairs.groupBy(*FILE).agg(F.count(F.lit(1)).alias("n"), ended.alias("ended"))
    whole = whole.where(F.col("ended") | (F.col("n") > SYSTEM_MIN_PAIRS)).select(*FILE)
    pairs = _first_file(pairs.join(whole, list(FILE), "left_semi"))
    ranked = by_lines(pairs.select(*FILE, "line_no", "key", "text")).positions("ord").rows()
    return ranked.select("file_id", "ord", "key", F.regexp_extract("text", unix(SYSTEM_PAIR), 2).alias("value"))


def application_table(body: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(applications, reported totals) of the application-statistics body; the last five fields are numbers."""
    clean = trimmed(F.col("text"))
    marked = body.select(*FILE, "line_no", clean.alias("text"), F.when(clean.rlike(any_case(VSYS_LINE)), F.regexp_extract(clean, any_case(VSYS_LINE), 1)).alias("_vsys"))
    rows = by_lines(marked).carry({"vsys": "_vsys"}).rows().where(F.col("_vsys").isNull())
    low = F.lower("text")
    rows = rows.where(~low.startswith("number of apps") & ~low.startswith("app (report-as)") & ~F.col("text").rlike("^[- ]*$"))
    f = fields(F.col("text"))
    rows = rows.where(F.size(f) >= 6).select(
        *FILE,
        "line_no",
        F.coalesce("vsys", F.lit("")).alias("vsys"),
        F.array_join(F.slice(f, F.lit(1), F.size(f) - 5), " ").alias("app"),
        F.transform(F.slice(f, -5, 5), number).alias("n"),
    )
    rows = rows.where(~F.exists("n", lambda v: v.isNull()))
    is_total = F.lower("app") == "total"
    measures = ("sessions", "packets", "bytes", "app_changed", "threats")
    apps = rows.where(~is_total).select("file_id", "vsys", "app", *[F.col("n")[i].alias(m) for i, m in enumerate(measures)], "line_no")
    reported = F.max_by(F.struct(*[F.col("n")[i].alias(f"reported_{m}") for i, m in enumerate(measures[:3])]), "line_no")
    totals = rows.where(is_total).groupBy("file_id").agg(reported.alias("t")).select("file_id", "t.*")
    return apps, totals


def licence_pairs(body: DataFrame) -> DataFrame:
    """(file_id, entry_at, line_no, key, value) of every licence entry, keys as written."""
    clean = trimmed(F.col("text"))
    entry = F.when(clean.rlike(any_case(LICENCE_ENTRY)), F.col("line_no"))
    marked = body.select(*FILE, "line_no", clean.alias("text"), entry.alias("_entry"))
    rows = by_lines(marked).carry({"entry_at": "_entry"}).rows()
    rows = rows.where(F.col("entry_at").isNotNull() & F.col("_entry").isNull() & F.col("text").rlike(unix(LICENCE_PAIR)))
    return rows.select(
        "file_id",
        "entry_at",
        "line_no",
        trimmed(F.regexp_extract("text", unix(LICENCE_PAIR), 1)).alias("key"),
        trimmed(F.regexp_extract("text", unix(LICENCE_PAIR), 2)).alias("value"),
    )


def licences(pairs: DataFrame) -> DataFrame:
    """One row per licence entry with a feature or description; a repeated key keeps its last value."""
    key = F.lower("key")
    columns = [
        F.coalesce(F.max_by("value", F.when(key.isin(*names), F.col("line_no"))), F.lit("")).alias(column)
        for column, names in LICENCE_KEYS.items()
    ]
    rows = pairs.groupBy("file_id", "entry_at").agg(*columns)
    return rows.where((F.col("feature") != "") | (F.col("description") != ""))


def other_licence_pairs(pairs: DataFrame, kept: DataFrame) -> DataFrame:
    """Pairs with keys that have no column of their own, for the licences that were kept."""
    known: Sequence[str] = [n for names in LICENCE_KEYS.values() for n in names]
    return pairs.where(~F.lower("key").isin(*known)).join(kept.select("file_id", "entry_at"), ["file_id", "entry_at"], "left_semi")


def licence_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("file_id").agg(
        F.count(F.lit(1)).alias("installed"), F.count_if(F.lower("expired") == "yes").alias("expired")
    )
