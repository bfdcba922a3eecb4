"""Posture report of the endpoint agent: locating it, its tables and flat facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logquarry.functions.text import base_name, groups, trimmed
from logquarry.functions.timestamps import agent_timestamp
from logquarry.operators.agentlogs import SERVICE_LOGS, age
from logquarry.operators.ordered import by_lines
from logquarry.operators.structure import PORTAL_LINE, TRACE_LINE

# Block markers, file names, attributes and fact names.
BLOCK_START = "---------------Full hip report ---------"
BLOCK_END = "---------------End of full hip report ---------"
REPORT_END = "</hip-report>"
REPORT_FILE = r"(hrpt\.xml|^hipreport\.xml)$"
PRODUCT_ATTRIBUTES = {"vendor": "vendor", "name": "name", "version": "version", "def_version": "defver", "engine_version": "engver"}
PRODUCT_STATES = {
    "real_time_protection": "real-time-protection", "last_full_scan": "last-full-scan-time",
    "enabled": "is-enabled", "last_backup": "last-backup-time",
}
PATCH_TAGS = {
    "title": "title", "description": "description", "vendor": "vendor", "kb": "kb-article-id",
    "bulletin": "security-bulletin-id", "severity": "severity", "category": "category", "installed": "is-installed",
}
REPORT_TAGS = {"generated_at": "generate-time", "version": "hip-report-version", "user_name": "user-name", "ip_address": "ip-address"}
HOST_TAGS = {"client_version": "client-version", "os": "os", "os_vendor": "os-vendor", "domain": "domain", "host_id": "host-id"}
REPORT_FACTS = {"generated": "generated_at", "report version": "version"}
HOST_FACTS = {
    "client-version": "client_version", "os": "os", "os-vendor": "os_vendor", "domain": "domain",
    "host-name": "host_name", "host-id": "host_id", "user-name": "user_name", "ip-address": "ip_address",
}
PRODUCT_FACTS = {
    "vendor": "vendor", "version": "version", "definition version": "def_version", "engine version": "engine_version",
    "definition date": "def_date", "real-time protection": "real_time_protection", "last full scan": "last_full_scan",
    "enabled": "enabled", "last backup": "last_backup",
}
PATCH_FACTS = {
    "category": "category", "severity": "severity", "kb-article-id": "kb", "security-bulletin-id": "bulletin",
    "vendor": "vendor", "installed": "installed", "description": "description",
}

FILE = ("file_id", "entry_ord", "path")
DOCUMENT = ("file_id", "path")


def report_lines(lines: DataFrame) -> DataFrame:
    """XML lines of one report per archive: the last complete block of the newest service log, else a report file."""
    base = base_name(F.col("path"))
    logs = lines.where(base.rlike(SERVICE_LOGS))
    text = F.col("text")
    mark = _marker(text)
    stamped = logs.select(*FILE, "line_no", "text", mark.alias("mark"))
    stamped = stamped.withColumn("_mark", F.when(F.col("mark").isNotNull(), F.struct(F.col("line_no").alias("at"), F.col("mark").alias("kind"))))
    rows = by_lines(stamped).carry(above={"open": "_mark"}).rows()
    inside = F.col("open.kind") == "start"
    body = rows.where(inside & F.col("mark").isNull()).withColumn("block_at", F.col("open.at"))
    ends = rows.where(inside & (F.col("mark") == "end")).select(*FILE, F.col("open.at").alias("block_at"))
    whole = body.groupBy(*FILE, "block_at").agg(F.max(F.col("text").contains(REPORT_END)).alias("whole"))
    whole = whole.where("whole").join(ends, [*FILE, "block_at"], "left_semi")
    rank = F.struct(age(base_name(F.col("path"))).alias("age"), (-F.col("entry_ord")).alias("later"), (-F.col("block_at")).alias("last"))
    best = whole.groupBy("file_id").agg(F.min_by(F.struct("entry_ord", "path", "block_at"), rank).alias("b")).select("file_id", "b.*")
    picked = body.join(best, [*FILE, "block_at"], "left_semi")
    trace, portal = groups(F.col("text"), TRACE_LINE, 8), groups(F.col("text"), PORTAL_LINE, 8)
    picked = picked.select(*FILE, "line_no", F.coalesce(trace[7], portal[7], F.col("text")).alias("text"))
    files = lines.where(base.rlike(REPORT_FILE)).join(best.select("file_id"), "file_id", "left_anti")
    last = files.groupBy("file_id").agg(F.max("entry_ord").alias("entry_ord"))
    files = files.join(last, ["file_id", "entry_ord"], "left_semi").select(*FILE, "line_no", "text")
    return _from_root(picked.unionByName(files))


def _marker(text: Column) -> Column:
    return F.when(text.contains(BLOCK_START), "start").when(text.contains(BLOCK_END), "end")


def _from_root(rows: DataFrame) -> DataFrame:
    """Drop everything in front of the report's root element, if it occurs."""
    root = "<hip-report"
    first = rows.where(F.col("text").contains(root)).groupBy(*FILE).agg(F.min("line_no").alias("root_at"))
    joined = rows.join(first, list(FILE), "left").where(F.col("root_at").isNull() | (F.col("line_no") >= F.col("root_at")))
    cut = F.expr("substring(text, instr(text, '<hip-report'))")
    text = F.when(F.col("line_no") == F.col("root_at"), cut).otherwise(F.col("text"))
    return joined.select(*FILE, "line_no", text.alias("text"))


def _under(*tags: str) -> Column:
    """Element whose tag path below the root is exactly these tags."""
    return F.slice("tags", 2, 64) == F.array(*[F.lit(t) for t in tags])


ENTRY = ("categories", "entry")


def report(nodes: DataFrame) -> DataFrame:
    """Header and host information; the host-info category's host name wins over the header's."""
    def first(condition: Column) -> Column:
        return F.min_by("text", F.when(condition, F.col("ord")))

    in_host = F.element_at("tags", 2) == "categories"
    named = nodes.where(_under(*ENTRY)).select(*DOCUMENT, F.col("node_id").alias("entry_id"), F.col("name").alias("category"))
    children = nodes.where((F.col("depth") == 1) | ((F.col("depth") == 3) & in_host))
    children = children.withColumn("entry_id", F.when(F.col("depth") == 3, F.col("parent_id")))
    rows = children.join(named, [*DOCUMENT, "entry_id"], "left")
    rows = rows.where((F.col("depth") == 1) | (F.col("category") == "host-info"))
    top, inner = F.col("depth") == 1, F.col("depth") == 3
    host_name = F.coalesce(
        first(inner & (F.col("tag") == "host-name") & (F.col("text") != "")), first(top & (F.col("tag") == "host-name"))
    )
    return rows.groupBy(*DOCUMENT).agg(
        *[F.coalesce(first(top & (F.col("tag") == t)), F.lit("")).alias(c) for c, t in REPORT_TAGS.items()],
        *[F.coalesce(first(inner & (F.col("tag") == t)), F.lit("")).alias(c) for c, t in HOST_TAGS.items()],
        F.coalesce(host_name, F.lit("")).alias("host_name"),
    )


def _categories(nodes: DataFrame) -> DataFrame:
    return nodes.where(_under(*ENTRY)).select(*DOCUMENT, F.col("node_id").alias("category_id"), F.coalesce("name", F.lit("")).alias("category"))


def products(nodes: DataFrame) -> DataFrame:
    """Products of every category except host-info; unnamed ones are dropped."""
    below = (*ENTRY, "list", "entry", "ProductInfo")
    inside = nodes.where((F.size("tags") > len(below)) & (F.slice("tags", 2, len(below)) == F.array(*[F.lit(t) for t in below])))
    rows = inside.select(
        *DOCUMENT, F.col("ids")[2].alias("category_id"), F.col("ids")[4].alias("product_id"), F.col("ids")[5].alias("info_id"),
        "tag", "attrs", "text", "ord", "depth", "node_id",
    )
    info = rows.where(F.col("node_id") == F.col("info_id")).groupBy(*DOCUMENT, "product_id").agg(F.min("info_id").alias("info_id"))
    rows = rows.join(info, [*DOCUMENT, "product_id", "info_id"], "left_semi")
    child = F.col("depth") == 6
    prod = F.min_by("attrs", F.when(child & (F.col("tag") == "Prod"), F.col("ord")))
    states = [
        F.coalesce(F.min_by(trimmed(F.col("text")), F.when(child & (F.col("tag") == t), F.col("ord"))), F.lit("")).alias(c)
        for c, t in PRODUCT_STATES.items()
    ]
    found = rows.groupBy(*DOCUMENT, "category_id", "product_id").agg(prod.alias("prod"), *states)

    def attribute(name: str) -> Column:
        return F.coalesce(F.try_element_at("prod", F.lit(name)), F.lit(""))

    def padded(name: str) -> Column:
        return F.when(F.length(attribute(name)) == 1, F.concat(F.lit("0"), attribute(name))).otherwise(attribute(name))

    date = F.when(attribute("dateyear") != "", F.concat_ws("-", attribute("dateyear"), padded("datemon"), padded("dateday"))).otherwise("")
    found = found.join(_categories(nodes), [*DOCUMENT, "category_id"]).where(F.col("category") != "host-info")
    found = found.select(
        *DOCUMENT, "product_id", "category", *[attribute(a).alias(c) for c, a in PRODUCT_ATTRIBUTES.items()],
        date.alias("def_date"), *PRODUCT_STATES,
    )
    return found.where(F.col("name") != "")


def drives(nodes: DataFrame) -> DataFrame:
    """Drives of disk-encryption products."""
    path = (*ENTRY, "list", "entry", "ProductInfo", "drives", "entry")
    inside = nodes.where((F.size("tags") == len(path) + 2) & (F.slice("tags", 2, len(path)) == F.array(*[F.lit(t) for t in path])))
    rows = inside.select(*DOCUMENT, F.col("ids")[4].alias("product_id"), F.col("ids")[7].alias("drive_id"), "tag", "text", "nth")

    def value(tag: str) -> Column:
        return F.coalesce(F.max(F.when((F.col("tag") == tag) & (F.col("nth") == 0), F.col("text"))), F.lit(""))

    return rows.groupBy(*DOCUMENT, "product_id", "drive_id").agg(value("drive-name").alias("drive"), value("enc-state").alias("state"))


def patches(nodes: DataFrame) -> DataFrame:
    """Missing patches of any category."""
    path = (*ENTRY, "missing-patches", "entry")
    entries = nodes.where(_under(*path)).select(*DOCUMENT, F.col("node_id").alias("patch_id"), F.col("ids")[2].alias("category_id"))
    children = nodes.where((F.col("depth") == 5) & (F.col("nth") == 0)).select(*DOCUMENT, F.col("parent_id").alias("patch_id"), "tag", "text")
    joined = entries.join(children, [*DOCUMENT, "patch_id"], "left")
    columns = [F.coalesce(F.max(F.when(F.col("tag") == t, F.col("text"))), F.lit("")).alias(c) for c, t in PATCH_TAGS.items()]
    return joined.groupBy(*DOCUMENT, "category_id", "patch_id").agg(*columns)


def interfaces(nodes: DataFrame) -> DataFrame:
    """Network adapters of the host-info category with their addresses as arrays."""
    path = (*ENTRY, "network-interface", "entry")
    inside = nodes.where((F.size("tags") > len(path)) & (F.slice("tags", 2, len(path)) == F.array(*[F.lit(t) for t in path])))
    rows = inside.select(*DOCUMENT, F.col("ids")[2].alias("category_id"), F.col("ids")[4].alias("interface_id"), "tags", "name", "text", "ord", "depth", "nth")
    host = _categories(nodes).where(F.col("category") == "host-info")
    rows = rows.join(host, [*DOCUMENT, "category_id"], "left_semi")
    tail = F.element_at("tags", -1)

    def child(tag: str) -> Column:
        return F.coalesce(F.max(F.when((F.col("depth") == 5) & (tail == tag) & (F.col("nth") == 0), F.col("text"))), F.lit(""))

    def addresses(tag: str) -> Column:
        held = (F.col("depth") == 6) & (F.element_at("tags", -2) == tag) & (tail == "entry") & (F.col("name") != "")
        return F.transform(F.array_sort(F.collect_list(F.when(held, F.struct("ord", "name")))), lambda a: a["name"])

    return rows.groupBy(*DOCUMENT, "interface_id").agg(
        F.coalesce(F.max(F.when(F.col("depth") == 4, F.col("name"))), F.lit("")).alias("id"),
        child("description").alias("description"),
        child("mac-address").alias("mac"),
        addresses("ip-address").alias("ipv4"),
        addresses("ipv6-address").alias("ipv6"),
    )


def empty_categories(nodes: DataFrame) -> DataFrame:
    """Categories in which no product and no patch was found."""
    categories = _categories(nodes).where(F.col("category") != "host-info")
    owners = nodes.select(*DOCUMENT, F.col("node_id").alias("product_id"), F.get("ids", F.lit(2)).alias("category_id"))
    with_product = products(nodes).join(owners, [*DOCUMENT, "product_id"]).select(*DOCUMENT, "category_id")
    used = with_product.unionByName(patches(nodes).select(*DOCUMENT, "category_id"))
    return categories.join(used, [*DOCUMENT, "category_id"], "left_anti")


def facts(nodes: DataFrame) -> DataFrame:
    """All values as (category, item, field, value) in category and item order; blanks are skipped."""

    def pairs(names: dict[str, str]) -> list[Column]:
        return [F.struct(F.lit(f).alias("field"), F.col(c).alias("value")) for f, c in names.items()]

    def rows(source: DataFrame, group: int, category: Column, item: Column, place: Column, values: Column) -> DataFrame:
        return source.select(
            *DOCUMENT, category.alias("category"), item.alias("item"), F.lit(group).alias("group"), place.cast("long").alias("place"),
            F.posexplode(values).alias("pos", "f"),
        )

    head = report(nodes)
    adapters = interfaces(nodes)
    adapter = F.when(F.col("description") != "", F.col("description")).otherwise(F.col("id"))

    def listed(column: str, field: str) -> Column:
        return F.transform(column, lambda a: F.struct(F.lit(field).alias("field"), a.alias("value")))

    found = products(nodes)
    disks = drives(nodes).join(found.select(*DOCUMENT, "product_id", "category", "name"), [*DOCUMENT, "product_id"])
    zero, none = F.lit(0), F.lit("")
    tables = [
        rows(head, 0, F.lit("report"), none, zero, F.array(*pairs(REPORT_FACTS))),
        rows(head, 1, F.lit("host-info"), none, zero, F.array(*pairs(HOST_FACTS))),
        rows(
            adapters, 2, F.lit("network-interface"), adapter, F.col("interface_id"),
            F.concat(F.array(*pairs({"adapter id": "id", "mac-address": "mac"})), listed("ipv4", "ipv4"), listed("ipv6", "ipv6")),
        ),
        rows(found, 3, F.col("category"), F.col("name"), F.col("product_id"), F.array(*pairs(PRODUCT_FACTS))),
        rows(
            disks, 3, F.col("category"), F.col("name"), F.col("drive_id"),
            F.array(F.struct(F.concat(F.lit("drive "), "drive").alias("field"), F.col("state").alias("value"))),
        ),
        rows(patches(nodes), 4, F.lit("missing-patch"), F.col("title"), F.col("patch_id"), F.array(*pairs(PATCH_FACTS))),
        rows(
            empty_categories(nodes), 5, F.col("category"), none, F.col("category_id"),
            F.array(F.struct(F.lit("products found").alias("field"), F.lit("none").alias("value"))),
        ),
    ]
    merged = tables[0]
    for table in tables[1:]:
        merged = merged.unionByName(table)
    merged = merged.where(trimmed(F.col("f.value")) != "").select(*DOCUMENT, "category", "item", "group", "place", "pos", "f.field", "f.value")
    # one report is one document of bounded size, so its facts are numbered in one window
    window = Window.partitionBy(*DOCUMENT).orderBy("category", "item", "group", "place", "pos")
    return merged.withColumn("ord", F.row_number().over(window)).drop("group", "place", "pos")


def search(table: DataFrame, needle: str) -> DataFrame:
    """Rows with the text in any of their values."""
    shown = [F.array_join(c, " ") if t.startswith("array") else F.col(c).cast("string") for c, t in table.dtypes if c not in DOCUMENT]
    return table.where(F.lower(F.concat_ws(" ", *shown)).contains(needle.strip().lower()))


def generated_time(head: DataFrame) -> DataFrame:
    """Report with the time it was generated, for judging its age."""
    stamp = trimmed(F.col("generated_at"))
    return head.withColumn("generated_ts", agent_timestamp(F.substring(stamp, 1, 10), F.substring(stamp, 12, 8)))
