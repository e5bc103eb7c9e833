"""Issue exports: pages of nested JSON flattened into tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from shipgauge.functions.fields import number_field
from shipgauge.functions.times import parse_tracker_time
from shipgauge.sources.schemas import ATTACHMENTS, KNOWN_FIELDS, LINKS, PAGE, REJECTS


_UNREADABLE = "unreadable"
# Pages of 100 issues in one written file, some 140 MB of text.
PAGES_PER_FILE = 1_000


def _pages(spark: SparkSession, path: str, multiline: bool, mode: str) -> DataFrame:
    reader = spark.read.schema(f"{PAGE}, {_UNREADABLE} STRING").option("columnNameOfCorruptRecord", _UNREADABLE)
    return reader.option("mode", mode).option("multiLine", multiline).json(path)


def write_issue_pages(pages: DataFrame, path: str) -> None:
    """Pages of JSON text (one column) as compressed lines.

    A compressed file is read by one task, so a file holds PAGES_PER_FILE pages at most.
    """
    pages.write.option("compression", "gzip").option("maxRecordsPerFile", PAGES_PER_FILE).text(path)


def read_issue_pages(spark: SparkSession, path: str, multiline: bool = False, strict: bool = True) -> DataFrame:
    """One row per issue: issue_key, fields VARIANT, changelog.

    One page per line keeps large plain files splittable; ``multiline`` reads files that
    hold one formatted page each. A page is parsed once, its fields into a VARIANT.
    Invalid JSON fails the job; without ``strict`` such pages and issues without a key
    are left out, and ``issue_rejects`` tells which.
    """
    pages = _pages(spark, path, multiline, "FAILFAST" if strict else "PERMISSIVE")
    if not strict:
        pages = pages.where(F.col(_UNREADABLE).isNull())
    issues = pages.select(F.explode("issues").alias("i")).select(
        F.col("i.key").alias("issue_key"), "i.fields", "i.changelog"
    )
    return issues if strict else issues.where(F.col("issue_key").isNotNull())


def issue_rejects(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """What an export holds that cannot be used: level, issue_key, reason, record.

    Pages that are not JSON, issues without a key, and status changes at a time that
    cannot be read (which operators skip). One pass; every page gives its own list.
    """
    def rejects(value: str) -> Column:
        return F.expr(f"CAST({value} AS ARRAY<{REJECTS}>)")

    page = F.when(F.col(_UNREADABLE).isNotNull(), rejects(f"array(named_struct('level', 'page', 'issue_key', NULL, 'reason', 'not JSON', 'record', {_UNREADABLE}))"))
    keyless = F.transform(
        F.filter("issues", lambda i: i["key"].isNull()),
        lambda i: _reject("issue", F.lit(None).cast("string"), "no key", i["fields"].cast("string")))

    def undated(i: Column) -> Column:
        late = F.filter(i["changelog"]["histories"], lambda h: parse_tracker_time(h["created"]).isNull())
        return F.flatten(F.transform(late, lambda h: F.transform(
            F.filter(h["items"], lambda c: c["field"] == "status"),
            lambda c: _reject("change", i["key"], "time not readable", F.concat_ws(" ", h["created"], c["toString"])))))

    changes = F.flatten(F.transform("issues", lambda i: F.coalesce(undated(i), rejects("array()"))))
    usable = F.when(F.col(_UNREADABLE).isNull(), F.concat(keyless, changes))
    lists = _pages(spark, path, multiline, "PERMISSIVE").select(F.coalesce(page, usable, rejects("array()")).alias("r"))
    return lists.select(F.explode("r").alias("r")).select("r.*")


def _reject(level: str, key: Column, reason: str, record: Column) -> Column:
    return F.struct(F.lit(level).alias("level"), key.alias("issue_key"), F.lit(reason).alias("reason"), record.alias("record"))


def issues_table(
    pages: DataFrame, cycle_field: str | None = None, points_field: str | None = None,
    epic_field: str | None = None,
) -> DataFrame:
    """Typed issues as the operators expect them.

    The known fields leave the variant as one struct, in one walk through it; custom
    fields are looked up by name. Everything downstream works on plain columns.
    """
    def number(name: str | None) -> Column:
        return number_field(F.col("fields"), name) if name else F.lit(None).cast("double")

    epic = F.try_variant_get("fields", f"$.{epic_field}", "string") if epic_field else F.lit(None).cast("string")
    k = F.col("known")
    return pages.withColumn("known", F.try_variant_get("fields", "$", KNOWN_FIELDS)).select(
        F.regexp_extract("issue_key", r"^(.*)-\d+$", 1).alias("project_key"),
        "issue_key",
        epic.alias("epic_key"),
        k["parent"]["key"].alias("parent_key"),
        F.coalesce(k["summary"], F.lit("")).alias("summary"),
        F.coalesce(k["status"]["name"], F.lit("")).alias("raw_status"),
        k["issuetype"]["name"].alias("issue_type"),
        F.coalesce(k["labels"], F.array().cast("array<string>")).alias("labels"),
        F.coalesce(k["assignee"]["displayName"], F.lit("")).alias("assignee"),
        parse_tracker_time(k["created"]).alias("created"),
        parse_tracker_time(k["updated"]).alias("updated"),
        F.coalesce(k["timespent"], F.lit(0)).alias("time_spent_s"),
        number(cycle_field).alias("override_hours"),
        number(points_field).alias("story_points"),
    )


def transitions_table(pages: DataFrame) -> DataFrame:
    """One row per changed field, numbered in the order of the changelog."""
    return (
        pages.select("issue_key", F.posexplode("changelog.histories").alias("h", "history"))
        .select("issue_key", "h", "history", F.posexplode("history.items").alias("i", "item"))
        .select(
            "issue_key",
            parse_tracker_time(F.col("history.created")).alias("ts"),
            F.struct("h", "i").alias("seq"),
            F.col("history.author.displayName").alias("author"),
            F.col("item.field").alias("field"),
            F.col("item.fromString").alias("from_status"),
            F.col("item.toString").alias("to_status"),
        )
    )


def links_flat(pages: DataFrame) -> DataFrame:
    """One row per link: the outward end if there is one, else the inward end."""
    links = F.try_variant_get("fields", "$.issuelinks", LINKS)
    link = pages.select("issue_key", F.explode(links).alias("l"))
    out, inw = F.col("l.outwardIssue"), F.col("l.inwardIssue")
    return link.where(out.isNotNull() | inw.isNotNull()).select(
        "issue_key", F.col("l.id").alias("link_id"), F.col("l.type.name").alias("link_type"),
        F.when(out.isNotNull(), F.col("l.type.outward")).otherwise(F.col("l.type.inward")).alias("verb"),
        F.coalesce(out, inw)["key"].alias("target_key"),
        F.coalesce(out, inw)["fields"]["status"]["name"].alias("target_status"),
        F.coalesce(out, inw)["fields"]["summary"].alias("target_summary"),
    )


def attachments_flat(pages: DataFrame) -> DataFrame:
    files = F.try_variant_get("fields", "$.attachment", ATTACHMENTS)
    return pages.select("issue_key", F.explode(files).alias("a")).select(
        "issue_key", F.col("a.id").alias("attachment_id"), "a.filename", "a.size",
        F.substring("a.created", 1, 10).alias("created_day"),
        F.coalesce("a.author.displayName", F.lit("")).alias("author"),
    )
