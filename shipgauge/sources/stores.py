"""Stored tables: item snapshots, reference classes, report history, JSON output."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from shipgauge.functions.times import days_before
from shipgauge.operators.trends import retained
from shipgauge.sources.manifest import Manifest
from shipgauge.sources.schemas import HISTORY, ITEM, ITEM_FILE, REF_ITEMS, REF_PROJECTS

# Name of a per-project item file and its text for "no time".
ITEM_FILE_NAME = r"^data(?:-(.*))?\.json$"
NO_TIME = "0001-01-01T00:00:00Z"


def conform(df: DataFrame, schema: str) -> DataFrame:
    """Columns of ``schema`` in its order and types; missing ones are NULL."""
    target = df.sparkSession.createDataFrame([], schema).schema
    return df.select(*[
        (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in target
    ])


def read_or_empty(spark: SparkSession, path: str, schema: str, fmt: str = "parquet") -> DataFrame:
    """A table that was never written is empty; malformed content is an error."""
    reader = spark.read.schema(schema)
    if fmt == "json":
        reader = reader.option("mode", "FAILFAST")
    try:
        return reader.format(fmt).load(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], schema)
        raise


class ItemStore:
    """Item snapshots, partitioned by project, replaced per project.

    The folder of a project is named after its key behind an underscore, so that
    the key '' has one too. A project whose snapshot is empty keeps a single mark.
    """

    STORED = f"{ITEM}, mark BOOLEAN, project STRING"

    def __init__(self, spark: SparkSession, root: str, fmt: str = "parquet"):
        if fmt not in ("parquet", "json"):
            raise ValueError("fmt must be 'parquet' or 'json'")
        self.spark, self.root, self.fmt = spark, root, fmt

    def write(self, items: DataFrame, synchronised: DataFrame | None = None) -> None:
        """Replace the snapshots of the projects in ``items`` and ``synchronised``.

        ``synchronised``: project_key; those without items become empty. A NULL key
        is written as ''. Rebalancing by project gives few files per project, and
        splits a project that is too large for one task.
        """
        rows = conform(items, ITEM).withColumn("project_key", F.coalesce("project_key", F.lit("")))
        rows = rows.withColumn("mark", F.lit(None).cast("boolean"))
        if synchronised is not None:
            keys = synchronised.select(F.coalesce("project_key", F.lit("")).alias("project_key")).distinct()
            empty = keys.join(rows.select("project_key").distinct(), "project_key", "left_anti")
            rows = rows.unionByName(empty.withColumn("mark", F.lit(True)), allowMissingColumns=True)
        (
            rows.withColumn("project", F.concat(F.lit("_"), "project_key"))
            .hint("rebalance", "project")
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("project")
            .format(self.fmt)
            .save(self.root)
        )

    def _stored(self) -> DataFrame:
        return read_or_empty(self.spark, self.root, self.STORED, self.fmt)

    def read(self, project: str | None = None) -> DataFrame:
        rows = self._stored().where(F.col("mark").isNull())
        if project is not None:
            rows = rows.where(F.col("project") == f"_{project}")  # one folder
        return rows.drop("mark", "project")

    def projects(self) -> DataFrame:
        """Projects that hold items."""
        return self.read().select("project_key").distinct()


# Between two records of an indented array: text never holds a line break, which JSON writes as an escape.
RECORD_BREAK = "\n  },\n  {\n"


def read_item_files(spark: SparkSession, folder: str, projects: list[str] | None = None) -> DataFrame:
    """Per-project item files ``data-{key}.json``, each one JSON array.

    An array indented by two spaces, as the files are written, is cut between records,
    so several tasks read one file and no task holds it; any other layout is read
    whole. ``data.json`` has the project key ''. With ``projects`` only their files are
    listed. Anything but an array of records is an error. A folder that does not exist
    holds no items.
    """
    c = F.col
    names = "data*.json" if projects is None else "{%s}" % ",".join(
        "data.json" if key == "" else "data-%s.json" % re.sub(r"([\[\]{}*?,\\\\])", r"\\\1", key) for key in projects)
    try:
        files = spark.read.option("lineSep", RECORD_BREAK).option("pathGlobFilter", names).text(folder)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], ITEM)
    text = F.when(F.trim(c("value")) == "null", "[]").otherwise(c("value"))
    opened = F.when(F.ltrim(text).startswith("["), text).otherwise(F.concat(F.lit("[{"), text))
    other_layout = F.ltrim(text).startswith("[") & ~text.startswith("[\n  {\n")
    last = text.rlike(r"\n  \}\n\]\s*$") | other_layout
    array = F.when(last, opened).otherwise(F.concat(opened, F.lit("}]")))
    records = F.from_json(array, f"ARRAY<STRUCT<{ITEM_FILE}>>", {"mode": "FAILFAST"})
    # The file's name comes as part of a URI.
    name = F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B")))
    raw = files.select(name.alias("_file"), records.alias("r")).where(c("_file").rlike(ITEM_FILE_NAME)).select("_file", F.explode("r").alias("r")).select("_file", "r.*")

    def time(name: str) -> Column:
        return F.nullif(c(name), F.lit(NO_TIME)).cast("timestamp")

    return raw.select(
        F.regexp_extract("_file", ITEM_FILE_NAME, 1).alias("project_key"),
        c("ID").alias("item_id"), c("Type").alias("item_type"), c("Description").alias("description"),
        c("Size").alias("size"), F.coalesce(c("Status"), F.lit("")).alias("status"), time("Created").alias("created"),
        time("InProgress").alias("in_progress_ts"), time("Done").alias("done_ts"),
        c("CycleTime").alias("cycle_hours"), c("Assignee").alias("assignee"),
        c("JiraKey").alias("tracker_key"),
    )


class ReferenceStore:
    """Reference classes: projects and their items, added in batches.

    A batch's projects and items become visible together; a batch that is added again
    replaces what it added before.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self._table = spark, Manifest(spark, root)

    def add(self, projects: DataFrame, items: DataFrame, batch: str) -> None:
        """``projects``: project_key, name, type, completed_at, team_size.
        ``items``: project_key, item_type, size, cycle_hours.

        A project's id is a hash of its batch and key, so no counter is shared
        between writers.
        """
        numbered = projects.withColumn("project_id", F.xxhash64(F.lit(batch), "project_key"))
        owned = items.join(numbered.select("project_key", "project_id"), "project_key")
        path = self._table.new_folder(batch)
        conform(owned, REF_ITEMS).write.parquet(self._table.absolute(f"{path}/items"))
        conform(numbered, REF_PROJECTS).write.parquet(self._table.absolute(f"{path}/projects"))
        self._table.change(lambda parts, notes: parts.update({batch: {"path": path}}))

    def _read(self, name: str, schema: str) -> DataFrame:
        return self._table.read([f"{p['path']}/{name}" for p in self._table.parts().values()], schema)

    def projects(self) -> DataFrame:
        return self._read("projects", REF_PROJECTS)

    def items(self) -> DataFrame:
        return self._read("items", REF_ITEMS)


def _month(time: Column) -> Column:
    """Months since year 0 in UTC, whatever the session's zone: a table is one for all its readers."""
    day = F.floor(F.unix_micros(time) / F.lit(86_400_000_000)).cast("int")
    date = F.date_from_unix_date(day)
    return F.year(date) * 12 + F.month(date)


class HistoryStore:
    """Report history per project, added in batches and laid out by month and time.

    Retention is applied when reading; clearing a project adds a mark that hides its
    entries up to a time. A batch is visible whole or not at all, and one that is
    added again replaces what it added before. ``compact`` writes what is visible to a
    new place.
    """

    MARKS = "project_key STRING, cleared_until TIMESTAMP"

    def __init__(self, spark: SparkSession, root: str, keep: int = 100):
        self.spark, self.keep, self._table = spark, keep, Manifest(spark, root)

    def append(self, entries: DataFrame, batch: str) -> None:
        path = self._table.new_folder(batch)
        rows = conform(entries, HISTORY).withColumn("month", _month(F.col("ts"))).hint("rebalance", "month")
        rows.sortWithinPartitions("month", "ts").write.partitionBy("month").parquet(self._table.absolute(path))
        self._table.change(lambda parts, notes: parts.update({f"entries {batch}": {"path": path, "kind": "entries"}}))

    def clear(self, projects: DataFrame, until: Column) -> None:
        """``projects``: project_key."""
        path = self._table.new_folder("cleared")
        projects.select("project_key", until.cast("timestamp").alias("cleared_until")).write.parquet(self._table.absolute(path))
        self._table.change(lambda parts, notes: parts.update({path: {"path": path, "kind": "cleared"}}))

    def visible(self, since: Column | None = None) -> DataFrame:
        """Entries that are retained and not cleared, only those after ``since`` if given.

        Retention keeps the newest, so it can be decided among these alone; a constant
        ``since`` leaves out whole months, and within one the files' row groups, before anything is read.
        """
        paths: dict[str, list[str]] = {"entries": [], "cleared": []}
        for p in self._table.parts().values():
            paths[p["kind"]].append(p["path"])
        entries = self._table.read(paths["entries"], f"{HISTORY}, month INT", partitioned=True)
        if since is not None:
            entries = entries.where((F.col("month") >= _month(since)) & (F.col("ts") > since))
        entries = entries.drop("month")
        if paths["cleared"]:
            marks = self._table.read(paths["cleared"], self.MARKS).groupBy("project_key").agg(F.max("cleared_until").alias("cleared_until"))
            entries = entries.join(marks, "project_key", "left").where(
                F.col("cleared_until").isNull() | (F.col("ts") > F.col("cleared_until"))).drop("cleared_until")
        return retained(entries, self.keep)

    def window(self, as_of: Column, days: int = 30) -> DataFrame:
        """Visible entries strictly after ``as_of`` minus ``days``."""
        return self.visible(days_before(as_of, days))

    def read(self) -> DataFrame:
        """Visible entries, by project and time."""
        return self.visible().orderBy("project_key", "ts")

    def compact(self, root: str) -> HistoryStore:
        new = HistoryStore(self.spark, root, self.keep)
        new.append(self.visible(), "compacted")
        return new


def save_bucketed(df: DataFrame, table: str, key: str, buckets: int) -> DataFrame:
    """A catalog table bucketed and sorted by ``key``.

    With issues and transitions bucketed alike by issue_key, the anchors and
    their join with the issues need no shuffle.
    """
    df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).saveAsTable(table)
    return df.sparkSession.table(table)


def as_json(df: DataFrame, name: str = "json") -> DataFrame:
    """One JSON document per row."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias(name))


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("ignoreNullFields", False).json(path)
