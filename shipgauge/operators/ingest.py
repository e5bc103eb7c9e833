"""Issues and their changelogs turned into work items.

``issues``: issue_key, project_key, epic_key, summary, raw_status, labels
ARRAY<STRING>, assignee, created, updated, time_spent_s, override_hours,
story_points. ``transitions``: issue_key, ts, seq, author, field, from_status,
to_status. The type of ``issue_key`` is free.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shipgauge.functions.labels import first_mapped
from shipgauge.functions.status import normalize_status
from shipgauge.functions.times import hours_between
from shipgauge.settings import DONE, Settings


def _status_changes(transitions: DataFrame) -> DataFrame:
    return transitions.where((F.col("field") == "status") & F.col("ts").isNotNull())


def first_transitions(transitions: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """Earliest entry into any in-progress and any done status, per issue.

    Other targets are dropped before the shuffle and ``min`` combines on the map
    side, so an issue with any number of changes sends one row per task.
    """
    to = F.col("to_status")
    wip, done = to.isin(*cfg.wip_statuses), to.isin(*cfg.done_statuses)
    return (
        _status_changes(transitions)
        .where(wip | done)
        .groupBy("issue_key")
        .agg(
            F.min(F.when(wip, F.col("ts"))).alias("in_progress_ts"),
            F.min(F.when(done, F.col("ts"))).alias("done_ts"),
        )
    )


def done_facts(transitions: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """``first_transitions`` and ``closed_by`` from one pass over the changes."""
    to = F.col("to_status")
    wip, done, closed = to.isin(*cfg.wip_statuses), to.isin(*cfg.done_statuses), to == DONE
    return (
        _status_changes(transitions)
        .where(wip | done | closed)
        .groupBy("issue_key")
        .agg(
            F.min(F.when(wip, F.col("ts"))).alias("in_progress_ts"),
            F.min(F.when(done, F.col("ts"))).alias("done_ts"),
            F.min_by("author", F.when(closed, F.struct("ts", "seq"))).cast("string").alias("closed_by"),
        )
    )


def closed_by(transitions: DataFrame) -> DataFrame:
    """Author of the first change to the literal Done; '' without an author."""
    return (
        _status_changes(transitions)
        .where(F.col("to_status") == DONE)
        .groupBy("issue_key")
        .agg(F.min_by("author", F.struct("ts", "seq")).alias("closed_by"))
        .withColumn("closed_by", F.coalesce(F.col("closed_by").cast("string"), F.lit("")))
    )


def cycle_hours(wip: Column, done: Column, override: Column, spent_s: Column) -> Column:
    """Changelog hours, replaced by a positive override; logged time fills a zero.

    A negative changelog value is kept and does not fall through to logged time.
    """
    measured = F.coalesce(hours_between(wip, done), F.lit(0.0))
    chosen = F.when(override > 0, override.cast("double")).otherwise(measured)
    return F.when((chosen == 0) & (spent_s > 0), spent_s / F.lit(3600.0)).otherwise(chosen)


def items_from_issues(
    issues: DataFrame, transitions: DataFrame, cfg: Settings = Settings()
) -> DataFrame:
    """One work item per issue. Both join sides hold one row per issue.

    Neither side is small unless both are, and their sizes are guessed from files that may
    be compressed, so the sides are merged; no size makes Spark send one through the driver.
    """
    c = F.col
    return issues.join(first_transitions(transitions, cfg).hint("merge"), "issue_key", "left").select(
        "project_key",
        c("issue_key").alias("item_id"),
        first_mapped(c("labels"), cfg.type_labels, cfg.default_type).alias("item_type"),
        c("summary").alias("description"),
        first_mapped(c("labels"), cfg.size_labels, cfg.default_size).alias("size"),
        normalize_status(c("raw_status"), cfg.done_statuses, cfg.wip_statuses).alias("status"),
        "created",
        "in_progress_ts",
        "done_ts",
        cycle_hours(
            c("in_progress_ts"), c("done_ts"), c("override_hours"), c("time_spent_s")
        ).alias("cycle_hours"),
        "assignee",
        c("issue_key").alias("tracker_key"),
    )


def changelog_flat(changes: DataFrame) -> DataFrame:
    """Readable history: empty ends become (none), a missing author Unknown."""
    def shown(name: str, default: str) -> Column:
        return F.coalesce(F.nullif(F.col(name).cast("string"), F.lit("")), F.lit(default)).alias(name)
    return changes.select(
        "issue_key", "ts", "seq", "field",
        shown("author", "Unknown"), shown("from_status", "(none)"), shown("to_status", "(none)"),
    )
