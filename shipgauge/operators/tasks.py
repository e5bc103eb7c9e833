"""Planned tasks: conversion to items, reconciliation with issues, dependencies.

``tasks``: key, tracker_key, summary, type, size, status, labels ARRAY<STRING>,
blocked_by ARRAY<key type>, created_at, started_at, completed_at, assignee.
Dates are YYYY-MM-DD text; empty or NULL means not set.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shipgauge.functions.labels import first_prefixed
from shipgauge.functions.status import normalize_task_status
from shipgauge.functions.times import hours_between, parse_task_date
from shipgauge.settings import TO_DO

# Label prefix that carries a size, and type of a new issue.
SIZE_PREFIX = "size:"
NEW_ISSUE_TYPE = "Story"

DATES = {"created_at": "created", "started_at": "in_progress_ts", "completed_at": "done_ts"}


def _given(name: str) -> Column:
    return F.nullif(F.col(name).cast("string"), F.lit(""))


def _problem(name: str) -> Column:
    """What is wrong with a date column; NULL when it is empty or a date."""
    return F.when(
        _given(name).isNotNull() & parse_task_date(F.col(name)).isNull(),
        F.concat(F.lit(f"{name}: not a date: "), F.col(name)),
    )


def _reject_reason() -> Column:
    return F.coalesce(
        F.when(_given("key").isNull(), F.lit("key is required")), *[_problem(name) for name in DATES]
    )


def _dated(tasks: DataFrame) -> DataFrame:
    return tasks.withColumns({out: parse_task_date(_given(src)) for src, out in DATES.items()})


def _item_columns() -> list[Column]:
    start, end = F.col("in_progress_ts"), F.col("done_ts")
    return [
        F.col("key").alias("item_id"),
        F.col("type").alias("item_type"),
        F.col("summary").alias("description"),
        F.upper(F.trim(F.coalesce("size", F.lit("")))).alias("size"),
        normalize_task_status(F.col("status")).alias("status"),
        F.col("created"), start, end,
        F.coalesce(hours_between(start, end), F.lit(0.0)).alias("cycle_hours"),
        F.col("assignee"), F.col("tracker_key"),
    ]


def items_from_tasks(tasks: DataFrame) -> DataFrame:
    """Strict conversion: the first invalid task fails the job.

    Every output column is read through the check, so a later filter or projection
    on any of them still runs it on every task; a bare count runs it as a filter.
    """
    message = F.concat_ws(" ", F.lit("task"), F.col("key").cast("string"), _reject_reason())
    valid = _reject_reason().isNull() | F.raise_error(message).cast("boolean")
    fields = _item_columns()
    checked = F.when(_reject_reason().isNull(), F.struct(*fields)).otherwise(F.raise_error(message))
    return _dated(tasks.where(valid)).select(checked.alias("_item")).select("_item.*")


def valid_items_from_tasks(tasks: DataFrame) -> DataFrame:
    """Items of the valid tasks; ``task_rejects`` holds the others."""
    return _dated(tasks.where(_reject_reason().isNull())).select(*_item_columns())


def task_rejects(tasks: DataFrame) -> DataFrame:
    return tasks.select("key", _reject_reason().alias("reject_reason")).where(
        F.col("reject_reason").isNotNull()
    )


def items_from_synced_tasks(tasks: DataFrame) -> DataFrame:
    """Items of a synchronised task file: size from its label, status as it is."""
    return tasks.select(
        F.col("key").alias("item_id"), F.col("type").alias("item_type"),
        F.col("summary").alias("description"),
        F.coalesce(first_prefixed(F.col("labels"), SIZE_PREFIX), F.lit("")).alias("size"),
        "status", "tracker_key",
    )


def task_reconcile(tasks: DataFrame, issues: DataFrame) -> DataFrame:
    """What a synchronisation would do with each task.

    A task with a tracker key and a matching issue is an ``update`` and takes
    the issue's status; without a match it is a ``skip``; without a tracker key
    it is a ``create``. Tasks without a key never enter the join, where they
    would all meet in one partition.
    """
    keyed = tasks.where(F.col("tracker_key").isNotNull())
    statuses = issues.select(
        F.col("issue_key").alias("tracker_key"), F.col("raw_status").alias("_issue_status")
    )
    found = keyed.join(statuses, "tracker_key", "left")
    matched = F.col("_issue_status").isNotNull()
    existing = found.select(
        "key", "tracker_key",
        F.when(matched, "update").otherwise("skip").alias("action"),
        F.coalesce("_issue_status", "status").alias("new_status"),
        (matched & ~F.col("_issue_status").eqNullSafe(F.col("status"))).alias("status_changed"),
        F.col("type").alias("issue_type"),
    )
    fresh = tasks.where(F.col("tracker_key").isNull()).select(
        "key", "tracker_key", F.lit("create").alias("action"), F.lit(TO_DO).alias("new_status"),
        (~F.col("status").eqNullSafe(F.lit(TO_DO))).alias("status_changed"),
        F.coalesce(F.nullif(F.col("type"), F.lit("")), F.lit(NEW_ISSUE_TYPE)).alias("issue_type"),
    )
    return existing.unionByName(fresh)


def reconcile_counts(plan: DataFrame) -> DataFrame:
    return plan.groupBy("action").agg(F.count("*").alias("n"))


def dependency_edges(tasks: DataFrame, links: DataFrame) -> DataFrame:
    """Blocks links still to be made: (blocker, blocked) tracker keys.

    Both ends must be tasks with a tracker key. ``links`` (blocker, blocked) are
    the ones that exist. The blocked end is on the task itself; only the blocker
    is looked up; adaptive execution splits one that many tasks wait for.
    """
    named = tasks.where(F.col("tracker_key").isNotNull())
    keys = named.select(F.col("key").alias("_dep"), F.col("tracker_key").alias("blocker"))
    edges = named.select(
        F.col("key").alias("_task"), F.col("tracker_key").alias("blocked"),
        F.explode("blocked_by").alias("_dep"),
    )
    resolved = edges.join(keys, "_dep")
    return (
        resolved.select("blocker", "blocked")
        .join(links.select("blocker", "blocked"), ["blocker", "blocked"], "left_anti")
        .distinct()
    )
