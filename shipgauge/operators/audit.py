"""Data-quality audits and planned bulk changes.

Nothing here changes a tracker; each plan is a table of the changes to make.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shipgauge.functions.fields import value_kind
from shipgauge.functions.labels import relabel
from shipgauge.operators.ingest import cycle_hours, done_facts
from shipgauge.operators.rollup import total_level
from shipgauge.settings import DONE, Settings

# Prefix of custom fields and words that hint at story points.
CUSTOM_PREFIX = "customfield_"
POINT_WORDS = ("story", "point", "estimate")


def missing_times(
    issues: DataFrame, transitions: DataFrame, cfg: Settings = Settings()
) -> DataFrame:
    """Issues with the literal status Done and no cycle time, with who closed them."""
    c = F.col
    done = issues.where(c("raw_status") == DONE)
    timed = done.join(done_facts(transitions, cfg), "issue_key", "left").withColumn(
        "cycle_hours",
        cycle_hours(c("in_progress_ts"), c("done_ts"), c("override_hours"), c("time_spent_s")),
    )
    return (
        timed.where(c("cycle_hours") == 0)
        .select(
            "project_key", "issue_key", "summary", "story_points",
            F.coalesce(F.nullif(c("closed_by"), F.lit("")), F.lit("(unknown)")).alias("closed_by"),
        )
    )


def missing_totals(missing: DataFrame) -> DataFrame:
    """Missing times per project, and in all at level ``all``, where the project is NULL."""
    return missing.rollup("project_key").agg(total_level(), F.count("*").alias("missing"))


def time_backfill_plan(missing: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """Time to log per issue: points times hours per point, else the default."""
    points = F.coalesce(F.col("story_points").cast("double"), F.lit(0.0))
    hours = F.when(points > 0, points * F.lit(cfg.hours_per_point)).otherwise(
        F.lit(cfg.hours_without_points)
    )
    return missing.select(
        "project_key", "issue_key", "closed_by", points.alias("story_points"),
        hours.alias("hours"), (hours * 3600).cast("bigint").alias("seconds"),
    )


def custom_fields(fields: DataFrame) -> DataFrame:
    """(issue_key, field, kind) for every custom field that is not null.

    ``fields``: issue_key, raw VARIANT.
    """
    entries = fields.sparkSession.tvf.variant_explode(F.col("raw").outer())
    return (
        fields.lateralJoin(entries)
        .where(F.col("key").startswith(CUSTOM_PREFIX))
        .select("issue_key", F.col("key").alias("field"), value_kind(F.col("value")).alias("kind"))
        .where(F.col("kind").isNotNull())
    )


def field_profile(fields: DataFrame, definitions: DataFrame) -> DataFrame:
    """Issues per custom field and kind of value, with the field's name.

    ``definitions``: field, name. Names are attached after the aggregation.
    """
    counts = custom_fields(fields).groupBy("field", "kind").agg(F.count("*").alias("n"))
    return counts.join(definitions, "field", "left").select(
        "field", F.coalesce("name", F.lit("")).alias("name"), "kind", "n",
        maybe_points(F.coalesce("name", F.lit(""))).alias("maybe_points"),
    )


def maybe_points(name: Column) -> Column:
    low = F.lower(name)
    out = F.lit(False)
    for word in POINT_WORDS:
        out = out | low.contains(word)
    return out


def bulk_transition_plan(issues: DataFrame, workflow: DataFrame, target: str) -> DataFrame:
    """Transition to take per issue: the first whose name or target is ``target``.

    ``workflow``: status, transition_id, name, to_status, position. It shrinks to
    one row per status before it meets the issues.
    """
    usable = (
        workflow.where((F.col("name") == target) | (F.col("to_status") == target))
        .groupBy(F.col("status").alias("raw_status"))
        .agg(F.min_by("transition_id", "position").alias("transition_id"))
    )
    return issues.join(usable, "raw_status", "left").select(
        "issue_key", F.col("raw_status").alias("from_status"), F.lit(target).alias("requested"),
        "transition_id",
        F.when(F.col("transition_id").isNotNull(), "accepted").otherwise("rejected").alias("outcome"),
    )


def bulk_label_plan(issues: DataFrame, add: list[str], remove: list[str]) -> DataFrame:
    after = relabel(F.col("labels"), add, remove)
    return issues.select(
        "issue_key", F.col("labels").alias("labels_before"), after.alias("labels_after")
    )
