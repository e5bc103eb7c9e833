"""Choosing issues, projects and tracker instances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shipgauge.settings import Settings

# Fixed value: shape of an issue key.
ISSUE_KEY_PATTERN = r"^[A-Z][A-Z0-9]+-\d+$"


def issue_filter(
    issues: DataFrame, project: str | None = None, epic: str | None = None,
    labels: list[str] | None = None, status: str | None = None,
) -> DataFrame:
    """Issues of a project, epic, status and any of the labels, oldest first.

    The epic link falls back to the parent where it is missing.
    """
    out = issues
    if project is not None:
        out = out.where(F.col("project_key") == project)
    if epic is not None:
        out = out.where(F.coalesce("epic_key", "parent_key") == epic)
    if labels:
        out = out.where(F.arrays_overlap("labels", F.array(*[F.lit(x) for x in labels])))
    if status is not None:
        out = out.where(F.col("raw_status") == status)
    return out.orderBy("created", "issue_key")


def issue_search(matches: DataFrame, limit: int = 20) -> DataFrame:
    """First ``limit`` matches (by creation, then key) with the count of all.

    The limit is a top-k over a total order; the count is a separate aggregate
    over every match, attached as a scalar.
    """
    total = matches.agg(F.count("*").alias("total_matches"))
    top = matches.orderBy("created", "issue_key").limit(limit)
    return top.select("issue_key", "raw_status", "summary").withColumn(
        "total_matches", total.scalar()
    )


def resolve_epic(own: Column, configured: Column) -> Column:
    """Own epic if it is an issue key, else the configured one if it is, else NULL."""
    return F.coalesce(
        F.when(own.rlike(ISSUE_KEY_PATTERN), own),
        F.when(configured.rlike(ISSUE_KEY_PATTERN), configured),
    )


def project_id(df_key: str = "project_key", epic: str = "epic_key") -> Column:
    """Project key, or its epic where the key is empty."""
    return F.coalesce(F.nullif(F.col(df_key), F.lit("")), F.col(epic))


def all_projects(configured: DataFrame, from_task_files: DataFrame) -> DataFrame:
    """Both project lists; an unnamed task-file project is named by its key."""
    named = from_task_files.withColumn(
        "name", F.coalesce(F.nullif(F.col("name"), F.lit("")), F.col("project_key"))
    )
    return configured.unionByName(named, allowMissingColumns=True)


def resolve_projects(requests: DataFrame, projects: DataFrame, request: str) -> DataFrame:
    """Project named by key or epic; the first in configuration order wins.

    Key and epic become rows of one alias table, so this is one equi-join
    instead of a nested loop over an OR condition.
    """
    def alias(name: str) -> DataFrame:
        return projects.select(
            F.col(name).alias(request),
            F.struct("config_order", project_id().alias("project")).alias("_hit"),
        )
    aliases = (
        alias("project_key").unionByName(alias("epic_key"))
        .where(F.col(request).isNotNull() & (F.col(request) != ""))
        .groupBy(request)
        .agg(F.min("_hit").alias("_hit"))
        .select(request, F.col("_hit.project").alias("resolved_project"))
    )
    return requests.join(aliases, request, "left")


def key_prefix(key: Column) -> Column:
    """Upper-cased part before the first dash; NULL for a malformed key."""
    return F.when(
        F.instr(key, "-") > 1, F.upper(F.substring_index(key, "-", 1))
    )


def route_instances(keys: DataFrame, instances: DataFrame, key: str, default: str) -> DataFrame:
    """Tracker instance owning each key, by prefix.

    ``instances``: instance, prefixes ARRAY<STRING>, is_default. The default
    instance is asked first and takes every key nobody claims. Prefixes claimed
    twice go to the first instance by name.
    """
    claims = (
        instances.select("instance", "is_default", F.explode("prefixes").alias("_p"))
        .groupBy(F.upper("_p").alias("_prefix"))
        .agg(F.min_by("instance", F.struct(~F.col("is_default"), F.col("instance"))).alias("instance"))
    )
    routed = keys.withColumn("_prefix", key_prefix(F.col(key))).join(claims, "_prefix", "left")
    return routed.withColumn("instance", F.coalesce("instance", F.lit(default))).drop("_prefix")


def effective_capacity(project: Column, cfg: Settings) -> Column:
    """Hours per day: the project's, else the global one, else the fallback."""
    rest = cfg.fallback_capacity
    if cfg.global_capacity is not None and cfg.global_capacity > 0:
        rest = cfg.global_capacity
    return F.when(project > 0, project.cast("double")).otherwise(F.lit(float(rest)))
