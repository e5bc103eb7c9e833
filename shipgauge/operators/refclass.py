"""Reference classes: finished projects as a yardstick.

``ref_projects``: project_id, name, type, completed_at, team_size.
``ref_items``: project_id, item_type, size, cycle_hours.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shipgauge.functions import stats
from shipgauge.functions.status import is_done


def refclass_items(items: DataFrame) -> DataFrame:
    """Completed work with a cycle time, as reference items."""
    return items.where(is_done(F.col("status")) & (F.col("cycle_hours") > 0)).select(
        "project_key", "item_type", "size", "cycle_hours"
    )


def _per_project(ref_items: DataFrame, *keys: str) -> DataFrame:
    ms = stats.to_ms(F.col("cycle_hours"))
    grouped = ref_items.groupBy("project_id", *keys).agg(
        F.count("*").alias("n"), *stats.sum_parts(ms, "sum_ms"), *stats.square_parts(ms, "sq_ms")
    )
    return stats.resolve(grouped, ("sum_ms",), ("sq_ms",))


def _added() -> list[Column]:
    return [F.sum(c).alias(c) for c in ("n", "sum_ms", "sq_ms")]


def refclass_distribution(ref_projects: DataFrame, ref_items: DataFrame) -> DataFrame:
    """Mean and population deviation per (project type, item type, size).

    Items are reduced to three sums per project before the type is attached: the
    join moves one row per (project, item type, size) instead of every item.
    A combination without items has no row.
    """
    n, total, sq = F.col("n"), F.col("sum_ms"), F.col("sq_ms")
    return (
        _per_project(ref_items, "item_type", "size")
        .join(ref_projects.select("project_id", "type"), "project_id")
        .groupBy("type", "item_type", "size")
        .agg(*_added())
        .select(
            "type", "item_type", "size", "n",
            stats.mean_hours(total, n).alias("mean"),
            stats.sd_population_hours(total, sq, n).alias("stddev"),
        )
    )


def backoff_distribution(ref_projects: DataFrame, ref_items: DataFrame) -> DataFrame:
    """Mean and population deviation at three levels, from one aggregate.

    Level 3 is (project type, item type, size), level 2 (project type, size), level 1
    the project type alone; columns that a level adds up over are NULL.
    """
    n, total, sq = F.col("n"), F.col("sum_ms"), F.col("sq_ms")
    sums = (
        _per_project(ref_items, "item_type", "size")
        .join(ref_projects.select("project_id", "type"), "project_id")
        .groupBy("type", "item_type", "size").agg(*_added())
    )
    sets = [[F.col("type"), F.col("item_type"), F.col("size")], [F.col("type"), F.col("size")], [F.col("type")]]
    level = F.when(F.grouping("size") == 1, 1).when(F.grouping("item_type") == 1, 2).otherwise(3)
    return (
        sums.groupingSets(sets, "type", "item_type", "size").agg(*_added(), level.alias("level"))
        .select(
            "type", "item_type", "size", "level", "n",
            stats.mean_hours(total, n).alias("mean"), stats.sd_population_hours(total, sq, n).alias("stddev"),
        )
    )


def refclass_summary(ref_projects: DataFrame, ref_items: DataFrame) -> DataFrame:
    """Projects, items, average and population deviation per project type.

    With one row per project on either side the number of projects is a plain
    count, so no DISTINCT aggregation is needed.
    """
    n, total, sq = (F.coalesce(F.col(c), F.lit(0)) for c in ("n", "sum_ms", "sq_ms"))
    return (
        ref_projects.select("project_id", "type")
        .join(_per_project(ref_items), "project_id", "left")
        .groupBy("type")
        .agg(F.count("*").alias("project_count"), *_added())
        .select(
            "type", "project_count", n.alias("item_count"),
            F.coalesce(stats.mean_hours(total, n), F.lit(0.0)).alias("avg_hours"),
            F.coalesce(stats.sd_population_hours(total, sq, n), F.lit(0.0)).alias("stddev"),
        )
        .orderBy(F.col("project_count").desc(), "type")
    )
