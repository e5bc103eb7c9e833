"""Earned value against a linear plan.

The plan is a formula, so planned value and earned schedule are computed in
closed form per project. Only ``planned_schedule``, whose result is the plan
itself, produces one row per week.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shipgauge.functions import stats
from shipgauge.functions.status import schedule_band, spi_band
from shipgauge.functions.times import MICROS_PER_HOUR
from shipgauge.operators.selection import effective_capacity
from shipgauge.settings import Settings

WEEKS_PER_CHUNK = 1_000


def _whole(a: Column, b: Column) -> Column:
    """Quotient truncated to a BIGINT."""
    return F.call_function("div", a, b)


def _product(a: Column, b: Column) -> Column:
    """DECIMAL, so that items times weeks cannot overflow."""
    return a.cast("decimal(19,0)") * b.cast("decimal(18,0)")


def planned_value(total: Column, weeks: Column, week: Column) -> Column:
    """Items due by the end of ``week``: floor(total * week / weeks)."""
    return _whole(_product(total, week), weeks.cast("decimal(19,0)"))


def duration_weeks(total: Column, avg_hours: Column, capacity: Column) -> Column:
    """Whole five-day weeks of work, at least 1; 12 where it cannot be told."""
    days = total * avg_hours / capacity
    return F.when(
        (avg_hours > 0) & (capacity > 0), F.greatest(F.floor(days / 5), F.lit(1))
    ).otherwise(F.lit(12)).cast("bigint")


def elapsed_weeks(started: Column, as_of: Column) -> Column:
    """1-based week of ``as_of``, counted from the start, truncated towards zero."""
    gap = F.unix_micros(as_of) - F.unix_micros(started)
    return _whole(gap, F.lit(168 * MICROS_PER_HOUR)) + 1


def completion_week(weeks: Column, spi: Column) -> Column:
    return F.when(spi == 0, F.lit(0)).otherwise((weeks / spi).cast("bigint")).cast("bigint")


def with_plan(facts: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """Adds capacity and planned_weeks to project facts carrying ``capacity``."""
    return facts.withColumn(
        "capacity", effective_capacity(F.col("capacity"), cfg)
    ).withColumn(
        "planned_weeks",
        duration_weeks(F.col("total"), F.col("avg_cycle_hours"), F.col("capacity")),
    )


def planned_schedule(plans: DataFrame) -> DataFrame:
    """(project_key, week, pv) for plans (project_key, total, planned_weeks).

    Weeks are produced in two steps, chunks then weeks, with the chunks dealt
    out in between: the plan of a huge project is no single long array.
    """
    weeks = F.col("planned_weeks")
    chunks = F.sequence(F.lit(0), _whole(weeks - 1, F.lit(WEEKS_PER_CHUNK)))
    first = F.col("_chunk") * WEEKS_PER_CHUNK + 1
    last = F.least(first + WEEKS_PER_CHUNK - 1, weeks)
    return (
        plans.where(weeks > 0)
        .select("project_key", "total", "planned_weeks", F.explode(chunks).alias("_chunk"))
        .repartition("project_key", "_chunk")
        .withColumn("week", F.explode(F.sequence(first, last)))
        .select("project_key", "week", planned_value(F.col("total"), weeks, F.col("week")).alias("pv"))
    )


def eva_metrics(
    plans: DataFrame, as_of: Column, pv_after_end: str = "total"
) -> DataFrame:
    """Earned value per project.

    ``plans`` are project facts through ``with_plan``. After the planned end PV
    stays at the total; ``pv_after_end='zero'`` drops it to 0 there instead.
    Projects without a start date keep their counts and have NULL metrics.
    """
    if pv_after_end not in ("total", "zero"):
        raise ValueError("pv_after_end must be 'total' or 'zero'")
    c = F.col
    week, weeks, ev, pv, ac = c("week"), c("planned_weeks"), c("ev"), c("pv"), c("ac")
    beyond = c("total") if pv_after_end == "total" else F.lit(0)
    due = (
        F.when(week > weeks, beyond)
        .when(week < 1, F.lit(0))
        .otherwise(planned_value(c("total"), weeks, week))
    )
    started = c("started").isNotNull()
    return (
        plans.withColumn("week", elapsed_weeks(c("started"), as_of))
        .withColumns({
            "pv": F.when(started, due.cast("bigint")),
            "ev": c("done"),
            "ac": F.coalesce(c("cost_ms").cast("double") / F.lit(stats.MS_PER_HOUR), F.lit(0.0)),
        })
        .withColumns({
            "sv": ev - pv,
            "cv": ev - ac,
            "spi": F.when(pv > 0, ev / pv).when(started, F.lit(0.0)),
            "cpi": F.when(ac > 0, ev / ac).otherwise(F.lit(0.0)),
        })
        .select(
            "project_key", "planned_weeks", "week", "pv", "ev", "ac", "sv", "cv", "spi", "cpi",
            schedule_band(c("sv")).alias("sv_band"),
            spi_band(c("spi")).alias("spi_band"),
            completion_week(weeks, c("spi")).alias("completion_week"),
        )
    )


def earned_schedule(plans: DataFrame) -> DataFrame:
    """Week at which the plan reaches what has been earned, interpolated.

    The first week with floor(total * w / weeks) >= ev is ceil(ev * weeks / total).
    """
    total, weeks, ev = F.col("total"), F.col("planned_weeks"), F.col("done")
    size = F.greatest(total, F.lit(1)).cast("decimal(19,0)")
    reach = _whole(_product(ev, weeks) + size - 1, size)
    w = F.greatest(reach, F.lit(1))
    before = F.col("_w") - 1
    pv_before = planned_value(total, weeks, before)
    pv_at = planned_value(total, weeks, F.col("_w"))
    es = (
        F.when(ev > total, weeks.cast("double"))
        .when(F.col("_w") == 1, F.lit(1.0))
        .otherwise(before + (ev - pv_before) / (pv_at - pv_before))
    )
    return plans.withColumn("_w", w).select(
        "project_key", "planned_weeks", ev.alias("ev"), es.alias("earned_schedule")
    )


def buffer_projection(facts: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """Rough days left at 70 % and 95 %, from items to do and average hours.

    Fixed values: factors 1.3 and 1.8. NULL unless done, to_do and the average
    are all positive. Items in progress are not counted.
    """
    capacity = effective_capacity(F.col("capacity"), cfg)
    usable = (F.col("done") > 0) & (F.col("to_do") > 0) & (F.col("avg_cycle_hours") > 0)
    per_item = F.col("avg_cycle_hours") / capacity
    def days(factor: float) -> Column:
        return F.when(usable, (F.col("to_do") * per_item * F.lit(factor)).cast("bigint"))
    return facts.withColumns({"days_70": days(1.3), "days_95": days(1.8)})
