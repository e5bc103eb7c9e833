"""Grouped item metrics.

``group_facts`` is the one wide aggregate everything else is derived from: a
single scan and one map-side combined shuffle. It carries only counts, sums and
minima, so a project holding a third of all items sends one partial row per task
like any other, and facts of a fine grain add up to those of a coarser one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shipgauge.functions import stats
from shipgauge.functions.status import is_done, is_live, is_remaining, progress_pct
from shipgauge.functions.times import days_before
from shipgauge.settings import BLOCKED, CANCELED, DONE, IN_PROGRESS, TO_DO, Settings


def with_sample(items: DataFrame) -> DataFrame:
    """Adds cycle_ms and the marker of a usable cycle-time sample."""
    return items.withColumn("cycle_ms", stats.to_ms(F.col("cycle_hours"))).withColumn(
        "is_sample", is_done(F.col("status")) & (F.col("cycle_hours") > 0)
    )


def _shown_type() -> Column:
    return F.coalesce(F.nullif(F.col("item_type"), F.lit("")), F.lit("Untyped"))


def throughput_count(as_of: Column, days: int) -> Column:
    """Items with a done time after the cutoff, whatever their status now."""
    return F.count_if(F.col("done_ts") > days_before(as_of, days))


def _count_measures(cfg: Settings, as_of: Column) -> list[Column]:
    status = F.col("status")
    wip = status.isin(*cfg.wip_statuses)
    sample_ms = F.when(F.col("is_sample"), F.col("cycle_ms"))
    return [
        F.count("*").alias("items"),
        F.count_if(is_live(status)).alias("total"),
        F.count_if(is_done(status)).alias("done"),
        F.count_if(wip).alias("in_progress"),
        F.count_if(is_remaining(status) & ~wip).alias("to_do"),
        F.count_if(status == CANCELED).alias("canceled"),
        F.count_if(F.col("is_sample")).alias("cycle_n"),
        *stats.sum_parts(sample_ms, "cycle_sum_ms"),
        *stats.square_parts(sample_ms, "cycle_sq_ms"),
        *stats.sum_parts(F.when(F.col("cycle_hours") > 0, F.col("cycle_ms")), "cost_ms"),
        throughput_count(as_of, cfg.throughput_days).alias("recent_done"),
        F.min("created").alias("started"),
    ]


def group_facts(
    items: DataFrame, as_of: Column, cfg: Settings = Settings(), by: tuple[str, ...] = ()
) -> DataFrame:
    """All measures per project and the columns ``by`` (size, item_type, or any as it is)."""
    names = {"size": F.coalesce("size", F.lit("")), "item_type": _shown_type()}
    grouped = (
        with_sample(items)
        .groupBy("project_key", *[names.get(n, F.col(n)).alias(n) for n in by])
        .agg(*_count_measures(cfg, as_of))
    )
    return stats.resolve(grouped, ("cycle_sum_ms", "cost_ms"), ("cycle_sq_ms",))


def add_up(facts: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Facts of a fine grain as facts per project and ``by``."""
    keys = ("project_key", "size", "item_type", "started")
    return facts.groupBy("project_key", *by).agg(
        *[F.sum(c).alias(c) for c in facts.columns if c not in keys], F.min("started").alias("started")
    )


def size_facts(items: DataFrame, as_of: Column, cfg: Settings = Settings()) -> DataFrame:
    return group_facts(items, as_of, cfg, ("size",))


def project_facts(source: DataFrame, as_of: Column, cfg: Settings = Settings()) -> DataFrame:
    """All measures per project, from items or from finer facts."""
    finer = "cycle_sum_ms" in source.columns
    grouped = add_up(source) if finer else group_facts(source, as_of, cfg)
    return grouped.withColumns({
        "avg_cycle_hours": F.coalesce(
            stats.mean_hours(F.col("cycle_sum_ms"), F.col("cycle_n")), F.lit(0.0)
        ),
        "progress_pct": progress_pct(F.col("done"), F.col("total")),
        "remaining": F.col("in_progress") + F.col("to_do"),
        "throughput_per_day": F.col("recent_done") / F.lit(float(cfg.throughput_days)),
    })


def status_counts(facts: DataFrame) -> DataFrame:
    return facts.select(
        "project_key", "total", "done", "in_progress", "to_do", "progress_pct",
        "cycle_n", "avg_cycle_hours",
    )


def flow_counts(facts: DataFrame) -> DataFrame:
    return facts.select("project_key", "to_do", "in_progress", "done", "canceled")


def average_cycle(facts: DataFrame) -> DataFrame:
    return facts.select("project_key", "avg_cycle_hours")


def throughput(facts: DataFrame) -> DataFrame:
    return facts.select("project_key", "recent_done", "throughput_per_day")


def status_breakdown(items: DataFrame) -> DataFrame:
    named = {"done": DONE, "in_progress": IN_PROGRESS, "to_do": TO_DO, "blocked": BLOCKED}
    status = F.col("status")
    return items.groupBy("project_key").agg(
        *[F.count_if(status == v).alias(k) for k, v in named.items()],
        F.count_if(~status.isin(*named.values())).alias("other"),
    )


def size_stats(facts: DataFrame) -> DataFrame:
    """Samples and average hours per size; sizes without samples give no row."""
    return facts.where((F.col("cycle_n") > 0) & (F.col("size") != "")).select(
        "project_key", "size", F.col("cycle_n").alias("n"),
        stats.mean_hours(F.col("cycle_sum_ms"), F.col("cycle_n")).alias("avg_hours"),
    )


def type_stats(facts: DataFrame) -> DataFrame:
    """Totals per item type, from facts by item_type; canceled items do not count."""
    return facts.where(F.col("total") > 0).select(
        "project_key", "item_type", "total", "done", (F.col("total") - F.col("done")).alias("remaining")
    )


def size_distribution(facts: DataFrame) -> DataFrame:
    """Mean and sample deviation of completed work and open items, per size (and item type if the facts have it)."""
    n, total, sq = F.col("cycle_n"), F.col("cycle_sum_ms"), F.col("cycle_sq_ms")
    return facts.select(
        "project_key", *(c for c in ("item_type",) if c in facts.columns), "size", n.alias("n"),
        stats.mean_hours(total, n).alias("mean"),
        stats.sd_sample_hours(total, sq, n).alias("stddev"),
        (F.col("in_progress") + F.col("to_do")).alias("remaining"),
    )


def worklog_totals(worklogs: DataFrame) -> DataFrame:
    return worklogs.groupBy("issue_key").agg(
        F.sum("seconds").alias("total_seconds"), F.count("*").alias("entries")
    )


def sync_summary(items: DataFrame) -> DataFrame:
    """Items per project, and over all of them at level ``all``, where the project is NULL."""
    return items.rollup("project_key").agg(total_level(), F.count("*").alias("item_count"))


def total_level() -> Column:
    """Tells the grand total of a rollup by project from a project without a key."""
    return F.when(F.grouping_id() == 0, "project").otherwise("all").alias("level")
