"""Composite reports over many projects.

``projects``: project_key, epic_key, name, capacity, config_order. All figures
of one report come from ``base_facts``: one scan of the items, stored once as a
small table because several branches of a report read it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from shipgauge.functions.status import (
    compare_health,
    progress_pct,
    status_health,
)
from shipgauge.functions.times import target_date
from shipgauge.operators import earned, quantiles, rollup, selection, series
from shipgauge.settings import PERCENTILES, Settings
from shipgauge.sources.scratch import materialize


@dataclass(frozen=True)
class Sampling:
    iterations: int = 10_000
    seed: int = 42
    rank_mode: str = "nearest"


@dataclass(frozen=True)
class BaseFacts:
    projects: DataFrame
    sizes: DataFrame
    types: DataFrame | None = None


def base_facts(
    items: DataFrame, projects: DataFrame, as_of: Column, cfg: Settings, with_types: bool = False
) -> BaseFacts:
    """Measures per project, size and perhaps type from a single pass over the items.

    Projects without items are kept, with NULL measures.
    """
    grain = ("size", "item_type") if with_types else ("size",)
    fine = materialize(rollup.group_facts(items, as_of, cfg, grain), "facts")
    sizes = rollup.add_up(fine, ("size",)) if with_types else fine
    types = rollup.add_up(fine, ("item_type",)) if with_types else None
    named = projects.withColumn("project_key", selection.project_id()).select(
        "project_key", "name", "epic_key", "capacity"
    )
    facts = rollup.project_facts(fine, as_of, cfg)
    return BaseFacts(named.join(facts, "project_key", "left"), sizes, types)


def _has_samples() -> Column:
    return F.coalesce(F.col("cycle_n"), F.lit(0)) > 0


def eligibility(facts: DataFrame) -> DataFrame:
    """Whether a project can be projected, and why not."""
    reason = (
        F.when(F.coalesce(F.col("items"), F.lit(0)) == 0, "no data")
        .when(~_has_samples(), "no cycle time data")
    )
    return facts.select("project_key", reason.isNull().alias("eligible"), reason.alias("reason"))


def _completion(
    base: BaseFacts, wanted: DataFrame, cfg: Settings, how: Sampling,
    percentiles: tuple[int, ...] = PERCENTILES,
) -> DataFrame:
    sizes = rollup.size_distribution(base.sizes).join(
        wanted.select("project_key"), "project_key", "left_semi"
    )
    return quantiles.completion_quantiles(
        sizes, wanted.select("project_key", "capacity"), cfg, percentiles,
        how.iterations, how.seed, how.rank_mode,
    )


def portfolio_run(
    items: DataFrame, projects: DataFrame, as_of: Column, cfg: Settings = Settings(),
    how: Sampling = Sampling(), percentiles: tuple[int, ...] = PERCENTILES,
) -> DataFrame:
    """Completion of every eligible project: one row per project and level."""
    base = base_facts(items, projects, as_of, cfg)
    eligible = base.projects.where(_has_samples())
    levels = _completion(base, eligible, cfg, how, percentiles)
    return eligible.join(levels, "project_key").select(
        "project_key", "name", "total", F.col("done").alias("completed"), "remaining",
        "avg_cycle_hours", "throughput_per_day", "pct", "days",
        target_date(as_of, F.col("days")).alias("target_date"),
    )


def history_entries(run: DataFrame, as_of: Column) -> DataFrame:
    """A finished run as rows for the history store."""
    keys = ["project_key", "total", "completed", "remaining", "avg_cycle_hours", "throughput_per_day"]
    return (
        run.groupBy(*keys)
        .agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("pct", "days")))).alias("percentiles"))
        .select(
            "project_key", as_of.alias("ts"), "total", "completed", "remaining",
            F.col("avg_cycle_hours").alias("avg_cycle"),
            F.col("throughput_per_day").alias("throughput"), "percentiles",
        )
    )


def project_compare(
    items: DataFrame, projects: DataFrame, drift: DataFrame, as_of: Column,
    cfg: Settings = Settings(), how: Sampling = Sampling(iterations=5_000),
) -> DataFrame:
    """Projects with data side by side. ``drift``: project_key, p85_drift.

    Without cycle times the projected days are 0.
    """
    base = base_facts(items, projects, as_of, cfg)
    present = base.projects.where(F.col("items") > 0)
    wide = quantiles.quantiles_wide(_completion(base, present.where(_has_samples()), cfg, how))
    days = {p: F.coalesce(F.col(f"p{p}"), F.lit(0.0)) for p in PERCENTILES}
    return (
        present.join(wide, "project_key", "left")
        .join(drift, "project_key", "left")
        .select(
            "project_key", "name", "total", "done", "remaining", "progress_pct",
            "avg_cycle_hours", "throughput_per_day",
            days[70].alias("p70"), days[85].alias("p85"), days[95].alias("p95"),
            F.when(_has_samples(), target_date(as_of, days[85])).alias("target_date_85"),
            compare_health(F.col("progress_pct"), days[85]).alias("health"),
            F.coalesce("p85_drift", F.lit(0.0)).alias("p85_drift"),
        )
    )


def compare_summary(comparison: DataFrame) -> DataFrame:
    """One row: fastest, most complete and riskiest project, and totals.

    Fastest is the smallest positive p85, riskiest the greatest p85 among
    projects that are behind or at risk; ties go to the first key. Progress is
    averaged in whole hundredths of a percent so that no order of adding rows
    shows in the result.
    """
    c = F.col
    risky = c("health").isin("behind", "at-risk")
    def first_by(order: Column, keep: Column) -> Column:
        return F.min(F.when(keep, F.struct(order.alias("o"), c("project_key").alias("k"))))["k"]
    exact = F.sum(F.round(c("progress_pct") * 1_000_000).cast("decimal(20,0)")).cast("double")
    return comparison.agg(
        first_by(c("p85"), c("p85") > 0).alias("fastest_project"),
        first_by(-c("progress_pct"), F.lit(True)).alias("most_complete"),
        first_by(-c("p85"), risky).alias("highest_risk"),
        F.coalesce(F.sum("remaining"), F.lit(0)).alias("total_remaining"),
        (exact / F.count("*") / 1_000_000).alias("average_progress"),
    )


def project_status(
    items: DataFrame, projects: DataFrame, as_of: Column,
    cfg: Settings = Settings(), how: Sampling = Sampling(iterations=5_000),
) -> DataFrame:
    """Status line per project with data: counts, p85 and health."""
    base = base_facts(items, projects, as_of, cfg)
    present = base.projects.where(F.col("items") > 0)
    open_work = present.where(_has_samples() & (F.col("remaining") > 0))
    p85 = _completion(base, open_work, cfg, how, (85,)).select("project_key", F.col("days").alias("p85"))
    return present.join(p85, "project_key", "left").select(
        "project_key", "name", "total", "done", "in_progress", "to_do", "progress_pct",
        "avg_cycle_hours", "p85", target_date(as_of, F.col("p85")).alias("target_date_85"),
        status_health(F.col("remaining"), F.col("progress_pct")).alias("health"),
    )


def dashboard(
    items: DataFrame, projects: DataFrame, as_of: Column, cfg: Settings = Settings()
) -> DataFrame:
    """Counts and rough target days per project; no draws, one aggregation."""
    facts = projects.withColumn("project_key", selection.project_id()).join(
        rollup.project_facts(items, as_of, cfg), "project_key", "left"
    )
    def count(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0)).alias(name)
    return earned.buffer_projection(facts, cfg).select(
        "project_key", "name", count("total"), count("done"), count("in_progress"), count("to_do"),
        F.coalesce("progress_pct", F.lit(0.0)).alias("progress_pct"),
        F.coalesce("avg_cycle_hours", F.lit(0.0)).alias("avg_cycle_hours"),
        target_date(as_of, F.col("days_70")).alias("target_70"),
        target_date(as_of, F.col("days_95")).alias("target_95"),
    )


def projects_list(items: DataFrame, projects: DataFrame, as_of: Column, cfg: Settings = Settings()) -> DataFrame:
    facts = rollup.project_facts(items, as_of, cfg).select("project_key", "total", "done", "remaining")
    named = projects.withColumn("project_key", selection.project_id())
    def count(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0))
    return named.join(facts, "project_key", "left").select(
        "project_key", "name", "epic_key", "capacity",
        count("total").alias("total"), count("done").alias("done"), count("remaining").alias("remaining"),
        progress_pct(count("done"), count("total")).alias("progress_pct"),
    )


def report_sections(
    items: DataFrame, projects: DataFrame, as_of: Column, cfg: Settings = Settings(),
    how: Sampling = Sampling(), pv_after_end: str = "total",
) -> dict[str, DataFrame]:
    """The tables of a full report: overview, eva, completion, sizes, types."""
    base = base_facts(items, projects, as_of, cfg, with_types=True)
    present = base.projects.where(F.col("items") > 0)
    plans = earned.with_plan(present, cfg)
    completion = _completion(base, present.where(_has_samples()), cfg, how)
    return {
        "overview": present.select(
            "project_key", "total", "done", "in_progress", "to_do", "remaining", "progress_pct",
            "cycle_n", "avg_cycle_hours", "throughput_per_day",
        ),
        "eva": earned.eva_metrics(plans, as_of, pv_after_end),
        "completion": completion.withColumn("target_date", target_date(as_of, F.col("days"))),
        "sizes": rollup.size_stats(base.sizes),
        "types": rollup.type_stats(base.types),
    }


def report_full(sections: dict[str, DataFrame]) -> DataFrame:
    """All sections in one table: (project_key, section, label, metric, value, text).

    A figure has a value, a date or band a text.
    """
    measures = {
        "overview": (None, ("total", "done", "in_progress", "to_do", "remaining", "progress_pct", "cycle_n", "avg_cycle_hours"), ()),
        "eva": (None, ("week", "pv", "ev", "sv", "spi", "completion_week"), ("sv_band", "spi_band")),
        "completion": ("pct", ("days",), ("target_date",)),
        "sizes": ("size", ("n", "avg_hours"), ()),
        "types": ("item_type", ("total", "done", "remaining"), ()),
    }
    none = {"value": F.lit(None).cast("double"), "text": F.lit(None).cast("string")}
    parts = []
    for section, (label, figures, texts) in measures.items():
        rows = [(n, F.col(n).cast("double"), none["text"]) for n in figures]
        rows += [(n, none["value"], F.col(n).cast("string")) for n in texts]
        cells = [v for n, value, text in rows for v in (F.lit(n), value, text)]
        parts.append(sections[section].select(
            "project_key", F.lit(section).alias("section"),
            (F.col(label).cast("string") if label else F.lit("")).alias("label"),
            F.stack(F.lit(len(rows)), *cells).alias("metric", "value", "text"),
        ))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
