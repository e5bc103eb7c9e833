"""Series of past reports.

``history``: project_key, ts, total, completed, remaining, avg_cycle,
throughput, percentiles MAP<INT, DOUBLE>.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shipgauge.functions.status import progress_pct
from shipgauge.functions.times import days_before
from shipgauge.operators.series import latest, top_rows


def level(pct: int) -> Column:
    """Days at a percentile; 0 where the entry does not have it."""
    return F.coalesce(F.try_element_at("percentiles", F.lit(pct)), F.lit(0.0))


def retained(history: DataFrame, keep: int = 100) -> DataFrame:
    """Last ``keep`` entries of each project; entries of one time in the order of their figures."""
    order = [F.col("ts").desc(), *[c.desc() for c in _figures()]]
    return top_rows(history, "project_key", order, keep, "_rank").drop("_rank")


def _figures() -> list[Column]:
    """What decides between entries of one project and time."""
    return [*[F.col(c) for c in ("completed", "total", "remaining", "avg_cycle", "throughput")], F.to_json("percentiles")]


def in_window(history: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """Entries strictly after ``as_of`` minus ``days``."""
    return history.where(F.col("ts") > days_before(as_of, days))


def history_window(history: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    return in_window(history, as_of, days).select(
        "project_key", "ts", "total", "completed", "remaining", "avg_cycle", "throughput",
        progress_pct(F.col("completed"), F.col("total")).alias("progress_pct"),
        level(70).alias("p70"), level(95).alias("p95"),
    )


def _ends(entries: DataFrame, row: Column) -> DataFrame:
    """First and last entry of each project with at least two."""
    order = F.struct("ts", *_figures())
    return (
        entries.groupBy("project_key")
        .agg(F.count("*").alias("entries"), F.min_by(row, order).alias("a"), F.max_by(row, order).alias("b"))
        .where(F.col("entries") >= 2)
    )


def history_trend(history: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """Change of progress (points), throughput and p70 (percent), and direction."""
    row = F.struct(
        progress_pct(F.col("completed"), F.col("total")).alias("progress"), "throughput",
        level(70).alias("p70"),
    )

    def change(name: str) -> Column:
        a, b = F.col(f"a.{name}"), F.col(f"b.{name}")
        return F.when(a > 0, (b - a) / a * 100).otherwise(F.lit(0.0))

    progress, p70 = F.col("progress_change"), F.col("p70_change")
    return (
        _ends(in_window(history, as_of, days), row)
        .select(
            "project_key", "entries",
            (F.col("b.progress") - F.col("a.progress")).alias("progress_change"),
            change("throughput").alias("throughput_change"),
            change("p70").alias("p70_change"),
        )
        .withColumn(
            "direction",
            F.when((progress > 5) & (p70 < -5), "improving")
            .when((progress < -5) | (p70 > 10), "declining")
            .otherwise("stable"),
        )
    )


def p85_drift(history: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    return _ends(in_window(history, as_of, days), F.struct(level(85).alias("p85"))).select(
        "project_key", (F.col("b.p85") - F.col("a.p85")).alias("p85_drift")
    )


def history_latest(history: DataFrame) -> DataFrame:
    return latest(history, "project_key", "ts", tuple(_figures()))
