"""Status vocabulary and health bands as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from shipgauge.settings import BLOCKED, CANCELED, DONE, IN_PROGRESS, TO_DO

# Accepted spellings of task statuses (after trim and lower).
TASK_STATUS_SPELLINGS = {
    TO_DO: ("", "todo", "to do", "to_do"),
    IN_PROGRESS: ("in_progress", "in progress", "inprogress"),
    DONE: ("done", "completed", "complete"),
    BLOCKED: ("blocked",),
}


def normalize_status(col: Column, done: tuple[str, ...], wip: tuple[str, ...]) -> Column:
    """Exact membership in the done set, then the in-progress set, else unchanged."""
    return (
        F.when(col.isin(*done), F.lit(DONE))
        .when(col.isin(*wip), F.lit(IN_PROGRESS))
        .otherwise(col)
    )


def normalize_task_status(col: Column) -> Column:
    """Canonical name of a task status; unknown text is kept as it was written."""
    folded = F.lower(F.trim(F.coalesce(col, F.lit(""))))
    out = F.when(F.lit(False), F.lit(""))
    for name, spellings in TASK_STATUS_SPELLINGS.items():
        out = out.when(folded.isin(*spellings), F.lit(name))
    return out.otherwise(col)


def is_done(col: Column) -> Column:
    return col == DONE


def is_live(col: Column) -> Column:
    """Counts towards the total: anything but the exact spelling ``Canceled``."""
    return col != CANCELED


def is_remaining(col: Column) -> Column:
    return ~col.isin(DONE, CANCELED)


def progress_pct(done: Column, total: Column) -> Column:
    return F.when(total > 0, done / total * 100).otherwise(F.lit(0.0))


def schedule_band(sv: Column) -> Column:
    """ahead, behind or on the plan."""
    return (
        F.when(sv > 0, "ahead")
        .when(sv < 0, "behind")
        .when(sv == 0, "on")
    )


def spi_band(spi: Column) -> Column:
    """kept (1 and more), slipping (0.9), late (0.8) or far-off."""
    return (
        F.when(spi >= 1.0, "kept")
        .when(spi >= 0.9, "slipping")
        .when(spi >= 0.8, "late")
        .when(spi.isNotNull(), "far-off")
    )


def status_health(open_items: Column, progress: Column) -> Column:
    return (
        F.when(open_items == 0, "good")
        .when(progress >= 75, "good")
        .when(progress >= 25, "warning")
        .otherwise("critical")
    )


def compare_health(progress: Column, p85: Column) -> Column:
    return (
        F.when(progress >= 90, "ahead")
        .when((progress >= 50) & (p85 <= 60), "on-track")
        .when((progress < 25) | (p85 > 90), "behind")
        .otherwise("at-risk")
    )
