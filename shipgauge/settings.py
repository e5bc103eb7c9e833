"""Parameters shared by the operators.

Every value can be overridden; nothing here reads the clock, the environment
or a random source, so that a job's result depends on its inputs alone.
"""

from __future__ import annotations

from dataclasses import dataclass

# Canonical status vocabulary.
DONE = "Done"
IN_PROGRESS = "In Progress"
TO_DO = "To Do"
BLOCKED = "Blocked"
CANCELED = "Canceled"

# Fallback cycle-time distribution per size, (mean, sd) in hours,
# and the pair used for any other size.
DEFAULT_SIZE_HOURS = {
    "S": (1.5, 0.5),
    "M": (4.0, 1.5),
    "L": (8.0, 2.5),
    "XL": (16.0, 5.0),
}
OTHER_SIZE_HOURS = (4.0, 2.0)
MIN_ITEM_HOURS = 0.5

PERCENTILES = (50, 70, 85, 95)


@dataclass(frozen=True)
class Settings:
    done_statuses: tuple[str, ...] = (DONE,)
    wip_statuses: tuple[str, ...] = (IN_PROGRESS, "In Development")
    # (label, value) pairs; where a label occurs twice the first pair counts.
    type_labels: tuple[tuple[str, str], ...] = ()
    size_labels: tuple[tuple[str, str], ...] = ()
    default_type: str = "Unknown"
    default_size: str = "M"
    global_capacity: float | None = None
    fallback_capacity: float = 8.0
    throughput_days: int = 14
    hours_per_point: float = 4.0
    hours_without_points: float = 8.0
