"""Label-array expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def first_mapped(labels: Column, pairs: tuple[tuple[str, str], ...], default: str) -> Column:
    """Value of the first label (in label order) that has a mapping."""
    if not pairs:
        return F.lit(default)
    lookup: dict[str, str] = {}
    for label, value in pairs:
        lookup.setdefault(label, value)
    known = F.filter(labels, lambda x: x.isin(*lookup))
    table = F.create_map(*[F.lit(v) for pair in lookup.items() for v in pair])
    return F.coalesce(F.try_element_at(table, F.get(known, F.lit(0))), F.lit(default))


def first_prefixed(labels: Column, prefix: str) -> Column:
    """Rest of the first label that starts with ``prefix``; NULL without one."""
    hit = F.get(F.filter(labels, lambda x: x.startswith(prefix)), F.lit(0))
    return F.substring(hit, len(prefix) + 1, 1 << 30)


def relabel(labels: Column, add: list[str], remove: list[str]) -> Column:
    """Labels after removing and adding; both lists empty is an error."""
    if not add and not remove:
        raise ValueError("no labels to add or remove")
    out = labels
    if remove:
        out = F.array_except(out, F.array(*[F.lit(x) for x in remove]))
    if add:
        out = F.array_union(out, F.array(*[F.lit(x) for x in add]))
    return out
