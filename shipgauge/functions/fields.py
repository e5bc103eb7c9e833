"""Expressions over dynamically typed custom fields (VARIANT)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def value_kind(value: Column) -> Column:
    """number, string, object, array or unknown; NULL for a JSON null."""
    kind = F.schema_of_variant(value)
    return (
        F.when(kind == "VOID", F.lit(None).cast("string"))
        .when(kind.rlike(r"^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), "number")
        .when(kind == "STRING", "string")
        .when(kind.startswith("OBJECT"), "object")
        .when(kind.startswith("ARRAY"), "array")
        .otherwise("unknown")
    )


def number_field(raw: Column, name: str) -> Column:
    """A numeric custom field as double. Numeric text is not a number."""
    value = F.try_variant_get(raw, f"$.{name}", "variant")
    return F.when(
        value_kind(value) == "number", F.try_variant_get(raw, f"$.{name}", "double")
    )


def story_points(raw: Column, name: str) -> Column:
    return F.coalesce(number_field(raw, name), F.lit(0.0))
