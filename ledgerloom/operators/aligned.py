"""Append rows that carry only some of a table's columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def align(rows: DataFrame, target: DataFrame) -> DataFrame:
    """Project `rows` onto the schema of `target`: missing columns become NULL, unknown ones are an error."""
    unknown = [c for c in rows.columns if c not in target.columns]
    if unknown:
        raise ValueError(f"columns not in the target table: {unknown}")
    return rows.select([
        (F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in target.schema
    ])


def append_aligned(target: DataFrame, rows: DataFrame) -> DataFrame:
    return target.unionByName(align(rows, target))
