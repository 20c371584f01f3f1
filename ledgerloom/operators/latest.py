"""Latest row per key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, key: str | list[str], order_by: str = "created_at", ties: tuple[str, ...] = ()) -> DataFrame:
    """Keep the newest row of each key.

    Equal times are settled by `ties` and then by all other columns in their order, the highest value first and NULL
    last, so the row kept is a matter of the data alone and any engine can state it. Keys that were cut to a fixed width
    share their time with many other rows. Catalyst puts a group limit below the shuffle for the
    `= 1` filter: each map task sends at most one row per key, so a key that
    holds a third of the table does not pile up in one task.
    """
    keys = [key] if isinstance(key, str) else list(key)
    first = (order_by, *ties)
    order = [F.col(c).desc_nulls_last() for c in (*first, *(c for c in df.columns if c not in (*keys, *first)))]
    newest = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(newest)).where(F.col("_rank") == 1).drop("_rank")
