"""Exact discrete medians by nested value histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.operators.fanout import join_groups

#: Low bits that a cell of each histogram leaves open. Cells are refined by 2^20 at most.
LEVELS = (40, 20, 0)


def cents(amount: Column) -> Column:
    return (amount * 100).cast("bigint")


def group_medians(rows: DataFrame, keys: list[str], amount: str, name: str) -> DataFrame:
    """`keys` and the median of `amount`, a money column, of every group: the smallest value that half the rows don't exceed.

    Rows are counted by value before anything else, so the shuffle is by group and value and a hot group spreads. Then the
    counts of a group's coarse cells tell the cell that holds the middle row, and only that cell is counted by finer ones.
    No group's rows or values are sorted; the running sum of a step goes over cells, however many rows they hold. Null
    amounts don't count; a group with none but nulls has no row. Null keys are a group.
    """
    value = cents(F.col(amount))
    left = rows.where(F.col(amount).isNotNull()).groupBy(*keys, value.alias("_value")).agg(F.count(F.lit(1)).alias("_rows"))
    chosen, before = None, 0
    for bits in LEVELS:
        cell = F.shiftright("_value", bits)
        if chosen is not None:
            # the cell found before, and what is left of the rank inside it
            of_cell = F.shiftright("_value", before).alias("_cell")
            left = join_groups(left.withColumn("_cell", of_cell), chosen.withColumnRenamed("_found", "_cell"), [*keys, "_cell"]).drop("_cell")
            counted = left.groupBy(*keys, cell.alias("_found"), "_rank").agg(F.sum("_rows").alias("_rows"))
            left = left.drop("_rank")
        else:
            counted = left.groupBy(*keys, cell.alias("_found")).agg(F.sum("_rows").alias("_rows"))
            counted = counted.withColumn("_rank", F.ceil(F.sum("_rows").over(Window.partitionBy(*keys)) / 2))
        upto = F.sum("_rows").over(Window.partitionBy(*keys).orderBy("_found").rowsBetween(Window.unboundedPreceding, 0))
        chosen = counted.withColumn("_upto", upto).where(
            (F.col("_upto") >= F.col("_rank")) & (F.col("_upto") - F.col("_rows") < F.col("_rank"))
        ).select(*keys, "_found", (F.col("_rank") - F.col("_upto") + F.col("_rows")).alias("_rank"))
        before = bits
    return chosen.select(*keys, (F.col("_found").cast("decimal(20,0)") / 100).cast("decimal(18,2)").alias(name))
