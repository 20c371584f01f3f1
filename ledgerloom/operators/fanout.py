"""Side-by-side child joins without the row explosion.

A gold table that left-joins several independent children to one parent repeats
each child's rows once per combination of the other children. The totals of
such a join follow from each child's own totals:

    sum over the join of x (child c) = sum(x) of c  *  product over i != c of max(1, rows of i)

so every child is aggregated to the parent key first and only one row per key
and child is joined. Same numbers, and the work is linear in the children
instead of their product. With `repeat=False` the repetition factors are left
out, which gives the totals that count every child row once.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Arm:
    """One child, aggregated to one row per parent key.

    rows   column with the number of child rows of the key
    scaled additive measures (sums and counts), which the join repeats
    plain  measures the join leaves alone (distinct counts, extremes)
    """

    frame: DataFrame
    rows: str
    scaled: tuple[str, ...] = ()
    plain: tuple[str, ...] = ()


def at_least_one(rows: Column | str) -> Column:
    rows = F.col(rows) if isinstance(rows, str) else rows
    return F.greatest(F.coalesce(rows, F.lit(0)), F.lit(1))


def product(factors: list[Column]) -> Column:
    """Factors of hot keys multiply past 64 bits, so the product has 38 digits."""
    return reduce(lambda a, b: (a * b).cast("decimal(38,0)"), [f.cast("decimal(19,0)") for f in factors], F.lit(1).cast("decimal(38,0)"))


def _repeated(df: DataFrame, measure: str, factor: Column) -> Column:
    """A measure times its factor; counts stay counts."""
    value = F.col(measure) * factor
    return (value.cast("bigint") if df.schema[measure].dataType.typeName() in ("integer", "long") else value).alias(measure)


def side_by_side(
    parent: DataFrame, key: str, arms: list[Arm], *, repeat: bool = True, rows_as: str | None = None
) -> DataFrame:
    """Parent rows with the measures of every arm, as the side-by-side join would total them.

    `key` names the parent key and is the key column of every arm. `rows_as`
    adds the number of joined rows of each parent row.
    """
    joined = parent
    for arm in arms:
        joined = joined.join(arm.frame, key, "left")
    columns = [F.col(c) for c in parent.columns]
    for i, arm in enumerate(arms):
        factor = product([at_least_one(other.rows) for j, other in enumerate(arms) if j != i and repeat])
        columns += [_repeated(joined, c, factor) if repeat else F.col(c) for c in arm.scaled]
        columns += [F.col(c) for c in arm.plain]
        columns.append(F.coalesce(F.col(arm.rows), F.lit(0)).alias(arm.rows))
    if rows_as:
        factor = product([at_least_one(arm.rows) for arm in arms] if repeat else [])
        columns.append(factor.alias(rows_as))
    return joined.select(columns)


def left_join_many(parent: DataFrame, children: DataFrame, key: str) -> DataFrame:
    """Left join where one parent key may own very many children.

    AQE can split a hot key of an inner join but not the optional side of a
    left join, so the matches come from an inner join and the childless parents
    from an anti join.
    """
    matched = children.join(parent, key)
    alone = parent.join(children, key, "left_anti")
    return alone.unionByName(matched, allowMissingColumns=True)


def join_groups(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join of two aggregates over the same groups; NULL is a group like any other."""
    renamed = right.withColumnsRenamed({k: f"_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return left.join(renamed, same, how).drop(*[f"_{k}" for k in keys])
