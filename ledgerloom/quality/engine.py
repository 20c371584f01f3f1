"""Rule evaluation: all rules of a table in one aggregate pass."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.scalars import or_zero, round_to, safe_div
from ledgerloom.quality.rules import Rule, passes


def _failed(rule: Rule, today: date) -> Column:
    if rule.kind == "unique":
        # Rows beyond the first of each value. Spark shuffles on the value itself, so no value is gathered.
        return F.count(rule.column) - F.countDistinct(rule.column)
    if rule.kind == "table":
        return F.when(rule.ok(today), F.lit(0).cast("bigint")).otherwise(F.count(F.lit(1)))
    return F.count_if(~passes(rule, today))


def evaluate(df: DataFrame, dataset: str, table: str, rules: Sequence[Rule], today: date) -> DataFrame:
    """One result row per rule: rows evaluated, rows failed, pass rate in percent and verdict."""
    measured = df.agg(F.count(F.lit(1)).alias("rows_evaluated"),
                      *[_failed(r, today).cast("bigint").alias(f"f{i}") for i, r in enumerate(rules)],
                      *[rules[i].ok(today).alias(f"t{i}") for i in range(len(rules)) if rules[i].kind == "table"])

    def result(i: int, r: Rule) -> Column:
        share = safe_div(F.col("rows_evaluated") - F.col(f"f{i}"), "rows_evaluated")
        verdict = F.col(f"t{i}") if r.kind == "table" else F.coalesce(share >= r.threshold, F.lit(True))
        return F.struct(
            F.lit(dataset).alias("dataset"), F.lit(table).alias("table_name"), F.lit(r.name).alias("rule_name"),
            F.lit(r.dimension).alias("dimension"), F.lit(r.column).cast("string").alias("column_name"),
            round_to(share * 100, 4).alias("pass_rate"), F.col("rows_evaluated"), F.col(f"f{i}").alias("rows_failed"),
            F.lit(float(r.threshold)).alias("threshold"), verdict.alias("passed"),
            F.lit(r.term).cast("string").alias("term"))

    return measured.select(F.inline(F.array(*[result(i, r) for i, r in enumerate(rules)])))


def tag_failures(df: DataFrame, rules: Sequence[Rule], today: date) -> DataFrame:
    """Add `failed_rules`: names of the row rules each row fails."""
    names = [F.when(~passes(r, today), F.lit(r.name)) for r in rules if r.kind == "row"]
    return df.withColumn("failed_rules", F.array_compact(F.array(*names)))


def quarantine(df: DataFrame, rules: Sequence[Rule], today: date) -> tuple[DataFrame, DataFrame]:
    """Rows that pass every row rule, and the rest with the names of the rules they fail."""
    tagged = tag_failures(df, rules, today)
    bad = F.size("failed_rules") > 0
    return tagged.where(~bad).drop("failed_rules"), tagged.where(bad)


def compare_runs(before: DataFrame, after: DataFrame) -> DataFrame:
    """Change of every rule between two runs; both sides are one row per rule."""
    keys = ["table_name", "rule_name"]
    left = before.select(*keys, F.col("pass_rate").alias("before"), F.col("rows_failed").alias("failed_before"))
    right = after.select(*keys, F.col("pass_rate").alias("after"), F.col("rows_failed").alias("failed_after"))
    return left.join(right, keys, "full").select(
        *keys, "before", "after", (F.col("after") - F.col("before")).alias("delta"),
        (or_zero("failed_after") - or_zero("failed_before")).alias("new_failures"))
