"""Stored layers: one database per layer, parquet tables in a folder the caller names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators.aligned import align

CORRUPT = "_corrupt_line"


class Warehouse:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def name(self, layer: str, table: str) -> str:
        return f"{layer}.{table}"

    def read(self, layer: str, table: str) -> DataFrame:
        return self.spark.table(self.name(layer, table))

    def replace(self, layer: str, table: str, rows: DataFrame, partition_by: str | None = None) -> DataFrame:
        """Create or replace the table with its schema."""
        self.spark.sql(f"CREATE DATABASE IF NOT EXISTS `{layer}`")
        writer = rows.write.mode("overwrite").format("parquet").option("path", f"{self.root}/{layer}/{table}")
        if partition_by:
            writer = writer.partitionBy(partition_by)
        writer.saveAsTable(self.name(layer, table))
        return self.read(layer, table)

    def refresh(self, layer: str, table: str, rows: DataFrame) -> DataFrame:
        """New rows under the stored schema; column comments and views on the table stay."""
        target = self.read(layer, table)
        (align(rows, target).write.option("partitionOverwriteMode", "static")
         .insertInto(self.name(layer, table), overwrite=True))
        return self.read(layer, table)

    def append(self, layer: str, table: str, rows: DataFrame) -> DataFrame:
        """Add rows that may carry only some of the columns."""
        align(rows, self.read(layer, table)).write.insertInto(self.name(layer, table))
        return self.read(layer, table)

    def view(self, name: str, rows: DataFrame) -> None:
        rows.createOrReplaceTempView(name)


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; lines that cannot be decoded are skipped."""
    lines = (
        spark.read.schema(f"{schema}, {CORRUPT} string").option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT).json(path)
    )
    return lines.where(F.col(CORRUPT).isNull()).drop(CORRUPT)


def write_json_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)
