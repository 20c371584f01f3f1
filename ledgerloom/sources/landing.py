"""The provided parquet tables, and the frames the bronze bindings project from."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.scalars import dec, quarter_end

# Declared schemas: no footer-reading job per scan, and a changed file fails early.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
                "l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "labels": "doc_id bigint, quality int, toxic int",
    "pages": "page_id bigint, url string, html string",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}

MARKET_SLOTS = 10
CAPITAL_SLOTS = 4
FILING_SLOTS = 8
STRESS_SLOTS = 24


# A session may ask for the large landing tables to be dealt out by key before anything runs over them. That pays where
# a table lands in fewer row groups than there are cores, as in tests and benchmarks on one machine; a cluster that reads
# many files leaves the setting out and reads them as they are.
DEALT = "spark.ledgerloom.landing.partitions"
KEYS = {
    "customer": ("c_custkey",),
    "orders": ("o_orderkey",),
    "lineitem": ("l_orderkey", "l_linenumber"),
    "events": ("event_id",),
    "documents": ("doc_id",),
    "conversations": ("conv_id", "turn"),
}


STATUS = re.compile(r"path=([^;]+); isDirectory=(true|false); length=(\d+);.*?modification_time=(\d+)")


def landing_files(spark: SparkSession, path: str) -> list[tuple[str, str, str]]:
    """(name, length, modification time) of a file, or of all files under a folder. A missing path has none."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    system = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(root):
        return []
    found, folders = [], [root]
    while folders:
        # One call for a whole folder; its text has every file's name, length and time.
        for name, is_folder, length, changed in STATUS.findall(jvm.org.apache.commons.lang3.ArrayUtils.toString(system.listStatus(folders.pop()))):
            if is_folder == "true":
                folders.append(jvm.org.apache.hadoop.fs.Path(name))
            else:
                found.append((name, length, changed))
    return sorted(found)


def identity_of(spark: SparkSession, path: str) -> str:
    """Digest of the names, sizes and times of all landing files in a data directory."""
    files = [landing_files(spark, f"{path}/{name}.parquet") for name in SCHEMAS]
    return hashlib.sha256(repr(files).encode()).hexdigest()


class Landing:
    """Read access to one data directory."""

    def __init__(self, spark: SparkSession, path: str, dealt: bool = True):
        self.spark = spark
        self.path = path
        self.dealt = dealt
        self.identity = identity_of(spark, path)
        self._branch_count: int | None = None
        self._scans: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._scans:
            rows = self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.path}/{name}.parquet")
            parts = self.spark.conf.get(DEALT, None) if self.dealt else None
            self._scans[name] = rows.repartition(int(parts), *KEYS[name]) if parts and name in KEYS else rows
        return self._scans[name]

    @property
    def branch_count(self) -> int:
        """Size of the branch dimension; one footer-only count per data directory."""
        if self._branch_count is None:
            self._branch_count = self.table("supplier").count()
        return self._branch_count

    def source(self, name: str) -> DataFrame:
        build = getattr(self, f"_{name}", None)
        return build() if build else self.table(name)

    def _customer_feed(self) -> DataFrame:
        """Customers as landed: every fiftieth one also arrived a day earlier."""
        base = self.table("customer")
        resent = base.where(F.col("c_custkey") % 50 == 0)
        return base.withColumn("age_days", F.lit(0)).unionByName(resent.withColumn("age_days", F.lit(1)))

    def _order_lines(self) -> DataFrame:
        return self.table("lineitem").join(
            self.table("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")
        )

    def _branch_sites(self) -> DataFrame:
        nation = self.table("nation")
        region = self.table("region")
        return (
            self.table("supplier")
            .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
            .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        )

    def _market_days(self) -> DataFrame:
        """One row per quoted instrument slot and trading day, summed from the lines of that day."""
        return (
            self.table("lineitem")
            .groupBy(
                (F.col("l_suppkey") % MARKET_SLOTS).alias("slot"), F.col("l_shipdate").cast("date").alias("market_day")
            )
            .agg(
                dec(F.sum(dec("l_discount", 6, 12)), 6).alias("sum_discount"),
                dec(F.sum(dec("l_tax", 6, 12)), 6).alias("sum_tax"),
                dec(F.sum(dec("l_extendedprice"))).alias("turnover"),
                F.count(F.lit(1)).alias("line_count"),
            )
        )

    def _replies(self) -> DataFrame:
        """Assistant turns and documents as one stream of texts with a numeric key."""
        turns = self.table("conversations").where(F.col("role") == "assistant").select(
            F.concat(F.lit("C-"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"))
            .alias("reply_id"),
            (F.col("conv_id") * 7 + F.col("turn")).alias("k"), "text")
        documents = self.table("documents").select(
            F.concat(F.lit("D-"), F.col("doc_id").cast("string")).alias("reply_id"), F.col("doc_id").alias("k"), "text")
        return turns.unionByName(documents)

    def _quarters(self, slots: int) -> DataFrame:
        quarters = (
            self.table("orders")
            .groupBy(quarter_end("o_orderdate").alias("quarter_end"))
            .agg(dec(F.sum(dec("o_totalprice"))).alias("booked"), F.count(F.lit(1)).alias("order_count"))
        )
        return quarters.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))

    def _capital_quarters(self) -> DataFrame:
        return self._quarters(CAPITAL_SLOTS)

    def _filing_quarters(self) -> DataFrame:
        return self._quarters(FILING_SLOTS)

    def _stress_quarters(self) -> DataFrame:
        return self._quarters(STRESS_SLOTS)
