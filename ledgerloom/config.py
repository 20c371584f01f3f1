"""Run-wide settings: the clock every query uses, and how sessions are configured."""

from __future__ import annotations

import os
from dataclasses import dataclass
from datetime import date, datetime

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Clock:
    """The wall clock of a run, fixed so that a rerun gives the same rows.

    The order book ends in 2001 and the event stream in January 2024, so each
    family of tables has its own "now".
    """

    book: datetime = datetime(2001, 8, 1)
    stream: datetime = datetime(2024, 1, 31)

    @property
    def book_day(self) -> date:
        return self.book.date()

    @property
    def stream_day(self) -> date:
        return self.stream.date()


CLOCK = Clock()

# Tables fed by the event stream; all other tables follow the order book.
STREAM_TABLES = {
    "atm_transactions",
    "audit_events",
    "card_transactions",
    "compliance_cases",
    "fraud_alerts",
}


def session(app: str = "ledgerloom", master: str | None = None, partitions: int | None = None) -> SparkSession:
    """A session with the settings the queries are planned for.

    On a cluster `master` and the number of shuffle partitions come from
    spark-submit; AQE then coalesces small partitions and splits skewed ones.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.parquet.filterPushdown", "true")
        .config("spark.sql.sources.partitionOverwriteMode", "dynamic")
        .config("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")
    )
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        builder = builder.config("spark.driver.memory", os.environ.get("LEDGERLOOM_DRIVER_MEMORY", "8g"))
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    if master and partitions:
        # On one machine a table is a file or two; see sources/landing.py.
        builder = builder.config("spark.ledgerloom.landing.partitions", str(partitions))
    return builder.getOrCreate()
