"""Structured Streaming twins of the ingest and monitoring operators.

Every job runs with an available-now trigger: it processes what has arrived and
stops, and a later start with a folder it is given goes on from its checkpoint. Sinks
are parquet folders; a batch that is retried after a failure leaves the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.scalars import is_true, micros
from ledgerloom.operators.checkpoints import scratch
from ledgerloom.operators.latest import latest
from ledgerloom.sources.bindings import BINDINGS
from ledgerloom.sources.lake import Lake, project
from ledgerloom.sources.landing import SCHEMAS

LATENESS = "10 minutes"
VELOCITY_WINDOW = "1 hour"
VELOCITY_STEP = "10 minutes"
VELOCITY_LIMIT = 3
SESSION_GAP = "30 minutes"
LINE_TIES = ("l_partkey", "l_suppkey")
EVENT_TYPES = ("click", "error", "purchase", "signup", "view")


def _epoch() -> Column:
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")


def instant(c: str) -> Column:
    """Zone-free time as the UTC instant the watermark needs."""
    return F.timestamp_micros(micros(c))


def wall(c: str) -> Column:
    """Back from the instant to zone-free time."""
    seconds = F.unix_micros(c).cast("decimal(20,0)") * F.lit("0.000001").cast("decimal(7,6)")
    return _epoch() + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))


def arriving(lake: Lake, table: str, files_per_trigger: int | None = None) -> DataFrame:
    """A landing table as a stream, whether it lands as one file or as a folder of part files."""
    reader = lake.spark.readStream.schema(SCHEMAS[table])
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    path = lake.spark._jvm.org.apache.hadoop.fs.Path(f"{lake.landing.path}/{table}.parquet")
    if not path.getFileSystem(lake.spark._jsc.hadoopConfiguration()).exists(path):
        raise FileNotFoundError(f"no landing table at {path}")
    # A pattern that fits this name alone: the reader takes a pattern for a file, but no plain path to one.
    return reader.parquet(f"{lake.landing.path}/{table}.parque[t]")


def job_folder(lake: Lake, name: str, folder: str | None) -> str:
    """The folder of a job's state and rows: the one given, from which it resumes, or a new one for this run.

    The file source knows files by path alone. A new folder reads everything that lies there now, so a run without a
    folder never returns what an earlier one made of files that have been rewritten since.
    """
    return folder or scratch(lake.spark, f"streams/{name}")


def run_append(lake: Lake, rows: DataFrame, folder: str) -> DataFrame:
    """Run to the end of the input; the exactly-once parquet sink as a DataFrame.

    A later run with the same folder processes only files that came since, and adds their rows.
    """
    query = (
        rows.writeStream.format("parquet").outputMode("append").trigger(availableNow=True)
        .option("checkpointLocation", f"{folder}/state").start(f"{folder}/rows")
    )
    query.awaitTermination()
    return lake.spark.read.schema(rows.schema).parquet(f"{folder}/rows")


#: Delta rows for each row of the base at which a merge writes a new base.
COMPACT_AT = 1.0


class Merged:
    """A current table as a base and the deltas of the batches after it.

    A batch adds its newest rows as a delta, so it writes what it brings. When the deltas hold as many rows as the base, a
    new base is written from both; its size has doubled since the last one at most, so over all batches each row is
    rewritten a number of times that grows with the logarithm of the table. Folders carry the batch's number and are
    complete when their mark is there: a batch that is tried again writes the same folders from the same start.
    """

    def __init__(self, lake: Lake, folder: str, schema, newest: Callable[[DataFrame], DataFrame]):
        self.spark, self.folder, self.schema, self.newest = lake.spark, f"{folder}/current", schema, newest
        self.path = lake.spark._jvm.org.apache.hadoop.fs.Path
        self.files = self.path(self.folder).getFileSystem(lake.spark._jsc.hadoopConfiguration())

    def _complete(self, kind: str) -> list[int]:
        if not self.files.exists(self.path(self.folder)):
            return []
        names = [f.getPath().getName() for f in self.files.listStatus(self.path(self.folder))]
        return sorted(
            int(n.removeprefix(f"{kind}=")) for n in names
            if n.startswith(f"{kind}=") and self.files.exists(self.path(f"{self.folder}/{n}/_SUCCESS")))

    def parts(self, before: int | None = None) -> tuple[int | None, list[int]]:
        """The newest base below batch `before`, and the deltas after it."""
        bases = [v for v in self._complete("base") if before is None or v < before]
        base = bases[-1] if bases else None
        return base, [v for v in self._complete("delta") if (base is None or v > base) and (before is None or v < before)]

    def _rows(self, base: int | None, deltas: list[int]) -> DataFrame | None:
        paths = [f"{self.folder}/delta={v}" for v in deltas] + ([f"{self.folder}/base={base}"] if base is not None else [])
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else None

    def merge(self, batch: DataFrame, number: int) -> None:
        base, deltas = self.parts(before=number)
        names = [f.name for f in self.schema]
        self.newest(batch).select(names).write.mode("overwrite").parquet(f"{self.folder}/delta={number}")
        deltas.append(number)
        held = self._rows(base, []).count() if base is not None else 0  # footers only
        if self._rows(None, deltas).count() > COMPACT_AT * held and len(deltas) > 1:
            self.newest(self._rows(base, deltas)).select(names).write.mode("overwrite").parquet(f"{self.folder}/base={number}")
            # What the new base replaces stays until the next one, so a reader that began before it can end.
            for kind in ("base", "delta"):
                for old in self._complete(kind):
                    if base is not None and (old < base if kind == "base" else old <= base):
                        self.files.delete(self.path(f"{self.folder}/{kind}={old}"), True)

    def current(self) -> DataFrame:
        rows = self._rows(*self.parts())
        return self.spark.createDataFrame([], self.schema) if rows is None else self.newest(rows).select([f.name for f in self.schema])


def run_merge(lake: Lake, rows: DataFrame, folder: str, newest: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Run to the end of the input, merging every batch into one current table of the newest row per key."""
    table = Merged(lake, folder, rows.schema, newest)
    query = (
        rows.writeStream.outputMode("append").trigger(availableNow=True)
        .option("checkpointLocation", f"{folder}/state").foreachBatch(table.merge).start()
    )
    query.awaitTermination()
    return table.current()


def cdc_latest(lake: Lake, stream: DataFrame | None = None, folder: str | None = None) -> DataFrame:
    """Newest version of every order line of a change feed."""

    def newest(rows: DataFrame) -> DataFrame:
        return latest(rows, ["l_orderkey", "l_linenumber"], "l_shipdate", LINE_TIES)

    feed = stream if stream is not None else arriving(lake, "lineitem")
    return run_merge(lake, feed, job_folder(lake, "cdc", folder), newest)


def fraud_tumbling(lake: Lake, stream: DataFrame | None = None, folder: str | None = None) -> DataFrame:
    """Fraud alerts per day and type; a day is emitted once the watermark has passed it."""
    events = stream if stream is not None else arriving(lake, "events")
    alerts = project(BINDINGS["fraud_alerts"], events)
    counted = (
        alerts.select(instant("alert_date").alias("alert_date"), "alert_type", "loss_amount")
        .withWatermark("alert_date", LATENESS)
        .groupBy(F.window("alert_date", "1 day"), "alert_type")
        .agg(F.count(F.lit(1)).alias("alerts"), F.sum("loss_amount").alias("losses"))
        .select(wall("window.start").alias("day_start"), "alert_type", "alerts", "losses")
    )
    return run_append(lake, counted, job_folder(lake, "fraud-tumbling", folder))


def velocity_sliding(lake: Lake, stream: DataFrame | None = None, folder: str | None = None) -> DataFrame:
    """Users with many events inside any sliding hour."""
    events = stream if stream is not None else arriving(lake, "events")
    busy = (
        events.select(instant("ts").alias("ts"), "user_id", F.col("value").cast("decimal(18,2)").alias("value"))
        .withWatermark("ts", LATENESS)
        .groupBy(F.window("ts", VELOCITY_WINDOW, VELOCITY_STEP), "user_id")
        .agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("amount"))
        .where(F.col("events") >= VELOCITY_LIMIT)
        .select(wall("window.start").alias("window_start"), "user_id", "events", "amount")
    )
    return run_append(lake, busy, job_folder(lake, "velocity", folder))


def sessions(lake: Lake, stream: DataFrame | None = None, folder: str | None = None) -> DataFrame:
    """Sessions of activity per user, closed after half an hour of silence.

    The session setting of `config.session` merges a user's events inside each
    partition before the shuffle, so a very busy user arrives as sessions.
    """
    events = stream if stream is not None else arriving(lake, "events")
    closed = (
        events.select(instant("ts").alias("ts"), "user_id", "event_type").withWatermark("ts", LATENESS)
        .groupBy(F.session_window("ts", SESSION_GAP), "user_id")
        .agg(F.count(F.lit(1)).alias("events"), F.count_if(F.col("event_type") == "error").alias("errors"))
        .select(wall("session_window.start").alias("session_start"), wall("session_window.end").alias("session_end"),
                "user_id", "events", "errors")
    )
    return run_append(lake, closed, job_folder(lake, "sessions", folder))


def dq_monitor(lake: Lake, stream: DataFrame | None = None, folder: str | None = None) -> DataFrame:
    """Rule pass counts of the arriving events per day."""
    events = stream if stream is not None else arriving(lake, "events")
    rules = {
        "user_present": F.col("user_id").isNotNull(),
        "known_type": F.col("event_type").isin(*EVENT_TYPES),
        "value_in_range": F.col("value").between(0, 50),
        "props_readable": F.get_json_object("props", "$.k").isNotNull(),
    }
    monitored = (
        events.withColumn("ts", instant("ts")).withWatermark("ts", LATENESS).groupBy(F.window("ts", "1 day"))
        .agg(F.count(F.lit(1)).alias("rows_evaluated"), *[F.count_if(is_true(ok)).alias(n) for n, ok in rules.items()])
        .select(wall("window.start").alias("day_start"), "rows_evaluated", *rules)
    )
    return run_append(lake, monitored, job_folder(lake, "dq-monitor", folder))


STREAMS = {
    "st_cdc_latest": cdc_latest,
    "st_fraud_tumbling": fraud_tumbling,
    "st_velocity_sliding": velocity_sliding,
    "st_sessions": sessions,
    "st_dq_monitor": dq_monitor,
}
