"""Layers stored once for each state of the landing files, shared by the queries that read many tables."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from importlib import resources

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.operators.checkpoints import checkpoint_root
from ledgerloom.sources.lake import Lake

#: Tables that are written at the same time; the scheduler shares the executors among their jobs.
WRITERS = 8


def code_digest() -> str:
    """Digest of this package's source: layers written by other code are not read."""
    digest = hashlib.sha256()

    def add(folder) -> None:
        for entry in sorted(folder.iterdir(), key=lambda e: e.name):
            if entry.is_dir() and not entry.name.startswith("__"):
                add(entry)
            elif entry.name.endswith(".py"):
                digest.update(entry.read_bytes())

    add(resources.files("ledgerloom"))
    return digest.hexdigest()


class Files:
    """Small files and folders beside the tables, wherever Spark keeps them."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm = spark._jvm
        self.system = self.path(root).getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def read(self, name: str) -> str | None:
        if not self.system.exists(self.path(name)):
            return None
        stream = self.system.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Write a file that must be new; False if it is there already."""
        try:
            stream = self.system.create(self.path(name), False)
        except Exception as error:
            if self.system.exists(self.path(name)):
                return False
            raise error
        stream.write(bytearray(text.encode()))
        stream.close()
        return True


class LayerStore:
    """Tables under a folder named after the landing files (names, sizes, times), the clock and the code.

    A table is written to a folder of its own, then entered in a small file that is created once, so of two sessions that
    write the same table the first entry counts, and a broken write is never read. Layers are planned over what is stored
    below them. Changed landing files give another folder; nothing is ever read from an older one.

    Tables that the lake has pinned are taken as they are. What follows from them is this lake's own matter, so a lake with
    pinned tables gets a folder that no other shares.
    """

    def __init__(self, lake: Lake):
        self.spark = lake.spark
        state = f"{lake.identity} {lake.clock} {code_digest()}"
        digest = uuid.uuid4().hex if lake.pinned else hashlib.sha256(state.encode()).hexdigest()[:24]
        self.root = f"{checkpoint_root(lake.spark)}/layers/{digest}"
        self.files = Files(lake.spark, self.root)
        # Tables are written side by side, so landing files needn't be dealt out to fill the cores of one machine.
        self.lake = Lake(lake.spark, lake.landing.path, lake.clock, dealt=False)
        self.pinned = dict(lake.pinned)
        for name, frame in self.pinned.items():
            self.lake.pin(name, frame)
        self._entries: dict[str, dict] = {}
        self._frames: dict[str, DataFrame] = {}

    def _entry(self, name: str) -> dict | None:
        if name not in self._entries:
            text = self.files.read(f"{self.root}/{name}.json")
            if text is None:
                return None
            self._entries[name] = json.loads(text)
        return self._entries[name]

    def keep(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """The stored result of `build`, written now if it isn't stored yet."""
        if name not in self._frames:
            self._frames[name] = self._read_or_write(name, build)
        return self._frames[name]

    def _read_or_write(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        entry = self._entry(name)
        if entry is None:
            rows = build()
            path = f"{self.root}/data/table={name}/run={uuid.uuid4().hex}"
            rows.write.parquet(path)
            self.files.create(f"{self.root}/{name}.json", json.dumps({"path": path, "schema": rows.schema.jsonValue()}))
            entry = self._entry(name)
        return self.spark.read.schema(T.StructType.fromJson(entry["schema"])).parquet(entry["path"])

    def keep_all(self, builds: dict[str, Callable[[], DataFrame]]) -> dict[str, DataFrame]:
        with ThreadPoolExecutor(WRITERS) as pool:
            return dict(zip(builds, pool.map(lambda name: self.keep(name, builds[name]), builds)))

    def tables(self, names: Iterable[str]) -> dict[str, DataFrame]:
        """Stored layer tables by full name; layers below them are stored first."""
        names = list(names)
        found = {n: self.pinned[n] for n in names if n in self.pinned}
        for layer in ("bronze", "silver", "gold"):
            wanted = [n for n in names if n.startswith(f"{layer}_") and n not in found]
            found |= self.keep_all({n: (lambda n=n: self.lake(n)) for n in wanted})
            for n in wanted:
                self.lake.pin(n, found[n])
        return {n: found[n] for n in names}

    def __call__(self, name: str) -> DataFrame:
        return self.tables([name])[name]

    def footers(self, names: Iterable[str]) -> DataFrame:
        """(table_name, row_count) of the stored tables that have rows, from the footers of all their files in one scan.

        The count is pushed into the file source, which answers it without reading a page; that takes the second version
        of the source and a setting, so the frame belongs to a session of its own.
        """
        session = self.spark.newSession()
        session.conf.set("spark.sql.sources.useV1SourceList", "")
        session.conf.set("spark.sql.parquet.aggregatePushdown", "true")
        files = session.read.option("basePath", f"{self.root}/data").schema("table string, run string").parquet(
            *[self._entry(n)["path"] for n in names])
        return files.groupBy("table", "run").count().select(F.col("table").alias("table_name"), F.col("count").alias("row_count"))

    def row_counts(self, names: Iterable[str]) -> DataFrame:
        """(table_name, row_count) of every named table: one row a table, so the counts pass through the driver."""
        names = list(names)
        self.tables(names)
        found = {n: self.pinned[n].count() for n in names if n in self.pinned}
        if written := [n for n in names if n not in found]:
            found |= {r["table_name"]: r["row_count"] for r in self.footers(written).collect()}
        return self.spark.createDataFrame([(n, found.get(n, 0)) for n in names], "table_name string, row_count long")
