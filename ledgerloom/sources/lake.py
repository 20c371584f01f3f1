"""The lake: bronze, silver and gold tables of one data directory as lazy DataFrames.

Every table is a plan over the tables below it. `Lake.pin` puts a stored copy of
a table in front of its plan, which is how a full build reuses what an
earlier layer has already written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.config import CLOCK, STREAM_TABLES, Clock
from ledgerloom.sources.bindings import BINDINGS, Binding
from ledgerloom.sources.landing import Landing, identity_of


class Lake:
    def __init__(self, spark: SparkSession, path: str, clock: Clock = CLOCK, dealt: bool = True):
        self.spark = spark
        self.clock = clock
        self.landing = Landing(spark, path, dealt)
        self._tables: dict[str, DataFrame] = {}
        self.pinned: dict[str, DataFrame] = {}
        self._store = None
        self._undealt = None

    @property
    def identity(self) -> str:
        """The state of the landing files as this lake found them."""
        return self.landing.identity

    @property
    def stored(self):
        """The layers as stored tables, for queries that read many of them."""
        from ledgerloom.sources.store import LayerStore

        if self._store is None:
            self._store = LayerStore(self)
        return self._store

    @property
    def undealt(self) -> Lake:
        """The same tables over landing files as they lie: queries over very many tables keep all cores busy anyway."""
        if self._undealt is None:
            self._undealt = Lake(self.spark, self.landing.path, self.clock, dealt=False)
            for name, frame in self.pinned.items():
                self._undealt.pin(name, frame)
        return self._undealt

    def raw(self, name: str) -> DataFrame:
        return self.landing.table(name)

    def pin(self, name: str, frame: DataFrame) -> None:
        self._tables[name] = self.pinned[name] = frame
        self._store = self._undealt = None

    def once(self, name: str, build) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = build()
        return self._tables[name]

    def now_of(self, name: str):
        return self.clock.stream if name in STREAM_TABLES else self.clock.book

    def bronze(self, name: str) -> DataFrame:
        return self.once(f"bronze_{name}", lambda: bind(self.landing, BINDINGS[name]))

    def silver(self, name: str) -> DataFrame:
        from ledgerloom.plans.silver import refine

        return self.once(f"silver_{name}", lambda: refine(name, self.bronze(name), self.now_of(name)))

    def gold(self, name: str) -> DataFrame:
        from ledgerloom.plans.gold import GOLD

        return self.once(f"gold_{name}", lambda: GOLD[name](self))

    def __call__(self, table: str) -> DataFrame:
        """Table by full name, such as `silver_loans`."""
        layer, _, name = table.partition("_")
        return {"bronze": self.bronze, "silver": self.silver, "gold": self.gold}[layer](name)


def project(binding: Binding, frame: DataFrame, branches: int | None = None) -> DataFrame:
    """The columns of a binding over any frame with its source columns, streaming ones included."""
    if binding.where:
        frame = frame.where(binding.where)
    return frame.select([
        F.expr(e.format(ts="timestamp_ntz", branches=branches)).alias(c) for c, e in binding.columns.items()])


def bind(landing: Landing, binding: Binding) -> DataFrame:
    branches = landing.branch_count if any("{branches}" in e for e in binding.columns.values()) else None
    return project(binding, landing.source(binding.source), branches)


_LAKES: dict[tuple[str, int, str], Lake] = {}


def lake_for(spark: SparkSession, path: str) -> Lake:
    """The lake over a data directory as it is now; plans over landing files that have changed since are let go."""
    key = (spark.sparkContext.applicationId, id(spark), path)
    if key not in _LAKES or _LAKES[key].identity != identity_of(spark, path):
        _LAKES[key] = Lake(spark, path)
    return _LAKES[key]
