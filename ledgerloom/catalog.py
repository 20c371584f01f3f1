"""The query catalog: one named entry per operator, each a function of (spark, data directory)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.functions.scalars import publish
from ledgerloom.plans.gold import GOLD, VARIANTS
from ledgerloom.plans.governance import GOVERNANCE
from ledgerloom.plans.quality import QUALITY
from ledgerloom.plans.reference import REFERENCE
from ledgerloom.plans.scoring import SCORING
from ledgerloom.plans.silver import SILVER
from ledgerloom.plans.snapshots import SNAPSHOTS
from ledgerloom.plans.staging import STAGING
from ledgerloom.plans.views import VIEWS
from ledgerloom.plans.workload import BUSINESS, WORKLOAD
from ledgerloom.streaming.jobs import STREAMS
from ledgerloom.sources.bindings import BINDINGS
from ledgerloom.sources.lake import Lake, lake_for

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def register(name: str, plan: Callable[[Lake], DataFrame]) -> None:
    QUERIES[name] = lambda spark, sf_dir: publish(plan(lake_for(spark, sf_dir)))


for _name in BINDINGS:
    register(f"bronze_{_name}", lambda lake, n=_name: lake.bronze(n))
for _name in SILVER:
    register(f"silver_{_name}", lambda lake, n=_name: lake.silver(n))

for _name in GOLD:
    register(f"gold_{_name}", lambda lake, n=_name: lake.gold(n))
for _name, _plan in VARIANTS.items():
    register(f"gold_{_name}", _plan)

for _group in (VIEWS, REFERENCE, STAGING, SNAPSHOTS, WORKLOAD, BUSINESS, QUALITY, GOVERNANCE, SCORING, STREAMS):
    for _name, _plan in _group.items():
        register(_name, _plan)
