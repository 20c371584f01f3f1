"""SQL twins of the registered queries, for the checking engine."""

from __future__ import annotations

from ledgerloom.oracle import governance, quality, rollups, scoring, streams, workload
from ledgerloom.oracle.gold import DOUBLES, published
from ledgerloom.oracle.layers import SILVER, bronze_published, expand, silver_published
from ledgerloom.sources.bindings import BINDINGS

ORACLE: dict[str, str] = {}


def twin(name: str, sql: str) -> None:
    ORACLE[name] = expand(sql)


for _name in BINDINGS:
    twin(f"bronze_{_name}", bronze_published(_name))
for _name in SILVER:
    twin(f"silver_{_name}", silver_published(_name))

for _table in DOUBLES:
    twin(_table, published(_table))

for _module in (rollups, workload, quality, governance, scoring, streams):
    for _name, _sql in _module.QUERIES.items():
        twin(_name, _sql)
