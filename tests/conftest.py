from __future__ import annotations

import os

import duckdb
import pytest

from ledgerloom.config import session
from ledgerloom.sources.lake import Lake
from tests.support import TABLES

SMALL = os.environ.get("LEDGERLOOM_TEST_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    os.environ.setdefault("LEDGERLOOM_DRIVER_MEMORY", "8g")
    s = session("tests", master="local[8]", partitions=8)
    s.sparkContext.setLogLevel("ERROR")
    s.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    yield s
    s.stop()


@pytest.fixture(scope="session")
def lake(spark):
    return Lake(spark, SMALL)


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con
