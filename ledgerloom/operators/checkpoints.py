"""Lineage cuts and scratch space in the folder the cluster names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def checkpoint_root(spark: SparkSession) -> str:
    """The shared checkpoint folder that the session names.

    A session on one machine (master `local…`, as in tests) gets a temporary folder where none is named. On a cluster
    that is an error: executors would write to their own disks.
    """
    context = spark.sparkContext
    named = spark.conf.get(SETTING, None) or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError(f"{SETTING} must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="ledgerloom-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Write `df` to the checkpoint folder and go on from there; survives lost executors."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for one run under the checkpoint folder."""
    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"
