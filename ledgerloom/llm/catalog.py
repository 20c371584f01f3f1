"""The registered queries of the text operators and the SQL twins of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm import (
    decontaminate, divergence, license_scan, mixing, neighbours, prefix_tree, quality_model, quality_rules, secret_scan, simhash,
    token_counts, toxicity, url_filter)
from ledgerloom.llm.oracle import ORACLE  # noqa: F401
from ledgerloom.llm.support import read

Query = Callable[[SparkSession, str], DataFrame]


def _documents(operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: operator(read(spark, sf_dir, "documents"))


def _with(table: str, operator: Callable[[DataFrame, DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: operator(read(spark, sf_dir, "documents"), read(spark, sf_dir, table))


QUERIES: dict[str, Query] = {
    "op1_token_counts": _documents(token_counts.document_tokens),
    "op2_decontaminate": _with("benchmark", decontaminate.report),
    "op3_mix_sources": _documents(mixing.mix),
    "op4_url_filter": lambda spark, sf_dir: url_filter.judged(read(spark, sf_dir, "pages")),
    "op5_quality_model": _with("labels", quality_model.quality),
    "op6_license_scan": _documents(license_scan.licenses),
    "op7_quality_rules": _documents(quality_rules.judged),
    "op8_toxicity": _with("labels", toxicity.toxicity),
    "op9_simhash": _documents(simhash.near_duplicates),
    "op10_secret_scan": _documents(secret_scan.secrets),
    "op11_neighbours": lambda spark, sf_dir: neighbours.nearest(read(spark, sf_dir, "embeddings")),
    "op12_divergence": _documents(divergence.audit),
    "op13_prefix_tree": lambda spark, sf_dir: prefix_tree.trie(read(spark, sf_dir, "conversations")),
}
