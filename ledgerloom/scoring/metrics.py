"""Heuristic scores of a response, all as built-in column expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.scalars import round_to
from ledgerloom.scoring.lexicon import (
    CATALOG_MARKERS,
    CONTEXT_MARKERS,
    DOLLARS,
    FAILURE_MARKERS,
    GLOSSARY_KEYWORDS,
    LONG_NUMBER,
    MENTIONED_TERMS,
    METADATA_PATTERNS,
    PERCENTAGES,
    PROBLEM_MARKERS,
    SECTIONS,
    TABLE_NAMES,
    TABLE_PREFIXES,
    expectations,
)

SUBSTANCE_CHARS = 200
PASS_MARK = 0.8


def has_any(text: Column, words: Iterable[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def score2(value: Column) -> Column:
    return round_to(value, 2).cast("double")


def strings(values: Iterable[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def named(found: dict[str, Column]) -> Column:
    """Names whose condition holds, in the order given."""
    return F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in found.items()])).cast("array<string>")


def table_mentions(text: Column) -> Column:
    """Known table names inside a lower-cased text. Texts without any layer prefix skip the list."""
    listed = F.filter(strings(TABLE_NAMES), lambda t: F.contains(text, t))
    return F.when(has_any(text, TABLE_PREFIXES), listed).otherwise(strings(()))


def glossary_mentions(text: Column) -> Column:
    """Distinct business terms whose keywords occur in a lower-cased text, sorted."""
    hits = F.array(*[
        F.when(F.contains(text, F.lit(word)), strings(terms)).otherwise(strings(()))
        for word, terms in MENTIONED_TERMS.items()])
    return F.array_sort(F.array_distinct(F.flatten(hits)))


def table_selection(queried: Column, right: Column, wrong: Column) -> Column:
    n = F.size(right)
    hits = F.size(F.array_intersect(right, queried)).cast("double")
    coverage = F.when(n > 0, F.least(F.lit(1.0), hits / F.greatest(F.lit(1), F.least(n, F.lit(2))))).otherwise(1.0)
    penalty = F.size(F.array_intersect(wrong, queried)) * F.lit(0.3)
    return (
        F.when((n == 0) & (F.size(wrong) == 0), 1.0).when(F.size(queried) == 0, 0.0)
        .otherwise(score2(F.greatest(F.lit(0.0), coverage - penalty)))
    )


def graceful_failure(text: Column, raw: Column) -> Column:
    return F.when(has_any(text, FAILURE_MARKERS), 1.0).when(
        F.contains(text, F.lit("error")) & (F.length(raw) < SUBSTANCE_CHARS), 0.3).otherwise(0.0)


def data_signals(raw: Column) -> Column:
    signs = [
        raw.rlike(DOLLARS), raw.rlike(PERCENTAGES),
        F.contains(raw, F.lit("|")) & F.contains(raw, F.lit("---")), raw.rlike(LONG_NUMBER)]
    out = F.lit(0)
    for s in signs:
        out = out + s.cast("int")
    return score2(F.least(F.lit(1.0), out / F.lit(2.0)))


def glossary_citation(text: Column, expected: Column) -> Column:
    known = named({term: has_any(text, words) for term, words in GLOSSARY_KEYWORDS.items()})
    cited = F.filter(expected, lambda t: F.when(
        t.isin(*GLOSSARY_KEYWORDS), F.array_contains(known, t)).otherwise(F.contains(text, F.lower(t))))
    return F.when(F.size(expected) == 0, 1.0).otherwise(
        score2(F.size(cited).cast("double") / F.greatest(F.size(expected), F.lit(1))))


def metadata_types(text: Column) -> Column:
    """Kinds of metadata a text cites. Plain words are searched as text; only real patterns use a regex."""
    found = {}
    for kind, patterns in METADATA_PATTERNS.items():
        cited = has_any(text, [p for p in patterns if "*" not in p])
        for p in patterns:
            if "*" in p:
                cited = cited | text.rlike(p)
        found[kind] = cited
    return named(found)


def metadata_citation(found: Column, expected: Column) -> Column:
    hits = F.size(F.array_intersect(found, expected)).cast("double")
    return F.when(F.size(expected) > 0, score2(hits / F.greatest(F.size(expected), F.lit(1)))).otherwise(
        score2(F.least(F.lit(1.0), F.size(found) / F.lit(2.0))))


def response_structure(raw: Column, agent: Column, data: Column) -> Column:
    sections = F.lit(0)
    for pattern in SECTIONS:
        sections = sections + raw.rlike(pattern).cast("int")
    substance = F.length(raw) > SUBSTANCE_CHARS
    plain = F.when(substance & (data > 0), 1.0).when(substance, 0.5).otherwise(0.0)
    return F.when(agent == "kc", score2(sections / F.lit(float(len(SECTIONS))))).otherwise(plain)


def outcome(kind: Column, data: Column, tables: Column, wrong_hit: Column, failure: Column) -> Column:
    """Decision table by expected outcome."""
    has_data = data > 0
    partial = F.when(wrong_hit, 0.3).when(has_data & (tables >= 0.5), 0.7).when(has_data, 0.5).otherwise(0.2)
    success = (
        F.when(has_data & (tables >= 0.8), 1.0).when(has_data & (tables >= 0.5), 0.8).when(has_data, 0.5).otherwise(0.2))
    return F.when(kind == "fail_gracefully", failure).when(kind == "partial", partial).otherwise(success)


def heuristic(text: Column, agent: Column, expected: Column) -> Column:
    """Points out of a hundred: right table, context, catalog citations, no error."""
    table = F.exists(expected, lambda t: F.contains(text, t))
    markers = F.lit(0)
    for m in CATALOG_MARKERS:
        markers = markers + F.contains(text, F.lit(m)).cast("int")
    points = (
        F.when(table, 30).otherwise(0)
        + F.when(has_any(text, CONTEXT_MARKERS), 20).otherwise(0)
        + F.when(agent == "kc", F.least(markers * 10, F.lit(50))).otherwise(0)
        + F.when(~has_any(text, PROBLEM_MARKERS), 10).otherwise(0))
    return F.least(points, F.lit(100)).cast("bigint")


def case_table(spark: SparkSession) -> DataFrame:
    rows = [(no, agent, kind, outcome_, *map(list, lists)) for no, agent, kind, outcome_, *lists in expectations()]
    return spark.createDataFrame(
        rows, "case_no bigint, agent string, complexity string, expected_outcome string, right_tables array<string>, "
              "wrong_tables array<string>, expected_terms array<string>, expected_metadata array<string>")


def score(responses: DataFrame) -> DataFrame:
    """Every score of every response, in one projection after joining the expectations of each case and agent."""
    raw, text, agent = F.col("response_text"), F.col("text_lower"), F.col("agent")
    base = (
        responses.join(F.broadcast(case_table(responses.sparkSession)), ["case_no", "agent"])
        .withColumn("text_lower", F.lower("response_text"))
        .withColumns({"tables": table_mentions(text), "found_metadata": metadata_types(text),
                      "data_in_response": data_signals(raw), "graceful_failure": graceful_failure(text, raw)})
        .withColumn("table_selection", table_selection(F.col("tables"), F.col("right_tables"), F.col("wrong_tables")))
    )
    wrong_hit = F.size(F.array_intersect("wrong_tables", "tables")) > 0
    return base.select(
        "response_id", "agent", "case_no", "complexity", "expected_outcome", "latency_s", "tables", "found_metadata",
        "table_selection", "graceful_failure", "data_in_response",
        glossary_citation(text, F.col("expected_terms")).alias("glossary_citation"),
        metadata_citation(F.col("found_metadata"), F.col("expected_metadata")).alias("metadata_citation"),
        response_structure(raw, agent, F.col("data_in_response")).alias("response_structure"),
        outcome(F.col("expected_outcome"), F.col("data_in_response"), F.col("table_selection"), wrong_hit,
                F.col("graceful_failure")).alias("outcome"),
        heuristic(text, agent, F.col("right_tables")).alias("heuristic_score"),
        glossary_mentions(text).alias("terms"),
        # What a report averages: a citation only where one is expected, a failure only where failing is right.
        (F.size("expected_terms") > 0).alias("terms_expected"), (F.size("expected_metadata") > 0).alias("metadata_expected"),
    )


def normalise_judge(raw: Column) -> Column:
    """A judge's 1..5 as 0..1, clamped."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score2((raw - 1.0) / 4.0)))
