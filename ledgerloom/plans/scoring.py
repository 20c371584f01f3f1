"""Agent analytics: event counts, tool calls, parsed lines, response scores and reports."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.scalars import dec, mean, ratio, ts_lit
from ledgerloom.scoring.metrics import (
    PASS_MARK,
    glossary_mentions,
    normalise_judge,
    score,
    table_mentions,
)
from ledgerloom.sources.bindings import AGENT_LINES, RESPONSES
from ledgerloom.sources.lake import Lake, bind

AGENTS = ("Basic", "Scaled", "KC")
METRICS = ("outcome", "table_selection", "data_in_response", "response_structure", "graceful_failure",
           "glossary_citation", "metadata_citation")
LINE_SCHEMA = (
    "content struct<parts: array<struct<function_call: struct<name: string, args: string>, "
    "function_response: struct<name: string, response: string>, text: string>>>"
)


def _last_day(lake: Lake) -> DataFrame:
    since = ts_lit(lake.clock.stream - timedelta(hours=24))
    return lake.raw("events").where(F.col("ts") > since)


def event_counts(lake: Lake) -> DataFrame:
    """Events and mean latency of the last day by type, most frequent first."""
    latency = F.get_json_object("props", "$.k").try_cast("decimal(18,4)")
    return _last_day(lake).groupBy("event_type").agg(
        F.count(F.lit(1)).alias("event_count"), mean(latency, 2).alias("avg_latency_ms")
    ).orderBy(F.col("event_count").desc(), "event_type")


def tool_calls(lake: Lake) -> DataFrame:
    """Completed tool calls of the last day per agent and tool; one scan for all three agents."""
    k = F.get_json_object("props", "$.k").try_cast("bigint")
    agent = F.element_at(F.array(*[F.lit(a) for a in AGENTS]), (F.col("user_id") % 3 + 1).cast("int"))
    return (
        _last_day(lake).where(F.col("event_type") == "click")
        .groupBy(agent.alias("agent"), F.concat(F.lit("tool_"), (k % 5).cast("string")).alias("tool_name"))
        .agg(F.count(F.lit(1)).alias("call_count")).orderBy("agent", F.col("call_count").desc(), "tool_name")
    )


def tool_pivot(lake: Lake) -> DataFrame:
    pivot = tool_calls(lake).groupBy("tool_name").pivot("agent", list(AGENTS)).agg(F.sum("call_count"))
    return pivot.na.fill(0)


def responses(lake: Lake) -> DataFrame:
    return bind(lake.landing, RESPONSES)


def scored(lake: Lake) -> DataFrame:
    return score(responses(lake))


def only(*columns: str):
    return lambda lake: scored(lake).select("response_id", *columns)


def joined(column: str):
    return F.array_join(column, ",").alias(column)


def table_mention_rows(lake: Lake) -> DataFrame:
    return scored(lake).select("response_id", joined("tables"), F.size("tables").cast("bigint").alias("n_tables"))


def glossary_mention_rows(lake: Lake) -> DataFrame:
    return scored(lake).select("response_id", joined("terms"), F.size("terms").cast("bigint").alias("n_terms"))


def metadata_rows(lake: Lake) -> DataFrame:
    return scored(lake).select("response_id", "metadata_citation", joined("found_metadata"))


def report(lake: Lake) -> DataFrame:
    """Mean of every metric over the responses it applies to, and of the latency, one column per agent."""
    applies = {"graceful_failure": F.col("expected_outcome") == "fail_gracefully", "glossary_citation": F.col("terms_expected"),
               "metadata_citation": F.col("metadata_expected")}
    values = F.array(*[
        F.struct(F.lit(m).alias("metric"), F.when(applies.get(m, F.lit(True)), F.col(m).cast("decimal(18,6)")).alias("value"))
        for m in (*METRICS, "latency_s")])
    long = scored(lake).select("agent", F.inline(values))
    averages = long.groupBy("agent", "metric").agg(mean("value", 4).cast("double").alias("mean"))
    return averages.groupBy("metric").pivot("agent", ["basic", "scaled", "kc"]).agg(F.first("mean"))


def report_by_complexity(lake: Lake) -> DataFrame:
    """Pass rate and symbol per complexity and agent."""
    value = dec("outcome", 4)
    grouped = scored(lake).groupBy("complexity", "agent").agg(
        F.count(F.lit(1)).alias("cases"), F.count_if(F.col("outcome") >= PASS_MARK).alias("passed"),
        mean(value, 4).cast("double").alias("avg_outcome"))
    return grouped.withColumns({
        "pass_rate": ratio("passed", "cases", 4),
        "symbol": F.when(F.col("avg_outcome") >= PASS_MARK, "+").when(F.col("avg_outcome") >= 0.4, "~").otherwise("-")})


def parse_events(lake: Lake) -> DataFrame:
    """Streamed agent lines as typed events; lines that are not JSON are skipped."""
    parsed = bind(lake.landing, AGENT_LINES).select("line_id", F.from_json("line", LINE_SCHEMA).alias("j"))
    parts = parsed.where(F.col("j.content.parts").isNotNull()).select(
        "line_id", F.posexplode("j.content.parts").alias("part_no", "p"))
    call, response, text = F.col("p.function_call"), F.col("p.function_response"), F.col("p.text")
    kind = F.when(call.isNotNull(), "tool_call").when(response.isNotNull(), "tool_response").when(
        text.isNotNull(), "text_chunk")
    body = F.lower(F.coalesce(
        call["args"], F.get_json_object(response["response"], "$.result"), response["response"], F.lit("")))
    typed = parts.select(
        "line_id", F.col("part_no").cast("bigint").alias("part_no"), kind.alias("type"),
        F.when(kind != "text_chunk", F.coalesce(call["name"], response["name"], F.lit(""))).alias("name"),
        F.when(kind == "text_chunk", text).alias("text"),
        F.when(kind != "text_chunk", F.array_join(table_mentions(body), ",")).alias("tables"),
        F.when(kind == "tool_response", F.array_join(glossary_mentions(body), ",")).alias("glossary_terms"))
    return typed.where(F.col("type").isNotNull())


def judge_scores(lake: Lake) -> DataFrame:
    """Judge scores brought to 0..1 and merged with the heuristic outcome of the same response."""
    judged = lake.raw("labels").select(
        F.concat(F.lit("D-"), F.col("doc_id").cast("string")).alias("response_id"),
        (F.col("quality") * 4 + F.col("doc_id") % 3 - F.col("toxic")).cast("double").alias("raw_score"))
    return judged.join(scored(lake).select("response_id", "agent", "case_no", "outcome"), "response_id").select(
        "response_id", "agent", "case_no", "raw_score", normalise_judge(F.col("raw_score")).alias("judge_score"),
        "outcome")


SCORING = {
    "ev_event_counts": event_counts,
    "ev_tool_calls": tool_calls,
    "ev_tool_pivot": tool_pivot,
    "ev_table_mentions": table_mention_rows,
    "ev_glossary_mentions": glossary_mention_rows,
    "ev_table_selection": only("table_selection"),
    "ev_graceful_failure": only("graceful_failure"),
    "ev_data_in_response": only("data_in_response"),
    "ev_glossary_citation": only("glossary_citation"),
    "ev_metadata_citation": metadata_rows,
    "ev_response_structure": only("agent", "response_structure"),
    "ev_outcome": only("expected_outcome", "outcome"),
    "ev_heuristic_score": only("agent", "heuristic_score"),
    "ev_report": report,
    "ev_report_complexity": report_by_complexity,
    "ev_parse_events": parse_events,
    "ev_judge_normalise": judge_scores,
}
