"""Quality rules as a bitmask ledger: every rule is evaluated once, policies are masks over the stored bits."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
WINDOW = 5

#: A rule's place is its bit; new rules go to the end, so that stored ledgers stay readable.
RULES: dict[str, Column | str] = {
    "few_words": "n_words < 10",
    "repeated_words": "100 * n_repeat_words > 20 * n_words",
    "symbols": "10 * n_symbols > word_chars",
    "repeated_lines": "10 * n_dup_lines > 3 * n_lines",
    "long_words": "word_chars > 15 * n_words",
    "short_words": "2 * word_chars < 3 * n_words",
    "same_words": "n_words >= 50 and 20 * n_distinct_words < n_words",
    "shouting": "n_letters >= 40 and 2 * n_upper > n_letters",
    "few_letters": "2 * n_letters < word_chars",
}
BIT = {name: 1 << k for k, name in enumerate(RULES)}


@dataclass(frozen=True)
class Policy:
    """A version of the decision: a document fails if one of the rules in `fatal` fails."""

    version: str
    fatal: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(BIT[name] for name in self.fatal)


BASE = Policy("base", ("few_words", "repeated_words"))
CURRENT = Policy("2", ("few_words", "repeated_words", "symbols", "repeated_lines", "same_words", "shouting", "few_letters"))


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and the measurements of every row of `docs`; all are 0 for a null text.

    n_repeat_words counts the words inside 5-word windows that stand twice or more in the text. Windows are compared by
    a 64-bit hash of their words, within one text only.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    split = docs.select(
        "doc_id", text.alias("text"), F.array_remove(F.split(text, GAP, -1), "").alias("w"),
        F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD)).alias("lines"))
    w = F.col("w")

    def window(i: Column) -> Column:
        return F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)])

    hashed = split.select(
        "doc_id",
        F.size(w).cast("long").alias("n_words"),
        F.length(F.regexp_replace("text", GAP, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.array_distinct(w)).cast("long").alias("n_distinct_words"),
        F.length(F.regexp_replace("text", r"[^\p{L}]+", "")).cast("long").alias("n_letters"),
        F.length(F.regexp_replace("text", r"[^\p{Lu}]+", "")).cast("long").alias("n_upper"),
        F.when(F.size(w) > WINDOW, F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), window)).otherwise(
            F.array().cast("array<bigint>")).alias("h"))
    h = F.col("h")
    # Only texts with a window that stands twice go on to sort their windows.
    placed = F.when(F.size(F.array_distinct(h)) < F.size(h), F.sort_array(
        F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))
    sorted_ = hashed.withColumn("s", placed).drop("h")
    s = F.col("s")
    twice = F.filter(s, lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"]))
    twice = F.sort_array(F.transform(twice, lambda x: x["i"]))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last"))
    covered = F.aggregate(
        twice, start, lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n"), i.alias("last")), lambda a: a["n"])
    return sorted_.withColumn("n_repeat_words", F.when(F.size(s) > 0, covered).otherwise(F.lit(0).cast("long"))).drop("s")


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements, and `failed`: the bits of the rules that each row of `docs` fails."""
    bits = [F.when(F.expr(rule), F.lit(BIT[name])).otherwise(F.lit(0)) for name, rule in RULES.items()]
    failed = bits[0]
    for b in bits[1:]:
        failed = failed.bitwiseOR(b)
    return measured(docs).withColumn("failed", failed.cast("long"))


def fails(policy: Policy) -> Column:
    return F.col("failed").bitwiseAND(F.lit(policy.mask)) != 0


def applied(entries: DataFrame, policy: Policy) -> DataFrame:
    """The ledger with `kept` under a policy; no text is read again."""
    return entries.withColumn("kept", ~fails(policy))


def ablations(entries: DataFrame, policy: Policy) -> DataFrame:
    """For each rule of a policy: rows that fail it, and rows that would be kept without it.

    Rows are first counted by their masked bits, so what comes together is one row for each combination of rules.
    """
    masked = F.col("failed").bitwiseAND(F.lit(policy.mask))
    combined = entries.groupBy(masked.alias("bits")).agg(F.count("*").alias("n"))
    rules = F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(BIT[name]).cast("long").alias("bit")) for name in policy.fatal])
    one = combined.select("bits", "n", F.explode(rules).alias("r")).where(F.col("bits").bitwiseAND(F.col("r.bit")) != 0)
    return one.groupBy("r.rule").agg(
        F.sum("n").alias("n_failed"), F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_only"))


def judged(docs: DataFrame, policy: Policy = CURRENT) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, failed of every row."""
    entries = applied(ledger(docs), policy)
    base_failed = fails(BASE)
    return entries.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed.alias("base_failed"), (~base_failed & F.col("kept")).alias("kept"), "failed")
