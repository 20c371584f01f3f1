"""Secret scans: patterns for known forms, and two character Markov models compared by log-likelihood ratio."""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.support import let, starts_of

#: The base patterns. A run that is too short for `access` or `hex` can't hold a longer one, so their
#: length stands in the pattern; an assignment is found first, and dropped after if its value is short.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
ASSIGNED = 6
BASE = f"{ASSIGN}|{ACCESS}|{HEX}"
#: What the models judge: runs of the characters of keys and identifiers that no base pattern takes (group 3).
CANDIDATE = f"{BASE}|([A-Za-z0-9+/_-]{{16,}})"
LONG_RUN = r"[A-Za-z0-9+/_-]{16,}"
KINDS = ("assign", "access", "hex", "markov")
#: Mean log-likelihood ratio of a transition from which a run counts as random.
RATIO = 1.0
#: Documents that the models are fitted on, about: for values of secrets, and for ordinary words.
SECRET_ROWS, WORD_ROWS = 50_000, 2_000
#: Lengths of values that teach what random strings look like.
VALUE = 16
#: Printable characters of the models from this code on, and the weight of the prior of each row of transitions.
FIRST, SYMBOLS, PRIOR = 0x21, 94, 16.0
UNIT = 1_000
EMPTY = "array<struct<start:bigint,kind:int,end:bigint,value:string>>"


def matches(text: Column, pattern: str, kind: str, group: int = 0) -> Column:
    """The leftmost non-overlapping matches as structs (start, kind, end, value): characters, end exclusive, and a group.

    Matches and the pieces between them alternate, so running sums of their lengths give the places.
    """
    whole, value = (F.regexp_extract_all(text, F.lit(pattern), F.lit(g)) for g in (0, group))
    pairs = F.zip_with(whole, value, lambda m, v: F.struct(F.length(m).cast("long").alias("m"), v.alias("v")))
    rows = F.filter(
        F.zip_with(pairs, F.split(text, pattern, -1), lambda p, gap: F.struct(p.alias("p"), F.length(gap).cast("long").alias("gap"))),
        lambda r: r["p"].isNotNull())
    placed = let(rows, lambda a: F.zip_with(starts_of(F.transform(a, lambda r: r["gap"] + r["p"]["m"])), a, lambda s, r: F.struct(
        (s + r["gap"]).alias("start"), F.lit(KINDS.index(kind)).alias("kind"), (s + r["gap"] + r["p"]["m"]).alias("end"), r["p"]["v"].alias("value"))))
    return F.when(text.rlike(pattern), placed).otherwise(F.array().cast(EMPTY))


def written(found: Column) -> Column:
    """kind:start:end of spans, by start and then kind, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.sort_array(found), lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _share(docs: DataFrame, rows: int, total: int) -> DataFrame:
    """About `rows` of `total` rows, by a hash of id and text, so that a rerun takes the same."""
    parts = 1_000_000
    part = min(parts, math.ceil(rows / max(total, 1) * parts))
    return docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts)) < part)


def _transitions(values: DataFrame) -> dict[tuple[int, int], int]:
    """Counts of neighbouring characters in distinct values; at most 94 * 94 rows come to the driver."""
    codes = F.transform(F.split("value", ""), lambda c: F.ascii(c) - FIRST)
    pairs = let(codes, lambda a: F.zip_with(F.slice(a, 1, F.size(a) - 1), F.slice(a, 2, F.size(a)), lambda x, y: F.struct(x.alias("x"), y.alias("y"))))
    counted = values.distinct().where(F.length("value") > 1).select(F.explode(pairs).alias("p")).groupBy("p.x", "p.y").agg(F.count("*").alias("n"))
    return {(r["x"], r["y"]): r["n"] for r in counted.where(f"x between 0 and {SYMBOLS - 1} and y between 0 and {SYMBOLS - 1}").collect()}


def _probabilities(counts: dict[tuple[int, int], int], prior: list[float]) -> list[list[float]]:
    totals = Counter()
    for (x, _), n in counts.items():
        totals[x] += n
    return [[(counts.get((x, y), 0) + PRIOR * prior[y]) / (totals[x] + PRIOR) for y in range(SYMBOLS)] for x in range(SYMBOLS)]


def fit(docs: DataFrame, secret_rows: int = SECRET_ROWS, word_rows: int = WORD_ROWS) -> list[int]:
    """Log-likelihood ratios of all transitions, random over ordinary, in thousandths, row by row.

    The labelled samples come from the base patterns: values that they find are random strings, words outside of them
    are ordinary identifiers. Random transitions fall back on equal shares of the characters that keys are made of,
    ordinary ones on how common a character is. Without any rows both models are their fallbacks.
    """
    rows = docs.where(F.col("text").isNotNull()).select("doc_id", "text")
    total = rows.count()
    text = F.col("text")
    values = _share(rows, secret_rows, total).where(text.rlike(BASE)).select(F.explode(F.concat(
        F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2)), F.regexp_extract_all(text, F.lit(ACCESS), F.lit(0)),
        F.regexp_extract_all(text, F.lit(HEX), F.lit(0)))).alias("value")).where(F.length("value") >= VALUE)
    words = _share(rows, word_rows, total).select(F.explode(F.regexp_extract_all(
        F.regexp_replace(text, BASE, " "), F.lit(r"[A-Za-z0-9+/_-]+"), F.lit(0))).alias("value"))
    random, ordinary = _transitions(values), _transitions(words)
    key = {ord(c) - FIRST for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"}
    common = Counter()
    for (_, y), n in ordinary.items():
        common[y] += n
    met = sum(common.values())
    fallback = [(common[y] + 0.5) / (met + 0.5 * SYMBOLS) for y in range(SYMBOLS)]
    equal = [1 / len(key) if y in key else 1e-6 for y in range(SYMBOLS)]
    p, q = _probabilities(random, equal), _probabilities(ordinary, fallback)
    return [round(UNIT * math.log(p[x][y] / q[x][y])) for x in range(SYMBOLS) for y in range(SYMBOLS)]


def ratio(value: Column, model: list[int]) -> Column:
    """Mean log-likelihood ratio of the transitions of a run of at least two characters."""
    table = F.expr(f"cast(split('{','.join(map(str, model))}', ',') as array<int>)")
    start = F.struct(F.lit(-1).alias("last"), F.lit(0).cast("long").alias("sum"))
    summed = F.aggregate(F.split(value, ""), start, lambda a, c: F.struct(
        (F.ascii(c) - FIRST).alias("last"),
        F.when(a["last"] < 0, a["sum"]).otherwise(a["sum"] + F.get(table, a["last"] * SYMBOLS + F.ascii(c) - FIRST)).alias("sum")), lambda a: a["sum"])
    return summed / (F.length(value) - 1) / UNIT


def scanned(docs: DataFrame, model: list[int], threshold: float = RATIO) -> DataFrame:
    """All columns of `docs` in a struct `row`, beside arrays of spans: assign, access, hex, markov."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), text.alias("text"))
    text = F.col("text")
    runs = F.when(text.rlike(LONG_RUN), F.filter(
        matches(text, CANDIDATE, "markov", 3), lambda s: (F.length(s["value"]) > 0) & (ratio(s["value"], model) >= threshold)))
    return rows.select(
        "row", F.filter(matches(text, ASSIGN, "assign", 2), lambda s: F.length(s["value"]) >= ASSIGNED).alias("assign"),
        matches(text, ACCESS, "access").alias("access"), matches(text, HEX, "hex").alias("hex"),
        F.coalesce(runs, F.array().cast(EMPTY)).alias("markov"))


def secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every row of `docs`.

    `spans` holds the base spans and those of kind markov: runs that no base pattern takes, and that are likelier as
    random strings than as ordinary identifiers. A null or empty text has no spans; its base_sha256 is that of "".
    """
    narrow = docs.select("doc_id", "text")
    found = scanned(narrow, fit(narrow)).select(
        F.col("row.doc_id").alias("doc_id"), F.size("assign").cast("long").alias("n_assign"), F.size("access").cast("long").alias("n_access"),
        F.size("hex").cast("long").alias("n_hex"), F.concat("assign", "access", "hex").alias("base"), "markov")
    return found.select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2(written(F.col("base")), 256).alias("base_sha256"),
        written(F.concat("base", "markov")).alias("spans"))


def without_secrets(docs: DataFrame) -> DataFrame:
    """The rows of `docs` in which no span is found, neither by a base pattern nor by the models."""
    found = scanned(docs, fit(docs.select("doc_id", "text")))
    return found.where(F.size("assign") + F.size("access") + F.size("hex") + F.size("markov") == 0).select("row.*")
