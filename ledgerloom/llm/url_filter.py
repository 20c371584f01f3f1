"""URL filters: rules first, and gradient-boosted trees on lexical features for the URLs that no rule fits."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.support import let

ALLOW, BLOCK = "allow", "block"
#: The rules of the registered query.
RULES = (("org/", ALLOW), ("example.org/es/", BLOCK), ("example.org/en/1", BLOCK), ("com/fr/", ALLOW), ("com/de/", BLOCK))
#: Rules become one expression; more than this need a table instead.
MOST_RULES = 500
#: Labelled URLs that trees and suffix statistics are fitted on, at most.
TRAINING_ROWS = 20_000
TREES, DEPTH, SEED = 20, 4, 7
#: Labels of a suffix count as many times as this before its own share weighs more than the overall one.
PRIOR = 5.0

LEXICAL = (
    "url_length", "host_length", "path_length", "host_labels", "depth", "digit_ratio", "host_digit_ratio", "entropy", "host_entropy",
    "parameters", "query_length", "hyphens", "longest_label", "secure", "fragment")
FEATURES = (*LEXICAL, "suffix_rows", "suffix_rate", "domain_rows", "domain_rate")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path: after the first `://` up to `/`, `?`, `#` or end, lower-cased; and then up to `?`, `#` or end."""
    text = F.coalesce(url, F.lit(""))
    place = F.instr(text, "://")
    after = F.when(place > 0, F.substring(text, place + 3, F.length(text))).otherwise("")
    host = F.regexp_extract(after, r"(?s)^([^/?#]*)([^?#]*)", 1)
    return lower_ascii(host), F.regexp_extract(after, r"(?s)^([^/?#]*)([^?#]*)", 2)


def ruled(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none fits.

    A rule is host and path; it fits its host and all subdomains where the path starts with the rule's.
    """
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    rule = verdict = None
    for text, says in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        of, slash, rest = text.partition("/")
        fits = ((host == of) | host.endswith(f".{of}")) & path.startswith(slash + rest)
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, says) if verdict is None else verdict.when(fits, says)
    if rule is None:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    return rule, verdict


def entropy(text: Column) -> Column:
    """Bits for a character, by how often each character stands in the text; 0 for an empty one."""
    n = F.length(text)
    return let(text, lambda t: F.when(F.length(t) > 0, F.aggregate(
        F.array_distinct(F.split(t, "")), F.lit(0.0),
        lambda s, c: s - let((F.length(t) - F.length(F.replace(t, c, F.lit("")))) / F.length(t), lambda p: F.when(p > 0, p * F.log2(p)).otherwise(0.0))))
        .otherwise(n * 0.0))


def featured(urls: DataFrame) -> DataFrame:
    """`urls` (id, url) with host, path, the lexical features, and the suffix and domain of the host."""
    host, path = parts(F.col("url"))
    u = urls.select("id", F.coalesce("url", F.lit("")).alias("url"), host.alias("host"), path.alias("path"))
    url, host, path = F.col("url"), F.col("host"), F.col("path")
    labels = F.split("host", r"\.")
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)

    def digits(c: Column) -> Column:
        return F.length(F.regexp_replace(c, "[^0-9]+", "")) / F.greatest(F.length(c), F.lit(1))

    return u.select(
        "id", "host", "path",
        F.length(url).alias("url_length"), F.length(host).alias("host_length"), F.length(path).alias("path_length"),
        F.size(labels).alias("host_labels"), F.size(F.array_remove(F.split(path, "/"), "")).alias("depth"),
        digits(url).alias("digit_ratio"), digits(host).alias("host_digit_ratio"), entropy(url).alias("entropy"), entropy(host).alias("host_entropy"),
        F.size(F.array_remove(F.split(query, "&"), "")).alias("parameters"), F.length(query).alias("query_length"),
        (F.length(url) - F.length(F.replace(url, F.lit("-"), F.lit("")))).alias("hyphens"),
        F.array_max(F.transform(labels, F.length)).alias("longest_label"),
        lower_ascii(url).startswith("https://").cast("int").alias("secure"), F.contains(url, F.lit("#")).cast("int").alias("fragment"),
        F.element_at(labels, -1).alias("suffix"), F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), ".").alias("domain"))


class Model:
    """Trees with the suffix statistics that they were fitted on; or one verdict where labels of one kind, or none, are known."""

    def __init__(self, trees: GBTClassificationModel | None, statistics: dict[str, DataFrame], rate: float) -> None:
        self.trees, self.statistics, self.rate = trees, statistics, rate

    def allowed(self, features: DataFrame) -> DataFrame:
        """`features` with `allowed` (boolean)."""
        if self.trees is None:
            return features.withColumn("allowed", F.lit(self.rate >= 0.5))
        with_statistics = _with_statistics(features, self.statistics, self.rate)
        vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(with_statistics)
        return self.trees.transform(vectors).withColumn("allowed", F.col("prediction") >= 0.5)


def _statistics(labelled: DataFrame, key: str, rate: float) -> DataFrame:
    return labelled.groupBy(F.col(key).alias(f"of_{key}")).agg(
        F.log1p(F.count("*")).alias(f"{key}_rows"), ((F.sum("label") + PRIOR * rate) / (F.count("*") + PRIOR)).alias(f"{key}_rate"))


def _with_statistics(features: DataFrame, statistics: dict[str, DataFrame], rate: float) -> DataFrame:
    for key, table in statistics.items():
        features = features.join(F.broadcast(table), F.col(key) == F.col(f"of_{key}"), "left").drop(f"of_{key}").withColumns({
            f"{key}_rows": F.coalesce(f"{key}_rows", F.lit(0.0)), f"{key}_rate": F.coalesce(f"{key}_rate", F.lit(rate))})
    return features


def fit(labelled: DataFrame, rows: int = TRAINING_ROWS) -> Model:
    """Trees from at most `rows` labelled URLs (url, label 0 or 1), taken by a hash of the URL.

    Suffix statistics come from one half of them and the trees from the other, so that the trees see statistics as they
    are for new URLs. The statistics have `rows` rows at most, which bounds their broadcast. Repeated URLs count once.
    """
    order = F.xxhash64("url")
    drawn = labelled.where("url is not null and label is not null").groupBy("url").agg(F.max("label").alias("label"))
    drawn = drawn.orderBy(order, "url").limit(rows).withColumn("half", F.pmod(F.xxhash64("url", F.lit(SEED)), F.lit(2)))
    counted = drawn.groupBy("half").agg(F.count("*").alias("n"), F.sum("label").alias("ones")).collect()  # two rows
    n, ones = sum(r["n"] for r in counted), sum(r["ones"] for r in counted)
    rate = ones / n if n else 1.0
    if len(counted) < 2 or any(r["ones"] in (0, r["n"]) for r in counted):
        return Model(None, {}, rate)
    described = featured(drawn.select(F.struct("label", "half").alias("id"), "url")).select("*", "id.label", "id.half").persist()
    statistics = {key: _statistics(described.where("half = 0"), key, rate) for key in ("suffix", "domain")}
    train = _with_statistics(described.where("half = 1"), statistics, rate)
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(train).select(
        "features", F.col("label").cast("double").alias("label"))
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=SEED, maxBins=64, minInstancesPerNode=2).fit(vectors)
    return Model(trees, statistics, rate)


def judged(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict of every row of `pages`.

    The labels are the verdicts of the rules; the trees judge the URLs that no rule fits. A url that is null or has no
    `://` has an empty host and path. Where rules label nothing, everything else is allowed.
    """
    host, path = parts(F.col("url"))
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    rows = pages.select("page_id", "url", host.alias("host"), path.alias("path")).withColumns({"rule": rule, "said": verdict})
    labelled = rows.where("rule is not null").select("url", (F.col("said") == ALLOW).cast("int").alias("label"))
    model = fit(labelled)
    described = featured(pages.select(F.struct("page_id").alias("id"), "url"))
    out = model.allowed(described).withColumns({"rule": rule, "said": verdict})
    return out.select(
        F.col("id.page_id").alias("page_id"), "host", "path", "rule",
        F.coalesce("said", F.when(F.col("allowed"), ALLOW).otherwise(BLOCK)).alias("verdict"))
