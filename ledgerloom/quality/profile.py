"""Table profiling: null and distinct ratios, extremes, moments and quartiles per column."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions.scalars import dbl, ratio, round_to

SAMPLE_SHARE = 0.25
SAMPLE_SEED = 7
SAMPLE_SLOTS = 10_000
QUARTILES = (0.25, 0.5, 0.75)


def _numeric(t: T.DataType) -> bool:
    return isinstance(t, T.NumericType)


def hash_sample(df: DataFrame, share: float, seed: int = SAMPLE_SEED) -> DataFrame:
    """The rows whose hash falls into the share: the same rows on every run, retry and partitioning."""
    slot = F.pmod(F.xxhash64(*df.columns, F.lit(seed)), F.lit(SAMPLE_SLOTS))
    return df.where(slot < int(share * SAMPLE_SLOTS))


def profile(
    df: DataFrame, *, sample: float | None = SAMPLE_SHARE, exact: bool = False, accuracy: int = 10_000
) -> DataFrame:
    """One row per column.

    All statistics come from one aggregate. With `exact`, distinct values are
    counted by unpivoting to (column, value) pairs and grouping twice, which
    stays distributed for any number of columns; otherwise by a sketch.
    """
    if sample is not None:
        df = hash_sample(df, sample)
    fields = df.schema.fields
    aggs: list[Column] = [F.count(F.lit(1)).alias("rows")]
    for i, f in enumerate(fields):
        c = F.col(f.name)
        aggs += [F.count(c).alias(f"n{i}"), F.min(c).cast("string").alias(f"lo{i}"), F.max(c).cast("string").alias(f"hi{i}")]
        if not exact:
            aggs.append(F.approx_count_distinct(c).alias(f"d{i}"))
        if _numeric(f.dataType):
            aggs += [F.sum(c.cast(T.DecimalType(18, 6))).alias(f"s{i}"), F.stddev_samp(dbl(c)).alias(f"q{i}"),
                     F.percentile_approx(c, list(QUARTILES), accuracy).alias(f"p{i}")]
    wide = df.agg(*aggs)

    def row(i: int, f: T.StructField) -> Column:
        if _numeric(f.dataType):
            numbers = [ratio(f"s{i}", f"n{i}", 4).cast("double"), round_to(f"q{i}", 4).cast("double"),
                       *[dbl(F.col(f"p{i}")[k]) for k in range(3)]]
        else:
            numbers = [F.lit(None).cast("double")] * 5
        names = ("mean", "stddev", "q1", "median", "q3")
        distinct = F.lit(None).cast("bigint") if exact else F.col(f"d{i}")
        return F.struct(
            F.lit(i).alias("position"), F.lit(f.name).alias("column_name"), F.col("rows").alias("row_count"),
            (F.col("rows") - F.col(f"n{i}")).alias("null_count"), distinct.alias("distinct_count"),
            F.col(f"lo{i}").alias("min_value"), F.col(f"hi{i}").alias("max_value"),
            *[v.alias(name) for v, name in zip(numbers, names, strict=True)])

    out = wide.select(F.inline(F.array(*[row(i, f) for i, f in enumerate(fields)])))
    if exact:
        out = out.drop("distinct_count").join(
            F.broadcast(distinct_counts(df)), "column_name", "left")  # one row per column
        out = out.withColumn("distinct_count", F.coalesce("distinct_count", F.lit(0).cast("bigint")))
    return out.withColumns({
        "null_ratio": ratio("null_count", "row_count", 4).cast("double"),
        "distinct_ratio": ratio("distinct_count", "row_count", 4).cast("double"),
    })


def distinct_counts(df: DataFrame) -> DataFrame:
    """Exact number of distinct non-NULL values of every column."""
    pairs = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in df.columns
    ])).alias("p")).select("p.*")
    values = pairs.where(F.col("value").isNotNull()).distinct()
    return values.groupBy("column_name").agg(F.count(F.lit(1)).alias("distinct_count"))


# ---- sketches of every column --------------------------------------------------------------------

#: A theta sketch of 2^16 entries is exact up to as many distinct values and off by 0.4 % (one standard deviation) beyond;
#: a KLL sketch of this k is exact up to k rows and off by about 0.01 % of ranks beyond.
DISTINCT_BITS, QUANTILE_K = 16, 65_535
#: Groups of partitions whose sketches are kept apart until the merge.
SLOTS = 64
#: Tasks that sketch one table: what the shuffle carries is as many sketches of a column, however large the table. All
#: tables are sketched side by side, which keeps the cluster busy.
SKETCH_TASKS = 4
PORTABLE_SHARE = "40"  # of the first two hexadecimal digits of a hash: a quarter


def portable_sample(df: DataFrame) -> DataFrame:
    """A quarter of the values of the first column, with all their rows, by a hash that other engines have too."""
    return df.where(F.substring(F.md5(F.coalesce(F.col(df.columns[0]).cast("string"), F.lit(""))), 1, 2) < PORTABLE_SHARE)


#: Types whose values differ exactly where their texts do, so that hashes of the values count distinct texts.
_AS_TEXT = (T.StringType, T.IntegralType, T.DecimalType, T.DateType, T.TimestampNTZType, T.BooleanType)
#: Between these a date or zone-free time sorts as its text does.
_PLAIN_TIMES = {T.DateType: ("0001-01-01", "9999-12-31"), T.TimestampNTZType: ("0001-01-01 00:00:00", "9999-12-31 23:59:59.999999")}


#: Columns of a row of sketches.
_SKETCH = ("dataset", "table_name", "column_name", "numeric", "rows", "filled", "distinct", "quantiles", "total", "least", "most", "first", "last")


@dataclass(frozen=True)
class Part:
    """A table among the rows of a frame: its columns, by the frame's columns that hold them, and what marks its rows (none: all)."""

    dataset: str
    table: str
    columns: dict[str, str]
    rows: str | None = None


def column_sketches(df: DataFrame, dataset: str, table: str) -> DataFrame:
    """A row for each column and slot of partitions: counts, extremes, an exact sum, and sketches that can be merged.

    One pass: every task sketches all columns of its rows, and the shuffle carries a row of sketches for each task.
    """
    return part_sketches(df, [Part(dataset, table, {c: c for c in df.columns})])


def part_sketches(df: DataFrame, parts: list[Part]) -> DataFrame:
    """The same for several tables that lie in the rows of one frame: a value that more than one of them has is sketched once.

    What the sketches take is computed before the aggregate, in compiled code: hashes of the values instead of their texts.
    """
    held = {place for part in parts for place in part.columns.values()}
    fields = [f for f in df.schema.fields if f.name in held]
    at = {f.name: i for i, f in enumerate(fields)}
    marks = list(dict.fromkeys(part.rows for part in parts if part.rows))
    # Expressions are texts here: thousands of columns take seconds to build one call at a time.
    ready, aggs = [f"spark_partition_id() % {SLOTS} as _slot", *marks], ["count(1) as rows"]
    for i, f in enumerate(fields):
        c = f"`{f.name}`"
        key = c if isinstance(f.dataType, _AS_TEXT) else f"cast({c} as string)"
        ready.append(f"if({c} is not null, xxhash64({key}), null) as h{i}")
        aggs += [f"count(h{i}) as n{i}", f"theta_sketch_agg(h{i}, {DISTINCT_BITS}) as d{i}"]
        if _numeric(f.dataType):
            ready += [f"cast({c} as double) as x{i}", f"cast({c} as decimal(28,6)) as e{i}"]
            aggs += [f"min(x{i}) as lo{i}", f"max(x{i}) as hi{i}", f"sum(e{i}) as s{i}", f"kll_sketch_agg_double(x{i}, {QUANTILE_K}) as q{i}"]
        elif type(f.dataType) in _PLAIN_TIMES:
            plain = "{} between {} and {}".format(c, *[f"cast('{v}' as {f.dataType.simpleString()})" for v in _PLAIN_TIMES[type(f.dataType)]])
            ready += [f"if({plain}, {c}, null) as v{i}", f"if({plain}, null, cast({c} as string)) as o{i}"]
            aggs += [f"least(cast(min(v{i}) as string), min(o{i})) as lo{i}", f"greatest(cast(max(v{i}) as string), max(o{i})) as hi{i}"]
        else:
            ready.append(f"cast({c} as string) as v{i}")
            aggs += [f"min(v{i}) as lo{i}", f"max(v{i}) as hi{i}"]
    wide = df.selectExpr(*ready).groupBy("_slot", *marks).agg(*map(F.expr, aggs))

    def row(part: Part, name: str, place: str) -> str:
        i = at[place]
        number = _numeric(fields[i].dataType)
        numbers = [f"q{i}", f"cast(s{i} as decimal(38,6))", f"lo{i}", f"hi{i}"] if number else [
            f"cast(null as {t})" for t in ("binary", "decimal(38,6)", "double", "double")]
        texts = ["cast(null as string)"] * 2 if number else [f"lo{i}", f"hi{i}"]
        values = (f"'{part.dataset}'", f"'{part.table}'", f"'{name}'", str(number).lower(), "rows", f"n{i}", f"d{i}", *numbers, *texts)
        return f"named_struct({', '.join(f"'{k}', {v}" for k, v in zip(_SKETCH, values, strict=True))})"

    def rows_of(part: Part) -> str:
        found = f"array({', '.join(row(part, name, place) for name, place in part.columns.items())})"
        return f"if({part.rows}, {found}, slice({found}, 1, 0))" if part.rows else found

    return wide.selectExpr(f"inline(concat({', '.join(map(rows_of, parts))}))")


def merged_profile(sketches: DataFrame) -> DataFrame:
    """One row per column of every sketched table; a column's sketches are merged by one task. Empty tables have no rows."""
    merged = sketches.groupBy("dataset", "table_name", "column_name", "numeric").agg(
        F.sum("rows").alias("row_count"), F.sum("filled").alias("filled"), F.theta_union_agg("distinct", DISTINCT_BITS).alias("distinct"),
        F.kll_merge_agg_double("quantiles", QUANTILE_K).alias("quantiles"), F.sum("total").alias("total"), F.min("least").alias("min_number"),
        F.max("most").alias("max_number"), F.min("first").alias("min_text"), F.max("last").alias("max_text"))
    measured = F.col("numeric") & (F.col("filled") > 0)

    def quantile(share: float) -> Column:
        return F.when(measured, F.kll_sketch_get_quantile_double("quantiles", F.lit(share)))

    distinct = F.theta_sketch_estimate("distinct")
    return merged.where("row_count > 0").select(
        "dataset", "table_name", "column_name", "row_count", (F.col("row_count") - F.col("filled")).alias("null_count"),
        distinct.alias("distinct_count"), "min_number", "max_number", "min_text", "max_text",
        F.when(measured, ratio("total", "filled", 4)).cast("double").alias("mean"),
        *[quantile(p).alias(n) for p, n in zip(QUARTILES, ("q1", "median", "q3"), strict=True)],
        ratio(F.col("row_count") - F.col("filled"), "row_count", 4).cast("double").alias("null_ratio"),
        ratio(distinct, "row_count", 4).cast("double").alias("distinct_ratio"))


# ---- keys ----------------------------------------------------------------------------------------


def text_values(tables: dict[str, DataFrame], wanted: dict[str, list[str]]) -> DataFrame:
    """(table_name, values) of every row of every table: the wanted columns as one array of strings.

    All tables get the same two columns, so what follows is planned and compiled once instead of once a table.
    """
    return reduce(DataFrame.unionByName, [
        df.select(F.lit(t).alias("table_name"), F.array(*[F.col(f"`{c}`").cast("string") for c in wanted[t]]).cast("array<string>").alias("values"))
        for t, df in tables.items()])


#: Hashes of 64 bits that agree by chance: fewer than this many rows, by any odds worth naming, up to ten billion rows.
CHANCE = 64


def _repeats(values: DataFrame, by: Column) -> DataFrame:
    """(table_name, rows, most, groups, nulls) of (table_name, value) rows, grouped by something made of the value."""
    one = F.when(F.col("value").isNotNull(), by).alias("by")
    return values.groupBy("table_name", one).agg(F.count(F.lit(1)).alias("n")).groupBy("table_name").agg(
        F.sum("n").alias("rows"), F.max("n").alias("most"), F.count(F.lit(1)).alias("groups"), F.count_if(F.col("by").isNull()).alias("nulls"))


def summaries(tables: dict[str, DataFrame], row_counts: DataFrame | None, lean: dict[str, DataFrame] | None = None) -> DataFrame:
    """Row and column count of every table, and the first id column that is unique and never NULL.

    The first id column of all tables goes through one aggregate by value, and that one through another by table. Tables
    whose column is no key go on with their next one: rounds end with the longest list of id columns, and a table whose
    first one is its key sends no other. What is sent is a hash of 64 bits. Distinct hashes mean distinct values; where so few
    rows share one that it may be chance, the values themselves are grouped.

    The first round counts the rows too; `row_counts` has those of tables without id columns at least. `lean` may hold frames with
    the same values in the first id column as the table has, and as many rows, that cost less.
    """
    ids = {t: [c for c in df.columns if c.endswith("_id")] for t, df in tables.items()}
    keys: dict[str, str] = {}
    sizes: dict[str, int] = {}
    for place in range(max(map(len, ids.values()), default=0)):
        left = {t: [columns[place]] for t, columns in ids.items() if t not in keys and place < len(columns)}
        if left:
            frames = {t: tables[t] for t in left} | ({t: df for t, df in (lean or {}).items() if t in left} if place == 0 else {})
            values = text_values(frames, left).select("table_name", F.col("values")[0].alias("value"))
            found = {r.table_name: r for r in _repeats(values, F.xxhash64("value")).collect()}
            if doubtful := [t for t, r in found.items() if not r.nulls and 0 < r.rows - r.groups < CHANCE]:
                found |= {r.table_name: r for r in _repeats(values.where(F.col("table_name").isin(doubtful)), F.col("value")).collect()}
            keys |= {t: left[t][0] for t, r in found.items() if r.most == 1 and r.nulls == 0}
            if place == 0:
                sizes = {t: found[t].rows if t in found else 0 for t in left}
    spark = next(iter(tables.values())).sparkSession
    shapes = spark.createDataFrame(
        [(t.partition("_")[0], t, sizes.get(t), len(df.columns), keys.get(t)) for t, df in tables.items()],
        "dataset string, table_name string, counted long, column_count long, pk_column string")
    if row_counts is None:
        return shapes.withColumnRenamed("counted", "row_count").select("dataset", "table_name", "row_count", "column_count", "pk_column")
    return shapes.join(row_counts, "table_name", "left").select(
        "dataset", "table_name", F.coalesce("counted", "row_count").alias("row_count"), "column_count", "pk_column")


def summary(df: DataFrame, dataset: str, table: str) -> DataFrame:
    """Row and column count, and the first id column that is unique and never NULL.

    The table is read once: (column, value) pairs of its id columns are grouped by both, then by column.
    """
    ids = [c for c in df.columns if c.endswith("_id")]
    if ids:
        pairs = df.select(F.explode(F.array(*[
            F.struct(F.lit(i).alias("position"), F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value"))
            for i, c in enumerate(ids)])).alias("p")).select("p.*")
        columns = pairs.groupBy("position", "column_name", "value").agg(F.count(F.lit(1)).alias("n")).groupBy(
            "position", "column_name").agg(F.sum("n").alias("rows"), F.count("value").alias("distinct"))
        unique = F.when(F.col("distinct") == F.col("rows"), F.col("position"))
        found = columns.agg(F.coalesce(F.max("rows"), F.lit(0).cast("bigint")).alias("row_count"),
                            F.min_by("column_name", unique).alias("pk_column"))
    else:
        found = df.agg(F.count(F.lit(1)).alias("row_count"), F.lit(None).cast("string").alias("pk_column"))
    return found.select(
        F.lit(dataset).alias("dataset"), F.lit(table).alias("table_name"), "row_count",
        F.lit(len(df.columns)).cast("bigint").alias("column_count"), "pk_column")
