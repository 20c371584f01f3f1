"""Mixing sources to target weights: nested hash thresholds found from histograms, without sorting documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.support import stored

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
#: Hash bits per level of the histogram (hex digits), and levels: 16 ** 9 cells for each source.
DIGITS = 3
LEVELS = 3


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def draw(doc_id: Column, text: Column) -> Column:
    """Hex digits that stand for a row: the same at every run, and different for different rows under one id."""
    return F.substring(F.md5(F.concat_ws(
        ":", F.coalesce(doc_id.cast("string"), F.lit("-")), F.md5(F.coalesce(text, F.lit("-")).cast("binary")))), 1, DIGITS * LEVELS)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size, target) for one row per source: `share` of all words by weight, `most` times a source at most.

    What the most leaves over is dealt again by weight until no source is above. That ends where every source gets its
    weight times one level, or its most; sources reach their most in the order of most over weight, so running sums in
    that order find the level. The windows hold one row per source, not documents.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = sizes.withColumn("weight", F.element_at(
        F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    by_ratio = Window.orderBy((F.col("source_size") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before, everything = by_ratio.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(F.lit(1))
    at = weighed.select(
        "source", "source_size", "weight",
        (F.sum("source_size").over(everything) * share).alias("budget"),
        (F.coalesce(F.sum("source_size").over(before), F.lit(0)) * most).alias("full"),
        (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))).alias("rest"))
    at = at.withColumn("level", (F.col("budget") - F.col("full")) / F.col("rest"))
    capped = F.col("level") * F.col("weight") >= F.col("source_size") * most
    level = F.first(F.when(~capped, F.col("level")), ignorenulls=True).over(
        by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return at.withColumn("level", level).select(
        "source", "source_size",
        F.least(F.coalesce(F.col("level") * F.col("weight"), (F.col("source_size") * most).cast("double")),
                (F.col("source_size") * most).cast("double")).alias("target"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(doc_id, source, draw, size, source_size, target, taken) of every row of `docs`.

    A source takes all its documents as often as its target allows, and once more those whose draw lies below a
    threshold. The threshold comes from sums by source and hash bucket; only the bucket in which the budget ends is cut
    into finer buckets. In the last, finest cell the documents are taken if that comes nearer to the target. Rows that
    agree in id and text share a draw and a decision. Null sources are one source, the last; a null or empty text has
    size 0 and nothing is taken from it. An empty table gives an empty result.
    """
    sized = stored(docs.select("doc_id", "source", draw(F.col("doc_id"), F.col("text")).alias("draw"), words(F.col("text")).alias("size")), "sizes")
    cells = stored(sized.groupBy("source", F.substring("draw", 1, DIGITS).alias("cell")).agg(F.sum("size").alias("size")), "cells")
    goals = targets(cells.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    copies = F.floor(F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0))
    goals = stored(goals.withColumn("copies", copies.cast("long")).withColumn(
        "budget", F.col("target") - F.col("copies") * F.col("source_size")), "goals")
    same_source = F.col("g.source").eqNullSafe(F.col("c.source"))
    level = cells.alias("c").join(goals.alias("g"), same_source).select("c.source", "c.cell", "c.size", "g.budget")
    first = None
    edges = []
    for depth in range(1, LEVELS + 1):
        inner = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
        summed = level.withColumn("before", F.coalesce(F.sum("size").over(inner), F.lit(0)).cast("double"))
        if depth == LEVELS:
            nearer = summed.where(F.col("before") + F.col("size") / 2 <= F.col("budget"))
            edges.append(nearer.groupBy("source").agg(F.max("cell").alias("edge")))
            break
        more = F.when(F.col("before") + F.col("size") <= F.col("budget"), 1).when(F.col("before") > F.col("budget"), 0)
        summed = stored(summed.withColumn("more", more), "cells")
        first = first or summed
        edge = summed.where("more is null").select("source", F.col("cell").alias("edge"), (F.col("budget") - F.col("before")).alias("budget"))
        if depth > 1:
            edges.append(edge.select("source", "edge"))
        inside = sized.alias("d").join(edge.alias("e"), F.col("d.source").eqNullSafe(F.col("e.source")) & (
            F.substring("d.draw", 1, DIGITS * depth) == F.col("e.edge")))
        level = inside.groupBy("d.source", F.substring("d.draw", 1, DIGITS * (depth + 1)).alias("cell"), "e.budget").agg(F.sum("d.size").alias("size"))
    # Draws up to `edge` are taken: the last cell taken at the finest level, or all that sorts before the cell cut last.
    below = edges[0]
    for more in edges[1:]:
        below = below.unionByName(more)
    below = below.groupBy("source").agg(F.max("edge").alias("edge"))
    lookup = (
        first.alias("c").join(goals.alias("g"), same_source)
        .join(below.alias("b"), F.col("c.source").eqNullSafe(F.col("b.source")), "left")
        .select(F.col("c.source").alias("of"), "c.cell", "c.more", "g.source_size", "g.target", "g.copies", "b.edge"))
    # The key of this join is spread over the cells of a source, so that a large source isn't one key.
    on = F.col("source").eqNullSafe(F.col("of")) & (F.substring("draw", 1, DIGITS) == F.col("cell"))
    more = F.coalesce(F.col("more"), F.coalesce(F.col("draw") <= F.col("edge"), F.lit(False)).cast("int"))
    return sized.join(lookup, on).select(
        "doc_id", "source", "draw", "size", "source_size", "target", ((F.col("copies") + more) * F.col("size")).alias("taken"))


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row of `docs`."""
    return mixed(docs).select("doc_id", "size", "source_size", "target", "taken")


def draw_mix(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that the mix takes, with size, source_size, target and taken after the columns of `docs`.

    Rows that agree in id, source and draw share their numbers, so the decision is joined back on these. Where `docs` has a
    column of one of these four names already, its own stays and the number isn't added.
    """
    own = ["_mix_doc_id", "_mix_draw"]
    decided = mixed(docs).where("taken > 0").select(
        F.col("doc_id").alias(own[0]), F.col("draw").alias(own[1]), F.col("source").alias("_mix_source"),
        F.struct("size", "source_size", "target", "taken").alias("_mix")).distinct()
    names = docs.columns
    rows = docs.withColumn("_mix_of", draw(F.col("doc_id"), F.col("text")))
    on = F.col("doc_id").eqNullSafe(F.col(own[0])) & (F.col("_mix_of") == F.col(own[1])) & F.col("source").eqNullSafe(F.col("_mix_source"))
    added = [c for c in ("size", "source_size", "target", "taken") if c not in names]
    return rows.join(decided, on).select(*[f"`{c}`" for c in names], *[F.col(f"_mix.{c}").alias(c) for c in added])
