"""Source divergence audit: how far each source of a language is from the others, and the terms it overuses most.

The terms come by dominance skybands: each partition retains a group's terms that fewer than k others dominate in group
count, language count and order; the skybands are merged and ranked exactly. The distances come from blocks of terms by
sources, summed where the terms are.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.support import letter_words, stored

#: Documents of a language that a term must stand in, ranks of overused terms, and the smoothing of a share.
LEAST_DOCUMENTS, RANKS, SMOOTH, SCALE = 30, 50, 5, 1_000_000_000
#: Counts that a task holds before it passes them on.
HELD_COUNTS = 1_000_000
#: Terms of a group that are held before all but their skyband are let go.
HELD_TERMS = 1 << 16
#: Rows compared with the skyband at once.
TOGETHER = 512
#: Sources of a language in one block of columns; buckets of terms that share the work of a pair of blocks.
TILE, BUCKETS = 64, 64
#: Terms whose shares are held at once.
BLOCK_TERMS = 1024


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts by group and term, summed over as many documents as HELD_COUNTS allows. A group's row without term says that it occurs."""
    held: dict[tuple[str, str], tuple[Counter[bytes], Counter[bytes]]] = {}
    n = 0

    def out(group: tuple[str, str], counts: Counter[bytes], docs: Counter[bytes]) -> pa.RecordBatch:
        size = len(counts)
        return pa.RecordBatch.from_arrays([
            pa.repeat(group[0], size + 1), pa.repeat(group[1], size + 1), pa.array([*counts, None], pa.binary()).cast(pa.string()),
            pa.array(np.fromiter([*counts.values(), 0], np.int64, size + 1)),
            pa.array(np.fromiter([*map(docs.__getitem__, counts), 0], np.int64, size + 1))], names=["lang", "source", "term", "n", "docs"])

    for batch in batches:
        langs, sources, texts = batch.column("lang").to_pylist(), batch.column("source").to_pylist(), batch.column("text")
        for group, text in zip(zip(langs, sources), texts):
            if group not in held:
                held[group] = Counter(), Counter()
                n += 1
            counts, docs = held[group]
            n -= len(counts)
            here: set[bytes] = set()
            for words in letter_words(text.as_py()):
                counts.update(words)
                here.update(words)
            docs.update(here)
            n += len(counts)
            if n > HELD_COUNTS:
                for name, found in held.items():
                    yield out(name, *found)
                held, n = {}, 0
    for name, found in held.items():
        yield out(name, *found)


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term in each group. A group has a row without term too."""
    plain = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")], F.col("text").cast("binary").alias("text"))
    parts = plain.mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column, terms: Column, smooth: int = SMOOTH) -> Column:
    """1 + floor(SCALE * (count + smooth) / (total + smooth * terms)) in whole numbers; null where there are no terms."""
    def whole(c: Column) -> Column:
        return c.cast("decimal(20,0)")

    return F.lit(1).cast("long") + F.call_function(
        "div", F.lit(SCALE).cast("decimal(10,0)") * whole(count + smooth), F.nullif(whole(total + smooth * terms), F.lit(0).cast("decimal(20,0)")))


def _skyband(n: np.ndarray, total: np.ndarray, place: np.ndarray, k: int) -> np.ndarray:
    """Positions of the rows that fewer than k others dominate: n no lower, total no higher, place earlier.

    Rows are taken with n falling, so those that dominate a row come before it. Comparing with the skyband so far is
    enough: of a row's dominators the first k are in it.
    """
    order = np.lexsort((place, total, -n))
    kept = np.zeros(0, dtype=np.int64)
    for at in range(0, len(order), TOGETHER):
        rows = order[at:at + TOGETHER]
        above = (total[kept] <= total[rows, None]) & (place[kept] < place[rows, None])
        near = (total[rows] <= total[rows, None]) & (place[rows] < place[rows, None]) & np.tri(len(rows), k=-1, dtype=bool)
        kept = np.r_[kept, rows[above.sum(axis=1) + near.sum(axis=1) < k]]
    return kept


def retained(k: int):
    """For mapInArrow over rows (lang, source, term, n, total) sorted by lang and source: those in the k-skyband of their group here."""
    names = ["lang", "source", "term", "n", "total"]

    def band(rows: list[tuple]) -> list[tuple]:
        if len(rows) <= k:
            return rows
        place = np.empty(len(rows), dtype=np.int64)
        place[sorted(range(len(rows)), key=lambda i: rows[i][0])] = np.arange(len(rows))
        found = _skyband(np.array([r[1] for r in rows]), np.array([r[2] for r in rows]), place, k)
        return [rows[i] for i in found.tolist()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, []

        def out() -> pa.RecordBatch:
            rows = band(held)
            return pa.RecordBatch.from_arrays([
                pa.array([group[0]] * len(rows), pa.string()), pa.array([group[1]] * len(rows), pa.string()),
                pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()),
                pa.array([r[2] for r in rows], pa.int64())], names=names)

        for batch in batches:
            for lang, source, *row in zip(*[batch.column(c).to_pylist() for c in names]):
                if (lang, source) != group:
                    if held:
                        yield out()
                    group, held = (lang, source), []
                held.append(tuple(row))
                if len(held) >= HELD_TERMS + k and len(held) % HELD_TERMS == 0:
                    held = band(held)
        if held:
            yield out()

    return run


def skyband(rows: DataFrame, k: int) -> DataFrame:
    """The rows (lang, source, term, n, total) that fewer than k others of their group dominate.

    A term dominates another with no lower n, no higher total and an earlier place in UTF-8 order. Partitions keep their
    own skybands, a group's skybands meet in one task, which holds one group and HELD_TERMS of its terms at most.
    """
    columns = "lang string, source string, term string, n long, total long"
    here = rows.select("lang", "source", "term", "n", "total").sortWithinPartitions("lang", "source").mapInArrow(retained(k), columns)
    return here.repartition("lang", "source").sortWithinPartitions("lang", "source").mapInArrow(retained(k), columns)


class _Block:
    """Distances between two tiles of one language's sources, summed term by term."""

    def __init__(self) -> None:
        self.base: dict[int, int] = {}
        self.terms = 0
        self.sums: np.ndarray | None = None

    def marker(self, column: int, base: int, terms: int) -> None:
        self.base[column], self.terms = base, terms

    def open(self, left: int, right: int, tile: int) -> None:
        """All columns are known: those of the left tile and of the right one. Terms that occur nowhere count as `base` everywhere."""
        self.columns = np.array(sorted(self.base))
        self.at = {c: i for i, c in enumerate(self.columns.tolist())}
        self.values = np.array([self.base[c] for c in self.columns.tolist()], dtype=np.int64)
        self.left, self.right = np.flatnonzero(self.columns // tile == left), np.flatnonzero(self.columns // tile == right)
        self.unseen = np.abs(self.values[self.left][:, None] - self.values[self.right])
        if self.sums is None:
            self.sums = np.zeros(self.unseen.shape, dtype=np.int64)

    def add(self, term: np.ndarray, column: np.ndarray, p: np.ndarray) -> None:
        """Rows of whole terms; `term` numbers them from 0 without gaps."""
        place = np.array([self.at[c] for c in column.tolist()])
        for low in range(0, int(term[-1]) + 1, BLOCK_TERMS):
            a, b = np.searchsorted(term, [low, low + BLOCK_TERMS])
            n = int(term[b - 1]) - low + 1
            shares = np.tile(self.values, (n, 1))
            shares[term[a:b] - low, place[a:b]] = p[a:b]
            for i, c in enumerate(self.left.tolist()):
                self.sums[i] += np.abs(shares[:, c:c + 1] - shares[:, self.right]).sum(axis=0)
            self.sums -= n * self.unseen

    def rows(self, lang: str) -> list[tuple]:
        a, b = np.meshgrid(self.columns[self.left], self.columns[self.right], indexing="ij")
        use = a < b
        pairs = list(zip(a[use].tolist(), b[use].tolist(), self.sums[use].tolist()))
        return [(lang, x, y, v) for x, y, v in pairs] + [(lang, y, x, v) for x, y, v in pairs]


def _summed(tile: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by lang, left, right, bucket, term; a bucket's markers, which have no term, come first."""
        key = bucket = None
        block, ready = _Block(), False
        held: tuple[list, list, list] = ([], [], [])  # rows of the terms at hand, the last of which may go on

        def flush(last: int) -> None:
            terms, columns, values = (x[:last] for x in held)
            if terms:
                number = np.cumsum(np.r_[0, [a != b for a, b in zip(terms[1:], terms)]]).astype(np.int64)
                block.add(number, np.array(columns), np.array(values, dtype=np.int64))
            for x in held:
                del x[:last]

        def out() -> pa.RecordBatch:
            rows = block.rows(key[0])
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 4, kinds)], names=["lang", "a", "b", "value"])

        def opened() -> None:
            nonlocal ready
            if not ready:
                block.open(key[1], key[2], tile)
                if bucket == 0:
                    block.sums += block.terms * block.unseen
                ready = True

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("lang", "left", "right", "bucket", "term", "idx", "p", "terms")]
            for lang, left, right, b, term, idx, p, terms in zip(*columns):
                if (lang, left, right) != key or b != bucket:
                    if key is not None:
                        opened()
                        flush(len(held[0]))
                        if (lang, left, right) != key:
                            yield out()
                            block = _Block()
                    key, bucket, ready = (lang, left, right), b, False
                if term is None:
                    block.marker(idx, p, terms)
                    continue
                opened()
                if len(held[0]) >= BLOCK_TERMS * 8 and term != held[0][-1]:
                    flush(len(held[0]))
                for x, v in zip(held, (term, idx, p)):
                    x.append(v)
        if key is not None:
            opened()
            flush(len(held[0]))
            yield out()

    return run


def distances(shares: DataFrame, sources: DataFrame, tile: int = TILE, buckets: int = BUCKETS) -> DataFrame:
    """(lang, a, b, value) for each two sources of a language, both ways: the sum over its terms of how far their shares differ.

    `shares` has (lang, term, idx, p) of the terms that occur in a source, `sources` (lang, idx, base, terms): each
    source's number in its language, its share of a term that doesn't occur in it, and the language's number of terms.
    A row goes to each pair of tiles that its source is in, by bucket of terms; a task holds the sums of one pair of
    tiles and the shares of BLOCK_TERMS terms.
    """
    widest = sources.groupBy("lang").agg((F.floor(F.max("idx") / tile)).cast("int").alias("last"))
    bucketed = shares.select("lang", "term", "idx", "p", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int").alias("bucket"), F.lit(None).cast("long").alias("terms"))
    markers = sources.select(
        "lang", F.lit(None).cast("string").alias("term"), "idx", F.col("base").alias("p"),
        F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket"), F.col("terms").cast("long"))
    own = F.floor(F.col("idx") / tile).cast("int")
    dealt = bucketed.unionByName(markers).join(widest, "lang").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("last"))))
    dealt = dealt.select("lang", F.least(own, "other").alias("left"), F.greatest(own, "other").alias("right"), "bucket", "term", "idx", "p", "terms")
    ordered = dealt.repartition("lang", "left", "right", "bucket").sortWithinPartitions("lang", "left", "right", "bucket", F.col("term").asc_nulls_first())
    return ordered.mapInArrow(_summed(tile), "lang string, a long, b long, value long").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, least_documents: int = LEAST_DOCUMENTS, ranks: int = RANKS, tile: int = TILE, buckets: int = BUCKETS) -> DataFrame:
    """lang, source, part, item, value, rank of every group (lang, source) of `docs`.

    Null text, lang and source count as empty. A language keeps the terms that stand in at least `least_documents` of its
    rows; repeated rows count each. A group's share of a term is 1 + floor(10^9 (n + 5) / (N + 5 V)). Part `pair` has
    every other source of the language with the summed differences of their shares (0 if no terms are kept), farthest
    first. Part `term` has the kept terms that the group uses at a higher share than its language, by the difference, up
    to `ranks`. Ties go by item in UTF-8 order. An empty table, and a language's only source without overused terms,
    have no rows. Other columns are not read.
    """
    counts = stored(term_counts(docs), "counts")
    terms = (
        counts.where("term is not null").groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs"))
        .where(F.col("docs") >= least_documents).select("lang", "term", "total"))
    kept = stored(counts.where("term is not null").select("lang", "source", "term", "n").join(terms, ["lang", "term"]), "kept")
    langs = kept.groupBy("lang", "term").agg(F.max("total").alias("total")).groupBy("lang").agg(
        F.count("*").alias("terms"), F.sum("total").alias("lang_n"))
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("source_n"))
    numbered = Window.partitionBy("lang").orderBy("source")
    groups = stored(
        counts.where("term is null").select("lang", "source").join(sums, ["lang", "source"], "left").join(langs, "lang", "left")
        .select(
            "lang", "source", F.coalesce("source_n", F.lit(0)).alias("source_n"), F.coalesce("terms", F.lit(0)).alias("terms"),
            F.coalesce("lang_n", F.lit(0)).alias("lang_n"), (F.row_number().over(numbered) - 1).cast("long").alias("idx"))
        .withColumn("base", F.coalesce(share(F.lit(0).cast("long"), F.col("source_n"), F.col("terms")), F.lit(0))), "groups")
    p = share(F.col("n"), F.col("source_n"), F.col("terms"))

    shares = kept.join(groups, ["lang", "source"]).select("lang", "term", "idx", p.alias("p"))
    name = groups.select("lang", "source", "idx")
    pairs = (
        distances(shares, groups, tile, buckets)
        .join(name.select("lang", F.col("idx").alias("a"), "source"), ["lang", "a"])
        .join(name.select("lang", F.col("idx").alias("b"), F.col("source").alias("item")), ["lang", "b"])
        .select("lang", "source", F.lit("pair").alias("part"), "item", "value"))

    q = share(F.col("total"), F.col("lang_n"), F.col("terms"))
    over = (
        skyband(kept, ranks).join(groups, ["lang", "source"])
        .select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (p - q).alias("value")).where("value > 0"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    top = over.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= ranks)
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(top)
