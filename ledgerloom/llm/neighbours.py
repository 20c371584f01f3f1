"""Approximate nearest neighbours by collision counting: single-projection sorted arrays, query-centred windows that grow
by virtual rehashing, a collision threshold, and exact distances of the vectors that exceed it."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil, erf, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.support import shared_path, stored

SEED = 42
#: Projections of a vector, each a sorted array of its own.
PROJECTIONS = 128
#: Half the width of a window, in radii. At distance one radius a projection then collides with a chance of 0.68.
HALF = 1.0
#: The collision threshold lies this many standard deviations below the mean at distance one radius.
SURE = 2.0
#: Windows grow by this factor, in so many steps, up to the radius within which k vectors are known to be.
GROWTH, STEPS = 1.15, 5
#: Vectors from whose exact distances a query's first radius is taken. Every vector is indexed and searched all the same.
PILOT_ROWS = 4096
#: Vectors, and bytes of them, whose sorted arrays are held at once.
BLOCK_ROWS, BLOCK_BYTES = 8192, 64 << 20
#: Bytes of query vectors that are sent to the executors for one pass over the vectors.
PASS_BYTES = 32 << 20
#: Queries whose windows are looked up at once.
TOGETHER = 256

FOUND = "query long, query_id long, row long, vec_id long, score double"

#: (distance, has no id, id, row): the order of a query's neighbours.
Neighbour = tuple[float, bool, int, int]


def usable(vectors: DataFrame) -> DataFrame:
    """(row, vec_id, embedding) of the vectors that take part, with a number of their own for each row.

    Null and empty vectors, zero vectors and those with null or non-finite components take no part.
    """
    finite = F.forall("embedding", lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False)))
    return vectors.select("vec_id", "embedding").where(finite & F.exists("embedding", lambda x: x != 0)).select(
        F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))


def directions(size: int, projections: int = PROJECTIONS) -> np.ndarray:
    """(size, projections): the same normal random directions in every task."""
    return np.random.default_rng([SEED, size]).standard_normal((size, projections))


def projected(vectors: np.ndarray, projections: int = PROJECTIONS) -> np.ndarray:
    with np.errstate(over="ignore", invalid="ignore"):
        return np.nan_to_num(vectors @ directions(vectors.shape[1], projections))


def threshold(projections: int = PROJECTIONS) -> int:
    chance = erf(HALF / sqrt(2))
    return max(1, ceil(projections * chance - SURE * sqrt(projections * chance * (1 - chance))))


def distances(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Euclidean distances; where squares would leave the range of a double, differences are scaled by a power of two."""
    with np.errstate(over="ignore", under="ignore"):
        apart = vectors - query
        d = np.sqrt(np.square(apart).sum(axis=1))
        odd = np.flatnonzero(~((d > 1e-140) & (d < 1e140)))
        power = np.frexp(np.abs(apart[odd]).max(axis=1, initial=0))[1]
        d[odd] = np.ldexp(np.sqrt(np.square(np.ldexp(apart[odd], -power[:, None])).sum(axis=1)), power)
    return d


class Block:
    """Some vectors of one length, with their projections in sorted arrays."""

    def __init__(self, rows: list[int], ids: list[int | None], vectors: np.ndarray) -> None:
        self.rows, self.ids, self.vectors = rows, ids, vectors
        values = projected(vectors)
        self.order = np.ascontiguousarray(np.argsort(values, axis=0, kind="stable").T)
        self.sorted = np.take_along_axis(np.ascontiguousarray(values.T), self.order, axis=1)

    def windows(self, values: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the windows begin and end, by query, step and projection. `radius` is by query and step."""
        half = HALF * radius * (1 + 1e-6) + 1e-9 * (1 + np.abs(values).max(axis=1, initial=0))[:, None]
        low = np.empty((*radius.shape, values.shape[1]), dtype=np.int64)
        high = np.empty_like(low)
        for j, array in enumerate(self.sorted):
            low[:, :, j] = np.searchsorted(array, values[:, j, None] - half, side="left")
            high[:, :, j] = np.searchsorted(array, values[:, j, None] + half, side="right")
        return low, high

    def search(self, query: np.ndarray, own: int, low: np.ndarray, high: np.ndarray, radius: np.ndarray,
               best: list[Neighbour], k: int, need: int) -> list[Neighbour]:
        """`best` with the vectors of this block that come before its k-th. Windows grow until k vectors lie within the radius."""
        n = len(self.rows)
        collisions = np.zeros(n, dtype=np.int64)
        verified = np.zeros(n, dtype=bool)
        before = None
        for step in range(len(radius)):
            first, last = low[step].tolist(), high[step].tolist()
            if before is None:
                pieces = [o[a:b] for o, a, b in zip(self.order, first, last)]
            else:  # only what the windows have grown by
                pieces = [o[a:b] for o, a, b in zip(self.order, first, before[0])] + [o[a:b] for o, a, b in zip(self.order, before[1], last)]
            before = first, last
            collisions += np.bincount(np.concatenate(pieces), minlength=n)
            near = np.flatnonzero((collisions >= need) & ~verified)
            verified[near] = True
            d = distances(self.vectors[near], query)
            if len(best) >= k:
                closer = d <= best[-1][0]
                near, d = near[closer], d[closer]
            if len(near) > k:  # ties at the k-th are kept
                closer = d <= np.partition(d, k)[k]
                near, d = near[closer], d[closer]
            if len(near):
                held = {x[3] for x in best} | {own}
                new = [(score, self.ids[i] is None, self.ids[i] or 0, self.rows[i])
                       for i, score in zip(near.tolist(), d.tolist()) if self.rows[i] not in held]
                best = sorted(best + new)[:k]
            if len(best) >= k and best[-1][0] <= radius[step]:
                break
        return best


class Queries:
    """Query vectors of one length and the best neighbours known of each."""

    def __init__(self) -> None:
        self.rows: list[int] = []
        self.ids: list[int | None] = []
        self.best: list[list[Neighbour]] = []
        self.vectors: list[np.ndarray] | np.ndarray = []

    def closed(self) -> Queries:
        self.vectors = np.stack(self.vectors)
        self.values = projected(self.vectors)
        return self

    def search(self, block: Block, k: int, need: int) -> None:
        for at in range(0, len(self.rows), TOGETHER):
            part = slice(at, at + TOGETHER)
            known = np.array([b[-1][0] if len(b) >= k else np.inf for b in self.best[part]])
            radius = known[:, None] * GROWTH ** np.arange(1.0 - STEPS, 1.0)
            low, high = block.windows(self.values[part], radius)
            for i in range(len(known)):
                q = at + i
                steps = slice(0, None) if np.isfinite(known[i]) and known[i] > 0 else slice(STEPS - 1, None)
                self.best[q] = block.search(
                    self.vectors[q], self.rows[q], low[i, steps], high[i, steps], radius[i, steps], self.best[q], k, need)


def _of_sizes(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, vectors) of a batch's vectors, by their length."""
    arrays = batch.column("embedding")
    lengths = arrays.value_lengths().to_numpy(zero_copy_only=False)
    flat, starts = arrays.flatten().to_numpy(zero_copy_only=False), np.r_[0, np.cumsum(lengths)]
    for size in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == size)
        yield at, flat[starts[at][:, None] + np.arange(size)]


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    """Blocks of vectors of one length, of BLOCK_ROWS rows or BLOCK_BYTES at most."""
    held: dict[int, tuple[list, list, list]] = {}

    def full(size: int) -> int:
        return max(1, min(BLOCK_ROWS, BLOCK_BYTES // (8 * size)))

    for batch in batches:
        rows, ids = batch.column("row").to_pylist(), batch.column("vec_id").to_pylist()
        for at, vectors in _of_sizes(batch):
            size = vectors.shape[1]
            kept = held.setdefault(size, ([], [], []))
            for i in range(0, len(at), full(size)):
                part = at[i:i + full(size)].tolist()
                kept[0].extend(rows[p] for p in part)
                kept[1].extend(ids[p] for p in part)
                kept[2].append(vectors[i:i + full(size)])
                if len(kept[0]) >= full(size):
                    yield Block(kept[0], kept[1], np.concatenate(kept[2]))
                    kept = held[size] = ([], [], [])
    for rows, ids, vectors in held.values():
        if rows:
            yield Block(rows, ids, np.concatenate(vectors))


def _rows(found: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
    columns = list(zip(*found)) or [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["query", "query_id", "row", "vec_id", "score"])


def _named(query: int, query_id: int, best: list[Neighbour]) -> list[tuple]:
    return [(query, query_id, row, None if unnamed else vec_id, score) for score, unnamed, vec_id, row in best]


def pilot(queries: DataFrame, sample, k: int) -> DataFrame:
    """The k nearest of the sample, for each query: the first neighbours known of it. `sample` is a broadcast Arrow table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, tuple[list, list, np.ndarray]] = {}
        for batch in sample.value.combine_chunks().to_batches():
            rows, ids = batch.column("row").to_pylist(), batch.column("vec_id").to_pylist()
            for at, vectors in _of_sizes(batch):
                known[vectors.shape[1]] = [rows[i] for i in at.tolist()], [ids[i] for i in at.tolist()], vectors
        for batch in batches:
            numbers, names, out = batch.column("row").to_pylist(), batch.column("vec_id").to_pylist(), []
            for at, vectors in _of_sizes(batch):
                rows, ids, others = known.get(vectors.shape[1], ([], [], None))
                for place, query in zip(at.tolist(), vectors):
                    d = distances(others, query) if rows else np.zeros(0)
                    near = np.flatnonzero(d <= np.partition(d, k)[k]).tolist() if len(d) > k + 1 else range(len(d))
                    best = sorted((d[i].item(), ids[i] is None, ids[i] or 0, rows[i]) for i in near if rows[i] != numbers[place])
                    out.extend(_named(numbers[place], names[place], best[:k]))
            yield _rows(out)

    return queries.mapInArrow(run, FOUND)


def _searcher(sent, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        questions, first = sent.value
        best: dict[int, list[Neighbour]] = {}
        for query, row, vec_id, score in first:
            best.setdefault(query, []).append((score, vec_id is None, vec_id or 0, row))
        groups: dict[int, Queries] = {}
        for batch in questions.combine_chunks().to_batches():
            rows, ids = batch.column("row").to_pylist(), batch.column("vec_id").to_pylist()
            for at, vectors in _of_sizes(batch):
                group = groups.setdefault(vectors.shape[1], Queries())
                for i, vector in zip(at.tolist(), vectors):
                    group.rows.append(rows[i])
                    group.ids.append(ids[i])
                    group.best.append(sorted(best.get(rows[i], [])))
                    group.vectors.append(vector)
        known = {q: {x[3] for x in found} for q, found in best.items()}
        for group in groups.values():
            group.closed()
        need = threshold()
        for block in blocks(batches):
            if group := groups.get(block.vectors.shape[1]):
                group.search(block, k, need)
        for group in groups.values():
            for q, query_id, found in zip(group.rows, group.ids, group.best):
                yield _rows(_named(q, query_id, [x for x in found if x[3] not in known.get(q, ())]))

    return run


def search(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every row of `queries` among `rows`, its own row left out.

    Both have the columns of `usable` and must be stored, so that row numbers stay; `queries` holds rows of `rows` or
    others with numbers of their own. Only vectors of the query's length are its candidates. Nearness is the Euclidean
    distance; ties go to the smaller vec_id, rows without one last.

    A query starts with its k nearest of PILOT_ROWS vectors (drawn by a hash, a bound on the draw alone), so the radius
    up to which it must look is known. Every block of vectors is then searched: windows around the query in each sorted
    array grow up to that radius, which shrinks as nearer vectors are found; a vector that collides in enough of them is
    compared by its distance. There is no limit on candidates. A vector within the final radius is missed with a chance
    of about 0.02 (SURE) or less. Where fewer than k vectors are known the windows cover everything, which is exact.

    Queries go out in passes of PASS_BYTES; what a task holds is one pass and one block. A task returns k rows for a
    query at most, and only those that beat the ones known from the pilot.
    """
    spark = rows.sparkSession
    drawn = rows.orderBy(F.xxhash64("row"), "row").limit(PILOT_ROWS).toArrow()
    first = stored(pilot(queries, spark.sparkContext.broadcast(drawn), k), "pilot")
    total = queries.agg(F.sum(F.size("embedding") * 8 + 200).alias("n")).first()["n"] or 0
    passes = max(1, ceil(total / PASS_BYTES))
    path = shared_path(spark, "neighbours")
    for p in range(passes):
        def part(df: DataFrame, column: str) -> DataFrame:
            return df.where(F.pmod(F.xxhash64(column), F.lit(passes)) == p)

        known = [tuple(r) for r in part(first, "query").select("query", "row", "vec_id", "score").collect()]
        sent = spark.sparkContext.broadcast((part(queries, "row").toArrow(), known))
        rows.mapInArrow(_searcher(sent, k), FOUND).write.parquet(f"{path}/part={p}")
        sent.unpersist()
    found = first.unionByName(spark.read.schema(first.schema).parquet(*[f"{path}/part={p}" for p in range(passes)]))
    order = Window.partitionBy("query").orderBy("score", F.col("vec_id").asc_nulls_last(), "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, every: int = 100, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row whose vec_id is divisible by `every`.

    Rows that `usable` leaves out take no part; a row without vec_id is no query but can be found. Of repeated rows each
    is a query and a candidate by itself. A query without candidates has no rows, nor has an empty table. Other columns
    of `vectors` are not read.
    """
    rows = stored(usable(vectors), "vectors")
    return search(rows, rows.where(F.col("vec_id") % every == 0), k)
