"""SimHash near-duplicates: deletion-variant signatures of two half fingerprints, equality groups, verified links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.components import components
from ledgerloom.llm.support import spaced_words, stored

SEED = 42
MAX_BITS = 2
#: A bucket of more fingerprints than this is dealt out again by a finer key. Two levels of finer keys fix 48 bits or
#: more, so that no bucket can pass 2 ** 16 and the rounds end.
BUCKET_ROWS = 1 << 16
#: Buckets up to this size are compared pair by pair, all at once for a batch.
SMALL = 32
#: Linked fingerprints that a task remembers before it writes its links.
REMEMBERED = 500_000


def shingle_hashes(data: bytes | None) -> Iterator[np.ndarray]:
    """XXH64 (seed 42) of the 3-word shingles of a text, block by block; a text of one or two words is one shingle."""
    tail: list[bytes] = []
    n = 0
    digest = xxhash.xxh64_intdigest
    for block in spaced_words(data):
        words = tail + block
        n += len(block)
        if len(words) >= 3:
            yield np.array([digest(b" ".join(s), SEED) for s in zip(words, words[1:], words[2:])], dtype=np.uint64)
        tail = words[-2:]
    if 0 < n < 3:
        yield np.array([digest(b" ".join(tail), SEED)], dtype=np.uint64)


def fingerprint(data: bytes | None) -> int:
    """Signed 64-bit fingerprint: a bit is set if over half of the shingle hashes have it; no words give zero."""
    ones, n = np.zeros(64, dtype=np.int64), 0
    for hashes in shingle_hashes(data):
        for part in np.array_split(hashes, len(hashes) // 4096 + 1):
            ones += np.unpackbits(part.astype("<u8").view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int32)
        n += len(hashes)
    bits = np.packbits(2 * ones > n, bitorder="little")
    return int(bits.view("<i8")[0])


def _of_batch(texts: pa.Array) -> pa.Array:
    return pa.array([fingerprint(t.as_py()) for t in texts], pa.int64())


def fingerprint_column(text: Column) -> Column:
    return F.arrow_udf(_of_batch, T.LongType())(text.cast("binary"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of every row of `docs`; a null text has no words."""
    return docs.select("doc_id", fingerprint_column(F.col("text")).alias("fp"))


def variants(fp: Column) -> Column:
    """The 64 keys of a fingerprint: which half, which of its 32 bits is left out, and the 31 bits that remain.

    Of two fingerprints that differ in two bits at most, one half differs in one bit at most, so they share a key.
    """
    def key(j: Column) -> Column:
        half, bit = F.shiftright(j, 5), j.bitwiseAND(F.lit(31))
        value = F.when(half == 0, fp.bitwiseAND(F.lit(0xFFFFFFFF))).otherwise(F.shiftrightunsigned(fp, 32))
        out = F.expr("bigint(1)")
        left_out = F.call_function("shiftleft", out, bit)
        return F.call_function("shiftleft", j.cast("long"), F.lit(32)).bitwiseOR(value.bitwiseAND(F.bitwise_not(left_out)))

    return F.transform(F.sequence(F.lit(0), F.lit(63)), key)


def finer(key: Column, fp: Column, half: Column, level: int) -> Column:
    """Three keys that split a bucket: `key` with one third of the bits of the other half.

    At most two bits differ, so one of three thirds is the same in both. Level 0 cuts the half in a row, level 1 takes
    every third bit. The lowest bit of a key says which half the first key belonged to.
    """
    other = F.when(half == 0, F.shiftrightunsigned(fp, 32)).otherwise(fp.bitwiseAND(F.lit(0xFFFFFFFF)))
    masks = (0x000007FF, 0x003FF800, 0xFFC00000) if level == 0 else (0x49249249, 0x92492492, 0x24924924)
    return F.array(*[
        F.xxhash64(key, F.lit(t), other.bitwiseAND(F.lit(m))).bitwiseAND(F.lit(-2)).bitwiseOR(half.cast("long"))
        for t, m in enumerate(masks)])


def linked(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= MAX_BITS


class Forest:
    """Union by smallest root of the fingerprints that a task has linked."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        parent = self.parent
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while (up := parent.get(x, x)) != root:
            parent[x] = root
            x = up
        return root

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            low, high = (a, b) if a < b else (b, a)
            self.parent[high] = low
            self.parent.setdefault(low, low)

    def edges(self) -> list[tuple[int, int]]:
        return [(x, r) for x in self.parent if (r := self.find(x)) != x]


def _small_links(keys: np.ndarray, fps: np.ndarray, size: np.ndarray, place: np.ndarray, forest: Forest) -> None:
    """Link pairs inside the buckets of at most SMALL rows."""
    for lag in range(1, SMALL):
        at = np.flatnonzero((size <= SMALL) & (place + lag < size))
        if not len(at):
            return
        at = at[linked(fps[at], fps[at + lag])]
        pairs = np.unique(np.stack([fps[at], fps[at + lag]], axis=1), axis=0)
        for a, b in pairs.view(np.int64).tolist():
            forest.join(a, b)


def _large_links(fps: np.ndarray, forest: Forest) -> None:
    """Link a bucket by walking from each fingerprint to those not reached yet."""
    rest = fps
    while len(rest) > 1:
        todo, rest = [rest[0]], rest[1:]
        while todo and len(rest):
            x = todo.pop()
            near = linked(rest, x)
            if near.any():
                found = rest[near]
                rest = rest[~near]
                for y in found.view(np.int64).tolist():
                    forest.join(int(x.view(np.int64)), y)
                todo.extend(found)


def match(limit: int):
    """For mapInArrow over rows sorted by key: links (a, b, null) and rows of too large buckets (null, fp, key).

    At most `limit` rows of a bucket and REMEMBERED linked fingerprints are held.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        held_keys, held_fps = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        over: int | None = None  # the bucket that is passed on

        def rows(a, b, key) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(key, pa.int64())], names=["a", "b", "key"])

        def passed_on(keys, fps) -> pa.RecordBatch:
            return rows([None] * len(fps), fps.view(np.int64), keys)

        def links() -> pa.RecordBatch:
            edges = forest.edges()
            forest.parent.clear()
            return rows([e[0] for e in edges], [e[1] for e in edges], [None] * len(edges))

        def whole(keys: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
            """Buckets of which all rows are here."""
            if not len(keys):
                return
            first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            count = np.diff(np.r_[first, len(keys)])
            size, place = np.repeat(count, count), np.arange(len(keys)) - np.repeat(first, count)
            _small_links(keys, fps, size, place, forest)
            for k in np.flatnonzero(count > SMALL):
                part = slice(first[k], first[k] + count[k])
                if count[k] > limit:
                    yield passed_on(keys[part], fps[part])
                else:
                    _large_links(fps[part], forest)

        for batch in batches:
            keys = np.r_[held_keys, batch.column("key").to_numpy()]
            fps = np.r_[held_fps, batch.column("fp").to_numpy().view(np.uint64)]
            if over is not None:
                n = int(np.searchsorted(keys, over, side="right"))
                if n:
                    yield passed_on(keys[:n], fps[:n])
                    keys, fps = keys[n:], fps[n:]
                if len(keys):
                    over = None
            if not len(keys):
                held_keys, held_fps = keys, fps
                continue
            last = int(np.searchsorted(keys, keys[-1], side="left"))
            yield from whole(keys[:last], fps[:last])
            held_keys, held_fps = keys[last:], fps[last:]
            if len(held_keys) > limit:
                over = int(held_keys[0])
                yield passed_on(held_keys, held_fps)
                held_keys, held_fps = held_keys[:0], held_fps[:0]
            if len(forest.parent) > REMEMBERED:
                yield links()
        yield from whole(held_keys, held_fps)
        yield links()

    return run


def links(fps: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Links (a, b) that connect the distinct fingerprints `fps` (column fp) exactly as all links would.

    Within a bucket links form a forest instead of all pairs. Fingerprints that differ in one bit, or not at all, in a
    half share a key, so every link is seen in some bucket, and every link is verified on all 64 bits.
    """
    fp = F.col("fp")
    keyed = fps.select("fp", F.explode(variants(fp)).alias("key"))
    found = []
    for level in (0, 1, 2):
        ordered = keyed.select("key", "fp").repartition("key").sortWithinPartitions("key", "fp")
        limit = bucket_rows if level < 2 else 1 << 62
        out = stored(ordered.mapInArrow(match(limit), "a long, b long, key long"), "links")
        found.append(out.where("a is not null").select("a", "b"))
        rest = out.where("a is null").select(F.col("b").alias("fp"), "key")
        if rest.isEmpty():
            break
        half = F.shiftrightunsigned("key", 37) if level == 0 else F.col("key").bitwiseAND(F.lit(1).cast("long"))
        keyed = rest.select("fp", F.explode(finer(F.col("key"), fp, half, level)).alias("key"))
    all_links = found[0]
    for more in found[1:]:
        all_links = all_links.unionByName(more)
    return all_links.distinct()


def groups(docs: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(doc_id, fp, root, component_id) of every row of `docs`; `root` is the component's smallest fingerprint.

    `component_id` is the smallest doc_id reachable over links of at most two differing bits, the row's own included.
    Rows without an id take part and get the id of their component, or null if no row of it has an id. Rows without
    words share the fingerprint zero. Repeated rows each come back. An empty table gives an empty result.
    """
    return grouped(stored(fingerprints(docs), "fingerprints"), bucket_rows)


def grouped(prints: DataFrame, bucket_rows: int = BUCKET_ROWS, more: DataFrame | None = None) -> DataFrame:
    """As `groups`, from stored rows (doc_id, fp); `more` are further links (a, b) between their fingerprints."""
    distinct = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    between = links(distinct.select("fp"), bucket_rows)
    star = components(between if more is None else between.unionByName(more))
    members = star.select(F.col("node").alias("fp"), "root").unionByName(
        star.select(F.col("root").alias("fp"), "root").distinct())
    rooted = members.join(distinct, "fp")
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component"))
    named = rooted.select("fp", "root").join(smallest, "root").select("fp", "root", "component")
    of_print = distinct.join(named, "fp", "left").select(
        "fp", F.coalesce("root", "fp").alias("root"),
        F.when(F.col("root").isNotNull(), F.col("component")).otherwise(F.col("first")).alias("component_id"))
    return prints.join(stored(of_print, "components"), "fp").select("doc_id", "fp", "root", "component_id")


def hexadecimal(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row of `docs`."""
    return groups(docs).select("doc_id", hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """The rows of `docs` with one document of each group: the one whose doc_id is the component's.

    `members` are the rows that `groups` gives, if other links than its own are to count as well.

    Where that id stands on several rows of a group, or where no row of a group has an id, one of the rows stays: the one
    with the smallest hash of all its columns.
    """
    names = docs.columns
    marked = stored(groups(docs) if members is None else members, "groups")
    kept = marked.where(F.col("doc_id") == F.col("component_id"))
    rows = stored(kept.groupBy("doc_id").agg(F.count("*").alias("rows")), "kept")
    out = docs.join(rows.where("rows = 1").select("doc_id"), "doc_id", "left_semi")
    several = rows.where("rows > 1").select("doc_id")
    if not several.isEmpty():
        repeated = docs.join(several, "doc_id", "left_semi")
        out = out.unionByName(_one_of_each(repeated, kept.join(several, "doc_id", "left_semi"), True).select(names))
    unnamed = marked.where("component_id is null")
    if not unnamed.isEmpty():
        out = out.unionByName(_one_of_each(docs.where("doc_id is null"), unnamed, False).select(names))
    return out.select(names)


def _one_of_each(docs: DataFrame, marked: DataFrame, by_id: bool) -> DataFrame:
    """One of the rows of `docs` for each group in `marked`, and for each id if `by_id`; groups are found by fingerprint."""
    of_row = "_fingerprint_of_row"
    root = marked.select(F.col("fp").alias(of_row), F.col("root").alias("_root"), *([F.col("doc_id").alias("_id")] if by_id else [])).distinct()
    on = F.col(of_row) == F.col("_of_row")
    rows = docs.withColumn("_of_row", fingerprint_column(F.col("text"))).join(root, on & (F.col("doc_id") == F.col("_id")) if by_id else on)
    first = Window.partitionBy(*["_root", "_id"][:1 + by_id]).orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]), "text")
    return rows.withColumn("_place", F.row_number().over(first)).where("_place = 1")
