"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The symbols are words. Test strings of one length are searched together: a shift table over blocks of two words says how
far the window may move on, buckets of the last block select test strings, and comparing the words confirms them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from itertools import chain
from math import ceil

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.support import plain_words, stored

WINDOW = 13
#: Benchmark text is searched in blocks of about this many bytes, so that the tables sent to executors stay bounded.
BLOCK_OF_ITEMS = 16 << 20

FOUND = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("item_ids", T.ArrayType(T.StringType())),
    T.StructField("places", T.ArrayType(T.IntegerType())),
])


class Patterns:
    """Shift and bucket tables of test strings that all have `length` words."""

    def __init__(self, length: int) -> None:
        self.length, self.block = length, min(2, length)
        self.far = length - self.block + 1
        self.shift: dict[bytes, int] = {}
        self.buckets: dict[bytes, dict[bytes, list[str]]] = {}

    def add(self, words: list[bytes], item: str | None) -> None:
        for end in range(self.block, self.length + 1):
            block = b" ".join(words[end - self.block:end])
            self.shift[block] = min(self.shift.get(block, self.far), self.length - end)
        items = self.buckets.setdefault(b" ".join(words[-self.block:]), {}).setdefault(b" ".join(words), [])
        if item is not None and (not items or items[-1] != item):
            items.append(item)

    def search(self, words: list[bytes]) -> Iterator[tuple[int, list[str]]]:
        """(place of the last word, items) of every occurrence."""
        n, size, two, far, shift = len(words), self.length, self.block == 2, self.far, self.shift.get
        p = size - 1
        while p < n:
            block = words[p - 1] + b" " + words[p] if two else words[p]
            if step := shift(block, far):
                p += step
                continue
            items = self.buckets[block].get(b" ".join(words[p - size + 1:p + 1]))
            if items is not None:  # an item without an id has windows, but nothing to report
                yield p, items
            p += 1


def compiled(items: Iterable[tuple[str | None, bytes]], window: int = WINDOW) -> list[Patterns]:
    """Tables by length. An item of fewer words than a window is one test string; an item without words is none."""
    tables: dict[int, Patterns] = {}
    for item, text in items:
        words = [w for block in plain_words(text) for w in block]
        size = min(window, len(words))
        for at in range(len(words) - size + 1 if size else 0):
            tables.setdefault(size, Patterns(size)).add(words[at:at + size], item)
    return list(tables.values())


def scan(data: bytes | None, tables: list[Patterns]) -> dict:
    """Words, hit places and items of one text, in blocks that overlap by one word less than the longest test string."""
    overlap = max((t.length for t in tables), default=1) - 1
    tail: list[bytes] = []
    n_words = 0
    places: set[int] = set()
    items: set[str] = set()
    for block in plain_words(data):
        words = tail + block
        base = n_words - len(tail)
        n_words += len(block)
        for table in tables:
            for end, found in table.search(words):
                items.update(found)
                places.update(range(base + end - table.length + 1, base + end + 1))
        tail = words[-overlap:] if overlap else []
    return {"n_words": n_words, "n_hit": len(places), "item_ids": sorted(items), "places": sorted(places)}


def _scanner(broadcast) -> Callable[[pa.Array], pa.Array]:
    kept: list[list[Patterns]] = []

    def run(texts: pa.Array) -> pa.Array:
        if not kept:
            kept.append(compiled(broadcast.value))
        return pa.array([scan(t.as_py(), kept[0]) for t in texts], pa.struct([
            ("n_words", pa.int64()), ("n_hit", pa.int64()), ("item_ids", pa.list_(pa.string())), ("places", pa.list_(pa.int32()))]))

    return run


def benchmark_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_OF_ITEMS) -> Iterator[list[tuple[str | None, bytes]]]:
    """(item_id, text) of the benchmark in blocks of about `block_bytes`, one at a time.

    Items without text have no words and are left out; repeated rows count once.
    """
    items = benchmark.where("text is not null").select(
        F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("binary").alias("text")).distinct()
    total = items.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    blocks = max(1, ceil(total / block_bytes))
    for k in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        yield [(r["item_id"], bytes(r["text"])) for r in part.toLocalIterator()]


def contamination(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_OF_ITEMS) -> DataFrame:
    """All columns of `docs` beside one struct `found` (n_words, n_hit, item_ids, contaminated).

    A word is hit if it is part of any occurrence of 13 consecutive words of an item; a document is contaminated if a
    twentieth of its words or more are hit. Windows of items without an id hit words too; only ids are reported. A null or
    empty text has no words and is clean. An empty benchmark finds nothing. Rows are kept as they are, repeated ones,
    those without an id and columns of any name too.

    A benchmark of one block is searched in one pass over `docs`. A larger one takes a pass for each block, whose finds
    go to the shared folder, so driver and executors hold the tables of one block at a time.
    """
    context = docs.sparkSession.sparkContext
    blocks = benchmark_blocks(benchmark, block_bytes)
    first, second = next(blocks), next(blocks, None)
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")

    def search(text: Column, block: list[tuple[str | None, bytes]]) -> tuple[Column, Broadcast]:
        sent = context.broadcast(block)
        return F.arrow_udf(_scanner(sent), FOUND)(text.cast("binary")).alias("found"), sent

    if second is None:
        rows = docs.select(whole, search(F.col("text"), first)[0])
        return rows.select("row", _judged(F.col("found.n_words"), F.col("found.n_hit"), F.col("found.item_ids")))
    numbered = stored(docs.select(F.monotonically_increasing_id().alias("number"), whole), "numbered")
    parts = []
    for block in chain((first, second), blocks):
        found, sent = search(F.col("row.text"), block)
        hits = numbered.select("number", found).select("number", "found.*")
        parts.append(stored(hits if not parts else hits.where("n_hit > 0"), "hits"))  # the first pass has all rows
        sent.destroy()
    merged = reduce(DataFrame.unionByName, parts).groupBy("number").agg(
        F.max("n_words").alias("n_words"), F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"))
    return numbered.join(merged, "number").select(
        "row", _judged(F.col("n_words"), F.size("places").cast("long"), F.col("item_ids")))


def _judged(n_words: Column, n_hit: Column, item_ids: Column) -> Column:
    return F.struct(
        n_words.alias("n_words"), n_hit.alias("n_hit"), item_ids.alias("item_ids"),
        ((n_hit > 0) & (20 * n_hit >= n_words)).alias("contaminated")).alias("found")


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every row of `docs`."""
    found = F.col("found")
    return contamination(docs.select("doc_id", "text"), benchmark).select(
        F.col("row.doc_id").alias("doc_id"), found["n_words"].alias("n_words"), found["n_hit"].alias("n_hit"),
        F.size(found["item_ids"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(found["item_ids"], ","), 256).alias("items_sha256"), found["contaminated"].alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs` that are not contaminated."""
    return contamination(docs, benchmark).where(~F.col("found.contaminated")).select("row.*")
