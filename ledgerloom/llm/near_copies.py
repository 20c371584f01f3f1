"""Near copies: 5-word shingles, similarity 0.8 or more; MinHash bands find candidates, whole shingle sets decide.

SimHash keys can't find these pairs (they differ in 3 to 17 bits), so the groups here are those of the SimHash operator
with further links: between texts whose sets of 5-word shingles have a Jaccard similarity of 0.8 or more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm import simhash
from ledgerloom.llm.components import components
from ledgerloom.llm.support import spaced_words, stored

WORDS = 5
#: Similarity as a fraction: 4 / 5.
SHARE, OF = 4, 5
BANDS, ROWS = 20, 4
HASHES = BANDS * ROWS
#: Pairs with fewer equal bytes of the 80 are no candidates: of pairs at 0.8 about 1 in 100,000 has fewer.
LEAST_EQUAL = 48
#: Bits of the filter in front of the join with texts, in pages of 32,768: 2 MB at most, however many sets are asked for.
FILTER_BITS = 1 << 24

_draw = np.random.Generator(np.random.PCG64(20))
_TIMES = _draw.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _draw.integers(0, 1 << 63, HASHES, dtype=np.uint64)
_WORD_TIMES = _draw.integers(0, 1 << 63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)

SHINGLED = T.StructType([
    T.StructField("sig", T.LongType()), T.StructField("n", T.LongType()), T.StructField("low", T.BinaryType()),
    T.StructField("bands", T.ArrayType(T.LongType()))])
WHOLE = T.StructType([T.StructField("sig", T.LongType()), T.StructField("shingles", T.ArrayType(T.LongType()))])


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(29))


def shingle_set(data: bytes | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the 5-word shingles of a text, A-Z lower-cased; fewer words are one shingle."""
    known: dict[bytes, int] = {}
    digest = xxhash.xxh64_intdigest
    tail, parts = np.zeros(0, np.uint64), []

    def of_words(hashes: np.ndarray) -> np.ndarray:
        n = max(len(hashes) - WORDS + 1, 1)
        total = np.zeros(n, np.uint64)
        for k in range(min(WORDS, len(hashes))):
            total += _mixed(hashes[k:k + n] * _WORD_TIMES[k])
        return _mixed(total)

    for block in spaced_words(data):
        for w in set(block).difference(known):
            known[w] = digest(w)
        words = np.r_[tail, np.fromiter((known[w] for w in block), np.uint64, len(block))]
        if len(words) >= WORDS:
            parts.append(np.unique(of_words(words)))
            tail = words[-(WORDS - 1):]
        else:
            tail = words
        if len(known) > 1 << 20:
            known.clear()
    if not parts and len(tail):
        parts.append(of_words(tail))
    return np.unique(np.concatenate(parts)) if parts else tail


def _least(hashes: np.ndarray) -> np.ndarray:
    out = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for part in np.array_split(hashes, len(hashes) // 1024 + 1):
        out = np.minimum(out, (part[:, None] * _TIMES + _PLUS).min(axis=0))
    return out


def _set_id(hashes: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(hashes.tobytes()) - (1 << 63)


def shingled(data: bytes | None) -> dict | None:
    """A text's set id, size, 80 signature bytes and 20 band keys; None if it has no words."""
    hashes = shingle_set(data)
    if not len(hashes):
        return None
    least = _least(hashes)
    return {
        "sig": _set_id(hashes), "n": len(hashes), "low": (_mixed(least) & np.uint64(255)).astype(np.uint8).tobytes(),
        "bands": [(xxhash.xxh64_intdigest(b.tobytes(), k) - (1 << 63)) // 32 * 32 + k for k, b in enumerate(least.reshape(BANDS, ROWS))]}


def whole(data: bytes | None) -> dict:
    """A text's set id and its shingle hashes."""
    hashes = shingle_set(data)
    return {"sig": _set_id(hashes), "shingles": hashes.view(np.int64)}


_ARROW = pa.struct([("sig", pa.int64()), ("n", pa.int64()), ("low", pa.binary()), ("bands", pa.list_(pa.int64()))])
_ARROW_WHOLE = pa.struct([("sig", pa.int64()), ("shingles", pa.list_(pa.int64()))])


def shingled_column(text: Column) -> Column:
    return F.arrow_udf(lambda texts: pa.array([shingled(t.as_py()) for t in texts], _ARROW), SHINGLED)(text.cast("binary"))


def whole_column(text: Column) -> Column:
    return F.arrow_udf(lambda texts: pa.array([whole(t.as_py()) for t in texts], _ARROW_WHOLE), WHOLE)(text.cast("binary"))


def _near(low: np.ndarray, n: np.ndarray, one_low: np.ndarray, one_n: int) -> np.ndarray:
    """Which rows can be near copies of one: sizes allow it, and enough signature bytes are equal."""
    fits = (OF * np.minimum(n, one_n) >= SHARE * np.maximum(n, one_n))
    return fits & ((low == one_low).sum(axis=1) >= LEAST_EQUAL)


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    low = np.frombuffer(b"".join(batch.column("low").to_pylist()), np.uint8).reshape(-1, HASHES)
    return *(batch.column(c).to_numpy() for c in ("key", "sig", "n")), low


def _buckets(key: np.ndarray) -> Iterator[slice]:
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else []
    for a, b in zip(starts, [*starts[1:], len(key)]):
        yield slice(int(a), int(b))


def led(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by key: (key, sig, leader), the leader being the first row of the bucket that can be a near copy.

    A row without one leads itself. Only the leaders of one bucket are held.
    """
    key_now, leaders, sizes, lows = None, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, HASHES), np.uint8)
    for batch in batches:
        key, sig, n, low = _columns(batch)
        out = np.empty(len(key), np.int64)
        for part in _buckets(key):
            if key[part.start] != key_now:
                key_now, leaders, sizes, lows = key[part.start], leaders[:0], sizes[:0], lows[:0]
            rest = np.arange(part.start, part.stop)
            place = 0
            while len(rest):
                if place == len(leaders):
                    first = rest[0]
                    leaders, sizes = np.r_[leaders, sig[first]], np.r_[sizes, n[first]]
                    lows = np.vstack([lows, low[first:first + 1]])
                near = _near(low[rest], n[rest], lows[place], sizes[place])
                out[rest[near]] = leaders[place]
                rest = rest[~near]
                place += 1
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(sig), pa.array(out)], names=["key", "sig", "leader"])


def _first_shared(low: np.ndarray, one_low: np.ndarray, band: int) -> np.ndarray:
    """Which rows share `band`, but none before it, with one: each pair is looked at in one bucket only."""
    equal = (low == one_low).reshape(-1, BANDS, ROWS).all(axis=2)
    return equal[:, band] & ~equal[:, :band].any(axis=1)


def _alike(a: np.ndarray, b: np.ndarray) -> bool:
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return (OF + SHARE) * shared >= SHARE * (len(a) + len(b))


def across(exact: bool):
    """For mapInArrow over rows sorted by key, the rows outside the bucket's main group first.

    Every pair of different groups has an end outside the main group; only those rows are held. If not `exact`, rows
    (a, b) are the key and the set id of each row with a possible near copy in another group. If `exact`, they are links
    between set ids, found on whole sets, that join groups of the bucket; groups joined already are not joined again.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key_now, held, held_sets, seen, joined = None, None, [], np.zeros(0, bool), simhash.Forest()
        for batch in batches:
            key, sig, n, low = _columns(batch)
            root, main = batch.column("root").to_numpy(), batch.column("main").to_numpy(zero_copy_only=False)
            sets = [x.values.to_numpy() for x in batch.column("shingles")] if exact else []
            found_a, found_b = [], []
            for part in _buckets(key):
                if key[part.start] != key_now:
                    key_now, held, held_sets, seen = key[part.start], (sig[:0], n[:0], low[:0], root[:0]), [], np.zeros(0, bool)
                    joined.parent.clear()
                inside = np.arange(part.start, part.stop)
                outside = inside[~main[inside]]
                known = len(seen)
                if len(outside):
                    held = tuple(np.concatenate([h, c[outside]]) for h, c in zip(held, (sig, n, low, root)))
                    seen = np.r_[seen, np.zeros(len(outside), bool)]
                    held_sets += [sets[i] for i in outside] if exact else []
                met = np.zeros(len(inside), bool)
                for at in range(len(seen)):
                    # a row held before meets all rows of this batch; one held now meets those after it
                    others = inside if at < known else inside[inside > outside[at - known]]
                    others = others[root[others] != held[3][at]]
                    others = others[_near(low[others], n[others], held[2][at], held[1][at])]
                    others = others[_first_shared(low[others], held[2][at], int(key_now) & 31)]
                    if exact:
                        one = int(held[3][at])
                        for other in others.tolist():
                            if joined.find(one) != joined.find(int(root[other])) and _alike(held_sets[at], sets[other]):
                                joined.join(one, int(root[other]))
                                found_a.append(int(held[0][at]))
                                found_b.append(int(sig[other]))
                    elif len(others):
                        met[others - part.start] = True
                        if at < known and not seen[at]:
                            found_a.append(int(key_now))
                            found_b.append(int(held[0][at]))
                        elif at >= known:
                            met[outside[at - known] - part.start] = True
                        seen[at] = True
                if not exact:
                    if len(outside):
                        seen[known:] |= met[outside - part.start]
                    found_a += key[inside[met]].tolist()
                    found_b += sig[inside[met]].tolist()
            if found_a:
                yield pa.RecordBatch.from_arrays([pa.array(found_a, pa.int64()), pa.array(found_b, pa.int64())], names=["a", "b"])

    return run


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of set ids whose whole sets have a similarity of 0.8 or more."""
    def of(side: str) -> DataFrame:
        return sets.select(F.col("sig").alias(side), F.col("shingles").alias(f"of_{side}"))

    both = pairs.join(of("b"), "b").join(of("a"), "a")
    shared = F.size(F.array_intersect("of_a", "of_b"))
    # shared / (|a| + |b| - shared) >= SHARE / OF
    return both.where((OF + SHARE) * shared >= SHARE * (F.size("of_a") + F.size("of_b"))).select("a", "b")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def crowded(sets: DataFrame) -> DataFrame:
    """(key, sig) of the buckets that hold two sets or more; a set alone in all its buckets has no near copy."""
    keyed = sets.select(F.explode("bands").alias("key"), "sig")
    several = keyed.groupBy("key").agg(F.min("sig").alias("least"), F.max("sig").alias("most")).where("least < most").select("key")
    return keyed.join(several, "key", "left_semi")


def likely(texts: DataFrame, asked: DataFrame) -> DataFrame:
    """The rows of `texts` whose `copy` is among those `asked`, and few others: so the rest need no shuffle to be dropped.

    A bit is set for each copy asked for. Texts that only share a bit with one are left to the join that follows.
    """
    place = F.pmod("copy", F.lit(FILTER_BITS))
    page, bit = F.floor(place / 32768).cast("int"), (place % 32768).cast("int")
    pages = asked.select(page.alias("page"), bit.alias("bit")).groupBy("page").agg(F.bitmap_construct_agg("bit").alias("bits"))
    found = texts.withColumns({"page": page, "bit": bit}).join(F.broadcast(pages), "page")
    byte = F.conv(F.hex(F.expr("substring(bits, bit div 8 + 1, 1)")), 16, 10).cast("int")
    return found.where((byte / F.pow(F.lit(2), F.col("bit") % 8)).cast("int") % 2 == 1).select(*texts.columns)


def whole_sets(sets: DataFrame, wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """(sig, shingles) of the sets `wanted` (sig), made anew from one text of each, so that no other set is written."""
    # written first, as it is read twice
    asked = stored(sets.join(wanted, "sig").select("copy", F.col("sig").alias("asked")), "asked")
    texts = likely(docs.select("text").where("text is not null").withColumn("copy", copy_of(F.col("text"))), asked).join(asked, "copy")
    one = texts.groupBy("copy", "asked", F.xxhash64("text", F.lit(1)).alias("_again")).agg(F.min("text").alias("text"))
    made = one.select("asked", whole_column(F.col("text")).alias("w")).where("w.sig = asked").select("w.*")
    return made.groupBy("sig").agg(F.first("shingles").alias("shingles"))


def set_links(sets: DataFrame, docs: DataFrame) -> DataFrame:
    """Links (a, b) between set ids that connect the sets of `sets` as all links of 0.8 or more would.

    First each row of a bucket meets its leader. What the verified links leave in several groups within a bucket is
    compared across the groups: rows with a possible partner are marked, and only they bring their whole sets along.
    Each step writes no more rows than it reads. Equal sets are one row, so copies cost nothing here. A band's lowest
    five bits are its number.
    """
    buckets = stored(crowded(sets), "buckets")
    keyed = buckets.join(sets.select("sig", "n", "low"), "sig")
    # by a hash within a bucket, so a row meets other leaders in its other buckets
    sorted_rows = keyed.repartition("key").sortWithinPartitions("key", F.xxhash64("key", "sig"), "sig")
    leads = stored(sorted_rows.mapInArrow(led, "key long, sig long, leader long"), "leads")
    pairs = stored(_ordered(leads.select(F.col("sig").alias("a"), F.col("leader").alias("b"))), "pairs")
    first_sets = stored(whole_sets(sets, pairs.select(F.explode(F.array("a", "b")).alias("sig")).distinct(), docs), "whole-sets")
    first = stored(verified(pairs, first_sets), "near-links")
    roots = components(first)
    placed = leads.select("key", "sig").join(roots.withColumnRenamed("node", "sig"), "sig", "left").select(
        "key", "sig", F.coalesce("root", "sig").alias("root"))
    placed = stored(placed, "placed")
    sizes = placed.groupBy("key", "root").agg(F.count("*").alias("rows"))
    mixed = sizes.groupBy("key").agg(F.max(F.struct("rows", "root")).alias("most"), F.count("*").alias("groups")).where("groups > 1")
    rows = placed.join(mixed.select("key", F.col("most.root").alias("largest")), "key").select(
        "key", "sig", "root", (F.col("root") == F.col("largest")).alias("main"))
    possible = _sorted(rows.join(sets.select("sig", "n", "low"), "sig")).mapInArrow(across(False), "a long, b long")
    marked = stored(possible.select(F.col("a").alias("key"), F.col("b").alias("sig")).distinct(), "marked")
    asked = marked.select("sig").distinct()
    more = whole_sets(sets, asked.join(first_sets, "sig", "left_anti"), docs)
    again = rows.join(marked, ["key", "sig"]).join(sets.select("sig", "n", "low"), "sig").join(
        first_sets.join(asked, "sig", "left_semi").unionByName(more), "sig")
    second = stored(_sorted(again).mapInArrow(across(True), "a long, b long"), "near-links")
    return first.unionByName(second)


def copy_of(text: Column) -> Column:
    """Names the texts that are the same; different texts of one name are told apart by their sets."""
    return F.xxhash64(text)


def _sorted(rows: DataFrame) -> DataFrame:
    return rows.repartition("key").sortWithinPartitions("key", "main", "sig")


def groups(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, root, component_id) as by `simhash.groups`, with links between near copies as well.

    Near copies have 0.8 or more of their 5-word shingles in common (distinct shingles of the union, A-Z lower-cased,
    words parted by white space); a text of one to four words is one shingle. Texts without words, null or empty, are
    one group. Rows without an id take part. An empty table gives an empty result.
    """
    text = F.col("text")
    prints = stored(docs.select(
        "doc_id", simhash.fingerprint_column(text).alias("fp"), copy_of(text).alias("copy"), shingled_column(text).alias("s")), "shingled")
    sets = prints.where("s is not null").select("fp", "copy", "s.*").groupBy("sig").agg(
        F.min("fp").alias("fp"), F.min("copy").alias("copy"), F.first("n").alias("n"), F.first("low").alias("low"), F.first("bands").alias("bands"))
    sets = stored(sets, "sets")
    fp_of = sets.select("sig", "fp")
    between = set_links(sets, docs).join(fp_of.select(F.col("sig").alias("a"), F.col("fp").alias("fa")), "a").join(
        fp_of.select(F.col("sig").alias("b"), F.col("fp").alias("fb")), "b").select(F.col("fa").alias("a"), F.col("fb").alias("b"))
    # copies of one set whose fingerprints differ, as repeats of a shingle count there
    same = prints.where("s is not null").select("fp", F.col("s.sig").alias("sig")).distinct().join(
        fp_of.withColumnRenamed("fp", "least"), "sig").select(F.col("fp").alias("a"), F.col("least").alias("b"))
    return simhash.grouped(prints.select("doc_id", "fp"), more=_ordered(between.unionByName(same)))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of `docs` with one document of each group, chosen as by `simhash.keep_one`."""
    return simhash.keep_one(docs, groups(docs))
