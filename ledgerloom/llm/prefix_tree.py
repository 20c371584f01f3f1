"""Conversation prefix trie by burst tries: suffix containers under trie heads burst by their next turn while they are
too large; the others are sorted and swept into nodes.

A turn's key is 128 bits of a SHA-256 over role and text, written as 32 hexadecimal digits; a path is a row of keys, so
paths sort and compare as strings. Conversations are cut into segments of SEGMENT turns. Segments are worked from the last
to the first, so that what lies below a cut is known when the part above is swept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.support import stored

#: Digits of a turn's key.
KEY = 32
#: Turns of a conversation that are held in one row.
SEGMENT = 4096
#: Turns of a container beyond which it bursts.
LIMIT = 4096
#: A conversation borrows fewer turns than this from the one that leads its block of BLOCK ids.
HEADS, BLOCK = 4, 20
WORD = r"[^\x20\x09-\x0D]+"
#: Nodes that a task holds before it passes them on; those of a container stay together.
HELD_NODES = 10_000

NODES = ("head string, parent string, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, "
         "n_leaves long, saved_tokens long, class string")


def _positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conv_id get their place in it, from 1, and the number of the partition."""
    part, last, place = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        places = []
        for c in batch.column("conv_id").to_pylist():
            place = place + 1 if c == last else 1
            last = c
            places.append(place)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(places, pa.int64()), pa.array([part] * len(places), pa.int32())], names=[*batch.schema.names, "place", "part"])


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, at, key, words): a conversation's turns numbered from 1 by turn, null first, at a tie by key.

    Rows are dealt out by ranges of conversation and turn, so a conversation of any length is spread over tasks; a
    partition's count of a conversation's rows moves the numbers of the partitions after it.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long"), F.col("turn"),
        F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, KEY).alias("key"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("key")]
    placed = stored(
        rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "key", "words")
        .mapInArrow(_positions, "conv_id long, key string, words long, place long, part int"), "turns")
    parts = placed.groupBy("conv_id", "part").agg(F.count("*").alias("rows"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    moved = parts.select("conv_id", "part", F.sum("rows").over(earlier).alias("before")).where("before is not null")
    return placed.join(moved, ["conv_id", "part"], "left").select(
        "conv_id", (F.col("place") + F.coalesce("before", F.lit(0))).alias("at"), "key", "words")


def rebuilt(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rebuilt conversations' turns (conv_id, at, key, words), and (conv_id, length) of all of them, turnless ones too.

    A conversation c gets the first h turns of conversation c - c % 20, as many as there are, in place of its own first h;
    h is the unsigned CRC-32 of c in decimal, modulo 4.
    """
    borrows = F.crc32(F.col("conv_id").cast("string")) % HEADS
    convs = rows.groupBy("conv_id").agg(F.count("*").alias("own")).withColumn("h", borrows)
    leader = (F.col("conv_id") - F.col("conv_id") % BLOCK).alias("leader")
    given = convs.select("conv_id", leader, "own", "h").join(
        convs.select(F.col("conv_id").alias("leader"), F.col("own").alias("offers")), "leader", "left")
    convs = stored(given.withColumn("taken", F.least("h", F.coalesce("offers", F.lit(0)))), "conversations")
    heads = rows.where(F.col("at") < HEADS).select(F.col("conv_id").alias("leader"), "at", "key", "words")
    borrowed = convs.where("taken > 0").join(heads, "leader").where("at <= taken").select("conv_id", "at", "key", "words")
    short = convs.where("taken < h").select("conv_id", (F.col("h") - F.col("taken")).alias("gap"))
    own = rows.where(F.col("at") > borrows).join(short, "conv_id", "left").select(
        "conv_id", (F.col("at") - F.coalesce("gap", F.lit(0))).alias("at"), "key", "words")
    lengths = convs.select("conv_id", (F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("length"))
    return borrowed.unionByName(own), lengths


def segments(rows: DataFrame, lengths: DataFrame, size: int = SEGMENT) -> DataFrame:
    """(conv_id, segment, last, head, next, path, words): conversations in segments of `size` turns.

    A conversation ends inside its last segment, which is empty where the length is a multiple of `size`; all others are
    full. `head` stands for everything before the segment and `next` for everything before the next one.
    """
    number = F.floor((F.col("at") - 1) / size)
    turn = F.struct("at", "key", "words")
    cut = rows.withColumn("segment", number).groupBy("conv_id", "segment").agg(F.array_sort(F.collect_list(turn)).alias("turns")).select(
        "conv_id", "segment", F.array_join("turns.key", "").alias("path"), F.col("turns.words").alias("words"))
    ends = lengths.where(F.col("length") % size == 0).select(
        "conv_id", F.floor(F.col("length") / size).alias("segment"), F.lit("").alias("path"), F.array().cast("array<bigint>").alias("words"))
    several = lengths.where(F.col("length") >= size).select("conv_id", F.floor(F.col("length") / size).alias("last"))
    parts = stored(cut.unionByName(ends).join(several, "conv_id", "left").withColumn("last", F.coalesce("last", F.lit(0))), "segments")
    hashes = parts.where("last > 0").select("conv_id", "segment", *[F.xxhash64(F.lit(k), "segment", "path").alias(f"h{k}") for k in (1, 2)])
    to = Window.partitionBy("conv_id").orderBy("segment").rowsBetween(Window.unboundedPreceding, 0)
    name = F.concat(*[F.lpad(F.hex(F.bit_xor(f"h{k}").over(to)), 16, "0") for k in (1, 2)])
    chained = hashes.select("conv_id", "segment", name.alias("next"))
    heads = chained.select("conv_id", (F.col("segment") + 1).alias("segment"), F.col("next").alias("head"))
    return parts.join(chained, ["conv_id", "segment"], "left").join(heads, ["conv_id", "segment"], "left").withColumn(
        "head", F.coalesce("head", F.lit("")))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (class, conv_id) in order: the SHA-256 of the ids of each class in decimal, joined by commas."""
    last, digest = None, None
    for batch in batches:
        done: list[tuple[str, str]] = []
        for name, conv in zip(batch.column("class").to_pylist(), batch.column("conv_id").to_pylist()):
            if name == last:
                digest.update(b",%d" % conv)
                continue
            if last is not None:
                done.append((last, digest.hexdigest()))
            last, digest = name, hashlib.sha256(b"%d" % conv)
        yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], pa.string()) for k in (0, 1)], names=["class", "ends_sha256"])
    if last is not None:
        yield pa.RecordBatch.from_arrays([pa.array([last]), pa.array([digest.hexdigest()])], names=["class", "ends_sha256"])


def end_digests(parts: DataFrame) -> DataFrame:
    """(class, ends_sha256) of the conversations that end alike. A SHA-256 is one pass over its ids in order; it is taken as a stream."""
    ends = parts.where("segment = last").select(class_of().alias("class"), "conv_id")
    return ends.repartition("class").sortWithinPartitions("class", "conv_id").mapInArrow(_digests, "class string, ends_sha256 string")


def class_of() -> Column:
    return F.sha2(F.concat_ws("/", F.col("segment").cast("string"), "head", "path"), 256)


def _nodes(rows: list[dict]) -> Iterator[tuple]:
    """The nodes of one container, from its suffixes in order of path. The first is the container's head itself."""
    first = rows[0]
    # depth, conv_id, n_convs, n_children, n_leaves, saved_tokens, class, words, parent
    tree = [[first["depth"], None, 0, 0, 0, 0, None, first["top_words"], None]]
    line, before = [0], ""
    for row in rows:
        path, same = row["path"], 0
        while same < len(line) - 1 and path.startswith(before[KEY * same:KEY * (same + 1)], KEY * same) and KEY * same < len(path):
            same += 1
        del line[same + 1:]
        for k in range(same, len(path) // KEY):
            tree.append([first["depth"] + k + 1, None, 0, 0, 0, 0, None, row["words"][k], line[-1]])
            line.append(len(tree) - 1)
        node = tree[line[-1]]
        node[1] = row["conv_id"] if node[1] is None else min(node[1], row["conv_id"])
        node[2] += row["n"]
        node[3] += row["n_children"]
        node[4] += row["n_leaves"]
        node[5] += row["saved_tokens"]
        node[6] = row["class"]
        before = path
    for node in reversed(tree):
        if not node[3]:
            node[4] = 1
        node[5] += (node[2] - 1) * node[7]
        if node[8] is not None:
            up = tree[node[8]]
            up[1] = node[1] if up[1] is None else min(up[1], node[1])
            up[2] += node[2]
            up[3] += 1
            up[4] += node[4]
            up[5] += node[5]
    for k, (depth, conv, n, children, leaves, saved, end, _, parent) in enumerate(tree):
        yield (first["head"], None if k else first["parent"], depth, conv, tree[parent][1] if k else first["parent_conv_id"], n, children, leaves, saved, end)


def _swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Suffixes sorted by head and path become nodes. One container is held at a time."""
    kinds = (pa.string(), pa.string(), *[pa.int64()] * 7, pa.string())
    names = [c.split()[0] for c in NODES.split(", ")]
    held: list[dict] = []
    done: list[tuple] = []

    def out() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), kinds)], names=names)
        done.clear()
        return made

    for batch in batches:
        for row in batch.to_pylist():
            if held and row["head"] != held[0]["head"]:
                done.extend(_nodes(held))
                held = []
                if len(done) >= HELD_NODES:
                    yield out()
            held.append(row)
    if held:
        done.extend(_nodes(held))
    if done:
        yield out()


def shared_turns(low: Column, high: Column) -> Column:
    """How many turns two paths begin with in common."""
    n = (F.least(F.length(low), F.length(high)) / KEY).cast("int")

    def turn(path: Column, k: Column) -> Column:
        return F.substring(path, k * KEY + 1, F.lit(KEY))

    differ = F.array_position(F.transform(F.sequence(F.lit(0), n - 1), lambda k: turn(low, k) != turn(high, k)), True)
    return F.when(n == 0, 0).when(differ == 0, n).otherwise(differ - 1).cast("int")


def grown(suffixes: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The nodes (NODES) under the heads of `suffixes`, of which the heads themselves have no parent.

    `suffixes` has (head, parent, parent_conv_id, depth, top_words, path, words, n, conv_id, class, n_children, n_leaves,
    saved_tokens): distinct paths under a head with the number of conversations that take them, the smallest, and what
    lies below their end. A container of more than `limit` turns bursts: the turns that all its suffixes share become
    nodes at once, and each next turn gets a container of its own. Rounds go as deep as turns are shared by containers of
    such a size. A container of one suffix never bursts. The nodes above burst containers are summed up afterwards, from
    the last round to the first.
    """
    opened, rounds, found = stored(suffixes, "containers"), [], []
    while True:
        load = opened.groupBy("head").agg(F.sum(F.length("path") / KEY + 1).alias("turns"), F.count("*").alias("rows"))
        big = stored(load.where((F.col("turns") > limit) & (F.col("rows") > 1)).select("head"), "oversized")
        burst = not big.isEmpty()
        small = opened.join(big, "head", "left_anti") if burst else opened
        found.append(stored(small.repartition("head").sortWithinPartitions("head", "path").mapInArrow(_swept, NODES), "nodes"))
        if not burst:
            break
        large = opened.join(big, "head", "left_semi")
        heads = large.groupBy("head").agg(
            F.min("path").alias("low"), F.max("path").alias("high"), F.max_by("words", "path").alias("words"), F.sum("n").alias("n_convs"),
            F.min("conv_id").alias("conv_id"), *[F.any_value(c).alias(c) for c in ("parent", "parent_conv_id", "depth", "top_words")])
        heads = stored(heads.withColumn("shared", shared_turns(F.col("low"), F.col("high"))).select(
            "head", "parent", "parent_conv_id", "depth", "shared", "n_convs", "conv_id",
            F.concat(F.array("top_words"), F.slice("words", F.lit(1), F.col("shared"))).alias("line")), "heads")
        at = heads.select("head", "shared", F.col("conv_id").alias("own"))
        split = large.drop("parent", "parent_conv_id").join(at, "head")
        taken = (F.col("shared") + 1) * KEY
        ends = split.where(F.length("path") == F.col("shared") * KEY).select("head", "class", "n_children", "n_leaves", "saved_tokens")
        rounds.append((heads, stored(ends, "ends")))
        opened = stored(split.where(F.length("path") > F.col("shared") * KEY).select(
            F.sha2(F.concat("head", F.lit("/"), F.substring("path", F.lit(1), taken)), 256).alias("head"), F.col("head").alias("parent"),
            F.col("own").alias("parent_conv_id"), (F.col("depth") + F.col("shared") + 1).alias("depth"),
            F.element_at("words", F.col("shared") + 1).alias("top_words"), F.substring("path", taken + 1, F.length("path")).alias("path"),
            F.slice("words", F.col("shared") + 2, F.greatest(F.size("words") - F.col("shared") - 1, F.lit(0))).alias("words"),
            "n", "conv_id", "class", "n_children", "n_leaves", "saved_tokens"), "containers")
    nodes = found.pop()
    tops = nodes.where("parent is not null")
    for (heads, ends), swept in zip(reversed(rounds), reversed(found)):
        below = tops.groupBy(F.col("parent").alias("head")).agg(
            F.count("*").alias("more"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
        bottom = heads.join(below, "head", "left").join(ends, "head", "left").select(
            *[heads[c] for c in heads.columns], "class", *[(F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))).alias(c) for a, b, c in (
                ("more", "n_children", "bottom_children"), ("leaves", "n_leaves", "n_leaves"), ("saved", "saved_tokens", "below"))])
        k = F.col("k")
        above = bottom.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("shared")))).select(
            "head", F.when(k == 0, F.col("parent")).alias("parent"), (F.col("depth") + k).alias("depth"), "conv_id",
            F.when(k == 0, F.col("parent_conv_id")).otherwise(F.col("conv_id")).alias("parent_conv_id"), "n_convs",
            F.when(k == F.col("shared"), F.col("bottom_children")).otherwise(F.lit(1)).cast("long").alias("n_children"), "n_leaves",
            (F.col("below") + (F.col("n_convs") - 1) * F.aggregate(
                F.slice("line", k + 1, F.size("line")), F.lit(0).cast("long"), lambda s, x: s + x)).alias("saved_tokens"),
            F.when(k == F.col("shared"), F.col("class")).alias("class"))
        above = stored(above, "above")
        tops = above.unionByName(swept).where("parent is not null")
        nodes = nodes.unionByName(above).unionByName(swept)
    return nodes


def trie(conversations: DataFrame, segment: int = SEGMENT, limit: int = LIMIT) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node.

    Conversations are rebuilt (`rebuilt`), and every distinct sequence of their first d turns is a node, named by its
    smallest member and d. Null roles and texts are empty texts; rows without conv_id belong to no conversation and are
    left out. Repeated rows are turns of their own. Equal turn numbers are ordered by the turns' keys. An empty table has
    no conversations and no nodes, not even a root. Other columns are not read.
    """
    rows, lengths = rebuilt(turns(conversations))
    parts = stored(segments(rows, lengths, segment), "parts")
    last = parts.agg(F.max("last").alias("n")).first()["n"]
    zero = F.lit(0).cast("long")
    nodes, below = None, None
    for number in range(int(last or 0), -1, -1):
        here = parts.where(F.col("segment") == number)
        paths = here.groupBy("head", "path").agg(
            F.count("*").alias("n"), F.min("conv_id").alias("conv_id"), F.any_value("words").alias("words"), F.max("next").alias("next"),
            F.max(F.when(F.col("segment") == F.col("last"), class_of())).alias("class"))
        if below is not None:
            paths = paths.join(below, "next", "left").withColumn("class", F.coalesce("class", "end"))
        else:
            paths = paths.withColumns({c: zero for c in ("n_children", "n_leaves", "saved_tokens")})
        found = grown(paths.select(
            "head", F.lit(None).cast("string").alias("parent"), F.lit(None).cast("long").alias("parent_conv_id"),
            F.lit(number * segment).cast("long").alias("depth"), zero.alias("top_words"), "path", "words", "n", "conv_id", "class",
            *[F.coalesce(c, zero).alias(c) for c in ("n_children", "n_leaves", "saved_tokens")]), limit)
        if number:
            # The head of a later segment is the end of a full one: its node comes from there.
            top = F.col("depth") == number * segment
            below = stored(found.where(top).select(F.col("head").alias("next"), F.col("class").alias("end"), "n_children", "n_leaves", "saved_tokens"), "below")
            found = found.where(~top)
        nodes = found if nodes is None else nodes.unionByName(found)
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    ended = nodes.where("class is not null").join(end_digests(parts), "class").select(*columns, "ends_sha256")
    return ended.unionByName(nodes.where("class is null").select(*columns, F.sha2(F.lit(""), 256).alias("ends_sha256")))
