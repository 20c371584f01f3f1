"""Shared pieces of the text operators: stored intermediates, word blocks, label samples, running sums."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators.checkpoints import checkpoint_root

#: Bytes of text whose words are held at once.
BLOCK_BYTES = 1 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_OTHER = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")  # capitals are letters of words
#: A-Z to a-z, and every byte that is not part of a word `[^\x00-\x2F\x3A-\x60\x7B-\x7F]` to a space.
#: Bytes of 0x80 and above only occur inside code points that belong to words.
PLAIN = bytes(b if b >= 0x80 or chr(b).isdigit() or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 32 for b in range(256))

#: As PLAIN, without digits: words are `[^\x00-\x40\x5B-\x60\x7B-\x7F]+`.
_NO_LETTER = re.compile(rb"[\x00-\x40\x5B-\x60\x7B-\x7F]")
LETTERS = bytes(32 if chr(b).isdigit() and b < 0x80 else PLAIN[b] for b in range(256))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share."""
    return f"{checkpoint_root(spark)}/llm/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` written to the shared folder and read again: work done once, and safe when executors are lost."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _blocks(data: bytes, end_of_word: re.Pattern, size: int) -> Iterator[bytes]:
    at = 0
    while at < len(data):
        m = end_of_word.search(data, at + size) if at + size < len(data) else None
        end = m.start() if m else len(data)
        yield data[at:end]
        at = end


def spaced_words(data: bytes | None, size: int = BLOCK_BYTES) -> Iterator[list[bytes]]:
    """Lists of the `[^\\x20\\x09-\\x0D]+` words of a text with A-Z lower-cased, in order; None has no words."""
    for block in _blocks(data or b"", _SPACE, size):
        yield block.lower().split()


def plain_words(data: bytes | None, size: int = BLOCK_BYTES) -> Iterator[list[bytes]]:
    """Lists of the `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` words of a text with A-Z lower-cased, in order."""
    for block in _blocks(data or b"", _OTHER, size):
        yield block.translate(PLAIN).split()


def letter_words(data: bytes | None, size: int = BLOCK_BYTES) -> Iterator[list[bytes]]:
    """Lists of the `[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+` words of a text with A-Z lower-cased, in order; None has no words."""
    for block in _blocks(data or b"", _NO_LETTER, size):
        yield block.translate(LETTERS).split()


def held_out(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text leaves 0 by 5. A row without an id is held out: it can't be matched to a label."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(True))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, limit: int) -> DataFrame:
    """(doc_id, label, text) of at most `limit` labelled documents outside the held-out fold.

    Documents are drawn by a hash of their id, so the draw is the same at every run. Labels that are null, and
    documents labelled both ways, are left out; of several texts under one id the smallest is used. The drawn ids are
    at most `limit` rows, which bounds the broadcast; the texts stay distributed.
    """
    drawn = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out())
        .groupBy("doc_id").agg(F.min(label).alias("label"), F.max(label).alias("other"))
        .where(F.col("label") == F.col("other")).select("doc_id", F.col("label").cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    )
    return (
        docs.select("doc_id", "text").where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
        .join(F.broadcast(drawn), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    )


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` evaluated once per row, also where lambdas inside refer to it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def starts_of(lengths: Column, block: int = 256) -> Column:
    """Exclusive running sums of an array of numbers: where each piece starts.

    Appending to an array copies it, so sums run inside blocks first and then over the blocks' totals.
    """
    def run(a: Column) -> Column:
        empty = F.struct(F.lit(0).cast("long").alias("t"), F.array().cast("array<bigint>").alias("a"))
        return F.aggregate(a, empty, lambda s, x: F.struct((s["t"] + x).alias("t"), F.concat(s["a"], F.array(s["t"])).alias("a")))

    def whole(a: Column) -> Column:
        cut = F.transform(
            F.sequence(F.lit(0), F.floor((F.size(a) - 1) / block).cast("int")), lambda b: run(F.slice(a, b * block + 1, F.lit(block))))
        return let(cut, lambda c: let(run(F.transform(c, lambda s: s["t"])), lambda totals: F.flatten(
            F.zip_with(c, totals["a"], lambda s, off: F.transform(s["a"], lambda v: v + off)))))

    nothing = F.array().cast("array<bigint>")
    return let(lengths, lambda a: F.when(F.size(a) > 0, whole(a)).otherwise(nothing))


def calibrated(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0, steps: int = 50) -> np.ndarray:
    """Logistic regression by Newton steps: slopes of the columns of x, and a bias, which the ridge spares."""
    x = np.c_[x, np.ones(len(x))]
    penalty = np.diag([ridge] * (x.shape[1] - 1) + [1e-3])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        gradient = x.T @ (weight * (p - y)) + penalty @ w
        curvature = (x * (weight * p * (1 - p))[:, None]).T @ x + penalty
        move = np.linalg.solve(curvature, gradient)
        w -= move
        if np.abs(move).max() < 1e-10:
            break
    return w
