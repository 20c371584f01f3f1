"""Token counts by offset-mapped attribution: whole documents are encoded once, token spans are joined to sections."""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_type

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the vocabulary's makers cut text before merging; a fixed value that belongs to the vocabulary file.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
OUTSIDE = -1

Span = tuple[int, int]
COUNTS = pa.schema([("section", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("n_tokens", pa.int64()), ("n_crossing", pa.int64())])
#: Rows that a task hands on at once.
ROWS = 50_000


class Encoder:
    """Encodes a text and gives the character span of each token. The spans cover the text; a token that holds part of a
    code point has the span of the whole code point."""

    def __init__(self, vocabulary: bytes, pattern: str) -> None:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in vocabulary.splitlines() if line)}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.bytes_of = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for token, rank in ranks.items():
            self.bytes_of[rank] = len(token)

    def spans(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        ends = np.cumsum(self.bytes_of[self.encoding.encode_ordinary(text)])
        if not len(ends):
            return ends, ends
        starts = np.r_[0, ends[:-1]]
        if text.isascii():
            return starts, ends
        data = np.frombuffer(text.encode(), dtype=np.uint8)
        character = np.cumsum((data & 0xC0) != 0x80) - 1
        return character[starts], character[ends - 1] + 1


def paragraphs(text: str) -> list[Span]:
    """Sections that cover the text: its lines, each with its newline."""
    out, at = [], 0
    while at < len(text):
        end = text.find("\n", at) + 1 or len(text)
        out.append((at, end))
        at = end
    return out


def disjoint(sections: Sequence[Span | None], length: int) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Numbers, starts and ends of the sections in order of place, cut off where an earlier one or the text ends."""
    kept, at = [], 0
    for start, end, k in sorted((s[0], s[1], k) for k, s in enumerate(sections) if s is not None and None not in s):
        start, end = max(start, at, 0), min(end, length)
        if start < end:
            kept.append((k, start, end))
            at = end
    return [k for k, _, _ in kept], np.array([s for _, s, _ in kept], dtype=np.int64), np.array([e for _, _, e in kept], dtype=np.int64)


def attribute(starts: np.ndarray, ends: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each token: the place of its section in the disjoint `lows` and `highs`, or -1, and whether it crosses.

    The rule: a token belongs to the section that holds most of its characters, at a tie to the earlier one; a token
    that touches no section belongs to none. It crosses if it isn't wholly inside the section that it belongs to.
    """
    best, most = np.full(len(starts), -1), np.zeros(len(starts), dtype=np.int64)
    if len(lows):
        near = np.searchsorted(highs, starts, side="right")
        at = np.arange(len(starts))
        while len(at := at[near[at] < len(lows)]) and len(at := at[lows[near[at]] < ends[at]]):
            held = np.minimum(ends[at], highs[near[at]]) - np.maximum(starts[at], lows[near[at]])
            more = held > most[at]
            best[at[more]], most[at[more]] = near[at[more]], held[more]
            near[at] += 1
    return best, (best >= 0) & (most < ends - starts)


def counts(text: str | None, sections: Sequence[Span | None] | None, encoder: Encoder) -> list[dict]:
    text = text or ""
    starts, ends = encoder.spans(text)
    sections = paragraphs(text) if sections is None else sections
    numbers, lows, highs = disjoint(sections, len(text))
    best, crossing = attribute(starts, ends, lows, highs)
    tokens = np.bincount(best + 1, minlength=len(lows) + 1)
    crossed = np.bincount(best + 1, weights=crossing, minlength=len(lows) + 1).astype(np.int64)
    out = [
        {"section": k, "start": s, "end": e, "n_tokens": t, "n_crossing": c}
        for k, s, e, t, c in zip(numbers, lows.tolist(), highs.tolist(), tokens[1:].tolist(), crossed[1:].tolist())]
    if tokens[0] or not out:
        out.append({"section": OUTSIDE, "start": None, "end": None, "n_tokens": int(tokens[0]), "n_crossing": 0})
    return out


def _counter(vocabulary, pattern: str, kind: pa.DataType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow over (doc_id, text) and, where given, sections: a row for each section, some ROWS at a time."""
    made: list[Encoder] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = made[0] if made else made.append(Encoder(vocabulary.value, pattern)) or made[0]
        for batch in batches:
            ids, texts = batch.column(0).cast(kind), batch.column(1)
            given = batch.column(2) if batch.num_columns > 2 else None
            places: list[int] = []
            found: list[dict] = []
            for i, text in enumerate(texts):
                sections = None if given is None else [(s["start"], s["end"]) if s else None for s in given[i].as_py() or []]
                rows = counts(text.as_py(), sections, encoder)
                places += [i] * len(rows)
                found += rows
                if len(found) >= ROWS or i == len(texts) - 1:
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array(places, pa.int64())), *[pa.array([r[f.name] for r in found], f.type) for f in COUNTS]],
                        names=["doc_id", *[f.name for f in COUNTS]])
                    places, found = [], []

    return run


def section_tokens(
    docs: DataFrame, sections: Column | None = None, vocabulary: str = VOCABULARY, pattern: str = PATTERN
) -> DataFrame:
    """doc_id, section, start, end, n_tokens, n_crossing: one row for each section of each row of `docs`.

    `sections` is an array of structs (start, end) in characters, end exclusive; without it a document's lines are its
    sections, each with its newline. Sections count from 0. A document is encoded once and whole; each token is counted
    once, in the section that holds most of its characters (`attribute`), and n_crossing counts those of them that reach
    beyond it. Tokens outside of all sections are counted in a row with section -1, so that a document's rows add up to
    its tokens; a null or empty text has that row alone, with 0. Empty, null and overlapped sections are left out or cut.
    Repeated rows and rows without doc_id have rows of their own; an empty table has none. Other columns are not read.

    The vocabulary file is read on the driver and sent to the executors; its size is that of a vocabulary.
    """
    spark = docs.sparkSession
    with open(vocabulary, "rb") as file:
        sent = spark.sparkContext.broadcast(file.read())
    given = [sections.alias("sections")] if sections is not None else []
    columns = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *from_arrow_schema(COUNTS).fields])
    return docs.select("doc_id", "text", *given).mapInArrow(_counter(sent, pattern, to_arrow_type(columns["doc_id"].dataType)), columns)


def document_tokens(docs: DataFrame) -> DataFrame:
    """Tokens of every line of every row of `docs`."""
    return section_tokens(docs)
