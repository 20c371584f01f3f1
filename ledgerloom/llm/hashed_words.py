"""Hashed word n-grams of whole texts, as sparse vectors."""

from __future__ import annotations

import re
import zlib

import numpy as np

from ledgerloom.llm.support import BLOCK_BYTES

BITS = 18
#: Words are runs of letters and digits, or runs of one kind of mark.
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+|([!-/:-@\[-`{-~])\1*")
_SPACE = re.compile(rb"[\x00-\x20\x7F]")
_MIX = np.uint64(0x9E3779B97F4A7C15)
_REPEAT = np.uint64(0x51ED270B0B3F2A65)


class Words(dict):
    """Hashes of words that were met, forgotten when there are many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        value = self[word] = (zlib.crc32(word) << 32 | zlib.adler32(word)) & 0xFFFFFFFFFFFFFFFF
        return value


def features(data: bytes | None, words: Words, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the 1- and 2-grams of a text with their weights, of length 1 together; a word that repeats the one
    before it counts as a repetition in 1-grams. A text without words has no buckets."""
    data = data or b""
    buckets, counts = np.zeros(0, np.int64), np.zeros(0, np.float64)
    at, last = 0, np.zeros(0, np.uint64)
    while at < len(data):
        m = _SPACE.search(data, at + BLOCK_BYTES) if at + BLOCK_BYTES < len(data) else None
        end = m.start() if m else len(data)
        block = data[at:end].lower()
        h = np.fromiter((words[x.group()] for x in _WORD.finditer(block)), dtype=np.uint64)
        at = end
        if not len(h):
            continue
        joined = np.r_[last, h]
        one, two = joined[len(last):].copy(), joined[:-1] * _MIX + joined[1:]
        same = np.flatnonzero(joined[1:] == joined[:-1]) + 1 - len(last)
        one[same[same >= 0]] = _REPEAT
        last = h[-1:]
        found, n = np.unique(((np.r_[one, two] * _MIX) >> np.uint64(64 - bits)).astype(np.int64), return_counts=True)
        buckets, places = np.unique(np.r_[buckets, found], return_inverse=True)
        counts = np.bincount(places, weights=np.r_[counts, n], minlength=len(buckets))
    if not len(buckets):
        return buckets, counts
    weights = np.log1p(counts)
    return buckets, weights / np.sqrt((weights * weights).sum())
