"""Helpers shared by the tests: table list and exact, order-free comparison."""

from __future__ import annotations

from collections import Counter

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def _key(v):
    if isinstance(v, list):
        return tuple(_key(x) for x in v)
    return repr(v) if isinstance(v, float) else v


def difference(cols_a, rows_a, cols_b, rows_b) -> str:
    """Empty when both sides hold the same rows with exactly the same values and value types."""
    if sorted(cols_a) != sorted(cols_b):
        return f"columns {sorted(set(cols_a) ^ set(cols_b))}"
    pos_a = [list(cols_a).index(c) for c in sorted(cols_a)]
    pos_b = [list(cols_b).index(c) for c in sorted(cols_b)]
    a = Counter(tuple(_key(r[i]) for i in pos_a) for r in rows_a)
    b = Counter(tuple(_key(r[i]) for i in pos_b) for r in rows_b)
    if a == b:
        return ""
    left, right = list((a - b).elements()), list((b - a).elements())
    note = f"rows {len(rows_a)} vs {len(rows_b)}, {len(left)} differ"
    if left and right:
        key = min(left, key=str), min(right, key=str)
        names = sorted(cols_a)
        note += " e.g. " + "; ".join(f"{n}: {x!r} vs {y!r}" for n, x, y in zip(names, *key, strict=True) if x != y)[:400]
    return note
