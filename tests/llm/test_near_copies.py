"""Near copies against brute force: planted edits, chains, texts just below the limit, groups that share much."""

from __future__ import annotations

import random

import numpy as np
import pytest

from ledgerloom.llm import near_copies
from tests.conftest import SMALL
from tests.llm import brute

SCHEMA = "doc_id long, text string"


def planted():
    """Copies with one to twelve words changed, chains of edits, texts with a common part of varied length, odd texts."""
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(4000)}"
    rows, n = [], 0

    def add(text):
        nonlocal n
        rows.append((n, text))
        n += 1

    for _ in range(12):
        base = [word() for _ in range(rng.choice((40, 120, 300)))]
        add(" ".join(base))
        for edits in range(1, 13):
            other = list(base)
            for at in rng.sample(range(len(other)), min(edits, len(other))):
                other[at] = word()
            add((" " if edits % 2 else "  \n").join(other).upper() if edits % 3 else " ".join(other))
    chain = [word() for _ in range(200)]
    for at in range(0, 200, 4):  # each is near the one before, the ends share nothing
        chain[at:at + 4] = [word() for _ in range(4)]
        add(" ".join(chain))
    shared = [word() for _ in range(150)]
    for k in range(40):  # a common part of half to nearly all shingles
        add(" ".join(shared + [word() for _ in range(5 + 4 * k)]))
    for text in (None, "", " \n", "a", "A", "a b", "a b c d", "a b c d e", "a b c d e a b c d e", "a b c d e " * 50):
        add(text)
    rng.shuffle(rows)
    return rows


def of(spark, rows):
    return {r.doc_id: r.component_id for r in near_copies.groups(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_planted_near_copies_match_brute_force(spark):
    rows = planted()
    assert of(spark, rows) == dict(zip([d for d, _ in rows], brute.near_copy_ids(rows)))


def test_given_documents_match_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    assert of(spark, rows) == dict(zip([d for d, _ in rows], brute.near_copy_ids(rows)))


def test_a_group_of_templates_is_split_as_brute_force_splits_it(spark):
    """Texts of one template at 0.6 to 0.9 fill the same buckets without being one group."""
    rng = random.Random(9)
    base = [f"t{i}" for i in range(100)]
    rows = []
    for d in range(150):
        text = list(base)
        for at in rng.sample(range(0, 100, 6), rng.choice((1, 2, 4))):
            text[at] = f"own{d}_{at}"
        rows.append((d, " ".join(text)))
    assert of(spark, rows) == dict(zip(range(150), brute.near_copy_ids(rows)))


@pytest.mark.parametrize("size", [1, 2, 64, 4096])
def test_shingle_sets_do_not_depend_on_blocks(monkeypatch, size):
    text = " ".join(f"W{i % 97}" for i in range(2000)).encode()
    whole = near_copies.shingle_set(text)
    words = near_copies.spaced_words
    monkeypatch.setattr(near_copies, "spaced_words", lambda data: words(data, size))
    assert np.array_equal(near_copies.shingle_set(text), whole) and len(whole) == 97


def test_one_row_of_each_group_stays_and_columns_are_kept(spark):
    rows = planted()
    docs = spark.createDataFrame([(d, t, "own", d) for d, t in rows] + [(None, "no id " * 9, "own", 0)], SCHEMA + ", key string, sig long")
    out = near_copies.keep_one(docs)
    assert out.columns == docs.columns
    got = [r.doc_id for r in out.collect()]
    named = rows + [(None, "no id " * 9)]
    assert sorted(d for d in got if d is not None) == sorted(set(brute.near_copy_ids(named)) - {None}) and got.count(None) == 1


def test_an_empty_table_has_no_groups(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert near_copies.groups(empty).count() == 0 and near_copies.keep_one(empty).count() == 0


def test_texts_not_asked_for_go_before_the_join(spark):
    texts = spark.range(20000).selectExpr("xxhash64(id) AS copy", "id")
    asked = texts.where("id % 97 = 0").select("copy")
    kept = near_copies.likely(texts, asked)
    assert kept.columns == ["copy", "id"] and kept.where("id % 97 = 0").count() == asked.count() == 207
    assert kept.count() < 250
    ends = spark.createDataFrame([(x,) for x in (0, -1, 1, 7, 8, 32767, 32768, 2**63 - 1, -2**63)], "copy long")
    assert near_copies.likely(ends, ends.distinct()).distinct().count() == 8 + 1
    assert near_copies.likely(ends, ends.limit(0)).count() == 0
