"""Nulls, empty and very long texts, repeated rows, empty tables and clashing columns: every operator and stage."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerloom.llm import catalog
from tests.llm import brute

NAMES = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 7919} x{i % 31}" for i in range(150_000))
TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog and runs away from it all"), (2, None), (3, ""), (4, " \t\n\x0b\f\r "),
    (5, "one"), (6, "one two"), (7, LONG), (8, "a b c d e f g a b c d e f g"), (8, "a b c d e f g a b c d e f g"),
    (9, "tie"), (9, "another text under the same id"), (None, "no id at all here"), (None, None), (10, "Ünïcödé Wörter ändern nichts 字"),
    (11, "\x00odd\x1f bytes\x7f and \U0001F600 signs"), (12, "password=abcdefgh1234 token: short AKIA" + "B2" * 9 + " " + "0af" * 10)]
ROWS = [(d, t, None if d == 5 else "en", None if d in (4, 6) else f"s{(d or 0) % 4}", len(t) if t else None) for d, t in TEXTS]
LABELS = [(d, d % 2, (d + 1) % 2) for d in range(1, 13)] + [(1, 0, 1), (None, 1, 1), (2, None, None)]
BENCH = [(1, "The quick brown fox jumps over the lazy dog and runs away from it all"), (2, "one two"), (3, None), (None, "one"), (2, "one two"), (4, "")]
URLS = [(1, "https://A.example.ORG/es/x"), (2, None), (3, ""), (4, "no scheme"), (5, "x://"), (6, "http://com/fr/?a=1&b=2#c"), (None, "http://a.com/de/1"),
        (6, "http://com/fr/?a=1&b=2#c"), (7, "http://" + "a" * 5000 + ".net/" + "b/" * 3000), (8, "http://example.org/en/10"), (9, "http://notorg/")]
VECTORS = [(0, [1.0, 2.0]), (100, [1.0, 2.0]), (1, [1.0, 2.5]), (2, None), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [1.0, float("nan")]), (6, [float("inf"), 1.0]),
           (7, []), (8, [1.0, 2.0, 3.0]), (200, [9.0, 9.0, 9.0, 9.0]), (100, [1.0, 2.0]), (None, [1.0, 2.0]), (9, [1e200, -1e200]), (300, [1e200, 1e200])]
TALKS = [(c, t, r, x) for c in (0, 3, 7, 20, 21, 45, -5) for t, r, x in ((None, "user", "hi there"), (0, None, "hi"), (1, "user", None), (4, "user", "a b c"))]
TALKS += [(None, 1, "user", "lost"), (63, 0, "user", "hi there"), (64, 0, "user", LONG), (65, 0, "user", LONG), *[(80 + c, t, "u", f"turn {t}") for c in range(3) for t in range(9)]]
CLASHING = ("query", "rank", "row", "term", "n", "idx", "at", "path", "words", "head", "size", "taken", "fp", "found", "key", "draw", "cell", "h", "w", "label", "score", "base", "value", "a", "b")


def tables(spark, folder, docs=ROWS, labels=LABELS, bench=BENCH, urls=URLS, vectors=VECTORS, talks=TALKS, clash=True):
    out = str(folder)
    extra = {c: F.lit(f"own {c}") for c in CLASHING} if clash else {}
    for name, rows, schema in (
            ("documents", docs, NAMES), ("labels", labels, "doc_id long, quality int, toxic int"), ("benchmark", bench, "item_id long, text string"),
            ("pages", [(p, u, "") for p, u in urls], "page_id long, url string, html string"),
            ("embeddings", vectors, "vec_id long, embedding array<double>"), ("conversations", talks, "conv_id long, turn int, role string, text string")):
        spark.createDataFrame(rows, schema).withColumns({k: v for k, v in extra.items() if name == "documents" or k not in ("label",)}).coalesce(1) \
            .write.mode("overwrite").parquet(f"{out}/{name}.parquet")
    return out


@pytest.fixture(scope="module")
def edges(spark, tmp_path_factory):
    return tables(spark, tmp_path_factory.mktemp("edges"))


@pytest.fixture(scope="module")
def nothing(spark, tmp_path_factory):
    return tables(spark, tmp_path_factory.mktemp("nothing"), [], [], [], [], [], [])


@pytest.fixture(scope="module")
def unlabelled(spark, tmp_path_factory):
    return tables(spark, tmp_path_factory.mktemp("unlabelled"), labels=[], bench=[])


@pytest.mark.parametrize("name", [q for q in catalog.QUERIES if q.split("_")[0] not in ("op11", "op12", "op13")])
def test_every_row_comes_back(spark, edges, name):
    rows = catalog.QUERIES[name](spark, edges).collect()
    if name.startswith("op1_"):
        assert {r.doc_id for r in rows} == {d for d, _ in TEXTS}
    else:
        key = "page_id" if name.startswith("op4_") else "doc_id"
        expected = [p for p, _ in (URLS if key == "page_id" else TEXTS)]
        assert sorted((r[key] or 0) for r in rows) == sorted(d or 0 for d in expected)


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_empty_tables(spark, nothing, name):
    assert catalog.QUERIES[name](spark, nothing).collect() == []


@pytest.mark.parametrize("name", ["op2_decontaminate", "op5_quality_model", "op8_toxicity"])
def test_nothing_to_learn_or_to_search_for(spark, unlabelled, name):
    rows = catalog.QUERIES[name](spark, unlabelled).collect()
    assert len(rows) == len(TEXTS)
    if name.startswith("op8_"):
        assert {r.predicted for r in rows} == {0}
    if name.startswith("op2_"):
        assert {(r.n_hit, r.contaminated) for r in rows} == {(0, False)}


def test_edge_values(spark, edges):
    def ordered(name, *columns):
        return sorted((tuple(r[c] for c in columns) for r in catalog.QUERIES[name](spark, edges).collect()), key=str)

    assert ordered("op2_decontaminate", "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == sorted(
        ((d, *brute.contamination(t, BENCH)) for d, t in TEXTS), key=str)
    assert ordered("op6_license_scan", "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels") == sorted(
        ((d, *brute.licences(t)) for d, t in TEXTS), key=str)
    assert ordered("op7_quality_rules", "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == sorted(
        ((d, *brute.measured(t)) for d, t in TEXTS), key=str)
    prints = [(d, brute.fingerprint(t)) for d, t in TEXTS]
    assert ordered("op9_simhash", "doc_id", "fingerprint", "component_id") == sorted(
        ((d, f"{f:016x}", c) for (d, f), c in zip(prints, brute.component_ids(prints))), key=str)


def test_edge_values_of_searches_and_reports(spark, edges):
    def rows(name):
        return sorted((tuple(r) for r in catalog.QUERIES[name](spark, edges).collect()), key=str)

    assert rows("op11_neighbours") == sorted(brute.nearest(VECTORS, 100, 10), key=str)
    assert rows("op12_divergence") == sorted(brute.divergence([(r[2], r[3], r[1]) for r in ROWS], 30, 50), key=str)
    assert rows("op13_prefix_tree") == sorted(brute.prefix_tree(TALKS), key=str)


@pytest.mark.parametrize("number", range(len(corpus_pipeline.STAGES)))
def test_stages_take_edges(spark, edges, nothing, number):
    name, stage = corpus_pipeline.STAGES[number]
    docs = spark.read.parquet(f"{edges}/documents.parquet")
    out = stage(spark, docs, edges)
    last = number == len(corpus_pipeline.STAGES) - 1
    assert out.columns[:len(docs.columns)] == docs.columns and (last or out.columns == docs.columns)
    assert 0 < out.count() <= len(TEXTS)
    empty = spark.read.parquet(f"{nothing}/documents.parquet")
    assert stage(spark, empty, nothing).collect() == []


def test_near_duplicates_keep_one_row_of_each_group(spark, edges):
    docs = spark.read.parquet(f"{edges}/documents.parquet")
    kept = sorted((r.doc_id or 0) for r in dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, edges).collect())
    # No words: 2 stays for 2, 3, 4 and the null text. The repeated 8 stays once. Both texts of 9 stay, as they differ.
    prints = [(d, brute.fingerprint(t)) for d, t in TEXTS]
    groups = set(brute.component_ids(prints)) - {None}
    assert set(kept) - {0} == groups and (kept.count(8), kept.count(9), kept.count(0)) == (1, 2, 1)
