"""Held-out accuracy of the learnt operators."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import catalog, toxicity, url_filter
from ledgerloom.llm.support import read

LEARNT = "/root/testdata/sf0.01"


def held_out_rows(spark, name, label):
    scores = catalog.QUERIES[name](spark, LEARNT)
    rows = scores.join(read(spark, LEARNT, "labels"), "doc_id").where("held_out").select(label, "score", "predicted").collect()
    return [(r[0], r[1], r[2]) for r in rows]


@pytest.mark.parametrize("name, label, right", [("op5_quality_model", "quality", 0.9), ("op8_toxicity", "toxic", 0.9)])
def test_held_out_accuracy(spark, name, label, right):
    rows = held_out_rows(spark, name, label)
    assert all(0 <= s <= 1 for _, s, _ in rows)
    assert sum(y == p for y, _, p in rows) / len(rows) >= right


def test_scores_depend_on_texts_alone(spark, tmp_path):
    docs, labels = read(spark, LEARNT, "documents"), read(spark, LEARNT, "labels")
    changed = docs.withColumns({"lang": F.lit("xx"), "source": F.lit("none")})
    for fit in (toxicity.toxicity,):
        assert sorted(fit(docs, labels).collect()) == sorted(fit(changed, labels).collect())


def test_labels_of_the_held_out_fold_are_not_used(spark):
    docs, labels = read(spark, LEARNT, "documents"), read(spark, LEARNT, "labels")
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert sorted(toxicity.toxicity(docs, labels).collect()) == sorted(toxicity.toxicity(docs, flipped).collect())


def test_folding_and_exceptions():
    fold = toxicity.folded
    assert fold("1D10T") == fold("idiot") == fold("іdіοt") == fold("ｉｄｉｏｔ") == fold("id\u200biot")
    assert fold(None) == fold("") == fold("!?") == " "
    lexicon = toxicity.Lexicon({fold("trash"): 2.0, fold("scum").rstrip(): 3.0}, ("trash can",))
    automaton = lexicon.automaton()
    mass = lambda t: toxicity.mass(fold(t), automaton)
    assert (mass("a trash heap"), mass("a trash can"), mass("trashy"), mass("scumbags and trash"), mass("obscum")) == (2.0, 0, 0, 5.0, 0)


@pytest.mark.parametrize("size, recall, most_false", [("sf0.001", 0.5, 0.0), ("sf0.01", 0.6, 0.02), ("sf0.1", 0.9, 0.005)])
def test_lexicon_fits_any_number_of_labels(spark, size, recall, most_false):
    """Of all labelled documents; about a third of the toxic ones at sf0.01 hold no toxic word."""
    folder = f"/root/testdata/{size}"
    rows = toxicity.toxicity(read(spark, folder, "documents"), read(spark, folder, "labels")).join(read(spark, folder, "labels"), "doc_id").where(
        "toxic is not null").groupBy("toxic", "held_out").agg(F.sum("predicted").alias("hits"), F.count("*").alias("n")).collect()
    print(size, sorted((r.toxic, r.held_out, r.hits, r.n) for r in rows))
    of = {y: [sum(r[c] for r in rows if r.toxic == y) for c in ("hits", "n")] for y in (0, 1)}
    assert of[1][0] >= recall * of[1][1] and of[0][0] <= most_false * of[0][1]


def test_few_but_only_toxic_holders_make_an_entry(spark):
    rows = [(k, "vile words" if k < 4 else "plain words") for k in range(40)]
    sample = spark.createDataFrame([(t, int(k < 5)) for k, t in rows], "text string, label int")
    terms = toxicity.lexicon_terms(sample)
    assert " viie " in terms and " words " not in terms and " piain " not in terms


def test_masses_of_several_lexicons_equal_those_of_each():
    fold, weights = toxicity.folded, {" vie": [1.0, 0.5], " viie ": [2.0, 0.2], " trash ": [3.0, -1.0]}
    together = toxicity.ahocorasick.Automaton()
    for entry, by_width in weights.items():
        together.add_word(entry, (len(entry), by_width))
    together.add_word(key := fold("trash can"), (len(key), None))
    together.make_automaton()
    texts = ("vile trash", "trash can, vile", "view of a trash heap", "", None, "trash trash can trash")
    for width, least in ((0, 0.0), (0, 2.0), (1, 0.0), (1, 0.4)):
        alone = toxicity.Lexicon({e: w[width] for e, w in weights.items() if w[width] >= least}, ("trash can",)).automaton()
        for text in texts:
            assert toxicity.masses(fold(text), together, [(width, least)]) == [toxicity.mass(fold(text), alone)]


def test_odds_are_chosen_without_a_fold_at_a_time(spark):
    """Words of one toxic text each say nothing about other folds; where no fold can be compared the defaults are taken."""
    rows = [(f"filler{k} " + ("vile words" if k % 4 == 0 else "plain words"), int(k % 4 == 0)) for k in range(200)]
    lexicon, odds, width = toxicity.chosen(spark.createDataFrame(rows, "text string, label int"))
    assert " viie " in lexicon.weights and not any(e.startswith(" fiiier") and e.endswith(" ") for e in lexicon.weights)
    assert odds in toxicity.GRID_ODDS and width in toxicity.GRID_DEVIATIONS
    few = spark.createDataFrame([("vile", 1), ("plain", 0)], "text string, label int")
    assert toxicity.chosen(few)[1:] == (toxicity.ODDS, toxicity.DEVIATIONS)


def test_trees_learn_from_labelled_urls(spark):
    """Long digit-laden paths are bad here, whatever the host; half of the URLs are kept from the fit."""
    rows = [(f"http://h{i % 50}.example.net/{'a' * (i % 7)}" + (f"/{i * 7919 % 10**9}{i}?p={i}&q={i}" if i % 2 else "/page"), i % 2) for i in range(2000)]
    df = spark.createDataFrame(rows, "url string, label int")
    model = url_filter.fit(df.where(F.pmod(F.hash("url"), F.lit(2)) == 0))
    kept = df.where(F.pmod(F.hash("url"), F.lit(2)) == 1).select(F.struct("label").alias("id"), "url")
    judged = model.allowed(url_filter.featured(kept)).select((F.col("allowed").cast("int") == F.col("id.label")).alias("ok"))
    assert judged.agg(F.avg(F.col("ok").cast("int"))).first()[0] >= 0.95
    assert url_filter.fit(df.where("label = 1")).trees is None
