"""The pipeline's stages on the small tables: each decision takes effect, and only there."""

from __future__ import annotations

import corpus_pipeline
from ledgerloom.llm import decontaminate, simhash, support, toxicity
from tests.conftest import SMALL
from tests.llm import brute


def test_stages_in_order_against_brute_force(spark):
    docs = support.read(spark, SMALL, "documents")
    lexicon = toxicity.fit(docs, support.read(spark, SMALL, "labels"))
    automaton = lexicon.automaton()
    rows = {r.doc_id: r for r in docs.collect()}

    def toxic(text):
        x = toxicity.measures(text, automaton)
        return x @ lexicon.slopes + lexicon.bias >= 0

    kept = {d: r for d, r in rows.items() if not toxic(r.text)}
    texts = [(d, r.text) for d, r in kept.items()]
    kept = {d: kept[d] for (d, _), c in zip(texts, brute.near_copy_ids(texts)) if d == c}
    items = [(r.item_id, r.text) for r in support.read(spark, SMALL, "benchmark").collect()]
    kept = {d: r for d, r in kept.items() if not brute.contamination(r.text, items)[-1]}
    before = {d for d, r in kept.items() if not brute.base_spans(r.text)}
    out = corpus_pipeline.run(spark, SMALL).collect()
    got = {r.doc_id for r in out}
    assert got <= before and len(got) == len(out)
    _, _, target = brute.mix([(d, kept[d].text, kept[d].source) for d in sorted(before)])
    taken = {}
    for r in out:
        assert r.text == rows[r.doc_id].text and r.taken in (r.size, 2 * r.size)
        taken[r.source] = taken.get(r.source, 0) + r.taken
    largest = max(len(brute.SPACED.findall(kept[d].text)) for d in before)
    assert all(abs(taken.get(s, 0) - t) <= largest for s, t in target.items())


def test_stage_names_and_number():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "secrets", "mixture"]
    assert corpus_pipeline.ORACLE_SQL is None and simhash.MAX_BITS == 2 and decontaminate.WINDOW == 13
