"""Operators against SQL twins and brute force on the small tables, and their own general interfaces."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from ledgerloom.llm import (
    catalog, components, decontaminate, divergence, license_scan, mixing, neighbours, prefix_tree, quality_rules, secret_scan, simhash,
    support, token_counts, url_filter)
from pyspark.sql import functions as F
from tests.conftest import SMALL
from tests.llm import brute
from tests.support import difference


@pytest.fixture(scope="module")
def texts(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]


@pytest.mark.parametrize("name", list(catalog.ORACLE))
def test_query_matches_twin(spark, duck, name):
    got = catalog.QUERIES[name](spark, SMALL)
    cursor = duck.execute(catalog.ORACLE[name])
    columns = [d[0] for d in cursor.description]
    assert difference(got.columns, [tuple(r) for r in got.collect()], columns, cursor.fetchall()) == ""


def test_licences_match_brute_force(spark, texts):
    got = {r.doc_id: r for r in catalog.QUERIES["op6_license_scan"](spark, SMALL).collect()}
    for d, t in texts:
        r = got[d]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute.licences(t)
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_secrets_match_brute_force(spark, texts):
    got = {r.doc_id: r for r in catalog.QUERIES["op10_secret_scan"](spark, SMALL).collect()}
    for d, t in texts:
        spans = brute.base_spans(t)
        r = got[d]
        assert r.base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert [s for s in r.spans.split(",") if s and not s.startswith("markov")] == spans
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s.startswith(k) for s in spans) for k in ("assign", "access", "hex"))


def test_simhash_matches_brute_force(spark, texts):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in catalog.QUERIES["op9_simhash"](spark, SMALL).collect()}
    prints = [(d, brute.fingerprint(t)) for d, t in texts]
    assert got == {d: (f"{f:016x}", c) for (d, f), c in zip(prints, brute.component_ids(prints))}


@pytest.mark.parametrize("bucket_rows", [1 << 16, 40, 3])
def test_links_of_clustered_fingerprints(spark, bucket_rows):
    """Dense clusters around a few centres fill buckets; finer keys must find the same components."""
    rng = random.Random(5)
    prints = set()
    for _ in range(6):
        centre = rng.getrandbits(64)
        for _ in range(150):
            prints.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.choice((0, 1, 1, 2, 3)))))
    prints |= {rng.getrandbits(64) for _ in range(300)}
    signed = {p: p - (1 << 64) if p >> 63 else p for p in prints}
    fps = spark.createDataFrame([(s,) for s in signed.values()], "fp long")
    star = {r.node: r.root for r in components.components(simhash.links(fps, bucket_rows)).collect()}
    got, want = {}, {}
    for p, c in zip(sorted(prints), brute.component_ids([(k, p) for k, p in enumerate(sorted(prints))])):
        want.setdefault(c, set()).add(p)
        got.setdefault(star.get(signed[p], signed[p]), set()).add(p)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_components_of_long_and_wide_graphs(spark):
    chain = [(i, i + 1) for i in range(1000, 1200)]
    star = [(0, i) for i in range(1, 300)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(chain + star, "a long, b long")).collect()}
    assert got == {**{i: 1000 for i in range(1001, 1201)}, **{i: 0 for i in range(1, 300)}}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_search_finds_random_windows():
    rng = random.Random(3)
    items = [(k, " ".join(rng.choice("ab") + rng.choice("xy") for _ in range(rng.choice((0, 1, 2, 5, 13, 14, 40))))) for k in range(40)]
    tables = decontaminate.compiled([(str(k), t.encode()) for k, t in items])
    for _ in range(60):
        parts = [rng.choice(items)[1] if rng.random() < 0.4 else " ".join(rng.choice("abc") + rng.choice("xy") for _ in range(rng.randrange(12))) for _ in range(8)]
        text = " ".join(parts)
        found = decontaminate.scan(text.encode(), tables)
        n_words, n_hit, n_items, digest, _ = brute.contamination(text, items)
        assert (found["n_words"], found["n_hit"], len(found["item_ids"])) == (n_words, n_hit, n_items)
        assert hashlib.sha256(",".join(found["item_ids"]).encode()).hexdigest() == digest


def test_benchmark_in_blocks_gives_the_same(spark):
    docs, bench = support.read(spark, SMALL, "documents"), support.read(spark, SMALL, "benchmark")
    whole = decontaminate.contamination(docs.select("doc_id", "text"), bench).select("row.doc_id", "found")
    parts = decontaminate.contamination(docs.select("doc_id", "text"), bench, 2_000).select("row.doc_id", "found")
    assert sorted(map(str, whole.collect())) == sorted(map(str, parts.collect()))


@pytest.mark.parametrize("size", [1, 7, 64])
def test_word_blocks_lose_nothing(size):
    text = "Ab c\x00D e\u00e9F g-h  iJk\n\nlm nopqrstuvwxyz 0 \u00df1" * 5
    assert [w.decode() for b in support.plain_words(text.encode(), size) for w in b] == brute.plain(text)
    assert [w.decode() for b in support.spaced_words(text.encode(), size) for w in b] == brute.SPACED.findall(text.translate(brute.LOWER))


def test_running_sums(spark):
    for n in (0, 1, 255, 256, 257, 1000):
        row = spark.range(1).select(support.starts_of(F.transform(F.slice(F.sequence(F.lit(1), F.lit(n + 1)), 1, n), lambda x: x.cast("long"))).alias("s")).first()
        assert row.s == [k * (k + 1) // 2 for k in range(n)]


def test_mix_meets_targets(spark):
    docs = [(i, " ".join(["w"] * (i * 7 % 40)), None if i % 9 == 0 else f"s{min(i % 11, 4)}") for i in range(3000)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    rows = {r.doc_id: r for r in mixing.mix(df).collect()}
    again = {r.doc_id: r for r in mixing.mix(df.repartition(7)).collect()}
    assert rows == again
    sizes, total, target = brute.mix(docs)
    taken = {}
    for (d, _, s), n in zip(docs, sizes):
        r = rows[d]
        assert (r.size, r.source_size) == (n, total[s]) and r.target == pytest.approx(target[s]) and 0 <= r.taken <= 2 * n and (not n or r.taken % n == 0)
        taken[s] = taken.get(s, 0) + r.taken
    for s in taken:
        assert abs(taken[s] - target[s]) <= 40
    kept = mixing.draw_mix(df).collect()
    assert {r.doc_id: r.taken for r in kept} == {d: r.taken for d, r in rows.items() if r.taken}


def test_tokens_add_up_and_decode(spark, texts):
    with open(token_counts.VOCABULARY, "rb") as f:
        encoder = token_counts.Encoder(f.read(), token_counts.PATTERN)
    rng = random.Random(1)
    for d, t in texts[:60]:
        starts, ends = encoder.spans(t)
        assert (ends >= starts).all() and starts[0] == 0 and ends[-1] == len(t)
        cuts = sorted(rng.sample(range(len(t) + 1), min(6, len(t) + 1)))
        sections = [(a, b) for a, b in zip(cuts, cuts[1:]) if a < b and rng.random() < 0.8]
        rows = {r["section"]: r["n_tokens"] for r in token_counts.counts(t, sections, encoder)}
        want = {}
        for a, b in zip(starts.tolist(), ends.tolist()):
            held = [max(0, min(b, y) - max(a, x)) for x, y in sections]
            best = held.index(max(held)) if held and max(held) else -1
            want[best] = want.get(best, 0) + 1
        assert {k: n for k, n in rows.items() if n} == want and sum(rows.values()) == len(starts)
    lines = token_counts.counts("ab cd\nef", None, encoder)
    assert [(r["section"], r["start"], r["end"]) for r in lines] == [(0, 0, 6), (1, 6, 8)]
    df = spark.createDataFrame([(1, "one two three", [(0, 7), None, (5, 99)])], "doc_id long, text string, s array<struct<start:int,end:int>>")
    got = token_counts.section_tokens(df, F.col("s")).collect()
    assert [(r.section, r.start, r.end, r.n_tokens) for r in got] == [(0, 0, 7, 2), (2, 7, 13, 1)]


def test_documents_are_encoded_once(spark, texts):
    """One Python node in the plan, and the tokens of every line against a plain walk over the spans."""
    got = catalog.QUERIES["op1_token_counts"](spark, SMALL)
    text = got._jdf.queryExecution().executedPlan().toString()
    assert text.count("MapInArrow") == 1 and "EvalPython" not in text
    with open(token_counts.VOCABULARY, "rb") as f:
        encoder = token_counts.Encoder(f.read(), token_counts.PATTERN)
    rows = {(r.doc_id, r.section): (r.start, r.end, r.n_tokens, r.n_crossing) for r in got.collect()}
    seen = 0
    for d, t in texts:
        lines, at = [], 0
        for line in t.splitlines(keepends=True) if set(t) & set("\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029") == set() else []:
            lines.append((at, at + len(line)))
            at += len(line)
        if not lines:
            continue
        tokens = [[0, 0] for _ in lines]
        for a, b in zip(*(x.tolist() for x in encoder.spans(t))):
            held = [min(b, y) - max(a, x) for x, y in lines]
            tokens[held.index(max(held))][0] += 1
            tokens[held.index(max(held))][1] += max(held) < b - a
        for k, ((a, b), (n, crossing)) in enumerate(zip(lines, tokens)):
            assert rows[d, k] == (a, b, n, crossing)
            seen += 1
    assert seen > 500


def test_windows_of_items_without_an_id_hit_words(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma"), (2, "delta")], "doc_id long, text string")
    bench = spark.createDataFrame([(None, "alpha beta"), (7, "beta gamma")], "item_id long, text string")
    for size in (1 << 20, 1):
        got = {r.row.doc_id: r.found for r in decontaminate.contamination(docs, bench, size).collect()}
        assert (got[1].n_hit, got[1].item_ids, got[1].contaminated) == (3, ["7"], True) and (got[2].n_hit, got[2].contaminated) == (0, False)


def test_one_block_of_the_benchmark_at_a_time(spark, monkeypatch):
    """A larger benchmark takes more passes, each with the tables of its own block alone."""
    held, live = [], set()

    class Sent:
        def __init__(self, block):
            self.block, self.inner = block, send(block)
            live.add(id(self))
            held.append((len(live), sum(len(t) for _, t in block)))

        value = property(lambda self: self.inner.value)

        def destroy(self):
            live.discard(id(self))

        def __reduce__(self):
            return self.inner.__reduce__()

    send = spark.sparkContext.broadcast
    monkeypatch.setattr(spark.sparkContext, "broadcast", Sent)
    docs = spark.createDataFrame([(1, "a b c d")], "doc_id long, text string")
    bench = spark.createDataFrame([(i, f"a b w{i}") for i in range(60)], "item_id long, text string")
    assert decontaminate.contamination(docs, bench, 60).count() == 1
    assert len(held) > 3 and {n for n, _ in held} == {1} and max(size for _, size in held) < 200


def test_licence_expressions():
    read = license_scan.postfix
    assert read("mit or (apache-2.0 and gpl-2.0-only with classpath-exception-2.0)\nmore") == [
        "mit", "apache-2.0", "gpl-2.0-only", "classpath-exception-2.0", "with", "and", "or"]
    assert license_scan.evaluated(read("mit or gpl-3.0-or-later")) == ({"mit", "gpl"}, True)
    assert license_scan.evaluated(read("mit and gpl-3.0+")) == ({"mit", "gpl"}, False)
    assert license_scan.evaluated(read("gpl-2.0-only with classpath-exception-2.0")) == ({"gpl"}, True)
    assert read("mit or") == read("(mit") == read("or mit") == read("") == [] and read("mit licensed work") == ["mit"]
    found = license_scan.Scanner().scan("// SPDX-License-Identifier: (MIT OR BSD-3-Clause)\nThe  MIT-License; mit LICENSE".encode())
    assert (found["n_base"], found["first_word"], found["labels"], found["permissive"]) == (2, 9, "bsd,mit", True)


@pytest.mark.parametrize("start, end", [("(", ")"), ("", ""), ("(" * 5, ")" * 5)])
def test_long_licence_expressions_are_read_to_their_end(start, end):
    long = " AND ".join(["MIT", "Apache-2.0", "BSD-3-Clause"] * 200)
    text = f"License-Expression: {start}{long} AND GPL-3.0-only{end}\nSPDX-License-Identifier: ISC and\nLGPL-2.1-only"
    found = license_scan.Scanner().scan(text.encode())
    assert (found["labels"], found["n_expressions"], found["permissive"]) == ("apache,bsd,gpl,mit", 1, False)


def test_rules_and_policies(spark):
    docs = support.read(spark, SMALL, "documents")
    entries = quality_rules.ledger(docs).cache()
    policy = quality_rules.CURRENT
    kept = {r.doc_id for r in quality_rules.applied(entries, policy).where("kept").collect()}
    for r in quality_rules.ablations(entries, policy).collect():
        without = quality_rules.Policy("x", tuple(n for n in policy.fatal if n != r.rule))
        assert len({x.doc_id for x in quality_rules.applied(entries, without).where("kept").collect()} - kept) == r.n_only


def test_rules_of_urls(spark):
    rows = [("http://Sub.Example.org/es/1", "example.org/es/", "block"), ("http://example.org/en/1?x", "example.org/en/1", "block"),
            ("http://example.org/en/2", "org/", "allow"), ("http://org/", "org/", "allow"), ("http://org", None, None), ("http://xorg/", None, None),
            ("http://a.com/de/", "com/de/", "block"), ("http://a.com/de", None, None), ("a.com/de/", None, None), ("x://a.com/fr/://b", "com/fr/", "allow")]
    df = spark.createDataFrame(rows, "url string, want string, said string")
    host, path = url_filter.parts(F.col("url"))
    df = df.withColumns({"host": host, "path": path})
    rule, verdict = url_filter.ruled(F.col("host"), F.col("path"))
    got = df.select("want", "said", rule.alias("rule"), verdict.alias("verdict")).collect()
    assert [(r.rule, r.verdict) for r in got] == [(r.want, r.said) for r in got]
    with pytest.raises(ValueError):
        url_filter.ruled(F.col("host"), F.col("path"), (("a/", "allow"),) * 501)


def test_entropy(spark):
    got = spark.createDataFrame([("aabb",), ("aaaa",), ("",), ("abcd",)], "t string").select(url_filter.entropy(F.col("t")).alias("e")).collect()
    assert np.allclose([r.e for r in got], [1, 0, 0, 2])


def test_markov_finds_random_runs_and_leaves_words(spark):
    docs = support.read(spark, SMALL, "documents")
    model = secret_scan.fit(docs)
    rng = random.Random(2)
    runs = ["".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(32)) for _ in range(50)]
    found = spark.createDataFrame([(k, f"see {t} there") for k, t in enumerate(runs)], "doc_id long, text string")
    hits = [r.markov for r in secret_scan.scanned(found, model).collect()]
    assert sum(len(h) == 1 and (h[0].start, h[0].end) == (4, 36) for h in hits) >= 45
    calm = secret_scan.scanned(docs.select("doc_id", "text"), model).where(F.size("markov") > 0).count()
    assert calm <= 0.01 * docs.count()


def test_native_plans_have_no_python(spark):
    for name in ("op3_mix_sources", "op4_url_filter", "op7_quality_rules", "op10_secret_scan"):
        plan = catalog.QUERIES[name](spark, SMALL)._jdf.queryExecution().toString()
        assert not any(word in plan for word in ("EvalPython", "MapInArrow", "MapInPandas", "CartesianProduct", "NestedLoop")), name


def test_neighbours_reach_their_recall(spark):
    """Clusters, copies and noise: most of the true neighbours are found, with their exact distances."""
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((30, 24))
    vectors = [(i, (centres[i % 30] + rng.standard_normal(24) * (0.1 if i % 3 else 0.8)).tolist()) for i in range(9000)]
    vectors += [(9000 + i, vectors[i % 5][1]) for i in range(600)]
    want = {}
    for q, _, i, d in brute.nearest(vectors, 100, 10):
        want.setdefault(q, []).append((i, d))
    got = {}
    for r in neighbours.nearest(spark.createDataFrame(vectors, "vec_id long, embedding array<double>")).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    place = {i: v for i, v in vectors}
    hits = 0
    for q, near in want.items():
        found = sorted(got[q])
        assert [r for r, _, _ in found] == list(range(1, 11)) and [(d, i) for _, i, d in found] == sorted((d, i) for _, i, d in found)
        assert all(d == pytest.approx(np.linalg.norm(np.subtract(place[q], place[i])), rel=1e-12) for _, i, d in found)
        hits += len({i for _, i, _ in found} & {i for i, _ in near})
    assert hits >= 0.95 * 10 * len(want)


def test_neighbours_in_passes_and_blocks(spark, monkeypatch):
    vectors = support.read(spark, SMALL, "embeddings")
    whole = sorted(map(tuple, neighbours.nearest(vectors, every=10).collect()))
    monkeypatch.setattr(neighbours, "PASS_BYTES", 10_000)
    assert sorted(map(tuple, neighbours.nearest(vectors.repartition(5), every=10).collect())) == whole


def test_collisions_select_what_is_verified():
    rng = np.random.default_rng(4)
    vectors = rng.standard_normal((2000, 64))
    block = neighbours.Block(list(range(2000)), list(range(2000)), vectors)
    seen = []
    query = vectors[0] + 0.01 * rng.standard_normal(64)
    radius = np.array([0.05, 0.1])
    low, high = block.windows(neighbours.projected(query[None]), radius[None])
    exact = neighbours.distances
    try:
        neighbours.distances = lambda v, q: seen.append(len(v)) or exact(v, q)
        best = block.search(query, -1, low[0], high[0], radius, [], 1, neighbours.threshold())
    finally:
        neighbours.distances = exact
    assert best[0][3] == 0 and sum(seen) == 1  # windows have grown until one vector lay within; no other was compared


@pytest.mark.parametrize("seed", range(3))
def test_skyband_against_all_pairs(seed):
    rng = np.random.default_rng(seed)
    n, total, place = rng.integers(0, 30, 1500), rng.integers(0, 60, 1500), rng.permutation(1500)
    for k in (1, 5, 50):
        above = (n[None] >= n[:, None]) & (total[None] <= total[:, None]) & (place[None] < place[:, None])
        assert sorted(divergence._skyband(n, total, place, k).tolist()) == np.flatnonzero(above.sum(axis=1) < k).tolist()


@pytest.mark.parametrize("tile, buckets, ranks", [(64, 64, 50), (2, 3, 4), (1, 1, 1)])
def test_divergence_matches_brute_force(spark, tile, buckets, ranks):
    rng = random.Random(7)
    words = ["w" + chr(97 + i) * (i % 3 + 1) for i in range(26)] + ["\u00e9t\u00e9", "\U0001F600", "zz"]
    rows = [(rng.choice(("en", "en", "de", None, "fr")), rng.choice(("a", "b", "c", "d", "e", "hot", "hot", "hot", None)),
             " ".join(rng.choices(words, weights=range(1, 30), k=rng.randrange(25)))) for _ in range(400)] + [("xx", "only", "wa"), ("yy", "p", None), ("yy", "q", "Rare1rare")]
    df = spark.createDataFrame(rows, "lang string, source string, text string")
    got = divergence.audit(df, least_documents=6, ranks=ranks, tile=tile, buckets=buckets).collect()
    assert sorted(map(tuple, got)) == sorted(brute.divergence(rows, 6, ranks))


def _talks(seed):
    rng, rows = random.Random(seed), {}
    for _ in range(90):
        c = rng.randrange(-30, 120)
        for t in range(rng.choice((0, 1, 2, 4, 7, 13))):
            rows[c, t if t else rng.choice((None, 0))] = (rng.choice(("user", "assistant", None)), rng.choice(("x", "y z", " x  y\tz", "", None)))
    copies = [(200 + c, t, "user", f"t{t}") for c in range(50) for t in range(10 + (c % 7 == 0))]
    return [(c, t, *v) for (c, t), v in rows.items()] + copies


@pytest.mark.parametrize("segment, limit", [(4096, 4096), (4096, 12), (3, 4096), (2, 5), (1, 1)])
def test_tree_matches_brute_force(spark, segment, limit):
    rows = _talks(segment * limit)
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").repartition(5)
    got = [tuple(r) for r in prefix_tree.trie(df, segment, limit).collect()]
    assert sorted(got, key=str) == sorted(brute.prefix_tree(rows), key=str)


def test_turns_of_a_long_conversation_are_spread(spark):
    df = spark.range(20_000).select(F.lit(7).cast("long").alias("conv_id"), F.col("id").cast("int").alias("turn"), F.lit("u").alias("role"), F.col("id").cast("string").alias("text"))
    placed = prefix_tree.turns(df).select("at", F.spark_partition_id().alias("part")).collect()
    assert sorted(r.at for r in placed) == list(range(1, 20_001))
