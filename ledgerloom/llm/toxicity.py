"""Toxicity: a weighted lexicon matched by Aho-Corasick after folding look-alike letters and digits."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.support import calibrated, held_out, stored, training_rows

#: Labelled documents that lexicon and calibration are fitted on, at most.
TRAINING_ROWS = 20_000
THRESHOLD = 0.5
#: Entries that a lexicon may have, and how many times the odds of any labelled document those of an entry's holders
#: must be, at the lower end of a confidence interval this many standard deviations wide to each side. These two hold
#: where nothing can be compared; else one pair of the grid is chosen by cross-validation over FOLDS parts of the sample.
ENTRIES, ODDS, DEVIATIONS = 2_000, 5.0, 1.96
GRID_ODDS, GRID_DEVIATIONS, FOLDS = (3.0, 5.0, 10.0, 20.0), (1.28, 1.96, 2.58), 5
#: Lengths of the word beginnings that may become entries.
STEMS = range(4, 8)
#: Phrases in which a word of the lexicon means no harm.
EXCEPTIONS = ("trash can", "trash bin", "trash collection", "clown fish", "circus clown", "rodeo clown", "sore loser rule")

#: Look-alikes of Latin letters: Cyrillic, Greek and full-width ones, and digits inside words. l, i and 1 become one
#: letter, so that a 1 matches both. Marks that are set over or between letters vanish.
CYRILLIC, CYRILLIC_LATIN = "абвгеікмнорстухѕјьԁԛԝ", "abbreikmhopctyxsjbdqw"
GREEK, GREEK_LATIN = "αβεηικνορτυχω", "abenikvoptuxw"
DIGITS, DIGITS_LATIN = "013457", "oieast"
FOLD: dict[int, str | None] = {ord(a): b for a, b in zip(CYRILLIC + GREEK + DIGITS, CYRILLIC_LATIN + GREEK_LATIN + DIGITS_LATIN)}
FOLD |= {0xFF41 + k: chr(0x61 + k) for k in range(26)} | {0xFF10 + int(d): c for d, c in zip(DIGITS, DIGITS_LATIN)}
FOLD |= {c: None for c in (*range(0x300, 0x370), 0xAD, *range(0x200B, 0x2010), 0x2060, 0xFEFF)}
FOLD |= {ord("l"): "i", 0xFF4C: "i", ord("ı"): "i", ord("ł"): "i"}
FOLD |= {c: " " for c in range(128) if not chr(c).isalnum()}
FOLD |= {c: " " for c in (*range(0x2010, 0x2060), 0xA0, 0xA1, 0xAB, 0xB7, 0xBB, 0xBF, 0x3000)}


def folded(text: str | None) -> str:
    """Words of the text, folded, each between single spaces; " " if there are none."""
    words = (text or "").lower().translate(FOLD).split()
    return f" {' '.join(words)} " if words else " "


@dataclass
class Lexicon:
    """Weights of entries: " word " for whole words, " stem" for beginnings of words; and how a score is made of them."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = EXCEPTIONS
    bias: float = 0.0
    slopes: tuple[float, float] = (0.0, 0.0)

    def automaton(self) -> ahocorasick.Automaton:
        made = ahocorasick.Automaton()
        for entry, weight in self.weights.items():
            made.add_word(entry, (len(entry), weight))
        for phrase in self.exceptions:
            made.add_word(key := folded(phrase), (len(key), 0.0))
        made.make_automaton()
        return made


def mass(text: str, automaton: ahocorasick.Automaton) -> float:
    """Sum of the weights of the words of a folded text: each word by its heaviest entry, none inside an exception."""
    at: dict[int, float] = {}
    spared: list[tuple[int, int]] = []
    for end, (length, weight) in automaton.iter(text):
        start = end - length + 1
        if weight:
            at[start] = max(at.get(start, 0.0), weight)
        else:
            spared.append((start, end))
    for start, end in spared:
        for place in [p for p in at if start <= p < end] if len(at) < end - start else range(start, end):
            at.pop(place, None)
    return sum(at.values())


def masses(text: str, automaton: ahocorasick.Automaton, lexicons: list[tuple[int, float]]) -> list[float]:
    """`mass` of a folded text by each of several lexicons, its matches found once.

    The automaton holds (length, weights by width of the interval) for entries and (length, None) for exceptions; a
    lexicon is the place of its width and the least weight of its entries.
    """
    found = [(end - length + 1, end, weights) for end, (length, weights) in automaton.iter(text)]
    spared = {place for start, end, weights in found if weights is None for place in range(start, end)}
    live = [(start, weights) for start, _, weights in found if weights is not None and start not in spared]
    out = []
    for width, least in lexicons:
        at: dict[int, float] = {}
        for start, weights in live:
            if weights[width] >= least:
                at[start] = max(at.get(start, 0.0), weights[width])
        out.append(sum(at.values()))
    return out


def _pair(total: float, n_words: int) -> list[float]:
    return [math.log1p(total), math.log1p(100 * total / n_words) if n_words > 0 else 0.0]


def measures(text: str | None, automaton: ahocorasick.Automaton | None) -> np.ndarray:
    """What a score is made of: the mass, and the mass for a hundred words, both as logarithms."""
    words = folded(text)
    total = mass(words, automaton) if automaton is not None else 0.0
    return np.array(_pair(total, words.count(" ") - 1))


def _terms(stems: Iterable[int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Documents that hold each word or beginning, counted by fold and label; at most 200 documents' terms are held."""
    def flush(found: dict[int, Counter]) -> pa.RecordBatch:
        terms = sorted(set().union(*found.values()))
        return pa.RecordBatch.from_arrays(
            [pa.array(terms, pa.string()), *[pa.array([found[k][t] for t in terms], pa.int64()) for k in range(2 * FOLDS)]],
            names=["term", *COUNTS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, n = {k: Counter() for k in range(2 * FOLDS)}, 0
        for batch in batches:
            for text, fold, label in zip(batch.column("text"), batch.column("fold").to_pylist(), batch.column("label").to_pylist()):
                words = set(folded(text.as_py()).split())
                terms = {f" {w} " for w in words} | {f" {w[:k]}" for w in words for k in stems if len(w) >= k}
                found[2 * fold + (1 if label else 0)].update(terms)
                n += 1
                if n % 200 == 0:
                    yield flush(found)
                    found = {k: Counter() for k in range(2 * FOLDS)}
        yield flush(found)

    return run


#: Columns of counted terms: clean and toxic holders in each fold.
COUNTS = tuple(f"{label}{fold}" for fold in range(FOLDS) for label in ("clean", "toxic"))


def fold_of(text: Column) -> Column:
    """The part of the sample that a text is in: all rows of one text are in the same."""
    return F.pmod(F.xxhash64(text), F.lit(FOLDS)).cast("int")


def least_share(part: Column, whole: Column, deviations: Column | float = DEVIATIONS) -> Column:
    """The lower end of Wilson's interval for the share that `part` is of `whole`."""
    share, z2 = part / whole, deviations * deviations
    spread = deviations * F.sqrt(share * (1 - share) / whole + z2 / (4 * whole * whole))
    return (share + z2 / (2 * whole) - spread) / (1 + z2 / whole)


def weighted_terms(sample: DataFrame, odds: float, deviations: tuple[float, ...], left_out: tuple[int, ...], entries: int = ENTRIES) -> DataFrame:
    """(left_out, deviations, term, weight) of the entries that the sample without one fold gives, none left out at -1.

    `sample` has text and label. An entry is a word or word beginning whose holders are toxic at `odds` times those of
    any document. The odds are those of the least share of toxic holders that the counts allow, so a few holders are
    enough if all of them are toxic, they weigh less than many, and no number of documents is fixed. At most `entries`
    entries, the heaviest, for each fold and width of the interval. Nothing where one kind of label is missing.
    """
    sample = sample.select("text", "label", fold_of(F.col("text")).alias("fold"))
    totals = {(r["fold"], r["label"]): r["n"] for r in sample.groupBy("fold", "label").agg(F.count("*").alias("n")).collect()}  # two a fold
    cases = []
    for fold in left_out:
        kept = [k for k in range(FOLDS) if k != fold]
        clean, toxic = (sum(totals.get((k, label), 0) for k in kept) for label in (0, 1))
        if clean and toxic:
            held = {label: sum((F.col(f"{label}{k}") for k in kept), F.lit(0)).cast("double") for label in ("clean", "toxic")}
            cases.append(F.struct(
                F.lit(fold).alias("left_out"), held["clean"].alias("clean"), held["toxic"].alias("toxic"), F.lit(toxic / clean).alias("base")))
    if not cases:
        return sample.sparkSession.createDataFrame([], "left_out int, deviations double, term string, weight double")
    counted = sample.mapInArrow(_terms(STEMS), ", ".join(["term string", *[f"{c} long" for c in COUNTS]]))
    counted = counted.groupBy("term").agg(*[F.sum(c).alias(c) for c in COUNTS])
    holders = counted.select("term", F.explode(F.array(*cases)).alias("c")).select("term", "c.*").where("toxic > 0")
    holders = holders.withColumn("deviations", F.explode(F.array(*map(F.lit, deviations))))
    share = F.when(F.col("toxic") > 0, least_share(F.col("toxic"), F.col("toxic") + F.col("clean"), F.col("deviations")))
    ratio = share / (1 - share) / F.col("base")
    entered = holders.where(ratio >= odds).select("left_out", "deviations", "term", F.round(F.log(ratio), 6).alias("weight"))
    heaviest = Window.partitionBy("left_out", "deviations").orderBy(F.desc("weight"), "term")
    return entered.withColumn("place", F.row_number().over(heaviest)).where(F.col("place") <= entries).drop("place")


def lexicon_terms(sample: DataFrame, entries: int = ENTRIES, odds: float = ODDS, deviations: float = DEVIATIONS) -> dict[str, float]:
    """Words and word beginnings of the whole sample that become entries, with log-odds as weights."""
    return {r["term"]: r["weight"] for r in weighted_terms(sample, odds, (deviations,), (-1,), entries).collect()}  # `entries` rows


def _compared(sent) -> Callable[[pa.Array, pa.Array], pa.Array]:
    """The measures of a text by every lexicon of the grid, each made without the text's fold, one after another."""
    made: dict[int, ahocorasick.Automaton] = {}

    def run(texts: pa.Array, folds: pa.Array) -> pa.Array:
        by_fold, exceptions, lexicons = sent.value
        if not made:
            for fold, weights in by_fold.items():
                made[fold] = ahocorasick.Automaton()
                for entry, by_width in weights.items():
                    made[fold].add_word(entry, (len(entry), by_width))
                for phrase in exceptions:
                    made[fold].add_word(key := folded(phrase), (len(key), None))
                made[fold].make_automaton()
        out = []
        for text, fold in zip(texts, folds.to_pylist()):
            words = folded(text.as_py())
            n = words.count(" ") - 1
            out.append([v for total in masses(words, made[fold], lexicons) for v in _pair(total, n)])
        return pa.array(out, pa.list_(pa.float64()))

    return run


def losses(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[int, float]:
    """Documents that measures, calibrated on their labels, predict wrongly; and their mean log-loss."""
    v = np.clip(np.c_[x, np.ones(len(x))] @ calibrated(x, y, weight), -35, 35)
    wrong = int(weight[(v >= 0) != (y == 1)].sum())
    return wrong, round(float((weight * (np.log1p(np.exp(v)) - y * v)).sum() / weight.sum()), 6)


def chosen(sample: DataFrame, entries: int = ENTRIES, exceptions: tuple[str, ...] = EXCEPTIONS) -> tuple[Lexicon, float, float]:
    """The lexicon of the whole sample, and the odds and deviations its entries are chosen by.

    Every pair of the grid makes a lexicon without each fold in turn and measures that fold's documents by it. The pair
    whose measures, calibrated, predict the fewest documents wrongly is taken; at a tie the one of less log-loss, then of
    fewer odds and the wider interval. The same measures calibrate the lexicon: words that stand in toxic documents by
    chance say little about another fold. So both see training labels only, and no document by words learnt from it.
    Where the sample without some fold gives no entries, ODDS and DEVIATIONS are taken and the sample measures itself.
    """
    rows = weighted_terms(sample, min(GRID_ODDS), GRID_DEVIATIONS, (-1, *range(FOLDS)), entries).collect()  # `entries` rows for each fold and width
    by_fold: dict[int, dict[str, list[float]]] = {}
    for r in rows:
        by_fold.setdefault(r["left_out"], {}).setdefault(r["term"], [-1.0] * len(GRID_DEVIATIONS))[GRID_DEVIATIONS.index(r["deviations"])] = r["weight"]
    compared = all(fold in by_fold for fold in range(FOLDS))
    own = (ODDS, GRID_DEVIATIONS.index(DEVIATIONS))
    pairs = [(odds, width) for odds in GRID_ODDS for width in range(len(GRID_DEVIATIONS))] if compared else [own]
    lexicons = [(width, math.log(odds)) for odds, width in pairs]
    sent = sample.sparkSession.sparkContext.broadcast(
        ({k: by_fold.get(k if compared else -1, {}) for k in range(FOLDS)}, exceptions, lexicons))
    x = F.arrow_udf(_compared(sent), T.ArrayType(T.DoubleType()))("text", fold_of(F.col("text")))
    grouped = sample.select("label", F.transform(x, lambda v: F.round(v, 2)).alias("x")).groupBy("label", "x").agg(F.count("*").alias("n"))
    found = grouped.orderBy("label", "x").collect()  # a row for each document of the sample at most, 24 numbers each
    x, y, n = np.array([r["x"] for r in found]), np.array([r["label"] for r in found]), np.array([float(r["n"]) for r in found])
    measured = [x[:, 2 * k:2 * k + 2] for k in range(len(pairs))]
    best = min(range(len(pairs)), key=lambda k: (*losses(measured[k], y, n), pairs[k][0], -pairs[k][1]))
    width, least = lexicons[best]
    weights = {term: by_width[width] for term, by_width in by_fold.get(-1, {}).items() if by_width[width] >= least}
    w = calibrated(measured[best], y, n)
    return Lexicon(weights, exceptions, float(w[2]), (float(w[0]), float(w[1]))), pairs[best][0], GRID_DEVIATIONS[width]


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = TRAINING_ROWS, entries: int = ENTRIES,
        exceptions: tuple[str, ...] = EXCEPTIONS) -> Lexicon:
    """A lexicon and its calibration from at most `rows` labelled documents that are not held out.

    The sample is drawn and written once. Without labelled rows of both kinds the lexicon is empty, and no document is
    toxic.
    """
    sample = stored(training_rows(docs, labels, label, rows), "toxicity-sample")
    if sample.select("label").distinct().count() < 2:
        return Lexicon({}, exceptions, bias=-4.0)
    lexicon, _, _ = chosen(sample, entries, exceptions)
    return lexicon if lexicon.weights else Lexicon({}, exceptions, bias=-4.0)


def _scorer(sent) -> Callable[[pa.Array], pa.Array]:
    made: list = []

    def run(texts: pa.Array) -> pa.Array:
        lexicon = sent.value
        if not made:
            made.append(lexicon.automaton())
        slopes = np.array(lexicon.slopes)
        out = (measures(t.as_py(), made[0]) @ slopes + lexicon.bias for t in texts)
        return pa.array([round(1 / (1 + math.exp(-min(max(v, -35.0), 35.0))), 6) for v in out], pa.float64())

    return run


def score_column(text: Column, lexicon: Lexicon, docs: DataFrame) -> Column:
    return F.arrow_udf(_scorer(docs.sparkSession.sparkContext.broadcast(lexicon)), T.DoubleType())(text)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score (how likely label 1 is), predicted (1 from 0.5 on) of every row of `docs`.

    A text without words, null too, has no mass and gets the score of the bias. Rows without an id count as held out.
    Only texts enter a score.
    """
    lexicon = fit(docs, labels)
    scored = docs.select("doc_id", score_column(F.col("text"), lexicon, docs).alias("score"))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs` that are not predicted toxic."""
    return docs.where(score_column(F.col("text"), fit(docs, labels), docs) < THRESHOLD)
