"""License scans: Aho-Corasick finds notice phrases and identifier tags; a shunting-yard parser reads tagged expressions."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.support import plain_words

#: The base phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: More phrases of licence notices, as words.
NOTICES = {
    "affero general public license": "agpl",
    "lesser general public license": "lgpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "boost software license": "bsl",
    "bsd license": "bsd",
    "isc license": "isc",
    "redistribution and use in source and binary forms": "bsd",
    "permission is hereby granted free of charge": "mit",
    "permission to use copy modify and or distribute this software": "isc",
    "licensed under the apache license": "apache",
    "cc0": "cc0",
    "cc by": "cc-by",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc by nc": "cc-by-nc",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by nc nd": "cc-by-nc-nd",
    "all rights reserved": "all-rights-reserved",
}
#: What stands before a licence expression.
TAGS = ("spdx-license-identifier:", "license-expression:")
#: Families that may be used freely, and exceptions that make a licence so.
PERMISSIVE = frozenset({"mit", "apache", "bsd", "isc", "cc0", "cc-by", "bsl", "zlib", "unlicense", "python"})
FREEING = frozenset({"classpath-exception", "llvm-exception", "gcc-exception"})
#: How sure one kind of evidence is by itself.
SURE = {"tag": 0.95, "base": 0.8, "notice": 0.6}

_TOKEN = re.compile(r"[\x20\t]*(\(|\)|[a-z0-9][a-z0-9.+:-]*)")
_VERSION = re.compile(r"[-:.+]?(v?\d[\d.]*|only|or-later|clause|\+)+(?=$|-)")
RANK = {"or": 1, "and": 2, "with": 3}


def family(identifier: str) -> str:
    """A licence identifier without versions: apache-2.0 is apache, gpl-3.0-or-later is gpl, bsd-3-clause is bsd."""
    name = _VERSION.sub("", identifier.rstrip("+.")).strip("-.:")
    return re.sub(r"-(only|or-later|clause)$", "", name) or identifier


def postfix(text: str, at: int = 0) -> list[str]:
    """The expression that starts at `at` in `text` in postfix order, by shunting-yard; with binds before and before or.

    It ends where an operand follows an operand, at the end of its line, or at a bracket that closes nothing. An
    expression whose operators lack operands, or whose brackets stay open, gives nothing.
    """
    out: list[str] = []
    waiting: list[str] = []
    operand, depth = False, 0
    while m := _TOKEN.match(text, at):
        token = m[1]
        if token in RANK:
            if not operand:
                return []
            while waiting and waiting[-1] != "(" and RANK[waiting[-1]] >= RANK[token]:
                out.append(waiting.pop())
            waiting.append(token)
            operand = False
        elif token == "(":
            if operand:
                break
            waiting.append(token)
            depth += 1
        elif token == ")":
            if not depth:
                break
            if not operand:
                return []
            while waiting[-1] != "(":
                out.append(waiting.pop())
            waiting.pop()
            depth -= 1
        else:
            if operand:
                break
            out.append(token)
            operand = True
        at = m.end()
    if depth or not operand:
        return []
    return out + waiting[::-1]


def evaluated(order: list[str]) -> tuple[set[str], bool]:
    """Families that an expression names, and whether it lets the text be used freely: or needs one side, and both."""
    stack: list[tuple[set[str], bool, str]] = []
    for token in order:
        if token not in RANK:
            name = family(token)
            stack.append(({name}, name in PERMISSIVE, name))
            continue
        right, left = stack.pop(), stack.pop()
        if token == "with":  # the right side names an exception, not a licence
            stack.append((left[0], left[1] or right[2] in FREEING, left[2]))
        else:
            free = left[1] or right[1] if token == "or" else left[1] and right[1]
            few, many = sorted((left[0], right[0]), key=len)
            many |= few
            stack.append((many, free, ""))
    return stack[0][0], stack[0][1]


def _automaton(entries: dict[str, object]) -> ahocorasick.Automaton:
    made = ahocorasick.Automaton()
    for key, value in entries.items():
        made.add_word(key, value)
    made.make_automaton()
    return made


class Scanner:
    """Automata over the words of a text, as ` word word `, and over the text itself for tags."""

    def __init__(self) -> None:
        phrases: dict[str, tuple] = {}
        for words, label in NOTICES.items():
            phrases[f" {words} "] = (len(words), label, False)
        for words, label in BASE.items():
            phrases[f" {words} "] = (len(words), label, True)
        self.phrases, self.tags = _automaton(phrases), _automaton({t: len(t) for t in TAGS})
        self.overlap = max(k.count(" ") for k in phrases) - 2

    def places(self, data: bytes) -> Iterator[tuple[int, str, bool, int]]:
        """(first word, label, is base, words in all so far) of every phrase, each once; last (-1, "", False, words)."""
        tail: list[bytes] = []
        n = 0
        for block in plain_words(data):
            words = tail + block
            base = n - len(tail)
            n += len(block)
            text = f" {b' '.join(words).decode('latin-1')} "
            counted, at = 0, 0
            for end, (length, label, is_base) in self.phrases.iter(text):
                start = end - length - 1
                counted, at = counted + text.count(" ", at, start) if start >= at else text.count(" ", 0, start), start
                # The whole phrase in the words kept from before was reported with them.
                if counted + text.count(" ", start + 1, end) + 1 > len(tail):
                    yield base + counted, label, is_base, n
            tail = words[-self.overlap:]
        yield -1, "", False, n

    def scan(self, data: bytes | None) -> dict:
        data = data or b""
        base: dict[str, int] = {}
        longest: dict[int, str] = {}
        first = last = None
        n_base = n_words = 0
        for at, label, is_base, n_words in self.places(data):
            if at < 0:
                break
            if is_base:
                base[label] = base.get(label, 0) + 1
                n_base += 1
                first = at if first is None or at < first else first
                last = at if last is None or at > last else last
            else:
                longest[at] = label  # a longer phrase at one place ends later
        named, free = set(), []
        lower = data.lower().decode("latin-1")
        for end, _ in self.tags.iter(lower):
            if order := postfix(lower, end + 1):
                families, ok = evaluated(order)
                named |= families
                free.append(ok)
        notices = set(longest.values())
        doubt = (1 - SURE["base"]) ** len(base) * (1 - SURE["notice"]) ** len(notices) * (1 - SURE["tag"]) ** len(named)
        return {
            "n_words": n_words, "n_base": n_base, "first_word": first, "last_word": last,
            "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(set(base) | notices | named)),
            "score": round(1 - doubt, 6), "n_expressions": len(free), "permissive": all(free) if free else None}


FOUND = {"n_words": "long", "n_base": "long", "first_word": "long", "last_word": "long", "base_labels": "string", "labels": "string",
         "score": "double", "n_expressions": "long", "permissive": "boolean"}
_ARROW = {"long": pa.int64(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_()}
_SPARK = {"long": T.LongType(), "string": T.StringType(), "double": T.DoubleType(), "boolean": T.BooleanType()}


def _scanner() -> Callable[[pa.Array], pa.Array]:
    made: list[Scanner] = []

    def run(texts: pa.Array) -> pa.Array:
        if not made:
            made.append(Scanner())
        return pa.array([made[0].scan(t.as_py()) for t in texts], pa.struct([(k, _ARROW[v]) for k, v in FOUND.items()]))

    return run


def found_column(text: Column) -> Column:
    kind = T.StructType([T.StructField(k, _SPARK[v]) for k, v in FOUND.items()])
    return F.arrow_udf(_scanner(), kind)(text.cast("binary"))


def licenses(docs: DataFrame) -> DataFrame:
    """doc_id and what each row's whole text says of licences; every row of `docs` comes back.

    n_base counts the places of base phrases, first_word and last_word are their smallest and largest start. `labels`
    adds those of notice phrases, the longest at a place, and the families in tagged expressions, which are read to
    their end whatever their length. `score` grows with
    each label found, and is 0 without any. `permissive` says whether all tagged expressions allow free use; null
    without one, or if none can be read. A null or empty text has no words and no labels.
    """
    return docs.select("doc_id", found_column(F.col("text")).alias("f")).select("doc_id", "f.*")
