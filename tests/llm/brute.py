"""Plain versions of what the text operators must return, for small inputs."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import xxhash

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def plain(text):
    return PLAIN.findall((text or "").translate(LOWER))


def contamination(text, items):
    """items: (item_id, text); an item without an id has windows, but isn't reported."""
    words, hit, found = plain(text), set(), set()
    for item, body in items:
        if body is None:
            continue
        other = plain(body)
        size = min(13, len(other))
        windows = {tuple(other[i:i + size]) for i in range(len(other) - size + 1)} if size else set()
        for i in range(len(words) - size + 1):
            if size and tuple(words[i:i + size]) in windows:
                found.update([] if item is None else [str(item)])
                hit.update(range(i, i + size))
    digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
    return len(words), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(words)


def measured(text):
    text = text or ""
    words = SPACED.findall(text)
    grams = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    twice = Counter(grams)
    repeated = {p for i, g in enumerate(grams) if twice[g] > 1 for p in range(i, i + 5)}
    lines = [x for x in text.split("\n") if SPACED.search(x)]
    n = len(words)
    return (n, sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(repeated),
            n < 10 or 100 * len(repeated) > 20 * n)


def fingerprint(text):
    words = SPACED.findall((text or "").translate(LOWER))
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def shingles5(text):
    words = SPACED.findall((text or "").translate(LOWER))
    return {" ".join(words[i:i + 5]) for i in range(len(words) - 4)} or ({" ".join(words)} if words else set())


def similar(a, b):
    """Jaccard similarity of two shingle sets of 0.8 or more; empty sets are alike by their fingerprint only."""
    shared = len(a & b)
    return bool(shared) and 5 * shared >= 4 * (len(a) + len(b) - shared)


def near_copy_ids(rows):
    """rows: (doc_id, text); the smallest id reachable over two fingerprint bits or near copies, for each row."""
    prints = [(d, fingerprint(t)) for d, t in rows]
    of_text = {t: (shingles5(t), f) for (_, t), (_, f) in zip(rows, prints)}
    texts, more = list(of_text.values()), []
    for i, (a, fa) in enumerate(texts):
        more += [(fa, fb) for b, fb in texts[i + 1:] if similar(a, b)]
    return component_ids(prints, more)


def component_ids(rows, more=()):
    """rows: (doc_id, fingerprint); the smallest id reachable over at most two bits, or the links of `more`, for each row."""
    prints = sorted({f for _, f in rows})
    root = {f: f for f in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(prints):
        for b in prints[i + 1:]:
            if (a ^ b).bit_count() <= 2 and find(a) != find(b):
                root[find(b)] = find(a)
    for a, b in more:
        if find(a) != find(b):
            root[find(b)] = find(a)
    smallest = {}
    for d, f in rows:
        if d is not None:
            smallest[find(f)] = min(smallest.get(find(f), d), d)
    return [smallest.get(find(f)) for _, f in rows]


def base_spans(text):
    text = text or ""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return [f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(spans)]


def licences(text):
    words, places, labels = plain(text), [], set()
    for phrase, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")):
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i:i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def mix(rows):
    """rows: (doc_id, text, source); size, source_size, target and taken of each row."""
    size = [len(SPACED.findall(t or "")) for _, t, _ in rows]
    sources = sorted({s for _, _, s in rows if s is not None}) + [None] * any(s is None for _, _, s in rows)
    total = {s: sum(n for n, r in zip(size, rows) if r[2] == s) for s in sources}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sources)}
    target, capped = {}, set()
    while True:
        left = 1.5 * sum(size) - sum(2 * total[s] for s in capped)
        rest = sum(weight[s] for s in sources if s not in capped)
        target = {s: 2.0 * total[s] if s in capped else left * weight[s] / rest for s in sources}
        over = {s for s in sources if s not in capped and target[s] > 2 * total[s]}
        if not over:
            break
        capped |= over
    return size, total, target


def nearest(rows, every, k):
    """rows: (id, vector); (query, rank, id, distance) of the k nearest of each row whose id is divisible by `every`."""
    def takes_part(v):
        return v is not None and None not in v and all(map(math.isfinite, v)) and any(v)

    out = []
    for i, (q, a) in enumerate(rows):
        if q is not None and q % every == 0 and takes_part(a):
            near = sorted((math.dist(a, b), c is None, c or 0) for j, (c, b) in enumerate(rows) if j != i and takes_part(b) and len(a) == len(b))
            out += [(q, r + 1, None if unnamed else c, d) for r, (d, unnamed, c) in enumerate(near[:k])]
    return out


def divergence(rows, least, ranks):
    """rows: (lang, source, text)."""
    found, counts, docs = [], {}, {}
    for lang, source, text in rows:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        counts.setdefault(lang or "", {}).setdefault(source or "", Counter()).update(terms)
        docs.setdefault(lang or "", Counter()).update(set(terms))
    for lang, groups in counts.items():
        kept = [t for t, n in docs[lang].items() if n >= least]

        def shares(c):
            total = sum(c[t] for t in kept) + 5 * len(kept)
            return {t: 1 + 1_000_000_000 * (c[t] + 5) // total for t in kept}

        whole = shares(sum(groups.values(), Counter()))
        own = {s: shares(c) for s, c in groups.items()}
        for s, p in own.items():
            pairs = [(-sum(abs(p[t] - q[t]) for t in kept), o) for o, q in own.items() if o != s]
            over = [(whole[t] - p[t], t) for t in kept if groups[s][t] and p[t] > whole[t]]
            for part, items in (("pair", sorted(pairs)), ("term", sorted(over)[:ranks])):
                found += [(lang, s, part, item, -v, r + 1) for r, (v, item) in enumerate(items)]
    return found


def prefix_tree(rows):
    """rows: (conv_id, turn, role, text); turn numbers don't repeat in a conversation."""
    told = {}
    for c, turn, role, text in rows:
        if c is not None:
            told.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in told.items()}
    made, members, children = {}, {}, {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        made[c] = own.get(c - int(math.fmod(c, 20)), [])[:h] + turns[h:]
        for d in range(len(made[c]) + 1):
            members.setdefault(tuple(made[c][:d]), []).append(c)
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[x] for x in children.get(p, ())) or 1
        saved[p] = sum(saved[x] for x in children.get(p, ())) + ((len(members[p]) - 1) * len(SPACED.findall(p[-1][1])) if p else 0)
    return [(
        min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children.get(p, ())), leaves[p], saved[p],
        hashlib.sha256(",".join(map(str, sorted(c for c in m if len(made[c]) == len(p)))).encode()).hexdigest()) for p, m in members.items()]
