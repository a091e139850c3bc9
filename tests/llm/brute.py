"""Plain versions of the contracts, one document at a time."""

import hashlib
import re
from collections import Counter, defaultdict

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def quality(text):
    text = text or ""
    words = WORDS.findall(text)
    grams = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = set()
    for i in range(len(words) - 7):
        if grams[tuple(words[i : i + 8])] > 1:
            covered.update(range(i, i + 8))
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORDS.search(line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), n < 20 or 100 * len(covered) > 30 * n


def leaks(text, items):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words = pattern.findall(lower(text))
    hit, ids = set(), set()
    for item, body in items:
        own = pattern.findall(lower(body))
        n = min(10, len(own))
        grams = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)} if n else set()
        for i in range(len(words) - n + 1 if n else 0):
            if tuple(words[i : i + n]) in grams:
                hit.update(range(i, i + n))
                ids.add(str(item))
    return len(words), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)


def shingles(text):
    words = WORDS.findall(lower(text))
    if not words:
        return set()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def components(docs):
    """{doc_id: (set size, smallest id)} of (doc_id, text)."""
    sets = {i: shingles(t) for i, t in docs}
    boss = {i: i for i in sets}

    def root(x):
        while boss[x] != x:
            x = boss[x]
        return x

    of = defaultdict(set)
    for i, s in sets.items():
        for x in s:
            of[x].add(i)
    for i, s in sets.items():
        shared = Counter(j for x in s for j in of[x] if j > i)
        for j, n in shared.items():
            if 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                a, b = sorted((root(i), root(j)))
                boss[b] = a
    return {i: (len(s), root(i)) for i, s in sets.items()}


def repeats(docs, length=100):
    """{doc_id: (bytes, removed, spans, sha256 of the rest)} of (doc_id, text) in order of doc_id."""
    seen, out = set(), {}
    for i, text in sorted(docs):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            w = raw[p : p + length]
            if w in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(w)
        rest = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        spans = len(re.findall(b"\1+", bytes(gone)))
        out[i] = (len(raw), sum(gone), spans, hashlib.sha256(rest).hexdigest())
    return out


def targets(sizes, cap=3):
    """{source: target} by handing out again what is above the cap, until nothing is."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    full, total = {}, sum(sizes.values())
    while True:
        free = [s for s in names if s not in full]
        share = {s: (total - sum(full.values())) * weight[s] / sum(weight[x] for x in free) for s in free} if free else {}
        over = [s for s in free if share[s] > cap * sizes[s]]
        if not over:
            return {**full, **share}
        full |= {s: cap * sizes[s] for s in over}
