"""Plain Python versions of the operators, for small inputs."""

import hashlib
import itertools
import re

PLAIN = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingles(text, size):
    w = PLAIN.findall(lower(text))
    if len(w) < size:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}


def near_duplicates(rows, size=4, percent=80):
    """{id: (n_shingles, component)} for unique ids."""
    sets = {i: shingles(t, size) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by = {}
    for i, s in sets.items():
        for g in s:
            by.setdefault(g, []).append(i)
    pairs = {p for own in by.values() for p in itertools.combinations(sorted(own), 2)}
    for a, b in pairs:
        inter = len(sets[a] & sets[b])
        if 100 * inter >= percent * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


def contamination(docs, items, size=10):
    """{doc: (n_words, n_hit, sorted item ids)}"""
    windows = {}
    for item, text in items:
        w = ALNUM.findall(lower(text))
        n = min(size, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(str(item))
    lengths = {len(w) for w in windows}
    out = {}
    for doc, text in docs:
        w = ALNUM.findall(lower(text))
        hit, found = set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if own := windows.get(tuple(w[i : i + n])):
                    hit.update(range(i, i + n))
                    found |= own
        out[doc] = (len(w), len(hit), sorted(found))
    return out


def repeated_windows(rows, size=20):
    """{id: (n_words, n_removed, sha256 of the kept words)}"""
    first, words = {}, {}
    for i, t in sorted(rows):
        words[i] = w = PLAIN.findall(t or "")
        for s in range(len(w) - size + 1):
            first.setdefault(tuple(w[s : s + size]), (i, s))
    out = {}
    for i, w in words.items():
        gone = set()
        for s in range(len(w) - size + 1):
            if first[tuple(w[s : s + size])] < (i, s):
                gone.update(range(s, s + size))
        kept = [x for j, x in enumerate(w) if j not in gone]
        out[i] = (len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return out


SECRETS = [
    ("assign", re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 8),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16),
    ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 32),
]


def secrets(text):
    spans = [(m.start(), k, kind, m.end()) for k, (kind, p, ok) in enumerate(SECRETS) for m in p.finditer(text or "") if ok(m)]
    return [f"{kind}:{s}:{e}" for s, _, kind, e in sorted(spans)]
