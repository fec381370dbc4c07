"""Plain, slow versions of the operators."""

import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def words(text, lower=False):
    return WORD.findall((text or "").translate(ASCII_LOWER) if lower else text or "")


def repeats(rows, window):
    """(doc_id, n_words, n_removed, kept) of rows (doc_id, text)."""
    first = {}
    for i, t in rows:
        w = words(t)
        for s in range(len(w) - window + 1):
            k = tuple(w[s : s + window])
            if i is not None and first.get(k, i) >= i:
                first[k] = i
    out = []
    for i, t in rows:
        w = words(t)
        gone = set()
        for s in range(len(w) - window + 1):
            if i is not None and first[tuple(w[s : s + window])] < i:
                gone |= set(range(s, s + window))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def shingles(text, size):
    w = words(text, True)
    return {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def near(rows, size, percent):
    """(doc_id, n_shingles, component_id, kept) of rows (doc_id, text)."""
    sets = [(i, shingles(t, size)) for i, t in rows]
    up = {i: i for i, _ in sets if i is not None}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    by = {}
    for k, (_, s) in enumerate(sets):
        for x in s:
            by.setdefault(x, []).append(k)
    for k, (i, s) in enumerate(sets):
        for j in {j for x in s for j in by[x] if j > k}:
            o, t = sets[j]
            both = len(s & t)
            if i is not None and o is not None and 100 * both >= percent * (len(s) + len(t) - both):
                a, b = root(i), root(o)
                up[max(a, b)] = min(a, b)
    return [(i, len(s), None if i is None else root(i), i is None or root(i) == i) for i, s in sets]


def hits(rows, items, size=10):
    """(doc_id, n_words, n_hit, n_items, item ids) of rows (doc_id, text)."""
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    split = lambda t: word.findall((t or "").translate(ASCII_LOWER))
    windows = {}
    for i, t in items:
        w = split(t)
        for s in range(max(1, len(w) - size + 1) if w else 0):
            windows.setdefault(tuple(w[s : s + size]), set()).add(i)
    lengths = {len(k) for k in windows}
    out = []
    for i, t in rows:
        w, hit, found = split(t), set(), set()
        for n in lengths:
            for s in range(len(w) - n + 1):
                if (own := windows.get(tuple(w[s : s + n]))) is not None:
                    hit |= set(range(s, s + n))
                    found |= {x for x in own if x is not None}
        out.append((i, len(w), len(hit), len(found), ",".join(sorted(map(str, found)))))
    return out
