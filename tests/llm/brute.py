"""Plain versions of what the operators compute."""

import hashlib
import math
import re
import zlib
from collections import Counter


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def lowered(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def rule_counts(t):
    w, win, seen, dup = words(t), {}, set(), 0
    for i in range(len(w) - 7):
        win.setdefault(tuple(w[i : i + 8]), []).append(i)
    hit = {i + j for v in win.values() if len(v) > 1 for i in v for j in range(8)}
    for line in (t or "").split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(hit)


def shingles(t, n=3):
    w = words(lowered(t))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def components(texts, n=3, num=90, den=100):
    """texts: (key, text) in order; the first key of each group."""
    parent = {}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [(k, shingles(t, n)) for k, t in texts]
    for k, _ in sets:
        parent.setdefault(k, k)
    for i, (a, s) in enumerate(sets):
        for b, r in sets[:i]:
            k = len(s & r)
            if s and r and k * den >= num * (len(s) + len(r) - k):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {k: find(k) for k, _ in sets}


def hits(text, items, n=10):
    """Number of words, hit words, and ids of the items found."""
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(t))
    w, hit, found = cut(text), set(), set()
    for item, t in items:
        v = cut(t)
        size = min(n, len(v))
        for i in range(len(v) - size + 1 if v else 0):
            for j in range(len(w) - size + 1):
                if w[j : j + size] == v[i : i + size]:
                    hit.update(range(j, j + size))
                    if item is not None:
                        found.add(str(item))
    return len(w), len(hit), sorted(found)


def digest(ids):
    return hashlib.sha256(",".join(ids).encode()).hexdigest()


def base_scores(rows):
    """rows: (id, text); (tokens, known, train tokens, base score) of each row."""
    count = Counter()
    tokens = [[*words(lowered(t)), None] for _, t in rows]
    for (i, _), w in zip(rows, tokens):
        if zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2:
            count.update(w)
    n, v = sum(count.values()), len(count)
    return [(len(w), sum(count[x] > 0 for x in w), n, sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w)) for w in tokens]


def water_fill(sizes, weights=(5, 2, 1), most=3):
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, left, free = {}, float(sum(sizes.values())), set(order)
    while free:
        share = left / sum(weight[s] for s in free)
        over = {s for s in free if share * weight[s] > most * sizes[s]}
        if not over:
            target |= {s: share * weight[s] for s in free}
            break
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
        free -= over
    return target


def binomial_at_most(k, n, p):
    return sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
