"""Plain versions of the training-data contracts, for small fixtures."""

import hashlib
import random
import re
import zlib
from itertools import combinations

import numpy as np


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingles(text, k=4):
    words = re.findall("[^\x20\x09-\x0d]+", lower(text))
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def near_duplicates(docs, k=4):
    """doc_id -> (set size, component, kept); docs: list of (doc_id, text)."""
    sets = {i: shingles(t, k) for i, t in docs}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 80 * len(sets[a] | sets[b]):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


def one_link_clusters(k, clusters=12, size=102):
    """Rows of clusters of texts: all but the last kind are linked with each other, a text of the last kind with one of them alone, and nearly with the others."""
    rng, out = random.Random(17), []
    for c in range(clusters):
        base = [f"c{c}w{i}" for i in range(93 * k - 1)]  # 92 k shingles: ten changed words leave a similarity of 0.804, eleven 0.786
        places = rng.sample(range(k, len(base) - k, k), 17)
        changes = [rng.sample(places[5:], 6) for _ in range(size - 2)] + [rng.sample(places[5:], 5), places[:5]]
        rows = [" ".join(f"new{w}" if i in change else w for i, w in enumerate(base)) for change in changes]
        rng.shuffle(rows)
        out += [(len(out) + i, t) for i, t in enumerate(rows)]
    return out


def short_pairs(k, pairs=1500):
    """Texts of four shingles, each followed by the same one with another word at its end: a similarity of 0.8. Pairs share no word."""
    rows = [" ".join(f"p{p}w{i}" for i in range(k + 3 + longer)) for p in range(pairs) for longer in (0, 1)]
    return list(enumerate(rows))


def contamination(text, items, window=13):
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(t))
    mine, hit, found = words(text), set(), set()
    for i, t in items:
        w = words(t)
        for at in range(max(1, len(w) - window + 1) if w else 0):
            part = w[at : at + window]
            for k in range(len(mine) - len(part) + 1):
                if mine[k : k + len(part)] == part:
                    hit.update(range(k, k + len(part)))
                    found.add(i)
    digest = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
    return len(mine), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(mine)


PII = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def personal(text):
    def wanted(kind, m):
        digits = re.sub("[^0-9]", "", m)
        if kind == "ip":
            return all(int(p) <= 255 for p in m.split("."))
        if kind == "card":
            return 16 <= len(digits) <= 19 and luhn(digits)
        return kind == "email" or 8 <= len(digits) <= 15

    return {kind: [m.span() for m in re.finditer(p, text or "") if wanted(kind, m[0])] for kind, p in PII.items()}


def top(vectors, k=10, every=100):
    """Sorted (query, rank, id, score)."""
    v = [(i, np.floor(1024 * np.array(x, np.float64)).astype(object)) for i, x in vectors if i is not None and x is not None and all(y is not None and np.isfinite(y) for y in x)]
    out = []
    for q, a in v:
        if q % every == 0:
            scores = sorted(((-int(sum(a * b)), i) for i, b in v if i != q and len(a) == len(b)))[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores)]
    return sorted(out)


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())
