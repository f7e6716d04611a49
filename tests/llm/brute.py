"""Brute-force versions that several test modules use."""

import re
from collections import Counter, defaultdict

import xxhash

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))))


def brute_contamination(rows, bench, window):
    phrases = []
    for item, text in bench:
        w = words(text)
        phrases += [(tuple(w[i:i + window]), str(item)) for i in range(max(1, len(w) - window + 1)) if w]
    by = {}
    for p, item in phrases:
        by.setdefault(p, set()).add(item)
    sizes = {len(p) for p in by}
    out = []
    for r in rows:
        w, hit, items = words(r[1]), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (found := by.get(tuple(w[i:i + n]))):
                    hit.update(range(i, i + n))
                    items |= found
        out.append((r[0], len(w), len(hit), ",".join(sorted(items)), bool(hit) and 20 * len(hit) >= len(w)))
    return Counter(out)


def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    sh = [b" ".join(w[i:i + 4]) for i in range(max(1, len(w) - 3))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << i for i in range(64) if 2 * sum((x >> i) & 1 for x in h) > len(h))


def brute_components(rows):
    fps = [brute_fingerprint(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in range(len(rows)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 4:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    low = defaultdict(list)
    for i, r in enumerate(rows):
        low[find(i)].append(r[0])
    return fps, [min((x for x in low[find(i)] if x is not None), default=None) for i in range(len(rows))]
