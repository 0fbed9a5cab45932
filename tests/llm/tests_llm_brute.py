"""Brute-force versions of decontamination and near-duplicate groups."""

import re
from collections import Counter, defaultdict

from vaultspark.llm import decontaminate

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_hits(docs, items, width=10):
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    windows = defaultdict(set)
    for item, t in items.items():
        w = word.findall((t or "").translate(LOW))
        k = min(width, len(w))
        for i in range(len(w) - k + 1 if k else 0):
            windows[tuple(w[i : i + k])].add(str(item))
    sizes = {len(x) for x in windows}
    out = {}
    for d, t in docs.items():
        w = word.findall((t or "").translate(LOW))
        hit, found = set(), set()
        for k in sizes:
            for i in range(len(w) - k + 1):
                if x := windows.get(tuple(w[i : i + k])):
                    hit.update(range(i, i + k))
                    found |= x
        out[d] = (len(w), len(hit), len(found), decontaminate.items_digest(sorted(found)), bool(hit))
    return out


def brute_groups(texts, k, percent):
    word = re.compile("[^\x20\x09-\x0d]+")
    sets = {}
    for d, t in texts.items():
        w = word.findall((t or "").translate(LOW))
        sets[d] = frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    held = defaultdict(list)
    for d in sorted(sets):
        shared = Counter(o for g in sets[d] for o in held[g])
        for g in sets[d]:
            held[g].append(d)
        for o, n in shared.items():
            if 100 * n >= percent * (len(sets[d]) + len(sets[o]) - n):
                a, b = find(d), find(o)
                parent[max(a, b)] = min(a, b)
    return {d: (len(s), find(d)) for d, s in sets.items()}
