"""Texts and brute-force components for the tests beside this file."""

from __future__ import annotations

import random
import re

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def words(r: random.Random, n: int) -> str:
    return " ".join("".join(r.choice(("an", "er", "th", "ed", "ou", "ñ", "é")) for _ in range(r.randint(1, 4))) for _ in range(n))


def components_of(rows, k, percent):
    sets = {}
    for i, x in rows:
        w = WORD.findall((x or "").encode().translate(LOWER))
        sets[i] = {tuple(w)} if 0 < len(w) < k else {tuple(w[j : j + k]) for j in range(len(w) - k + 1)}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def edited(r, text, n):
    w = text.split()
    for _ in range(n):
        w[r.randrange(len(w))] = words(r, 1)
    return " ".join(w)
