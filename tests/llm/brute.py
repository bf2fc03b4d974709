"""Plain versions of the operators, one text at a time."""

from __future__ import annotations

import re
from collections import defaultdict

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def shingles(text, size=5):
    found = SPACED.findall((text or "").translate(FOLD))
    return {tuple(found[i : i + size]) for i in range(len(found) - size + 1)} if len(found) >= size else {tuple(found)} if found else set()


def classes(docs):
    """{id: smallest id reachable} of [(id, text)] with distinct ids."""
    sets = {key: shingles(text) for key, text in docs}
    post, parent = defaultdict(list), {key: key for key in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for key in sorted(sets):
        common = defaultdict(int)
        for shingle in sets[key]:
            for other in post[shingle]:
                common[other] += 1
            post[shingle].append(key)
        for other, n in common.items():
            if 100 * n >= 75 * (len(sets[key]) + len(sets[other]) - n):
                a, b = sorted((root(key), root(other)))
                parent[b] = a
    return {key: root(key) for key in sets}


def without_repeats(docs, window=13):
    """{id: (n_words, kept words)} of [(id, text)] with distinct ids."""
    split = {key: SPACED.findall(text or "") for key, text in docs}
    least = {}
    for key, own in split.items():
        for i in range(len(own) - window + 1):
            w = tuple(own[i : i + window])
            least[w] = min(least.get(w, key), key)
    out = {}
    for key, own in split.items():
        gone = {i + k for i in range(len(own) - window + 1) if least[tuple(own[i : i + window])] < key for k in range(window)}
        out[key] = (len(own), [w for i, w in enumerate(own) if i not in gone])
    return out


def contamination(docs, items, size=10):
    """[(n_words, words hit, items)] of [text] and [(item, text)]."""
    phrases = defaultdict(set)
    for item, text in items:
        own = ALNUM.findall((text or "").translate(FOLD))
        for i in range(max(1, len(own) - size + 1) if own else 0):
            phrases[tuple(own[i : i + size])].add("" if item is None else str(item))
    lengths, out = {len(p) for p in phrases}, []
    for text in docs:
        own, hit, found = ALNUM.findall((text or "").translate(FOLD)), set(), set()
        for n in lengths:
            for i in range(len(own) - n + 1):
                if (at := tuple(own[i : i + n])) in phrases:
                    hit |= set(range(i, i + n))
                    found |= phrases[at]
        out.append((len(own), hit, sorted(found)))
    return out
