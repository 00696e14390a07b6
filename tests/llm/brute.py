"""Plain definitions that the operators are compared with."""

from __future__ import annotations

import re
from collections import defaultdict

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def shingle_set(text, width=5):
    found = words(text)
    if not found:
        return frozenset()
    return frozenset(tuple(found[i : i + width]) for i in range(max(1, len(found) - width + 1)))


def components(size, links):
    """Index of the smallest member that each member reaches."""
    label = list(range(size))
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label


def near_duplicates(rows, percent):
    """(doc_id, set size, component id) per row; ids without null."""
    sets = [shingle_set(text) for _, text in rows]
    links = []
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= percent * len(a | sets[j]):
                links.append((i, j))
    label = components(len(rows), links)
    least = defaultdict(list)
    for (doc_id, _), name in zip(rows, label):
        least[name].append(doc_id)
    return sorted((doc_id, len(s), min(least[name])) for (doc_id, _), s, name in zip(rows, sets, label))
