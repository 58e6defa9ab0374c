"""Brute force shared by tests."""

import re


def shingles(text, words):
    seq = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return {tuple(seq[k:k + words]) for k in range(max(1, len(seq) - words + 1))} if seq else set()


def near_groups(rows, words, percent):
    """Of (id, text) rows those that stay: one row of each component of similar
    texts, that of the smallest id; rows without an id or words all stay."""
    texts = [(i, t) for i, t in dict.fromkeys(rows) if i is not None and shingles(t, words)]
    sets = [shingles(t, words) for _, t in texts]
    group = list(range(len(texts)))

    def find(a):
        while group[a] != a:
            a = group[a]
        return a
    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                group[max(find(a), find(b))] = min(find(a), find(b))
    stay = {}
    for a, row in enumerate(texts):
        stay[find(a)] = min(stay.get(find(a), row), row)
    kept = set(stay.values())
    return [r for r in dict.fromkeys(rows) if r in kept] + [r for r in rows if r[0] is None or not shingles(r[1], words)]
