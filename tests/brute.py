"""Plain Python answers for small graphs, written from the definitions."""

from __future__ import annotations

from collections import Counter


def two_paths(pairs):
    return Counter((a, b, d) for a, b in pairs for c, d in pairs if b == c)


def closed_walks(pairs):
    copies = Counter(pairs)
    found = Counter()
    for (a, b), n1 in copies.items():
        for (b2, c), n2 in copies.items():
            if b2 == b and (c, a) in copies:
                found[(a, b, c)] += n1 * n2 * copies[(c, a)]
    return found


def degrees(pairs):
    ins = Counter(b for _, b in pairs)
    outs = Counter(a for a, _ in pairs)
    return {v: (ins[v], outs[v]) for v in set(ins) | set(outs)}


def neighbours(pairs, endpoint):
    """Node -> Counter of the ids at the other end."""
    lists = {}
    for follower, followee in pairs:
        key, other = (followee, follower) if endpoint == "followee" else (follower, followee)
        lists.setdefault(key, Counter())[other] += 1
    return lists
