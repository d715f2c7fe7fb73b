"""Small graphs with known answers, and random ones."""

from __future__ import annotations

import random

TINY = [(1, 2), (1, 3), (2, 4), (3, 5), (3, 4), (4, 1), (5, 1), (6, 2), (7, 6), (7, 2)]
HUNDREDS = [(100, 300), (200, 400), (400, 100), (3, 5), (4, 100), (300, 400), (300, 100)]
LOOPS = [(1, 1), (1, 2), (2, 1), (2, 3), (3, 1), (1, 2), (5, 5), (5, 5)]
DIRTY = "100,300\n200,400\n400,100\n\nfoo,bar\n3,5\n4,\n,100\n1,2,9\n 7,8\n007,8\n"
DIRTY_EDGES = [(100, 300), (200, 400), (400, 100), (3, 5), (1, 2), (7, 8), (7, 8)]


def random_multigraph(seed, nodes=14, edges=90):
    """Copies, self-loops, negative ids and one hub on a third of the edges."""
    rng = random.Random(seed)
    ids = [rng.randint(-50, 50) * 2**rng.randint(0, 40) for _ in range(nodes)]
    hub = ids[0]
    pairs = []
    for _ in range(edges):
        a, b = rng.choice(ids), rng.choice(ids)
        kind = rng.random()
        if kind < 0.17:
            a = hub
        elif kind < 0.34:
            b = hub
        pairs.append((a, b))
        if rng.random() < 0.15:
            pairs.append((a, b))
    return pairs


def hub_graph(leaves=60, copies=40):
    """One hub on nearly all edges, and one edge repeated ``copies`` times."""
    pairs = [(0, v) for v in range(1, leaves)] + [(v, 0) for v in range(1, leaves)]
    pairs += [(v, v + 1) for v in range(1, leaves - 1)]
    pairs += [(1, 2)] * copies
    return pairs


def side_by_side(*graphs):
    """One graph whose parts share no node, so that one query tests them all."""
    return [(a + k * 10**15, b + k * 10**15) for k, g in enumerate(graphs) for a, b in g]
