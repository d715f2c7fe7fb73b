"""Answers computed by hand for small graphs."""

from __future__ import annotations

import pytest

import followgraph as fg
from followgraph.operators import counts, triangles
from graphs import HUNDREDS, LOOPS, TINY


def rows(df):
    return sorted(tuple(int(v) if not isinstance(v, str) else v for v in r) for r in df.collect())


PER_NODE = {
    "tiny": (TINY, {1: 4, 2: 3, 3: 2, 4: 2, 5: 1, 6: 1, 7: 0}),
    "hundreds": (HUNDREDS, {100: 3, 300: 2, 400: 2, 3: 0, 4: 0, 5: 0, 200: 0}),
    "loops": (LOOPS, {1: 9, 2: 4, 3: 1, 5: 4}),
}
WALKS = [
    (TINY, None, 9, 3),
    (TINY, 5, 6, 2),
    (HUNDREDS, None, 3, 1),
    (LOOPS, None, 21, 7),
]


@pytest.mark.parametrize("name", sorted(PER_NODE))
def test_two_paths_per_node(frame, name):
    pairs, want = PER_NODE[name]
    assert dict(rows(fg.two_path_by_node(frame(pairs)))) == want
    assert rows(fg.two_path_total(frame(pairs))) == [(sum(want.values()),)]
    assert fg.two_paths(frame(pairs)).count() == sum(want.values())


def test_truncated(frame):
    small = fg.truncate(frame(TINY), 5)
    assert rows(fg.edge_count(small)) == [(5,)]
    assert rows(fg.two_path_total(small)) == [(6,)]
    assert rows(fg.truncate(frame([(-3, 4), (4, 5), (5, 4), (4, 4)]), 5)) == [(-3, 4), (4, 4)]


@pytest.mark.parametrize("pairs,bound,walks,count", WALKS)
def test_triangles(frame, pairs, bound, walks, count):
    edges = frame(pairs)
    if bound is not None:
        edges = fg.truncate(edges, bound)
    assert rows(fg.triangle_count(edges)) == [(walks, count)]
    assert fg.closed_walks(edges, "broadcast").count() == walks


@pytest.mark.parametrize("strategy", triangles.STRATEGIES)
def test_no_triangles(frame, strategy):
    assert rows(fg.triangle_count(frame([]), strategy)) == [(0, 0)]


@pytest.mark.parametrize("strategy", counts.STRATEGIES)
def test_follower_counts_depend_on_the_column(frame, strategy):
    edges = frame(HUNDREDS)
    assert rows(fg.follower_count(edges, strategy, modulus=100)) == [(100, 3), (300, 1), (400, 2)]
    assert rows(fg.follower_count(edges, strategy, "follower", 100)) == [
        (100, 1),
        (200, 1),
        (300, 2),
        (400, 1),
    ]


def test_row_forms_of_a_triangle(frame):
    cycle = frame([(1, 2), (2, 3), (3, 1)])
    assert rows(fg.triangle_triples(cycle)) == [(1, 2, 3), (2, 3, 1), (3, 1, 2)]
    assert rows(fg.triangle_edges(cycle)) == [
        ("1,2", "2,3", "3,1"),
        ("2,3", "3,1", "1,2"),
        ("3,1", "1,2", "2,3"),
    ]
    assert rows(fg.triangle_walks(cycle)) == [(1, "1,2,3,1"), (2, "2,3,1,2"), (3, "3,1,2,3")]


def test_edge_rows(frame):
    edges = frame([(1, 2), (1, 2), (3, 3)])
    assert rows(fg.reverse(edges)) == [(2, 1), (2, 1), (3, 3)]
    assert rows(fg.tag_endpoints(edges)) == [
        (1, "S", 1, 2),
        (1, "S", 1, 2),
        (2, "D", 1, 2),
        (2, "D", 1, 2),
        (3, "D", 3, 3),
        (3, "S", 3, 3),
    ]
    assert rows(fg.collapse(edges)) == [(1, 2, 2), (3, 3, 1)]
    assert rows(fg.degrees(edges)) == [(1, 0, 2), (2, 2, 0), (3, 1, 1)]


def test_empty_graph(frame):
    none = frame([])
    assert rows(fg.edge_count(none)) == [(0,)]
    assert rows(fg.two_path_total(none)) == [(0,)]
    for df in (fg.degrees(none), fg.two_paths(none), fg.in_adjacency(none), fg.triangle_edges(none)):
        assert df.count() == 0


def test_missing_ends_are_dropped(frame):
    edges = frame([(1, 2), (2, None), (None, 1), (2, 3), (3, 1)])
    assert rows(fg.triangle_count(edges)) == [(3, 1)]
    assert fg.two_paths(edges).count() == 3


def test_unknown_names_raise(frame):
    edges = frame(TINY)
    with pytest.raises(ValueError):
        fg.follower_count(edges, "guess")
    with pytest.raises(ValueError):
        fg.follower_count(edges, endpoint="src")
    with pytest.raises(ValueError):
        fg.triangle_count(edges, "guess")
