"""Shingles, circulant MinHash, components and near duplicates against brute force."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from followgraph.llm import near_dedup
from followgraph.llm.components import components
from followgraph.llm.shingles import shingles, words
from followgraph.llm.worker import slices, text_buffer


def grams(text):
    found = (text or "").encode().lower().split()
    if len(found) < 5:
        return {tuple(found)} if found else set()
    return {tuple(found[i : i + 5]) for i in range(len(found) - 4)}


def brute(rows):
    """component per doc_id, by comparing all pairs."""
    sets = [(i, grams(t)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            both = len(a & b)
            if a and b and 100 * both >= 75 * (len(a) + len(b) - both):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return {i: root(i) for i in parent}


def texts_of(rng, n=60):
    vocabulary = [f"w{i}" for i in range(300)]
    base = [" ".join(rng.choices(vocabulary, k=rng.randint(30, 120))) for _ in range(6)]
    out = []
    for _ in range(n):
        found = rng.choice(base).split(" ")
        for _ in range(rng.choice([0, 0, 1, 2, 3, 6, 12])):
            found[rng.randrange(len(found))] = rng.choice(vocabulary)
        if rng.random() < 0.3:
            found = found[: rng.randint(1, len(found))]
        out.append(rng.choice([" ", "\n", "\t "]).join(found))
    return out


def test_words_and_shingles():
    texts = ["A b\tc\x0bd  e f", "", "   ", "one", "é É x", "a b c d", "a b c d e", "x" * 600_000 + " y"]
    data, offsets = text_buffer(pa.array([*texts, None]))
    found = words(data, offsets)
    assert found.counts().tolist() == [6, 0, 0, 1, 3, 4, 5, 2, 0]
    hashes, bounds = shingles(found)
    assert np.diff(bounds).tolist() == [2, 0, 0, 1, 1, 1, 1, 1, 0]
    again, own = shingles(words(*text_buffer(pa.array(["a B c D e"]))))
    assert again[0] == hashes[bounds[6]] and hashes[bounds[0]] == again[0]


def test_shingle_sets_match_python():
    rng = random.Random(5)
    texts = texts_of(rng)
    hashes, bounds = shingles(words(*text_buffer(pa.array(texts))))
    for i, text in enumerate(texts):
        assert len(np.unique(hashes[bounds[i] : bounds[i + 1]])) == len(grams(text))


def test_slices_keep_all_rows():
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * k for k in (5, 0, 9, 100, 1)] + [None])], ["text"])
    parts = list(slices(iter([batch]), size=10))
    assert sum(p.num_rows for p in parts) == 6 and len(parts) > 2


def test_circulant_signature_estimates_similarity():
    rng = np.random.default_rng(1)
    whole = rng.integers(0, 2**63, 3000).astype(np.uint64)
    one, two = near_dedup.signature(whole[:2400]), near_dedup.signature(whole[600:])
    assert abs((one == two).mean() - 0.6) < 0.15
    first, shifted = near_dedup._permutations()
    assert len(np.unique(first[:5000])) == 5000
    assert (shifted[7][:-1] == shifted[6][1:]).all()


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rng = random.Random(seed)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(i, i + 1) for i in range(100, 140)]
    got = components(spark.createDataFrame(links, "a bigint, b bigint")).collect()
    nodes = {x for a, b in links if a != b for x in (a, b)}
    least = {x: x for x in nodes}
    for _ in nodes:
        for a, b in links:
            if a != b:
                least[a] = least[b] = min(least[a], least[b])
    assert sorted((r.node, r.component) for r in got) == sorted(least.items())


def test_near_duplicates_match_brute_force(spark):
    rows = list(enumerate(texts_of(random.Random(7), 90)))
    rows += [(200, None), (201, ""), (202, "  "), (203, "two words"), (204, "TWO words"), (205, "x " * 5000)]
    rows += [rows[0], (None, rows[0][1]), (None, None)]
    frame = spark.createDataFrame([(t, i, "k", 1) for i, t in rows], "text string, doc_id bigint, node string, a int")
    got = near_dedup.near_duplicates(frame).collect()
    want = brute(rows)
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.component_id, r.kept) == (want[r.doc_id], want[r.doc_id] == r.doc_id)
            assert r.n_shingles == len(grams(dict(rows)[r.doc_id]))
    kept = near_dedup.drop_near_duplicates(frame)
    assert kept.columns == frame.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted({want[i] for i in want})
    assert ids.count(None) == 2


def test_open_buckets_are_settled(spark):
    """Heavily edited copies: some linked through others only, some not at all."""
    rng = random.Random(3)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(70):
        found = list(base)
        for k in range(rng.choice([1, 2, 3, 4, 5, 6, 7])):
            found[rng.randrange(120)] = f"e{i}_{k}"
        rows.append((i, " ".join(found)))
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), salt_rows=8)
    assert {r.doc_id: r.component_id for r in got.collect()} == brute(rows)


def test_empty_table(spark):
    assert near_dedup.near_duplicates(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []
