"""Whitening, k-d shards and the prefix trie against brute force."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from followgraph.llm import prefix_trie, sharding, whitening
from followgraph.llm.scratch import stored

VECTORS = "vec_id bigint, embedding array<float>, x bigint, n string"


def vectors(seed, n=120, d=24):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n, d)) * np.linspace(2, 0.2, d)
    rows = [(i, [float(np.float32(v)) for v in row], 7, "n") for i, row in enumerate(base)]
    rows += [(1000 + i, rows[3][1], None, None) for i in range(60)] + [rows[5]]
    odd = [None, [], [None] * d, [float("nan")] * d, [float("inf")] * d, [1e30] * d, [1.0] * (d - 1)]
    return rows + [(2000 + i, v, 1, "x") for i, v in enumerate(odd)] + [(None, rows[7][1], 1, "x")], d


def test_whitening_matches_direct_eigenvectors(spark):
    rows, d = vectors(1)
    got = whitening.whitened(spark.createDataFrame(rows, VECTORS).repartition(3)).collect()
    usable = [(i, v) for i, v, *_ in rows if v and len(v) == d and all(x is not None and abs(x) < 2**56 for x in v)]
    x = {i: (np.floor(64 * np.array(v, float)) + 1_000_000).astype(int) for i, v in usable}
    fit = np.array(sorted({tuple(v) for v in x.values()}))
    n, total = len(fit), fit.sum(axis=0)
    centred = (n * fit - total) / n
    values, directions = np.linalg.eigh(centred.T @ centred / n)
    values, directions = values[::-1][:16], directions[:, ::-1][:, :16]
    assert len(got) == 16 * len(usable) and {r.n for r in got} == {n}
    by = defaultdict(dict)
    for r in got:
        by[r.component].setdefault(r.vec_id, r)
        assert r.deviation == int(((n * x[r.vec_id] - total).astype(object) ** 2).sum())
        assert abs(r.explained - values[r.component - 1] / np.trace(centred.T @ centred / n)) < 1e-12
        assert r.identity_error < 1e-10
    for k in range(16):
        want = {i: (v - total / n) @ directions[:, k] / values[k] ** 0.5 for i, v in x.items()}
        sign = np.sign(sum(want[i] * by[k + 1][i].whitened for i in want))
        assert max(abs(want[i] - sign * by[k + 1][i].whitened) for i in want) < 1e-9


def test_whitening_of_nothing_and_of_flat_data(spark):
    schema = "vec_id bigint, embedding array<float>"
    for rows in ([], [(1, [1.0, 2.0])] * 3, [(1, []), (2, None)]):
        assert whitening.whitened(spark.createDataFrame(rows, schema)).collect() == []
    two = whitening.whitened(spark.createDataFrame([(1, [0.0, 1.0]), (2, [0.0, 3.0])], schema)).collect()
    assert sorted((r.vec_id, r.component, abs(round(r.whitened, 12)), round(r.explained, 12)) for r in two) == [(1, 1, 1.0, 1.0), (2, 1, 1.0, 1.0)]


def test_deviations_are_exact_for_wide_numbers():
    rng = random.Random(3)
    for top in (50, 1 << 30, 1 << 55):
        block = np.array([[rng.randrange(-top, top) for _ in range(5)] for _ in range(40)])
        sums = [int(sum(int(v) for v in c)) for c in block.T]
        want = [sum((40 * int(v) - s) ** 2 for v, s in zip(row, sums)) for row in block]
        assert whitening.Centre(40, sums).deviations(block) == want


@pytest.mark.parametrize("size,wanted,decay", [(300, 16, 3), (40, 16, 0), (5, 16, 1), (200, 4, 12)])
def test_jacobi_davidson(size, wanted, decay):
    rng = np.random.default_rng(size)
    turn, _ = np.linalg.qr(rng.standard_normal((size, size)))
    values = np.sort(rng.random(size))[::-1] ** decay
    matrix = (turn * values) @ turn.T
    got, vectors, residual = whitening.leading(lambda b: matrix @ b, size, wanted)
    assert np.allclose(got, values[:wanted], atol=1e-12) and residual < 1e-13
    assert np.allclose(vectors.T @ vectors, np.eye(min(size, wanted)), atol=1e-12)


DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint, shard string, _row int"


def documents(seed, n=400):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        text = "é" * rng.randrange(1, 40) if rng.random() < 0.6 else "same text"
        source = "hot" if rng.random() < 0.4 else f"s{rng.randrange(9)}"
        rows.append((i, text, rng.choice(["en", "de", None]), source, rng.choice([None, len(text)]), "x", 1))
    return rows + [(5, "copy", "en", "hot", 4, "x", 1)] * 80 + [(None, None, None, None, None, None, None), (7, "", "en", "a", 0, "x", 2), (8, "w" * 3000, "en", "a", 3000, "x", 2)]


def brute_tree(rows, first, shards, dims, out):
    """Shard per _row, by sorting every node whole."""
    if shards == 1 or not rows:
        out.update({r["_row"]: first for r in rows})
        return
    widest = max(dims, key=lambda d: max(r[f"_c_{d}"] for r in rows) - min(r[f"_c_{d}"] for r in rows))
    rows = sorted(rows, key=lambda r: (r[f"_k_{widest}"], r["_row"]))
    half, done = shards // 2, 0
    goal = sum(r["_size"] for r in rows) * half / shards
    for at, r in enumerate(rows):
        if done + r["_size"] >= goal:
            break
        done += r["_size"]
    at += goal - done >= done + rows[at]["_size"] - goal
    brute_tree(rows[:at], first, half, dims, out)
    brute_tree(rows[at:], first + half, shards - half, dims, out)


@pytest.mark.parametrize("shards", [1, 7, 40])
def test_shards_match_brute_force(spark, shards):
    frame = spark.createDataFrame(documents(shards), DOCUMENTS).repartition(3)
    meta = stored(sharding.metadata(frame))
    root = sharding.tree(meta, shards)
    got = {r["_row"]: r["s"] for r in meta.selectExpr("_row", f"{sharding._first_shard(root)} AS s").collect()}
    want = {}
    brute_tree([r.asDict() for r in meta.collect()], 0, shards, sharding.DIMENSIONS, want)
    assert got == want


def test_shards_are_even_whole_and_gapless(spark, tmp_path):
    rows = documents(9)
    frame = spark.createDataFrame(rows, DOCUMENTS).repartition(3)
    got = sharding.sharded(frame, 10).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted(((r[0], r[1]) for r in rows), key=str)
    by = defaultdict(list)
    for r in got:
        raw = (r.text or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 16, zlib.crc32(raw), "bytes", None)
        by[r.shard].append(r)
    assert sorted(by) == list(range(10))
    total = sum(r["size"] for r in got)
    for held in by.values():
        assert sorted(r.slot for r in held) == list(range(len(held)))
        assert abs(sum(r["size"] for r in held) - total / 10) <= 3016 + 16
    sharding.write_shards(frame, f"{tmp_path}/out", 4)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert back.count() == len(rows) and {r.shard for r in back.select("shard").distinct().collect()} == {0, 1, 2, 3}


def test_few_and_no_documents(spark):
    schema = DOCUMENTS
    assert sharding.sharded(spark.createDataFrame([], schema), 40).collect() == []
    one = sharding.sharded(spark.createDataFrame(documents(1)[:3], schema), 40).collect()
    assert len(one) == 3 and len({r.shard for r in one}) == 3 and {r.slot for r in one} == {0}
    with pytest.raises(ValueError):
        sharding.metadata(spark.createDataFrame([], schema), ("nothing",))


TURNS = "conv_id bigint, turn bigint, role string, text string, depth string, part int"


def turns(seed, n=260):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(0, 700), n) + [0, 100]:
        for t in range(rng.choice([1, 1, 2, 3, 6, 8, 30] if c % 7 else [2])):
            say = rng.choice(["a", "b", "\U0001f600", None]) if c % 7 else "same"
            rows.append((c, t if rng.random() < 0.95 else None, rng.choice(["user", None]) if c % 7 else "user", say, "x", 1))
    return rows + [(None, 1, "user", "lost", "x", 2), (-7, 1, "user", "x" * 5000, None, None), rows[0]]


def brute_trie(rows):
    own = defaultdict(list)
    for c, t, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            mark = hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()
            own[c].append(((t is not None, t), role, mark, text))
    own = {c: [(role, text) for _, role, _, text in sorted(v, key=lambda x: (x[0][0], x[0][1] or 0, *x[1:3]))] for c, v in own.items()}
    paths = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        head = c - int(np.fmod(c, 100))
        paths[c] = tuple(own.get(head, [])[:h] + own[c][h:])
    members = defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    children = defaultdict(int)
    for path in members:
        if path:
            children[path[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for path, held in members.items():
        for d in range(len(path) + 1):
            leaves[path[:d]] += not children[path]
            saved[path[:d]] += (len(held) - 1) * len(path[-1][1]) if path else 0
    out = []
    for path, held in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in held if paths[c] == path))
        parent = min(members[path[:-1]]) if path else None
        out.append((min(held), len(path), parent, len(held), children[path], leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("parts,pieces,trie_bytes", [("3", 50_000, 1 << 26), ("40", 2, 1 << 26), ("40", 3, 40)])
def test_trie_matches_brute_force(spark, monkeypatch, parts, pieces, trie_bytes):
    monkeypatch.setattr(prefix_trie, "IDS", pieces)
    monkeypatch.setattr(prefix_trie, "SKELETON_BYTES", trie_bytes)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", parts == "3")
        rows = turns(int(parts) + pieces)
        got = prefix_trie.prefix_trie(spark.createDataFrame(rows, TURNS).repartition(3))
        assert sorted((tuple(r) for r in got.select(prefix_trie.NODES).collect()), key=str) == brute_trie(rows)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_trie_of_nothing_and_of_turnless(spark):
    assert prefix_trie.prefix_trie(spark.createDataFrame([], TURNS)).collect() == []
    # A conversation whose only turns are replaced by those of a head that is not there.
    rows = [(c, 0, "user", "x", None, None) for c in (101, 102, 103, 104)]
    got = prefix_trie.prefix_trie(spark.createDataFrame(rows, TURNS)).select(prefix_trie.NODES).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_trie(rows)
