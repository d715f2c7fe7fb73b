"""Top-k search, benchmark passages and repeated passages against brute force."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from followgraph.llm import decontaminate, passages
from followgraph.llm.top_k import BallTree, top_k


def best(vectors, k):
    """Rows (query, rank, vec_id, score) by comparing all pairs."""
    whole = {
        i: [math.floor(256 * x) for x in v]
        for i, v in vectors
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    }
    out = []
    for q, a in whole.items():
        if q % 50 == 0:
            found = [
                (-sum(x * y for x, y in zip(a, b)), i) for i, b in whole.items() if i != q and len(a) == len(b)
            ]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out)


def test_top_k_matches_brute_force(spark):
    rng = random.Random(1)
    vectors = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(400)]
    vectors += [(i, vectors[3][1]) for i in range(400, 460)]  # ties
    vectors += [(500, None), (501, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (550, [math.nan] + [0.0] * 5), (502, [math.inf] * 6)]
    vectors += [(600, [1.0, 2.0]), (601, [3.0, 1.0]), (650, []), (None, [1.0] * 6), (700, [1.0]), (750, [0.0] * 6)]
    vectors += [vectors[0]]
    frame = spark.createDataFrame([(v, i, 1) for i, v in vectors], "embedding array<double>, vec_id bigint, rank int")
    for shard_rows, query_rows in ((10_000, 10_000), (60, 3)):
        got = top_k(frame, F.col("vec_id") % 50 == 0, 5, shard_rows, query_rows)
        assert sorted(map(tuple, got.collect())) == best(dict(vectors).items(), 5)
    assert top_k(frame.limit(0), F.col("vec_id") % 50 == 0).collect() == []


def test_queries_meet_all_shards_in_many_partitions(spark):
    """Without merged partitions, a shard and its queries must be dealt to the same one."""
    rng = random.Random(5)
    vectors = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(400)]
    frame = spark.createDataFrame(vectors, "vec_id bigint, embedding array<double>")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for shard_rows, query_rows in ((60, 1000), (60, 3)):
            got = top_k(frame, F.col("vec_id") % 50 == 0, 5, shard_rows, query_rows)
            assert sorted(map(tuple, got.collect())) == best(vectors, 5)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_scores_above_2_53_across_shards(spark):
    """The floor of other shards is exact: scores that differ by one near 2^60 are told apart."""
    vectors = [(0, [2.0**22, 1 / 256])] + [(i, [2.0**22, i / 256]) for i in range(1, 250)]
    frame = spark.createDataFrame(vectors, "vec_id bigint, embedding array<double>")
    got = top_k(frame, F.col("vec_id") == 0, 5, 30, 10)
    assert [(r.vec_id, r.score) for r in got.orderBy("rank").collect()] == [(i, 2**60 + i) for i in range(249, 244, -1)]


def test_ball_tree_bounds_hold():
    rng = np.random.default_rng(2)
    vectors = np.floor(rng.normal(0, 100, (500, 8)))
    tree = BallTree(np.arange(500), vectors, leaf_rows=20)
    queries = vectors[:7]
    bounds = tree.bounds(queries)
    for node, rows in enumerate(tree.rows):
        if rows is not None:
            assert (vectors[rows] @ queries.T <= bounds[:, node]).all()
    assert sorted(np.concatenate([r for r in tree.rows if r is not None])) == list(range(500))


def test_large_components_are_scored_exactly():
    vectors = np.array([[2.0**40, 1.0], [2.0**40, 2.0], [1.0, 1.0]])
    tree = BallTree(np.arange(3), vectors)
    query = np.array([2.0**20 + 1, 1.0])
    found = tree.search(query, -1, tree.bounds(query[None, :])[0], 2, -math.inf)
    assert sorted(found, reverse=True) == [(2**40 * (2**20 + 1) + 2, 1), (2**40 * (2**20 + 1) + 1, 0)]


def bag(found):
    out = Counter()
    for i in range(len(found) - 4):
        out[tuple(found[i : i + 5])] += sum(min(len(w), decontaminate.MOST_WEIGHT) for w in found[i : i + 5])
    return out


def alike(one, two):
    both = sum((one & two).values())
    return both / max(1, sum(one.values()) + sum(two.values()) - both)


def lines(rng, vocabulary, n):
    return rng.choices(vocabulary, k=n)


def test_contamination_matches_brute_force(spark):
    rng = random.Random(3)
    vocabulary = ["".join(rng.choices("abcdefgh", k=rng.randint(1, 9))) for _ in range(400)]
    items = [(i, lines(rng, vocabulary, rng.randint(12, 70))) for i in range(25)]
    docs = []
    for i in range(60):
        text = lines(rng, vocabulary, rng.randint(0, 200))
        for _ in range(rng.choice([0, 1, 2])):
            found = list(rng.choice(items)[1])
            for _ in range(rng.choice([0, 0, 1])):
                found[rng.randrange(len(found))] = "edited"
            at = rng.randint(0, len(text))
            text[at:at] = found
        docs.append((i, text))
    docs += [(100, items[0][1]), (101, items[1][1][:-1]), (102, ["x"]), (103, [])]
    items += [(90, items[0][1]), (91, ["too", "short"]), (92, [])]
    want = set()
    for d, text in docs:
        for i, item in items:
            n = len(item)
            if n < 5:
                continue
            whole = bag(item)
            best = max(
                (alike(bag(text[s : s + n]), whole) for s in range(max(1, len(text) - n + 1))), default=0
            )
            if 100 * best >= 75:
                want.add((d, i))
    documents = spark.createDataFrame(
        [(" ".join(t).upper(), d, 0) for d, t in docs] + [(None, 104, 0)], "text string, doc_id bigint, item_id int"
    )
    benchmark = spark.createDataFrame(
        [("  ".join(t), i, 0) for i, t in items] + [(None, 93, 0), ("a b c d e f", None, 0)],
        "text string, item_id bigint, doc_id int",
    )
    for block in (5000, 7):
        got = decontaminate.contamination(documents, benchmark, block).collect()
        assert {(r.doc_id, r.item_id) for r in got} == want
    texts = dict(docs)
    for r in got:
        assert alike(bag(texts[r.doc_id][r.start_word : r.end_word]), bag(dict(items)[r.item_id])) >= 0.75
        assert r.distance <= decontaminate.RADIUS
    clean = decontaminate.drop_contaminated(documents, benchmark)
    assert clean.columns == documents.columns
    bad = {d for d, _ in want}
    assert sorted(r.doc_id for r in clean.collect()) == sorted({d for d, _ in docs} - bad | {104})
    assert decontaminate.contamination(documents, benchmark.limit(0)).collect() == []
    assert decontaminate.contamination(documents.limit(0), benchmark).collect() == []


def test_windows_lie_on_a_grid_over_each_text():
    rng = random.Random(10)
    items = [[f"w{rng.randrange(9999)}" for _ in range(97)] for _ in range(40)]
    index = decontaminate.build([(i, " ".join(x)) for i, x in enumerate(items)])
    texts = []
    for item in items:
        at = rng.randint(0, 90)
        item = item[:at] + [f"e{i}" for i in range(4)] + item[at + 4 :]
        texts.append(" ".join(item + [f"w{rng.randrange(9999)}" for _ in range(rng.randint(0, 60))]))

    def found(some):
        data, offsets = decontaminate.text_buffer(pa.array(some))
        held = decontaminate.words(data, offsets)
        return {(some[t], i, at - int(held.first[t]), n, d) for t, i, at, n, d in decontaminate.candidates(held, index)}

    alone = set().union(*(found([t]) for t in texts))
    assert found(texts) == found(texts[::-1]) == alone
    assert {(t, i) for t, i, at, _, _ in alone if at == 0} == {(t, i) for i, t in enumerate(texts)}


def test_windows_are_the_same_in_chunks_of_any_size(monkeypatch):
    """Windows that cross chunks, of every place and of a grid, and texts shorter than a window."""
    rng = random.Random(12)
    some = [" ".join(lines(rng, [f"v{i}" for i in range(12)], k)) for k in (4, 9, 14, 16, 40, 60, 90, 0, 33)]
    index = decontaminate.build([(i, t) for i, t in enumerate(some) if len(t) > 30])
    assert {s.stride for s in index.sizes} >= {1, 2}
    held = decontaminate.words(*decontaminate.text_buffer(pa.array(some * 3, pa.large_string())))
    found = []
    for size in (decontaminate.CHUNK_WORDS, 1, 100):
        monkeypatch.setattr(decontaminate, "CHUNK_WORDS", size)
        found.append(sorted(decontaminate.candidates(held, index)))
    assert len(found[0]) >= 9 and found[0] == found[1] == found[2]


def test_edits_far_from_the_fingerprint():
    """Blocks replaced, ends cut off and words put in, down to the least similarity."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=rng.randint(1, 9)))
    items = [[word() for _ in range(rng.choice([33, 60, 97, 120]))] for _ in range(300)]
    index = decontaminate.build([(i, " ".join(x)) for i, x in enumerate(items)])
    texts = []
    for item in items:
        n, k = len(item), rng.randint(0, len(item) // 10)
        at = rng.choice([0, n // 2, n - k])
        passage = item[:at] + [word() for _ in range(rng.choice([0, k]))] + item[at + k :]
        texts.append([word() for _ in range(rng.choice([0, 7, 40]))] + passage + [word() for _ in range(40)])
    want = set()
    for i, text in enumerate(texts):
        n, whole = len(items[i]), bag(items[i])
        best = max(alike(bag(text[s : s + n]), whole) for s in range(len(text) - n + 1))
        if 100 * best >= 75:
            want.add((i, i, round(best, 9)))
    found = decontaminate.search(pa.array([" ".join(t) for t in texts]), index)
    assert len(want) > 200 and {(*k, round(v[0], 9)) for k, v in found.items()} == want


def test_blocks_show_every_print_within_the_radius():
    rng = np.random.default_rng(4)
    index = decontaminate.build([(i, " ".join(f"w{rng.integers(999)}" for _ in range(20))) for i in range(30)])
    size = index.sizes[-1]
    prints = np.repeat(size.prints, 20)
    for k in range(len(prints)):
        for bit in rng.choice(64, rng.integers(0, 16), replace=False):
            prints[k] ^= np.uint64(1) << np.uint64(bit)
    w, e, far = decontaminate._near(prints, size)
    want = {
        (i, j) for i, p in enumerate(prints) for j, q in enumerate(size.prints)
        if int(p ^ q).bit_count() <= decontaminate.RADIUS
    }
    assert set(zip(w.tolist(), e.tolist())) == want


def test_compact_windows_are_the_wide_nodes():
    rng = np.random.default_rng(0)
    for _ in range(200):
        n, least = int(rng.integers(0, 80)), int(rng.integers(1, 12))
        v = np.concatenate([[0], rng.integers(1, 30, n), [0]]).astype(np.uint32)
        if n > 10:
            v[n // 2] = 0
        want = set()
        for c in np.flatnonzero(v):
            left, right = c, c
            while v[left - 1] > v[c]:
                left -= 1
            while v[right + 1] >= v[c]:
                right += 1
            if right - left + 1 >= least:
                want.add((left, c, right))
        assert set(zip(*(x.tolist() for x in passages.compact_windows(v, least)))) == want


def test_repeated_passages(spark):
    rng = random.Random(5)
    vocabulary = [f"v{i}" for i in range(5000)]
    shared = [lines(rng, vocabulary, k) for k in (51, 60, 120, 300)]
    short = lines(rng, vocabulary, 40)
    docs = []
    for i in range(40):
        text = lines(rng, vocabulary, rng.randint(60, 200))
        if i < 24:
            found = list(shared[i % 4])
            if i >= 12 and i % 4 == 3:
                found[rng.randrange(20, len(found) - 20)] = "edited"
            at = rng.randint(0, len(text))
            text[at:at] = found
        elif i < 32:
            text[10:10] = short
        docs.append((i, text))
    docs += [(50, docs[0][1]), (51, []), (52, ["word"] * 200)]
    frame = spark.createDataFrame(
        [(" ".join(t), i, 0) for i, t in docs] + [(None, 60, 0), (" ".join(shared[2]), None, 0)],
        "text string, doc_id bigint, key int",
    )
    got = passages.repeated_passages(frame).collect()
    assert {x for r in got for x in (r.doc_id, r.other_id)} == set(range(24)) | {50}
    texts = dict(docs)
    for r in got:
        one = texts[r.doc_id][r.start_word : r.end_word]
        two = texts[r.other_id][r.other_start : r.other_end]
        a, b = ({tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in (one, two))
        assert min(len(one), len(two)) >= 51 and len(a & b) / len(a | b) >= 0.75
        assert abs(len(a & b) / len(a | b) - r.similarity) < 1e-9
    assert passages.repeated_passages(frame.limit(0)).collect() == []


def test_passage_of_shingles_that_occur_elsewhere(spark):
    """Documents that hold all its shingles in pieces stand first, and just before the second holder."""
    rng = random.Random(6)
    passage = [f"p{i}" for i in range(51)]

    def around(pieces):
        text = [f"x{rng.random()}" for _ in range(30)]
        for piece in pieces:
            text += piece + [f"x{rng.random()}" for _ in range(30)]
        return " ".join(text)

    pieces = [passage[:20], passage[16:36], passage[32:]]
    docs = [(i, around(rng.sample(pieces, 3))) for i in [*range(300), *range(400, 700)]]
    docs += [(350, around([passage])), (800, around([passage]))]
    got = passages.repeated_passages(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()
    assert {(r.doc_id, r.other_id) for r in got} == {(800, 350)}
    assert got[0].end_word - got[0].start_word == 51 and got[0].similarity == 1


def test_exact_repeats_match_brute_force(spark):
    rng = random.Random(7)
    parts = [lines(rng, [f"v{i}" for i in range(300)], 10) for _ in range(3)]
    docs = [(i, sum(rng.choices(parts, k=rng.randint(0, 12)), [])) for i in range(60)]
    held = {}
    for i, text in docs:
        for at in range(len(text) - 50):
            held.setdefault(tuple(text[at : at + 51]), []).append((i, at))
    want = {(x, s, min(held[k])) for k in held for x, s in held[k] if x != min(held[k])[0]}
    frame = spark.createDataFrame([(i, " ".join(t)) for i, t in docs], "doc_id bigint, text string")
    got = passages.exact_repeats(frame, 47).collect()
    assert want and {(r.x, r.s, (r.y, r.s - r["shift"])) for r in got} == want


def test_passages_with_a_word_put_in(spark):
    """Pairs of passages with a word in the middle of one, of similarity 0.83."""
    rng = random.Random(8)
    docs = []
    for i in range(400):
        passage = [f"p{i}.{j}" for j in range(51)]
        longer = passage[:25] + ["more"] + passage[25:]
        for name, found in ((2 * i, passage), (2 * i + 1, longer)):
            before, after = ([f"x{rng.random()}" for _ in range(30)] for _ in range(2))
            docs.append((name, " ".join(before + found + after)))
    got = passages.repeated_passages(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()
    assert {(r.other_id, r.doc_id) for r in got} == {(2 * i, 2 * i + 1) for i in range(400)}


@pytest.mark.parametrize("put_in", [True, False])
def test_near_repeats_among_documents_that_hold_most_of_them(spark, put_in):
    """24 other documents hold 38 of the 51 words of each passage, half of them before its first holder."""
    rng = random.Random(9)

    def around(found):
        before, after = ([f"x{rng.random()}" for _ in range(30)] for _ in range(2))
        return " ".join(before + found + after)

    docs, want = [], set()
    for i in range(40):
        one = [f"p{i}.{j}" for j in range(51)]
        two = one[:25] + ["more"] + one[25:] if put_in else one[:24] + ["this", "that"] + one[26:]
        for full in (one, two):
            for at in rng.choices([0, 13], k=12):
                docs.append((len(docs), around(one[at : at + 38])))
            docs.append((len(docs), around(full)))
        want.add((docs[-1][0], docs[-14][0]))
    got = passages.repeated_passages(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()
    assert {(r.doc_id, r.other_id) for r in got} == want


def test_near_repeats_whose_every_run_is_frequent(spark):
    """200 other documents hold parts of each passage, so that all its runs are in more than 16 documents."""
    rng = random.Random(10)

    def around(found):
        before, after = ([f"x{rng.random()}" for _ in range(30)] for _ in range(2))
        return " ".join(before + found + after)

    docs, want = [], set()
    for i in range(20):
        one = [f"p{i}.{j}" for j in range(51)]
        two = one[:25] + ["more"] + one[25:]
        for full in (one, two):
            docs += [(len(docs) + k, around(one[at : at + 38])) for k, at in enumerate(rng.choices([0, 13], k=100))]
            docs.append((len(docs), around(full)))
        want.add((docs[-1][0], docs[-102][0]))
    got = passages.repeated_passages(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()
    assert {(r.doc_id, r.other_id) for r in got} == want


def test_passages_wider_than_what_a_third_document_holds(spark):
    """Two documents share 140 words, of which an earlier one holds the 60 in the middle."""
    rng = random.Random(11)
    docs, want = [], {}
    for i in range(20):
        passage = [f"p{i}.{j}" for j in range(140)]
        for found in (passage[40:100], passage, passage):
            before, after = ([f"x{rng.random()}" for _ in range(3)] for _ in range(2))
            docs.append((len(docs), " ".join(before + found + after)))
        want[3 * i + 2, 3 * i + 1] = (3, 143, 3, 143)
    got = passages.repeated_passages(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()
    found = {(r.doc_id, r.other_id): (r.start_word, r.end_word, r.other_start, r.other_end) for r in got}
    assert {k: found.get(k) for k in want} == want


def test_rounds_find_what_one_finds(spark):
    shared = [f"p{j}" for j in range(60)]
    docs = [(i, " ".join([f"x{i}"] + shared + [f"y{i}"])) for i in range(12)]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    pairs = [(x, y, 0, 57, 0, 57) for x in range(12) for y in range(x)]
    regions = spark.createDataFrame(pairs, "x bigint, y bigint, s bigint, e bigint, lo bigint, hi bigint")
    one, many = (passages.compared_in_rounds(frame, regions, 47, 75, n) for n in (1 << 30, 8 * 58 * 10))
    assert len(one.inputFiles()) and one.count() == 66
    assert sorted(map(tuple, many.collect())) == sorted(map(tuple, one.collect()))
    assert len({f.rsplit("/", 2)[1] for f in many.inputFiles()}) == 7


def test_leaders_of_a_run_all_meet(spark, monkeypatch):
    rows = [(key, key * n, d, 5, 0, 60, False) for key, n in ((1, 40), (2, 1)) for d in range(n)]
    windows = spark.createDataFrame([(k, d, p, s, e, d, few) for k, _, d, p, s, e, few in rows], passages.WINDOWS)
    for side in (3, 256):
        monkeypatch.setattr(passages, "CELL_LEADERS", side)
        got = [(r.x, r.y) for r in passages.leader_meetings(windows, passages.leaders(windows)).collect()]
        assert sorted(got) == [(x, y) for x in range(40) for y in range(x)]


def test_large_group_of_copies_gives_few_rows(spark):
    text = " ".join(f"c{i}" for i in range(120))
    frame = spark.createDataFrame([(i, text) for i in range(300)], "doc_id bigint, text string")
    got = passages.repeated_passages(frame).collect()
    assert len(got) <= 600 and {r.doc_id for r in got} | {r.other_id for r in got} == set(range(300))


def test_alike_finds_neighbours_that_are_apart_in_the_other():
    one = np.arange(200)
    two = np.concatenate([one[:100], -np.arange(1, 260), one[100:]])
    assert {x[:4] for x in passages._alike(one, two, 47, 75)} == {(0, 100, 0, 100), (100, 200, 359, 459)}


def test_alike_splits_down_to_exact_repeats():
    one = np.arange(400)
    two = one.copy()
    two[100:400] = np.where(np.arange(300) % 3 == 0, -two[100:400], two[100:400])
    found = list(passages._alike(one, two, 47, 75))
    assert found and found[0][:4] == (0, 100, 0, 100)
    assert list(passages._alike(one, -one - 1, 47, 75)) == []
    assert pa.types.is_int64(passages.KINDS[0])
