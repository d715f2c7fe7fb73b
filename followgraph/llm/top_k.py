"""Exact top-k search by inner product: one ball tree per shard, branch and bound."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from followgraph.llm.scratch import stored

SHARD_ROWS = 8192
QUERY_ROWS = 2048
LEAF_ROWS = 48
SCALE = 256
# Room for rounding in a bound that is computed in floating point.
SLACK = 1e-9
EXACT = 2.0**53
# A floor that every score reaches.
LEAST = -(2**63)

FOUND = "query_id bigint, vec_id bigint, score bigint"


class BallTree:
    """Vectors of whole numbers in nested balls.

    Every node has the centre and radius of its vectors; an inner product with
    q is at most q.centre + |q| * radius.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf_rows: int = LEAF_ROWS):
        self.ids, self.vectors = ids, vectors
        self.rows: list[np.ndarray | None] = []
        self.children: list[tuple[int, int] | None] = []
        centres, radii = [], []
        todo = [(np.arange(len(ids)), -1, 0)]
        while todo:
            rows, parent, side = todo.pop()
            here = vectors[rows]
            centre = here.mean(axis=0)
            away = np.sqrt(((here - centre) ** 2).sum(axis=1))
            node = len(centres)
            centres.append(centre)
            radii.append(away.max())
            if parent >= 0:
                left, right = self.children[parent]
                self.children[parent] = (node, right) if side == 0 else (left, node)
            if len(rows) <= leaf_rows or not radii[-1]:
                # Equal vectors stay together, in a leaf of any size.
                self.rows.append(rows)
                self.children.append(None)
                continue
            # Along the line between two far points, half of the rows to each side.
            one = here[away.argmax()]
            two = here[((here - one) ** 2).sum(axis=1).argmax()]
            order = np.argsort(here @ (two - one), kind="stable")
            half = len(rows) // 2
            self.rows.append(None)
            self.children.append((-1, -1))
            todo.append((rows[order[:half]], node, 0))
            todo.append((rows[order[half:]], node, 1))
        self.centres, self.radii = np.array(centres), np.array(radii)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Upper bound of every query (row) on every node (column)."""
        sizes = np.sqrt((queries**2).sum(axis=1))[:, None]
        reach = sizes * (np.sqrt((self.centres**2).sum(axis=1)) + self.radii)
        return queries @ self.centres.T + sizes * self.radii + SLACK * (1 + reach)

    def search(
        self, query: np.ndarray, own: int, bounds: np.ndarray, k: int, floor: float
    ) -> list[tuple[int, int]]:
        """The k best (score, vec_id) other than ``own`` that reach ``floor``; ties to smaller ids."""
        best: list[tuple[int, int]] = []  # (score, -vec_id), the worst first
        queue = [(-bounds[0], 0)]
        while queue:
            bound, node = heapq.heappop(queue)
            if -bound < floor:
                break
            if self.children[node] is not None:
                for child in self.children[node]:
                    if bounds[child] >= floor:
                        heapq.heappush(queue, (-min(-bound, bounds[child]), child))
                continue
            rows = self.rows[node]
            if abs(query).max(initial=0) * abs(self.vectors[rows]).max(initial=0) * len(query) < EXACT:
                scores = self.vectors[rows] @ query
            else:
                whole = [int(x) for x in query]
                scores = np.array([sum(int(a) * b for a, b in zip(v, whole)) for v in self.vectors[rows]], object)
            good = np.flatnonzero((scores >= floor) & (self.ids[rows] != own))
            if len(good) > k:
                good = good[np.lexsort((self.ids[rows][good], -scores[good]))[:k]]
            for i in good:
                item = (int(scores[i]), -int(self.ids[rows][i]))
                if len(best) < k:
                    heapq.heappush(best, item)
                elif item > best[0]:
                    heapq.heapreplace(best, item)
            if len(best) == k:
                floor = max(floor, best[0][0])
        return [(score, -i) for score, i in best]

    def reaching(self, queries: np.ndarray, floors: list[int], k: int) -> list[list[tuple[int, int]]]:
        """The k best (score, vec_id) that reach its floor, for every query; ties to smaller ids.

        A leaf is scored at once for all queries whose bound reaches their floor.
        """
        bounds, least = self.bounds(queries), np.array(floors, np.float64)
        found: list[list[tuple[int, int]]] = [[] for _ in floors]
        for node, rows in enumerate(self.rows):
            if rows is None:
                continue
            some = np.flatnonzero(bounds[:, node] >= least)
            if not len(some):
                continue
            scores = queries[some] @ self.vectors[rows].T
            names = self.ids[rows]
            for i in np.flatnonzero(scores.max(axis=1) >= least[some]).tolist():
                good = np.flatnonzero(scores[i] >= least[some[i]])
                if len(good) > k:
                    good = good[np.lexsort((names[good], -scores[i][good]))[:k]]
                found[some[i]] += [(int(scores[i, j]), int(names[j])) for j in good]
        return [sorted(f, key=lambda x: (-x[0], x[1]))[:k] for f in found]


def _matrix(column: pd.Series) -> np.ndarray:
    return np.floor(SCALE * np.stack([np.asarray(v, np.float64) for v in column]))


def _answers(shard: pd.DataFrame, asked: pd.DataFrame, k: int) -> pd.DataFrame:
    """Best rows of a shard for each asked row (vec_id, embedding, floor)."""
    out: list[tuple[int, int, int]] = []
    for dim, rows in shard.groupby(shard["embedding"].map(len)):
        some = asked[asked["embedding"].map(len) == dim]
        if len(some):
            tree = BallTree(rows["vec_id"].to_numpy(np.int64), _matrix(rows["embedding"]))
            queries = _matrix(some["embedding"])
            # Whole numbers: above 2^53 a rounded floor could pass over a score that reaches it.
            ids, floors = some["vec_id"].to_numpy(np.int64), some["floor"].to_numpy(np.int64).tolist()
            whole = abs(queries).max(initial=0) * abs(tree.vectors).max(initial=0) * dim < EXACT
            if whole and min(floors) > LEAST and not set(ids.tolist()) & set(tree.ids.tolist()):
                # With floors of another shard, all queries go through the leaves together.
                for i, best in zip(ids.tolist(), tree.reaching(queries, floors, k), strict=True):
                    out += [(i, vec, score) for score, vec in best]
                continue
            for i, bounds in enumerate(tree.bounds(queries)):
                found = tree.search(queries[i], int(ids[i]), bounds, k, floors[i])
                out += [(int(ids[i]), vec, score) for score, vec in found]
    return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")


def finite(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    whole = F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    )
    return vector.isNotNull() & whole


def top_k(
    vectors: DataFrame,
    asked: Column,
    k: int = 5,
    shard_rows: int = SHARD_ROWS,
    query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows for every row that ``asked`` selects.

    ``vectors`` has vec_id and embedding, whose components count as
    floor(256 * x). The score is the inner product; ties go to the smaller
    vec_id. All rows but those with the query's own vec_id are candidates.

    Rows are dealt to shards by id. Each query is first searched in its own
    shard; its k-th score there then bounds the search in all other shards,
    which get the queries in blocks. A group is one shard and one block, both
    of bounded size.

    A null vector, or one with a null or non-finite component, takes no part;
    nor does a row without vec_id. Vectors of different lengths have no score.
    Rows that agree in vec_id and embedding count once. Fewer than k
    candidates give fewer rows; no rows, or no queries, give none. Other
    columns are ignored. Scores must fit 64 bits.
    """
    rows = vectors.select(
        F.col("vec_id").cast("bigint").alias("vec_id"),
        F.col("embedding").cast("array<double>").alias("embedding"),
        F.coalesce(asked, F.lit(False)).alias("asked"),
    ).where(F.col("vec_id").isNotNull() & finite(F.col("embedding")))
    total, queries = rows.agg(F.count("*"), F.count_if("asked")).first()
    shards = max(1, -(-total // shard_rows))
    blocks = max(1, -(-queries // query_rows))
    # Long like the numbers that are generated below: keys of two types would not meet in one partition.
    shard_of = F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("bigint")
    dealt = rows.distinct().withColumn("shard", shard_of)

    def home(group: pd.DataFrame) -> pd.DataFrame:
        some = group[group["asked"]].assign(floor=LEAST)
        return _answers(group, some, k)

    near = stored(dealt.groupBy("shard").applyInPandas(home, FOUND))
    floors = near.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("floor"))
    wanted = (
        dealt.where("asked")
        .join(floors, F.col("vec_id") == F.col("query_id"), "left")
        .select(
            F.col("vec_id").alias("vec_id"),
            F.col("embedding").alias("embedding"),
            F.expr(f"coalesce(floor, {LEAST + 1}L - 1L)").alias("floor"),
            F.col("shard").alias("own"),
            F.pmod(F.xxhash64("vec_id", F.lit("block")), F.lit(blocks)).cast("bigint").alias("block"),
        )
        .withColumn("shard", F.expr(f"explode(sequence(0L, {shards - 1}L))"))
        .where("shard != own")
        .drop("own")
    )
    places = dealt.withColumn("block", F.expr(f"explode(sequence(0L, {blocks - 1}L))"))

    def away(shard: pd.DataFrame, some: pd.DataFrame) -> pd.DataFrame:
        if not len(shard) or not len(some):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        return _answers(shard, some, k)

    far = (
        places.groupBy("shard", "block")
        .cogroup(wanted.groupBy("shard", "block"))
        .applyInPandas(away, FOUND)
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = near.unionAll(far).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
