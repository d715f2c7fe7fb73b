"""Directed triangles a -> b -> c -> a, counted and as rows.

What is counted are closed walks of three steps over a multigraph: copies of
edges multiply and self-loops take part. Every walk is seen from three start
nodes, except a walk around one self-loop; triangles = closed walks div 3.

Each strategy finds one rotation of every walk, the one whose first node ``a``
ranks lowest (rank(a) < rank(b) and rank(a) <= rank(c), or a = b = c), and
derives the rest. Nodes are ranked by degree, then id, so that a hub is never
the middle of the join: its edges are looked up from their other ends.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from followgraph.functions.columns import (
    each,
    repeat_rows,
    slice_of,
    third,
    wide_product,
    wide_sum,
)
from followgraph.operators.edges import collapse
from followgraph.plans.sizing import BROADCAST_BYTES, deal_out, estimated_bytes, shuffle_partitions
from followgraph.plans.skew import slices_for

STRATEGIES = ("shuffle", "broadcast", "adjacency")

# Walks of two steps that one cell of a node's grid may make unnoticed.
LEAST_CELL = 2_500

# Cells that all such walks would fill, for each shuffle partition.
CELLS_PER_PARTITION = 8

# Nodes ranked by their exact degree when the graph is larger than this.
RANKED_NODES = 1_000_000

# Walks that may meet at one closing edge before it is replicated to slices.
CLOSING_ROWS = 100_000

# Entries of one page of a neighbour list.
PAGE_ENTRIES = 4_096

# The source of an edge, which is no self-loop, ranks below its target.
UPWARD = """(follower_rank < followee_rank
    OR (follower_rank = followee_rank AND follower < followee))"""

# A self-loop a -> b starts the walk around itself only.
ONE_ROTATION = "a != b OR a = c"


def _ranks(pairs: DataFrame, ranked_nodes: int) -> DataFrame:
    """Degrees of the high-degree nodes, and whether a cycle can visit them.

    With d = sum of degrees (twice the distinct edges), keeps nodes of degree
    >= min(sqrt(d), d / ranked_nodes). At most max(sqrt(d), ranked_nodes)
    nodes reach that, so the frame may be broadcast: at 5 * 10^12 edges it
    holds 3.2 million rows of three small columns.
    """
    # Reading n, which is always positive, lets this pass and the joins share the
    # shuffle of collapse. Reading both columns in the total does the same for
    # the shuffle of nodes.
    ends = "array(struct(follower AS _node, true AS _out), struct(followee AS _node, false AS _out))"
    nodes = (
        pairs.where("n > 0")
        .selectExpr(f"inline({ends})")
        .where("_node IS NOT NULL")
        .groupBy("_node")
        .agg(
            F.expr("count(1) AS _degree"),
            F.expr("bool_or(_out) AND bool_or(NOT _out) AS _through"),
        )
    )
    total = "sum(cast(if(_through IS NOT NULL, _degree, NULL) as double))"
    bar = nodes.selectExpr(f"least(sqrt({total}), {total} / {float(ranked_nodes)}D) AS bar")
    return nodes.where(F.col("_degree") >= bar.scalar())


def _ranked(pairs: DataFrame, ranked_nodes: int) -> DataFrame:
    """Distinct edges with the rank degree of both ends (0 if not a hub).

    Edges at a hub that has no in-edges, or no out-edges, are dropped here,
    before any of them is shuffled.
    """
    ranks = _ranks(pairs, ranked_nodes)

    def end(name: str) -> DataFrame:
        return F.broadcast(
            ranks.selectExpr(
                f"_node AS _{name}", f"_degree AS {name}_rank", f"_through AS {name}_through"
            )
        )

    return (
        pairs.join(end("follower"), F.expr("follower = _follower"), "left")
        .join(end("followee"), F.expr("followee = _followee"), "left")
        .where("coalesce(follower_through, true) AND coalesce(followee_through, true)")
        .selectExpr(
            "follower",
            "followee",
            "n",
            "coalesce(follower_rank, 0L) AS follower_rank",
            "coalesce(followee_rank, 0L) AS followee_rank",
        )
    )


def _legs(ranked: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The roles of an edge in a walk: a -> b (up), c -> a (down), b -> c (any).

    A self-loop can take every role.
    """
    first = ranked.where(f"{UPWARD} OR follower = followee").selectExpr(
        "follower AS a", "followee AS b", "n AS n_ab", "followee_rank AS b_rank"
    )
    last = ranked.where(f"NOT {UPWARD}").selectExpr(
        "followee AS a", "follower AS c", "n AS n_ca", "follower_rank AS c_rank"
    )
    middle = ranked.selectExpr(
        "follower AS b",
        "followee AS c",
        "n AS n_bc",
        "follower_rank AS b_rank",
        "followee_rank AS c_rank",
    )
    return first, last, middle


def _fan(most: int) -> str:
    """Slices of a closing edge b -> c.

    The walks it closes start at common neighbours, so they are no more than
    the smaller degree of its ends: only an edge between two hubs is sliced.
    """
    return slices_for("least(b_rank, c_rank)", CLOSING_ROWS, most)


def _grids(ranked: DataFrame) -> DataFrame:
    """Nodes whose walks c -> a -> b would weigh on a single task, with their grid.

    Ranking bounds up(a) and down(a), the edges on either side, but not their
    product. A node is cut if that is more than an eighth of a partition's
    share of all products; fewer than eight nodes for each partition can be.
    Every edge counts once, at its lower end; a self-loop is on both sides.
    """
    sides = ranked.selectExpr(
        f"IF({UPWARD}, follower, followee) AS a",
        f"{UPWARD} OR follower = followee AS _ups",
        f"NOT {UPWARD} AS _downs",
    )
    nodes = sides.groupBy("a").agg(F.count_if("_ups").alias("_up"), F.count_if("_downs").alias("_down"))
    product = "cast(_up AS double) * cast(_down AS double)"
    share = f"coalesce(sum({product}), 0D) / {float(CELLS_PER_PARTITION * shuffle_partitions(ranked))}D"
    side = nodes.selectExpr(f"sqrt(greatest({float(LEAST_CELL)}D, {share})) AS side").scalar()
    return nodes.where(F.expr(product) > side * side).select(
        F.col("a").alias("_hot"),
        F.ceil(F.col("_up") / side).alias("_rows"),
        F.ceil(F.col("_down") / side).alias("_columns"),
    )


def _on_grid(leg: DataFrame, grids: DataFrame, end: str, own: str, facing: str) -> DataFrame:
    """One side of the first join: its own place on the grid, replicated along the other axis."""
    placed = leg.join(F.broadcast(grids), F.expr("a = _hot"), "left")
    spread = placed.selectExpr(
        *leg.columns,
        f"IF(_hot IS NULL, 0L, {slice_of(own, end)}) AS _own",
        f"{each(f'coalesce({facing}, 1L)')} AS _facing",
    )
    return spread.withColumnsRenamed({"_own": own, "_facing": facing})


CELL = ("a", "_rows", "_columns")


def _sides(pairs: DataFrame, ranked_nodes: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Edges a -> b and c -> a on the grids of their nodes, and closing edges b -> c in slices."""
    ranked = _ranked(pairs, ranked_nodes)
    first, last, middle = _legs(ranked)
    grids = _grids(ranked)
    ups = _on_grid(first, grids, "b", "_rows", "_columns")
    downs = _on_grid(last, grids, "c", "_columns", "_rows")
    closing = middle.selectExpr("b", "c", "n_bc", f"{each(_fan(shuffle_partitions(pairs)))} AS _slice")
    return ups, downs, closing


def _wedges(met: DataFrame) -> DataFrame:
    """Walks c -> a -> b of one rotation, each with the slice of its closing edge."""
    fan = _fan(shuffle_partitions(met))
    return met.where(ONE_ROTATION).selectExpr("a", "b", "c", "n_ab", "n_ca", f"{slice_of(fan, 'a')} AS _slice")


def _by_shuffle(pairs: DataFrame, ranked_nodes: int) -> DataFrame:
    """Two sort-merge joins, on a and then on (b, c).

    After ranking, no node keeps more than sqrt(2 E) edges on either side of
    the first join, and a node whose two sides make very many walks is laid
    out on a grid: edges a -> b over its rows, edges c -> a over its columns.
    In the second join, the closing edge between two hubs is replicated to a
    few slices and the walks of the pair are dealt out to them.
    """
    ups, downs, closing = _sides(pairs, ranked_nodes)
    met = deal_out(ups, *CELL).join(deal_out(downs, *CELL).hint("merge"), [*CELL])
    return _wedges(met).join(closing.hint("merge"), ["b", "c", "_slice"])


def _by_broadcast(pairs: DataFrame, ranked_nodes: int) -> DataFrame:
    """The same two joins, whose right sides are replicated where they turn out to be small.

    The joins carry no hint. Adaptive execution knows the size of a side once
    it has been made, and replicates one below the session's threshold
    (spark.sql.adaptive.autoBroadcastJoinThreshold, else
    spark.sql.autoBroadcastJoinThreshold) to every task, without moving the
    other side; a larger one is shuffled and merged. One plan serves any size.
    """
    ups, downs, closing = _sides(pairs, ranked_nodes)
    return _wedges(ups.join(downs, [*CELL])).join(closing, ["b", "c", "_slice"])


def _by_adjacency(pairs: DataFrame, ranked_nodes: int) -> DataFrame:
    """Lists of the edges into a, in pages; each page is looked up from the edges a -> b.

    A page holds about PAGE_ENTRIES entries at most: a cell of a node's grid
    is dealt out to as many as that takes. The table of pages is replicated
    or shuffled by its size, page by page, as in ``_by_broadcast``; the edge
    b -> c is found by its key, so no list of a hub is walked again for each
    of the hub's edges.
    """
    ups, downs, closing = _sides(pairs, ranked_nodes)
    entries = F.count(F.lit(1)).over(Window.partitionBy(*CELL))
    page = f"pmod(xxhash64(c), _entries div {PAGE_ENTRIES}L + 1L) AS _page"
    pages = (
        downs.withColumn("_entries", entries)
        .selectExpr(*CELL, "c", "n_ca", "c_rank", page)
        .groupBy(*CELL, "_page")
        .agg(F.expr("collect_list(struct(c, n_ca, c_rank)) AS into_a"))
        .drop("_page")
    )
    looked_up = ups.join(pages, [*CELL]).selectExpr("a", "b", "n_ab", "b_rank", "inline(into_a)")
    return _wedges(looked_up).join(closing, ["b", "c", "_slice"])


def strategy_for(edges: DataFrame, wanted: str = "auto", max_bytes: int = BROADCAST_BYTES) -> str:
    """The strategy that a call with ``wanted`` runs.

    ``auto`` is ``broadcast`` where the optimizer expects at most ``max_bytes``
    of edges, else ``shuffle``. It goes by file sizes and runs no job. Any
    other strategy is itself.
    """
    if wanted == "auto":
        return "broadcast" if estimated_bytes(edges) <= max_bytes else "shuffle"
    if wanted not in STRATEGIES:
        raise ValueError(f"strategy must be auto or one of {STRATEGIES}, not {wanted!r}")
    return wanted


PLANS = {"shuffle": _by_shuffle, "broadcast": _by_broadcast, "adjacency": _by_adjacency}


def _walks(edges: DataFrame, strategy: str, ranked_nodes: int) -> DataFrame:
    """One rotation of every closed walk: a, b, c and the copies of its edges."""
    found = PLANS[strategy_for(edges, strategy)](collapse(edges), ranked_nodes)
    return found.select("a", "b", "c", "n_ab", "n_bc", "n_ca")


def triangle_count(edges: DataFrame, strategy: str = "shuffle", ranked_nodes: int = RANKED_NODES) -> DataFrame:
    """One row: ``closed_walks`` and ``triangles``, zeros for an empty graph.

    The plan is the one that is asked for; ``auto`` asks ``strategy_for``.
    ``broadcast`` and ``adjacency`` replicate what is small enough and shuffle
    the rest, so all give the same answer on a graph of any size.
    """
    walks = _walks(edges, strategy, ranked_nodes)
    copies = wide_product("n_ab", "n_bc", "n_ca")
    total = wide_sum(f"{copies} * if(a = b, 1, 3)")
    return walks.selectExpr(f"{total} AS closed_walks").selectExpr(
        "closed_walks", f"{third('closed_walks')} AS triangles"
    )


def closed_walks(edges: DataFrame, strategy: str = "shuffle", ranked_nodes: int = RANKED_NODES) -> DataFrame:
    """Every closed walk x -> y -> z -> x from every start, as rows (x, y, z).

    A walk appears once per combination of copies of its edges.
    """
    walks = _walks(edges, strategy, ranked_nodes)
    starts = [
        f"named_struct('x', {x}, 'y', {y}, 'z', {z})"
        for x, y, z in (("a", "b", "c"), ("b", "c", "a"), ("c", "a", "b"))
    ]
    rotated = walks.selectExpr(
        f"inline(if(a = b, array({starts[0]}), array({', '.join(starts)})))",
        "n_ab * n_bc * n_ca AS _copies",
    )
    return repeat_rows(rotated, "_copies", spread=True)


def triangle_triples(edges: DataFrame, strategy: str = "shuffle", **limits: int) -> DataFrame:
    """Closed walks as (follower, intermediate, followee)."""
    return closed_walks(edges, strategy, **limits).selectExpr(
        "x AS follower", "y AS intermediate", "z AS followee"
    )


def triangle_edges(edges: DataFrame, strategy: str = "shuffle", **limits: int) -> DataFrame:
    """Closed walks as their three edges, each as text ``a,b``."""
    return closed_walks(edges, strategy, **limits).selectExpr(
        "concat_ws(',', z, x) AS closing",
        "concat_ws(',', x, y) AS first_hop",
        "concat_ws(',', y, z) AS second_hop",
    )


def triangle_walks(edges: DataFrame, strategy: str = "auto", **limits: int) -> DataFrame:
    """Closed walks as start node and text ``x,y,z,x``."""
    return closed_walks(edges, strategy, **limits).selectExpr(
        "x AS src", "concat_ws(',', x, y, z, x) AS walk"
    )
