"""Whitening of embeddings: leading components of a covariance that is never built, by Jacobi-Davidson."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from followgraph.llm.scratch import stored

COMPONENTS = 16
SCALE, SHIFT = 64, 1_000_000
# Entries up to here have an x that fits a long.
LARGEST = float(1 << 56)
# Steps of MINRES for one correction, and directions kept before a restart.
INNER_STEPS = 5
BASIS = 128
ROUNDS = 200
# Residual norms, against the largest eigenvalue, that count as double precision.
RESIDUAL = 1e-14
# Directions of no variance, against the largest, can't be scaled to one.
FLAT = 1e-12
CHUNK = 1 << 18
# Tasks that add up the sums of all others.
MERGERS = 8
EPS = float(np.finfo(np.float64).eps)


def prepared(embeddings: DataFrame) -> DataFrame:
    """(vec_id, x) of every usable row; x = floor(64 c) + 1000000 for each entry c."""
    entry = f"e IS NOT NULL AND abs(cast(e AS double)) < {LARGEST!r}D"
    x = f"transform(embedding, e -> cast(floor({SCALE}D * cast(e AS double)) AS bigint) + {SHIFT}L)"
    return embeddings.where(f"embedding IS NOT NULL AND forall(embedding, e -> {entry})").selectExpr(
        "cast(vec_id AS bigint) AS vec_id", f"{x} AS x"
    )


def _blocks(batches: Iterator[pa.RecordBatch], column: int, size: int) -> Iterator[np.ndarray]:
    """The vectors of a list column as integer matrices of bounded size."""
    step = max(1, CHUNK // max(size, 1))
    for batch in batches:
        flat = batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, size)
        for at in range(0, batch.num_rows, step):
            yield flat[at : at + step]


def _summed(fit: DataFrame, size: int, each: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of ``each(block)`` over all blocks of the fit list.

    A task sends one array, whatever its number of rows; MERGERS tasks add
    them up, and the driver gets one array of each of those.
    """

    def total(arrays: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
        out = None
        for part in arrays:
            out = part if out is None else out + part
        if out is not None:
            yield pa.RecordBatch.from_arrays([pa.array([out.astype(np.float64).tobytes()], pa.binary())], ["v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from total(each(block).ravel() for block in _blocks(batches, 0, size))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from total(np.frombuffer(v.as_buffer()) for batch in batches for v in batch.column(0))

    parts = fit.mapInArrow(run, "v binary").repartition(MERGERS).mapInArrow(add, "v binary")
    return sum(np.frombuffer(bytes(r.v)) for r in parts.collect())


def _sums(fit: DataFrame, size: int) -> tuple[int, list[int]]:
    """Number of vectors and exact sum of each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, high, low = 0, np.zeros(size, np.int64), np.zeros(size, np.int64)
        for block in _blocks(batches, 0, size):
            rows += len(block)
            high += (block >> 24).sum(axis=0)
            low += (block & ((1 << 24) - 1)).sum(axis=0)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.arange(-1, size, dtype=np.int32)),
                pa.array(np.concatenate([[0], high])),
                pa.array(np.concatenate([[rows], low])),
            ],
            ["i", "high", "low"],
        )

    exact = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low")]
    rows = fit.mapInArrow(run, "i int, high bigint, low bigint").groupBy("i").agg(*exact).collect()
    found = {r.i: (int(r.high) << 24) + int(r.low) for r in rows}
    return found.get(-1, 0), [found.get(i, 0) for i in range(size)]


@dataclass
class Centre:
    """The mean of n vectors as a whole part and a rest of it, ``rest / n``, from 0 to 1."""

    n: int
    sums: list[int]

    def __post_init__(self) -> None:
        self.whole = np.array([s // self.n for s in self.sums], np.int64)
        self.rest = np.array([s % self.n for s in self.sums], object)
        self.part = np.array([s % self.n / self.n for s in self.sums])

    def __call__(self, block: np.ndarray) -> np.ndarray:
        """x - mean. Whole numbers are taken off first, so no digit is lost."""
        return (block - self.whole).astype(np.float64) - self.part

    def deviations(self, block: np.ndarray) -> list[int]:
        """The sum of (n x - sum)^2 of every vector, exact."""
        moved = block - self.whole
        most = (int(np.abs(moved).max()) + 1) * self.n if moved.size else 0
        if most < 1 << 52:
            values = moved * self.n - self.rest.astype(np.int64)
            high, low = values >> 26, values & ((1 << 26) - 1)
            parts = ((a * b).sum(axis=1).tolist() for a, b in ((high, high), (high, low), (low, low)))
            return [(a << 52) + (b << 27) + c for a, b, c in zip(*parts, strict=True)]
        values = moved.astype(object) * self.n - self.rest
        return [int((row * row).sum()) for row in values]


@dataclass
class Whitening:
    """Directions (a column each) by falling eigenvalue; residuals are against the largest eigenvalue."""

    centre: Centre
    directions: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float
    residual: float
    products: int


def _orthogonal(new: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Orthonormal directions of ``new`` outside ``basis``; those that vanish are left out."""
    kept = []
    for column in new.T:
        size = np.linalg.norm(column)
        for _ in range(3):
            column = column - basis @ (basis.T @ column)
            for other in kept:
                column = column - other * (other @ column)
        length = np.linalg.norm(column)
        if size > 0 and length > 1e-10 * size:
            kept.append(column / length)
    return np.stack(kept, axis=1) if kept else np.empty((len(new), 0))


def _minres(apply: Callable[[np.ndarray], np.ndarray], right: np.ndarray, steps: int) -> np.ndarray:
    """Approximate solutions of one symmetric system per column, all stepped at once."""
    beta = np.linalg.norm(right, axis=0)
    live = beta > 0
    v = right / np.where(live, beta, 1)
    before, w, older, x = (np.zeros_like(right) for _ in range(4))
    eta, cos, cos_before = beta.copy(), np.ones_like(beta), np.ones_like(beta)
    sin, sin_before = np.zeros_like(beta), np.zeros_like(beta)
    first = beta
    for _ in range(steps):
        image = apply(v)
        alpha = (v * image).sum(axis=0)
        following = image - alpha * v - beta * before
        after = np.linalg.norm(following, axis=0)
        delta = cos * alpha - cos_before * sin * beta
        rho = np.hypot(delta, after)
        live &= rho > 1e-300
        safe = np.where(live, rho, 1)
        step = (v - sin_before * beta * older - (sin * alpha + cos_before * cos * beta) * w) / safe
        cos_before, sin_before = cos, sin
        cos, sin = delta / safe, after / safe
        x += np.where(live, cos * eta, 0) * step
        eta = np.where(live, -sin * eta, 0)
        older, w = w, step
        # A column whose Krylov space is used up is left as it is.
        live &= after > 1e-13 * np.maximum(first, np.abs(alpha))
        before, v, beta = v, following / np.where(after > 0, after, 1), after
        if not live.any():
            break
    return x


def leading(product: Callable[[np.ndarray], np.ndarray], size: int, wanted: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Eigenvalues and orthonormal eigenvectors of the ``wanted`` largest of a symmetric operator, and the worst residual.

    Jacobi-Davidson on blocks. A Rayleigh-Ritz step in the search space gives
    the current pairs; those whose residual reached double precision are
    locked. For every other one, the correction t of (I - UU')(A - theta)(I - UU') t
    = -r is approximated by MINRES and widens the search space. ``product``
    multiplies a block of columns, so one pass over the data serves a step of
    all systems. The space restarts from its best directions when it is full.
    Once all are locked, their images are taken anew and must hold again.
    """
    wanted = min(wanted, size)
    if not wanted:
        return np.empty(0), np.empty((size, 0)), 0.0
    rng = np.random.default_rng(0)
    basis = _orthogonal(rng.standard_normal((size, min(size, wanted + 4))), np.empty((size, 0)))
    images = product(basis)
    fresh, best = True, np.inf
    for _ in range(ROUNDS):
        small = basis.T @ images
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        ritz, ritz_images = basis @ turn, images @ turn
        theta, pairs = values[:wanted], ritz[:, :wanted]
        off = ritz_images[:, :wanted] - pairs * theta
        norms = np.linalg.norm(off, axis=0)
        top = max(float(values[0]), 0.0)
        bar = max(RESIDUAL, 2 * EPS * size**0.5) * top
        open_ = np.flatnonzero(norms > bar)
        # Where the space is everything, rounding alone is left.
        stuck = basis.shape[1] == size and norms.max() >= 0.5 * best
        best = min(best, float(norms.max()))
        if not len(open_) or stuck:
            if fresh:
                return theta, pairs, float(norms.max() / top) if top else 0.0
            basis, _ = np.linalg.qr(ritz)
            images, fresh = product(basis), True
            continue
        if basis.shape[1] + len(open_) > max(BASIS, 3 * wanted):
            basis, images = ritz[:, : 2 * wanted], ritz_images[:, : 2 * wanted]
        if basis.shape[1] < size:
            shift = theta[open_]

            def clear(block: np.ndarray, pairs: np.ndarray = pairs) -> np.ndarray:
                return block - pairs @ (pairs.T @ block)

            def apply(block: np.ndarray, shift: np.ndarray = shift) -> np.ndarray:
                block = clear(block)
                return clear(product(block) - block * shift)

            moves = _minres(apply, clear(-off[:, open_]), INNER_STEPS)
            new = _orthogonal(moves, basis)
            if not new.shape[1]:
                new = _orthogonal(rng.standard_normal((size, len(open_))), basis)
            basis = np.concatenate([basis, new], axis=1)
            images = np.concatenate([images, product(new)], axis=1)
            fresh = False
        else:
            basis, _ = np.linalg.qr(basis)
            images, fresh = product(basis), True
    raise RuntimeError(f"no convergence: residual {best / top:.1e} of the largest eigenvalue")


def train(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The leading components of the distinct vectors of ``prepared`` rows; None where there are none.

    The list of distinct vectors is written once to the shared folder, and
    every product passes over it; nothing but sums of the size of a block of
    directions reaches the driver.
    """
    fit = stored(rows.select("x").distinct())
    sizes = fit.groupBy(F.size("x").alias("size")).agg(F.count(F.lit(1)).alias("rows"))
    usual = sizes.orderBy(F.desc("rows"), F.desc("size")).first()
    if usual is None:
        return None
    size = usual["size"]
    fit = fit.where(F.size("x") == size)
    n, sums = _sums(fit, size)
    centre = Centre(n, sums)
    count = 0

    def product(block: np.ndarray) -> np.ndarray:
        nonlocal count
        count += 1

        def each(x: np.ndarray) -> np.ndarray:
            centred = centre(x)
            return centred.T @ (centred @ block)

        return _summed(fit, size, each).reshape(block.shape) / n

    trace = float(_summed(fit, size, lambda x: np.array([(centre(x) ** 2).sum()])).sum()) / n
    values, directions, residual = leading(product, size, components)
    solid = values > FLAT * max(values.max(initial=0.0), 0.0)
    values, directions = values[solid], directions[:, solid]
    m = len(values)
    if not m:
        return Whitening(centre, directions, values, trace, 0.0, residual, count)
    # Either sign will do: the largest entry of a direction is positive.
    largest = directions[np.abs(directions).argmax(axis=0), np.arange(m)]
    directions = directions * np.sign(largest)
    scale = directions / np.sqrt(values)

    def spread(x: np.ndarray) -> np.ndarray:
        w = centre(x) @ scale
        return np.concatenate([w.sum(axis=0), (w.T @ w).ravel()])

    found = _summed(fit, size, spread) / n
    covariance = found[m:].reshape(m, m) - np.outer(found[:m], found[:m])
    error = float(np.abs(covariance - np.eye(m)).max())
    return Whitening(centre, directions, values, trace, error, residual, count)


SCHEMA = (
    "vec_id bigint, component int, n bigint, deviation decimal(38,0), "
    "whitened double, explained double, identity_error double"
)


def _apply(model: Whitening):
    size, m = model.directions.shape
    scale = model.directions / np.sqrt(model.values)
    share = model.values / model.trace if m else model.values
    names = [part.split()[0] for part in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for x in _blocks(iter([batch]), 1, size):
                rows = len(x)
                row = np.repeat(np.arange(rows), m)
                exact = [Decimal(d) if d < 10**38 else None for d in model.centre.deviations(x)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, rows).take(pa.array(row)),
                        pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), rows)),
                        pa.array(np.full(rows * m, model.centre.n, np.int64)),
                        pa.array(exact, pa.decimal128(38, 0)).take(pa.array(row)),
                        pa.array((model.centre(x) @ scale).ravel()),
                        pa.array(np.tile(share, rows)),
                        pa.array(np.full(rows * m, model.identity_error)),
                    ],
                    names,
                )
                at += rows

    return run


def whitened(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) per usable row and component.

    Components are numbered from 1 by falling variance over the distinct
    vectors. ``deviation`` is exact, null beyond 38 digits. A vector that is
    null or holds a null or an entry that is not finite (or past 2^56) takes
    no part; nor does one of another length than most distinct vectors have,
    of lengths as common the longest. Repeated rows and rows without vec_id
    are returned like others, but a vector counts once. Directions without
    variance are not components, so equal vectors, a single one, empty ones
    or an empty table give no rows. Other columns are ignored, whatever their
    names. Fitting runs when this is called.
    """
    rows = prepared(embeddings)
    model = train(rows, components)
    if model is None or not len(model.values):
        return embeddings.sparkSession.createDataFrame([], SCHEMA)
    return rows.where(F.size("x") == len(model.centre.sums)).mapInArrow(_apply(model), SCHEMA)
