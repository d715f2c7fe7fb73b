"""Text quality by a sparse ensemble of rules, compiled to one Spark expression."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The fit uses at most this many labelled rows, those of smallest hash of doc_id.
SAMPLE_ROWS = 20_000
HELD_OUT = 2
FOLDS = 4
ACCEPT = 0.7

TREES = 24
DEPTH = 3
BINS = 24
SHRINK = 0.4
LEAST_ROWS = 10
LASSO = 4e-4
STEPS = 400

MARKS = "!|#$%&*"

STATISTICS = (
    "log_chars",
    "word_chars",
    "distinct_words",
    "distinct_lines",
    "line_words",
    "upper",
    "digit",
    "foreign",
    "stop",
    "comma",
    *(f"mark_{i}" for i in range(len(MARKS))),
    "marks",
)


def statistics(text: Column) -> list[Column]:
    """The numbers that rules test, in the order of STATISTICS. Empty texts have finite ones."""
    n = F.greatest(F.length(text), F.lit(1))
    words = F.split(F.replace(text, F.lit("\n"), F.lit(" ")), " ")
    lines = F.split(text, "\n")

    def share(char: str) -> Column:
        return (F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))) / n

    marks = [share(c) for c in MARKS]
    values = [
        F.log1p(F.length(text)),
        n / F.size(words),
        F.size(F.array_distinct(words)) / F.size(words),
        F.size(F.array_distinct(lines)) / F.size(lines),
        F.size(words) / F.size(lines),
        F.regexp_count(text, F.lit("[A-ZÀ-Þ]")) / n,
        F.regexp_count(text, F.lit("[0-9]")) / n,
        (F.octet_length(text) - F.length(text)) / n,
        share("."),
        share(","),
        *marks,
        sum(marks[1:], marks[0]),
    ]
    return [v.cast("double").alias(name) for v, name in zip(values, STATISTICS, strict=True)]


@dataclass(frozen=True)
class Condition:
    """Whether a statistic is above a bound, or not."""

    statistic: int
    bound: float
    above: bool


Rule = frozenset[Condition]


def _paths(x: np.ndarray, edges: list[np.ndarray], slope: np.ndarray, weight: np.ndarray, grown: list[Rule]) -> np.ndarray:
    """Grow one tree on the slopes of the loss; adds the rule of every node; each row's step."""
    step = np.zeros(len(x))
    todo = [(np.arange(len(x)), frozenset(), 0)]
    while todo:
        rows, rule, depth = todo.pop()
        g, h = slope[rows], weight[rows]
        best = (1e-9, None)
        if depth < DEPTH and len(rows) >= 2 * LEAST_ROWS:
            whole = g.sum() ** 2 / (h.sum() + 1)
            for j, bounds in enumerate(edges):
                if not len(bounds):
                    continue
                place = x[rows, j]
                size = len(bounds) + 1
                gs = np.cumsum(np.bincount(place, g, size))[:-1]
                hs = np.cumsum(np.bincount(place, h, size))[:-1]
                ns = np.cumsum(np.bincount(place, minlength=size))[:-1]
                gain = gs**2 / (hs + 1) + (g.sum() - gs) ** 2 / (h.sum() - hs + 1) - whole
                gain[(ns < LEAST_ROWS) | (len(rows) - ns < LEAST_ROWS)] = 0
                if gain.max() > best[0]:
                    best = (gain.max(), (j, int(gain.argmax())))
        if best[1] is None:
            step[rows] = SHRINK * g.sum() / (h.sum() + 1)
            continue
        j, cut = best[1]
        for above in (False, True):
            side = rows[(x[rows, j] > cut) == above]
            grown.append(rule | {Condition(j, float(edges[j][cut]), above)})
            todo.append((side, grown[-1], depth + 1))
    return step


@dataclass
class RuleEnsemble:
    """A logistic model over rules; ``score`` is its Spark expression."""

    intercept: float
    rules: list[tuple[Rule, float]]

    def score(self) -> Column:
        """Probability of label 1, from columns named as STATISTICS."""
        terms = []
        for rule, weight in self.rules:
            tests = " AND ".join(
                f"{STATISTICS[c.statistic]} {'>' if c.above else '<='} {c.bound!r}D"
                for c in sorted(rule, key=lambda c: (c.statistic, c.bound, c.above))
            )
            terms.append(f"IF({tests}, {weight!r}D, 0D)")
        total = " + ".join([f"{self.intercept!r}D", *terms])
        return F.expr(f"1D / (1D + exp(-({total})))")


def fit(x: np.ndarray, y: np.ndarray) -> RuleEnsemble:
    """Trees give rules, one for each path from a root; lasso logistic regression weighs them.

    With one label only, or no rows, there is nothing to tell apart: the score
    is 1 if no row has label 0, else 0.
    """
    if not len(y) or y.min() == y.max():
        return RuleEnsemble(-40.0 if len(y) and not y.max() else 40.0, [])
    edges = [np.unique(np.quantile(column, np.linspace(0, 1, BINS + 1)[1:-1])) for column in x.T]
    # Rare values beyond the quantiles, such as marks that most texts lack.
    for j, column in enumerate(x.T):
        tail = column[column > column.min()]
        if len(tail):
            edges[j] = np.unique(np.append(edges[j], np.quantile(tail, np.linspace(0, 0.98, BINS))))
            edges[j] = edges[j][edges[j] < column.max()]
    place = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)], axis=1)
    grown: list[Rule] = []
    raw = np.zeros(len(y))
    for _ in range(TREES):
        chance = 1 / (1 + np.exp(-raw))
        raw += _paths(place, edges, y - chance, chance * (1 - chance), grown)
    rules = list(dict.fromkeys(grown))
    held = np.ones((len(y), len(rules)))
    for i, rule in enumerate(rules):
        for c in rule:
            held[:, i] *= (x[:, c.statistic] > c.bound) == c.above
    keep = (held.mean(axis=0) > 0) & (held.mean(axis=0) < 1)
    rules, held = [r for r, k in zip(rules, keep, strict=True) if k], held[:, keep]
    # Proximal gradient steps with momentum; the intercept is not penalised.
    centre = held.mean(axis=0)
    design = held - centre
    rate = 4 / (np.linalg.norm(design, 2) ** 2 / len(y) + 1)
    w, b = np.zeros(held.shape[1]), np.log(y.mean() / (1 - y.mean()))
    v, c, t = w, b, 1.0
    for _ in range(STEPS):
        off = (y - 1 / (1 + np.exp(-(design @ v + c)))) / len(y)
        stepped = v + rate * (design.T @ off)
        new_w = np.sign(stepped) * np.maximum(np.abs(stepped) - rate * LASSO, 0)
        new_b, new_t = c + rate * off.sum(), (1 + np.sqrt(1 + 4 * t * t)) / 2
        v = new_w + (t - 1) / new_t * (new_w - w)
        c = new_b + (t - 1) / new_t * (new_b - b)
        w, b, t = new_w, new_b, new_t
    used = np.flatnonzero(w)
    return RuleEnsemble(
        float(b - centre[used] @ w[used]), [(rules[i], round(float(w[i]), 6)) for i in used]
    )


def held_out(doc_id: Column) -> Column:
    """Rows whose labels no fit may see."""
    fold = F.crc32(doc_id.cast("string").cast("binary")) % FOLDS
    return F.coalesce(fold == HELD_OUT, F.lit(False))


def train(documents: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> RuleEnsemble:
    """Fit to ``labels`` (doc_id, quality) of documents outside the held-out fold.

    Label rows with a null take no part. The sample is bounded by
    ``sample_rows``, so it may be replicated to every task.
    """
    known = labels.select("doc_id", "quality").where(
        F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))
    )
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample_rows)
    texts = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    joined = texts.join(F.broadcast(sample), "doc_id").select("quality", *statistics(F.col("text")))
    rows = np.array(joined.limit(4 * sample_rows).collect(), float).reshape(-1, 1 + len(STATISTICS))
    rows = rows[np.lexsort(rows.T)]
    return fit(rows[:, 1:], (rows[:, 0] > 0).astype(float))


def scored(documents: DataFrame, model: RuleEnsemble) -> DataFrame:
    """(doc_id, held_out, score, predicted) per row of ``documents``.

    ``predicted`` is 1 where the score is at least ACCEPT. A null text is
    empty; empty and very long texts are scored like any other. Repeated rows
    get equal scores; a row without a doc_id is not held out. An empty table
    gives no rows; other columns are ignored.
    """
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return (
        rows.select(F.col("doc_id").cast("bigint").alias("doc_id"), *statistics(F.col("text")))
        .select("doc_id", held_out(F.col("doc_id")).alias("held_out"), model.score().alias("score"))
        .withColumn("predicted", F.when(F.col("score") >= ACCEPT, 1).otherwise(0).cast("int"))
    )


def keep_good(documents: DataFrame, model: RuleEnsemble) -> DataFrame:
    """The rows that ``scored`` predicts as good; same columns."""
    text = F.coalesce(F.col("text"), F.lit(""))
    whole = documents.select(F.struct("*").alias("_row"), F.struct(*statistics(text)).alias("_statistics"))
    # A generator of one row: a filter would otherwise be moved below the
    # statistics, and compute them anew for each of its tests.
    tested = whole.select("_row", F.inline(F.array("_statistics")))
    return tested.where(model.score() >= ACCEPT).select("_row.*")
