"""Quality by a sparse rule ensemble: tree paths become conjunctive rules over text statistics, a lasso-penalised
logistic model weighs them, and the rules that remain are compiled into one Spark column."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import fresh, text_or_empty

#: Labelled rows used at most, chosen by a hash of doc_id: the fit's documented bound.
FIT_ROWS = 20_000
TREES, DEPTH, BINS, RATE = 40, 3, 32, 0.3
PENALTY = 0.002


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a text that is not null, by name; shares are of characters, words or lines and 0 for empty texts."""
    n = F.greatest(F.char_length(text), F.lit(1))
    words = F.regexp_count(text, F.lit(r"\S+"))
    many = F.greatest(words, F.lit(1))
    count = lambda pattern: F.regexp_count(text, F.lit(pattern))
    letters = count(r"\p{L}")
    # every distinct word once, blanks between words being single in nearly all texts
    distinct = F.size(F.array_distinct(F.split(text, r"\s+")))
    lines = count("\n") + 1
    return {
        "chars": F.char_length(text).cast("double"),
        "words": words.cast("double"),
        "word_length": n / many,
        "letters": letters / n,
        "capitals": count(r"\p{Lu}") / F.greatest(letters, F.lit(1)),
        "digits": count("[0-9]") / n,
        "symbols": count(r"[^\p{L}\p{N}\s.,]") / n,
        "marks": count("[.,]") / many,
        "lone_marks": count(r"(?<!\S)[^\p{L}\p{N}\s]+(?!\S)") / many,
        "doubled_marks": count(r"([^\p{L}\p{N}\s])\1") / many,
        "repeats": count(r"(?<!\S)(\S+) \1(?!\S)") / many,
        "distinct": F.least(F.lit(1.0), distinct / many),
        "lines": lines.cast("double"),
        "line_length": n / lines,
    }


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, whether at most, bound)."""

    terms: tuple[tuple[str, bool, float], ...]

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        out = None
        for name, most, bound in self.terms:
            own = x[name] <= bound if most else x[name] > bound
            out = own if out is None else out & own
        return out

    def column(self, stats: dict[str, Column]) -> Column:
        out = None
        for name, most, bound in self.terms:
            own = stats[name] <= F.lit(bound) if most else stats[name] > F.lit(bound)
            out = own if out is None else out & own
        return out


@dataclass(frozen=True)
class Model:
    rules: tuple[Rule, ...]
    weights: tuple[float, ...]
    bias: float


def tree_rules(x: dict[str, np.ndarray], y: np.ndarray) -> list[Rule]:
    """All paths, inner ones too, of shallow trees that are boosted on the logistic loss."""
    names = list(x)
    cuts = {k: np.unique(np.quantile(x[k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in names}
    cells = {k: np.searchsorted(cuts[k], x[k], side="left") for k in names}
    score = np.full(len(y), np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    rules: dict[tuple, None] = {}
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        grad, hess = y - p, np.maximum(p * (1 - p), 1e-6)
        update = np.zeros(len(y))
        work = [((), np.arange(len(y)))]
        while work:
            terms, rows = work.pop()
            g, h = grad[rows].sum(), hess[rows].sum()
            best = None
            if len(terms) < DEPTH and len(rows) >= 20:
                for k in names:
                    size = len(cuts[k]) + 1
                    gl = np.cumsum(np.bincount(cells[k][rows], grad[rows], size))[:-1]
                    hl = np.cumsum(np.bincount(cells[k][rows], hess[rows], size))[:-1]
                    if not len(gl):
                        continue
                    gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1)
                    at = int(np.argmax(gain))
                    if best is None or gain[at] > best[0]:
                        best = (gain[at], k, at)
            if best and best[0] > 1e-3:
                _, k, at = best
                left = cells[k][rows] <= at
                for most, own in ((True, rows[left]), (False, rows[~left])):
                    path = (*terms, (k, most, float(cuts[k][at])))
                    rules[path] = None
                    if len(own):
                        work.append((path, own))
            else:
                update[rows] = g / (h + 1)
        score += RATE * update
        if np.abs(grad).mean() < 0.005:
            break
    return [Rule(r) for r in rules]


def lasso(z: np.ndarray, y: np.ndarray, penalty: float = PENALTY, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights and bias of least mean logistic loss plus penalty * sum of |weights|, by accelerated proximal steps."""
    n, k = z.shape
    design = np.hstack([z, np.ones((n, 1))])
    v = np.ones(k + 1)
    for _ in range(20):
        v = design.T @ (design @ v)
        v /= np.linalg.norm(v)
    step = 4 * n / np.linalg.norm(design @ v) ** 2
    w = seen = np.zeros(k + 1)
    t = 1.0
    for _ in range(steps):
        slope = design.T @ (1 / (1 + np.exp(-np.clip(design @ seen, -30, 30))) - y) / n
        new = seen - step * slope
        new[:k] = np.sign(new[:k]) * np.maximum(np.abs(new[:k]) - step * penalty, 0)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        seen = new + (t - 1) / t_new * (new - w)
        w, t = new, t_new
    return w[:k], float(w[k])


def fit(x: dict[str, np.ndarray], y: np.ndarray) -> Model:
    if not len(y) or y.min() == y.max():
        return Model((), (), 0.0 if not len(y) else 3.0 if y[0] else -3.0)
    rules = tree_rules(x, y)
    z = np.column_stack([r.holds(x) for r in rules]).astype(float)
    weights, bias = lasso(z, y)
    kept = np.flatnonzero(np.abs(weights) > 1e-4)
    return Model(tuple(rules[i] for i in kept), tuple(float(weights[i]) for i in kept), bias)


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fits on the statistics of labelled documents: labels has doc_id and quality (0 or 1), other values and nulls are
    left out, other columns of any name ignored. At most about FIT_ROWS rows, drawn by a hash of doc_id, reach the driver, as
    numbers; without any, every score is 0.5."""
    known = labels.where(F.col("quality").isin(0, 1)).select("doc_id", "quality")
    total = known.count()
    draw = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1_000_003)) / 1_000_003
    sample = known.where(draw < min(1.0, FIT_ROWS / max(1, total))) if total > FIT_ROWS else known
    # at most about FIT_ROWS rows of two numbers
    rows = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(sample), "doc_id")
    stats = statistics(F.col("text"))
    got = rows.select("quality", *[c.alias(k) for k, c in stats.items()]).toPandas()
    return fit({k: got[k].to_numpy(dtype=float) for k in stats}, got["quality"].to_numpy(dtype=float))


def score_column(model: Model, stats: dict[str, Column]) -> Column:
    total = F.lit(model.bias)
    for rule, weight in zip(model.rules, model.weights, strict=True):
        total = total + F.when(rule.column(stats), F.lit(weight)).otherwise(F.lit(0.0))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def with_quality(docs: DataFrame, model: Model, target: str = "score") -> DataFrame:
    """docs with the column target: the probability (0 to 1) that the text is of quality 1.

    Only the whole text enters; a null text counts as empty and is scored like it; repeated rows get equal
    scores; an empty table stays empty; a column with the name of target is replaced, all others stay. All of it is
    built-in expressions, without Python on the executors.
    """
    used = sorted({name for rule in model.rules for name, _, _ in rule.terms})
    text, own = fresh(docs, "_text"), fresh(docs, "_stats")
    stats = statistics(F.col(text))
    prepared = docs.withColumn(text, text_or_empty()).withColumn(own, F.struct(*[stats[k].alias(k) for k in used] or [F.lit(0).alias("none")]))
    return prepared.withColumn(target, score_column(model, {k: F.col(f"{own}.{k}") for k in used})).drop(text, own)
