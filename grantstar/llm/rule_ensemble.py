"""Quality classifier: a sparse ensemble of rules over statistics of the text.

Small boosted trees are grown on a bounded sample of labelled documents. Every path from a root to a node is a rule, a
conjunction of thresholds. Lasso logistic regression gives most rules no weight; those that are left are
compiled into one Spark column expression, and all documents are scored with built-in functions.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grantstar.llm.common import words

#: Labelled rows that the rules are learnt from: those with the least hash of their id.
TRAIN_ROWS = 10_000
TREES, DEPTH, LEAST_ROWS, BINS, RATE = 40, 3, 10, 32, 0.3
#: Penalties tried for the weights, as shares of the least one that leaves no rule.
PENALTIES = (0.3, 0.1, 0.03, 0.01, 0.003, 0.001)
STEPS = 150

STATISTICS = (
    "n_words", "word_length", "longest_word", "symbols", "exclamations", "upper", "digits", "line_ends",
    "sentence_ends", "repeated_words", "distinct_words",
)


def held_out(doc_id: Column) -> Column:
    """True for documents whose labels nothing is learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def text_statistics(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: doc_id and STATISTICS, doubles. A null or empty text has zeros."""
    text = F.coalesce(F.col("text"), F.lit(""))
    df = docs.select("doc_id", text.alias("text")).withColumn("w", words(F.col("text")))
    n, chars = F.greatest(F.size("w"), F.lit(1)), F.greatest(F.length("text"), F.lit(1))

    def count(pattern: str) -> Column:
        return F.length("text") - F.length(F.regexp_replace("text", pattern, ""))

    of = {
        "n_words": F.size("w"),
        "word_length": F.length(F.array_join("w", "")) / n,
        "longest_word": F.coalesce(F.array_max(F.transform("w", F.length)), F.lit(0)),
        "symbols": count(r"[#*$%&|<>]+") / n,
        "exclamations": count("!+") / n,
        "upper": count(r"\p{Lu}+") / chars,
        "digits": count(r"\p{Nd}+") / chars,
        "line_ends": (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))) / n,
        "sentence_ends": F.size(F.filter("w", lambda x: x.endswith("."))) / n,
        "repeated_words": F.size(F.filter("w", lambda x, i: x == F.get("w", i + 1))) / n,
        "distinct_words": F.size(F.array_distinct("w")) / n,
    }
    return df.select("doc_id", *(of[name].cast("double").alias(name) for name in STATISTICS))


#: (statistic, True for above, threshold)
Condition = tuple[int, bool, float]
Rule = tuple[Condition, ...]


def _grow(x: np.ndarray, binned: np.ndarray, edges: list[np.ndarray], g: np.ndarray, h: np.ndarray):
    """One tree on gradients: its rules (a path for each node but the root) and its value for each row."""
    value, rules = np.zeros(len(g)), []

    def split(rows: np.ndarray, path: Rule) -> None:
        value[rows] = g[rows].sum() / (h[rows].sum() + 1)
        if len(path) == DEPTH:
            return
        best = (1e-6, None)
        own = g[rows].sum() ** 2 / (h[rows].sum() + 1)
        for k, edge in enumerate(edges):
            size = len(edge) + 1
            at = binned[rows, k]
            n, gs, hs = (np.cumsum(np.bincount(at, v, size))[:-1] for v in (None, g[rows], h[rows]))
            rest_g, rest_h = g[rows].sum() - gs, h[rows].sum() - hs
            gain = gs**2 / (hs + 1) + rest_g**2 / (rest_h + 1) - own
            gain[(n < LEAST_ROWS) | (len(rows) - n < LEAST_ROWS)] = 0
            if len(gain) and gain.max() > best[0]:
                best = gain.max(), (k, int(gain.argmax()))
        if best[1] is None:
            return
        k, cut = best[1]
        for above in (False, True):
            longer = (*path, (k, above, float(edges[k][cut])))
            rules.append(longer)
            split(rows[(binned[rows, k] > cut) == above], longer)

    split(np.arange(len(g)), ())
    return rules, value


def _tidy(rule: Rule) -> Rule:
    """Of several thresholds on one side of a statistic the tightest."""
    tight: dict[tuple[int, bool], float] = {}
    for k, above, t in rule:
        old = tight.get((k, above), t)
        tight[k, above] = max(old, t) if above else min(old, t)
    return tuple((k, above, t) for (k, above), t in sorted(tight.items()))


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    """For which rows all conditions of a rule hold."""
    return np.logical_and.reduce([(x[:, k] > t) == above for k, above, t in rule])


def tree_rules(x: np.ndarray, y: np.ndarray) -> list[Rule]:
    """The paths of boosted trees, those that hold for the same rows once."""
    edges = [np.unique(np.quantile(column, np.linspace(0, 1, BINS + 1)[1:-1])) for column in x.T]
    edges = [(e[1:] + e[:-1]) / 2 if len(e) > 1 else e[:0] for e in edges]
    binned = np.stack([np.searchsorted(e, column, "left") for e, column in zip(edges, x.T)], axis=1)
    margin, found = np.full(len(y), _logit(y.mean())), {}
    for _ in range(TREES):
        p = _sigmoid(margin)
        rules, value = _grow(x, binned, edges, y - p, p * (1 - p))
        margin += RATE * value
        for rule in map(_tidy, rules):
            found.setdefault(np.packbits(holds(rule, x)).tobytes(), rule)
    return list(found.values())


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def _logit(p: float) -> float:
    return float(np.log(p / (1 - p)))


def lasso_logistic(a: np.ndarray, y: np.ndarray, penalty: float, start: np.ndarray) -> np.ndarray:
    """Weights for the columns of ``a``, whose last one (ones) is not penalised, by accelerated proximal steps."""
    step = 4 / float((a * a).sum(axis=1).max())
    shrink = np.full(a.shape[1], penalty * step)
    shrink[-1] = 0
    weights = look = start
    t = 1.0
    for _ in range(STEPS):
        moved = look - step * (a.T @ (_sigmoid(a @ look) - y)) / len(y)
        new = np.sign(moved) * np.maximum(np.abs(moved) - shrink, 0)
        t, before = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        look = new + (before - 1) / t * (new - weights)
        weights = new
    return weights


@dataclass(frozen=True)
class RuleEnsemble:
    """``rules`` with their ``weights``, and the log-odds of a text for which none holds."""

    rules: tuple[Rule, ...]
    weights: tuple[float, ...]
    bias: float

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray) -> RuleEnsemble:
        """From rows of STATISTICS and labels 0 or 1. The penalty is the largest one that on every fifth row does as well as
        the best, up to a standard error. Without labels of both kinds there are no rules: the score is the share of label 1, smoothed."""
        constant = cls((), (), _logit((y.sum() + 1) / (len(y) + 2)))
        test = np.arange(len(y)) % 5 == 0
        if len(y) < 5 * LEAST_ROWS or any(len(set(part)) < 2 for part in (y[test], y[~test])):
            return constant
        rules = tree_rules(x[~test], y[~test])
        if not rules:
            return constant
        held = np.stack([holds(r, x) for r in rules] + [np.ones(len(y))], axis=1)
        none = np.zeros(held.shape[1])
        none[-1] = _logit(y[~test].mean())
        most = np.abs(held[~test].T @ (y[~test].mean() - y[~test]))[:-1].max() / (~test).sum()
        tried, weights = [], none
        for share in PENALTIES:
            weights = lasso_logistic(held[~test], y[~test], share * most, weights)
            p = np.clip(_sigmoid(held[test] @ weights), 1e-9, 1 - 1e-9)
            loss = -np.log(np.where(y[test] == 1, p, 1 - p))
            tried.append((loss.mean(), loss.std() / len(loss) ** 0.5, weights))
        least, spread, _ = min(tried, key=lambda x: x[0])
        weights = next(w for mean, _, w in tried if mean <= least + spread)
        chosen = [(r, float(w)) for r, w in zip(rules, weights) if w]
        return cls(tuple(r for r, _ in chosen), tuple(w for _, w in chosen), float(weights[-1]))

    def score(self) -> Column:
        """The probability of label 1 as an expression over STATISTICS."""

        def condition(k: int, above: bool, t: float) -> Column:
            column = F.col(STATISTICS[k])
            return column > F.lit(t) if above else column <= F.lit(t)

        terms = [F.lit(self.bias)]
        for rule, weight in zip(self.rules, self.weights):
            every = reduce(Column.__and__, (condition(*c) for c in rule))
            terms.append(F.when(every, F.lit(weight)).otherwise(F.lit(0.0)))
        return 1 / (1 + F.exp(-reduce(Column.__add__, terms)))

    def described(self) -> list[tuple[str, float]]:
        """Each rule as text, with its weight, the heaviest first."""
        texts = [
            " and ".join(f"{STATISTICS[k]} {'>' if above else '<='} {t:.4g}" for k, above, t in rule)
            for rule in self.rules
        ]
        return sorted(zip(texts, self.weights), key=lambda x: -abs(x[1]))


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = TRAIN_ROWS) -> RuleEnsemble:
    """The rules from at most ``rows`` labelled documents that are not held out, those with the least hash of
    their id; rows with the same id count one by one, up to the same bound."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.select(F.col("doc_id").alias("of"), F.col(label).cast("double").alias("y"))
    chosen = known.orderBy(F.xxhash64("of"), "of", "y").limit(rows)
    own = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("of"))
    stats = text_statistics(own.withColumn("doc_id", F.struct("doc_id", "y")))
    sample = stats.select(F.col("doc_id.doc_id").alias("doc_id"), F.col("doc_id.y").alias("y"), *STATISTICS)
    order = [F.xxhash64("doc_id"), "doc_id", "y", *STATISTICS]
    table = sample.orderBy(*order).limit(rows).select("y", *STATISTICS).toPandas().to_numpy(float)
    return RuleEnsemble.fit(table[:, 1:].reshape(-1, len(STATISTICS)), table[:, 0])


def scored_quality(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """One row for each row of ``docs``: doc_id, held_out, score, predicted.

    Only the text makes the score. Nulls and empty texts score by their statistics, which are zero; a text of any
    length is measured as a whole. A row without an id is not held out, and no label belongs to it.
    Rows with equal texts get equal scores. An empty table gives no rows; without labels all scores are
    one half. Columns other than doc_id and text, and doc_id and the label, are not looked at.
    """
    model = learn(docs, labels, label)
    held = held_out(F.col("doc_id")).alias("held_out")
    scores = text_statistics(docs).select("doc_id", held, model.score().alias("score"))
    return scores.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
