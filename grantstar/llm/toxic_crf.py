"""Toxicity by a linear-chain conditional random field over tokens.

Labelled documents label their tokens: a token of a toxic document is toxic if its word, or a prefix or suffix
of it, occurs in toxic documents far more often than chance allows. A chain of two states (clean, toxic) is
trained on these tokens; forward-backward marginals give the offending spans, and their sum over a document
the score, fitted to the document labels.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass
from math import log

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grantstar.llm.tasks import map_slices

#: The bounded training sample: so many labelled documents of at most so many characters, by a hash of doc_id.
TRAIN_DOCS = 2500
TRAIN_CHARS = 16_000
#: Documents from this score on are toxic; spans need this marginal.
DOCUMENT_LIMIT, SPAN_LIMIT = 0.3, 0.5
#: Features of a word besides the word itself.
PREFIXES, SUFFIXES = (3, 4, 5, 6), (4,)
#: Passes over the training tokens, and the penalty on squared weights.
STEPS, PENALTY = 60, 0.02

_REMEMBERED = 400_000
_BLOCK = 128
_strip = re.compile(r"[\W_]+").sub


def in_training(doc_id) -> F.Column:
    """True for rows whose labels may be learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 != 2, F.lit(True))


def features(token: str) -> list[str]:
    """The word in lower case without marks, its beginnings and its endings."""
    word = _strip("", token.lower())
    if not word:
        return []
    out = [word]
    out += [f"{word[:k]}*" for k in PREFIXES if len(word) > k]
    return out + [f"*{word[-k:]}" for k in SUFFIXES if len(word) > k]


def odds(weight: np.ndarray, step: np.ndarray, first: np.ndarray, start: float) -> np.ndarray:
    """Running odds of state 1 against 0 along chains laid end to end.

    ``weight``: odds each token adds; ``first`` marks where a chain begins, with odds ``start``; elsewhere odds x
    go over to (step[0, 1] + step[1, 1] x) / (step[0, 0] + step[1, 0] x). Each step is a 2 x 2 matrix, so
    blocks of tokens are multiplied side by side, their products chained, and the blocks filled in.
    """
    n = len(weight)
    blocks = -(-n // _BLOCK)
    pad = blocks * _BLOCK - n
    w = np.concatenate([weight, np.ones(pad)]).reshape(blocks, _BLOCK)
    new = np.concatenate([first, np.zeros(pad, bool)]).reshape(blocks, _BLOCK)
    # Row vectors (mass of 0, mass of 1) times [[a, b], [c, d]].
    a, b = np.where(new, 1.0, step[0, 0]), np.where(new, start, step[0, 1]) * w
    c, d = np.where(new, 1.0, step[1, 0]), np.where(new, start, step[1, 1]) * w
    one, two = np.ones(blocks), np.zeros(blocks)
    three, four = np.zeros(blocks), np.ones(blocks)
    for k in range(_BLOCK):
        one, two = one * a[:, k] + two * c[:, k], one * b[:, k] + two * d[:, k]
        three, four = three * a[:, k] + four * c[:, k], three * b[:, k] + four * d[:, k]
        largest = np.maximum(np.maximum(one, two), np.maximum(three, four))
        one, two, three, four = one / largest, two / largest, three / largest, four / largest
    into, x = np.empty(blocks), 1.0
    for k, (p, q, r, s) in enumerate(zip(one.tolist(), two.tolist(), three.tolist(), four.tolist())):
        into[k] = x
        x = (q + s * x) / (p + r * x)
    out, x = np.empty((blocks, _BLOCK)), into
    for k in range(_BLOCK):
        x = (b[:, k] + d[:, k] * x) / (a[:, k] + c[:, k] * x)
        out[:, k] = x
    return out.ravel()[:n]


@dataclass
class Chain:
    """Step weights between states 0 and 1, the odds a chain begins with."""

    step: np.ndarray
    start: float

    def passes(self, emission: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Forward odds, backward odds (the token's own weight included), and token weights."""
        w = np.exp(np.clip(emission, -25, 25))
        first = np.zeros(len(w), bool)
        ends = np.cumsum(lengths)
        first[(ends - lengths)[lengths > 0]] = True
        last = np.zeros(len(w), bool)
        last[(ends - 1)[lengths > 0]] = True
        r = odds(w, self.step, first, self.start)
        g = odds(w[::-1], self.step.T, last[::-1], 1.0)[::-1]
        return r, g, w

    def marginals(self, emission: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The probability of state 1 for each token of chains laid end to end."""
        if not len(emission):
            return np.zeros(0)
        r, g, w = self.passes(emission, lengths)
        both = r / w * g
        return both / (1 + both)


@dataclass
class ToxicModel:
    weights: dict[str, float]
    bias: float
    chain: Chain
    #: Intercept and slopes of the score over ``summary``, and the share of toxic training documents.
    fit: tuple[float, float, float]

    def emission(self, token: str) -> float:
        get = self.weights.get
        return self.bias + sum(get(f, 0.0) for f in features(token))

    def emissions(self, tokens: list[str], known: dict[str, float]) -> list[float]:
        if len(known) > _REMEMBERED:
            known.clear()
        out = []
        for token in tokens:
            if (e := known.get(token)) is None:
                e = known[token] = self.emission(token)
            out.append(e)
        return out

    def score(self, summary: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.fit[0] + summary @ np.array(self.fit[1:]), -30, 30)))


def summaries(marginals: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """(documents, 2): log odds of the most toxic token, and log of the expected number of toxic tokens among
    those more likely toxic than not. Empty documents have the smallest values."""
    out = np.tile([-8.0, 0.0], (len(lengths), 1))
    full = np.flatnonzero(lengths)
    if len(full):
        starts = (np.cumsum(lengths) - lengths)[full]
        top = np.clip(np.maximum.reduceat(marginals, starts), 1e-12, 1 - 1e-12)
        out[full, 0] = np.clip(np.log(top / (1 - top)), -8, 8)
        out[full, 1] = np.log1p(np.add.reduceat(np.where(marginals > 0.5, marginals, 0), starts))
    return out


def training_sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """text, toxic: at most ``TRAIN_DOCS`` rows. The chosen labels are few, so they may be broadcast to the
    documents; labels of one document count as toxic if any of them does."""
    own = labels.where(in_training(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
    own = own.groupBy(F.col("doc_id").alias("label_id")).agg(F.max("toxic").alias("toxic"))
    chosen = own.orderBy(F.xxhash64("label_id"), "label_id").limit(TRAIN_DOCS)
    short = docs.where(F.length("text") <= TRAIN_CHARS).select("doc_id", "text")
    joined = short.join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id"))
    return joined.orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(TRAIN_DOCS).select("text", "toxic")


def marking_features(held: np.ndarray, toxic: float, n: int) -> np.ndarray:
    """Which features mark toxic tokens: those in four of five cases or more in toxic documents, by a
    log-likelihood ratio that chance would not give one of all features. ``held`` (features, 2): clean and
    toxic documents with each feature."""
    share = toxic / n
    k, of = held[:, 1], held.sum(1)
    with np.errstate(divide="ignore", invalid="ignore"):
        rest = np.where(of > k, (of - k) * np.log((of - k) / of / (1 - share)), 0)
        ratio = 2 * (k * np.log(k / of / share) + rest)
    return (k >= 0.8 * of) & (k > of * share) & (np.nan_to_num(ratio) >= 2 * log(max(2, len(held))))


def _some_shingles(ids: np.ndarray) -> set[int]:
    """About one in four of the shingles of four words, chosen by their hash."""
    if len(ids) < 4:
        return set()
    mixed = np.zeros(len(ids) - 3, np.uint64)
    for k in range(4):
        mixed = (mixed ^ ids[k : len(ids) - 3 + k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return set(mixed[mixed % np.uint64(4) == 0].tolist())


def fit_chain(documents: Iterable[list[str]], toxic: np.ndarray) -> ToxicModel:
    """Train the field on the driver, over the bounded sample. Without both kinds of documents nothing can be
    learnt: the score is then the smoothed share of toxic ones. Copies of a document count once, else all
    words of a copied toxic document would look toxic. Features that only one document has are not used."""
    words: dict[str, int] = {}
    names: dict[str, int] = {}
    features_of: list[np.ndarray] = []
    numbered: list[np.ndarray] = []
    n_toxic, n = float(toxic.sum()), len(toxic)
    even = log((n_toxic + 0.1) / (n - n_toxic + 1))
    flat = ToxicModel({}, -25.0, Chain(np.ones((2, 2)), 1.0), (even, 0.0, 0.0))
    if not 0 < n_toxic < n:
        return flat
    seen_before: set[int] = set()
    fresh = np.ones(len(toxic), bool)
    for number, document in enumerate(documents):
        ids = []
        for token in document:
            row = words.setdefault(token, len(words))
            if row == len(features_of):
                own = [names.setdefault(f, len(names)) for f in features(token)]
                features_of.append(np.array(own, np.int32))
            ids.append(row)
        own = _some_shingles(np.array(ids, np.int64))
        fresh[number] = len(own) == 0 or len(own & seen_before) <= 0.5 * len(own)
        seen_before |= own
        if fresh[number]:
            numbered.append(np.array(ids, np.int32))
    toxic = toxic[fresh]
    n_toxic, n = float(toxic.sum()), len(toxic)
    if not 0 < n_toxic < n:
        return flat
    del seen_before
    n_words = len(words)
    del words
    held = np.zeros((len(names), 2))
    for ids, label in zip(numbered, toxic):
        if len(ids):
            own = np.unique(np.concatenate([features_of[w] for w in np.unique(ids)]))
            held[own, int(label)] += 1
    marks = marking_features(held, n_toxic, n)
    if not marks.any():
        return flat
    used = np.flatnonzero(held.sum(1) > 1)
    place = np.full(len(names), -1, np.int32)
    place[used] = np.arange(len(used))
    kept = dict(zip(used.tolist(), range(len(used))))
    names = {f: kept[i] for f, i in names.items() if i in kept}
    rows = np.repeat(np.arange(n_words, dtype=np.int32), [len(f) for f in features_of])
    columns = np.concatenate([*features_of, np.zeros(0, np.int32)])
    marked = np.bincount(rows, marks[columns], n_words) > 0
    columns = place[columns]
    rows, columns = rows[columns >= 0], columns[columns >= 0]
    del features_of, held
    tokens = np.concatenate(numbered)
    lengths = np.array([len(d) for d in numbered])
    of_document = np.repeat(toxic, lengths)
    y = marked[tokens] & (of_document > 0)
    inside = np.ones(len(tokens), bool)
    inside[(np.cumsum(lengths) - lengths)[lengths > 0]] = False  # tokens with one before them
    at = np.flatnonzero(inside)
    pairs = np.bincount(2 * y[at - 1] + y[at], minlength=4).astype(float)
    # Weights: features, bias, start, steps 01, 10, 11; step 00 is fixed.
    theta = np.zeros(len(names) + 5)
    theta[-5] = -4.0
    theta[-4] = -1.0
    squares = np.zeros(len(theta))
    firsts = np.flatnonzero(~inside)
    seen = np.bincount(columns, np.bincount(tokens[y], minlength=n_words)[rows], len(names))
    target = np.concatenate([seen, [y.sum(), y[firsts].sum(), *pairs[1:]]])
    for _ in range(STEPS):
        step = np.exp(np.array([[0.0, theta[-3]], [theta[-2], theta[-1]]]))
        chain = Chain(step, float(np.exp(theta[-4])))
        emission = np.bincount(rows, theta[columns], n_words)[tokens] + theta[-5]
        r, g, w = chain.passes(emission, lengths)
        p = r / w * g
        p /= 1 + p
        before, later = r[at - 1], g[at]
        joint = np.stack([step[0, 0] + 0 * later, step[0, 1] * later, before * step[1, 0], before * step[1, 1] * later])
        joint /= joint.sum(0)
        by_word = np.bincount(tokens, p, n_words)
        expected = np.concatenate(
            [np.bincount(columns, by_word[rows], len(names)), [p.sum(), p[firsts].sum(), *joint[1:].sum(1)]]
        )
        gradient = target - expected - PENALTY * theta
        squares += gradient**2
        theta += 0.5 * gradient / np.sqrt(squares + 1e-8)
    step = np.exp(np.array([[0.0, theta[-3]], [theta[-2], theta[-1]]]))
    weights = {f: float(theta[i]) for f, i in names.items() if abs(theta[i]) > 1e-3}
    model = ToxicModel(weights, float(theta[-5]), Chain(step, float(np.exp(theta[-4]))), (even, 0.0, 0.0))
    emission = np.bincount(rows, theta[columns], n_words)[tokens] + theta[-5]
    model.fit = _logistic(summaries(model.chain.marginals(emission, lengths), lengths), toxic)
    return model


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Penalised logistic regression by Newton's method."""
    x = np.column_stack([np.ones(len(x)), x])
    beta, ridge = np.zeros(3), np.diag([1e-3, 0.1, 0.1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge
        beta = beta + np.linalg.solve(hessian, x.T @ (y - p) - ridge @ beta)
    return tuple(beta.tolist())


def train(docs: DataFrame, labels: DataFrame) -> ToxicModel:
    """Labels, lang, source and doc_id are never inputs of a score; labels of other rows are not read."""
    sample = training_sample(docs, labels).toPandas()
    documents = ((t or "").split() for t in sample["text"])
    return fit_chain(documents, (sample["toxic"].to_numpy() > 0).astype(float))


def spans_of(text: str, marginals: np.ndarray) -> list[dict]:
    """Offending spans (start, end; code points), toxic tokens side by side as one."""
    out: list[dict] = []
    last = -2
    for k, m in enumerate(re.finditer(r"\S+", text)):
        if marginals[k] >= SPAN_LIMIT:
            if last == k - 1:
                out[-1]["end"] = m.end()
            else:
                out.append({"start": m.start(), "end": m.end()})
            last = k
    return out


def toxicity(docs: DataFrame, model: ToxicModel) -> DataFrame:
    """One row for each row of ``docs``: doc_id, text_key (a hash of the text), score, spans.

    A null or empty text has no tokens and the score of a text without any sign of toxicity. Rows are scored one
    by one, so repeated rows agree. An empty table gives no rows. Only doc_id and text are looked at.
    """
    span = T.StructType([T.StructField("start", T.LongType(), False), T.StructField("end", T.LongType(), False)])
    schema = T.StructType(
        [
            T.StructField("doc_id", docs.schema["doc_id"].dataType),
            T.StructField("text_key", T.LongType()),
            T.StructField("score", T.DoubleType(), False),
            T.StructField("spans", T.ArrayType(span, False), False),
        ]
    )

    def make():
        known: dict[str, float] = {}

        def work(columns):
            texts = [t or "" for t in columns[2]]
            emission, lengths = [], []
            for text in texts:
                tokens = text.split()
                lengths.append(len(tokens))
                emission += model.emissions(tokens, known)
            sizes = np.array(lengths, np.int64)
            p = model.chain.marginals(np.array(emission), sizes)
            scores = model.score(summaries(p, sizes))
            starts = np.cumsum(sizes) - sizes
            spans = []
            for text, at, size in zip(texts, starts, sizes):
                own = p[at : at + size]
                spans.append(spans_of(text, own) if size and own.max() >= SPAN_LIMIT else [])
            return [columns[0], columns[1], scores, spans]

        return work

    return map_slices(docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text"), make, schema)


def scored_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: doc_id, held_out, score, predicted, n_spans, spans (start:end, joined by
    commas). The model is trained on ``labels`` of rows that are not held out.

    Null and empty texts have no spans and the score of a text without any; a text of any length is read whole. Rows with
    equal texts get equal results, also those without an id, which are not held out. An empty table gives no rows; without
    labels all scores are equal. Only doc_id, text, and the labels' doc_id and toxic are looked at.
    """
    found = toxicity(docs, train(docs, labels))
    texts = F.transform("spans", lambda x: F.concat_ws(":", x["start"], x["end"]))
    return found.select(
        "doc_id",
        (~in_training(F.col("doc_id"))).alias("held_out"),
        "score",
        (F.col("score") >= DOCUMENT_LIMIT).cast("int").alias("predicted"),
        F.size("spans").cast("long").alias("n_spans"),
        F.array_join(texts, ",").alias("spans"),
    )


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows scored toxic, all columns as they are; the same cases as ``toxicity``."""
    model = train(docs, labels)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        known: dict[str, float] = {}
        out = []
        for at in range(0, len(texts), 256):
            tokens = [(t or "").split() for t in texts[at : at + 256]]
            sizes = np.array([len(t) for t in tokens], np.int64)
            emission = np.array([e for t in tokens for e in model.emissions(t, known)])
            out.append(model.score(summaries(model.chain.marginals(emission, sizes), sizes)))
        return pd.Series(np.concatenate(out) if out else [], dtype="float64")

    return docs.where(score("text") < DOCUMENT_LIMIT)
