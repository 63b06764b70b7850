"""Language model, SimHash and toxicity field: against brute force and on held-out labels."""

import random
import zlib
from collections import Counter, defaultdict
from itertools import combinations, product
from math import log10

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from grantstar.llm import backoff_lm, simhash_index
from grantstar.llm.backoff_lm import DISCOUNT, Answer, Automaton, Followers, add_up, learn, scored
from grantstar.llm.common import stored
from grantstar.llm.components import connected_components
from grantstar.llm.simhash_index import ball_links, drop_near_copies, fingerprint, links, near_copies
from grantstar.llm.toxic_crf import (
    Chain,
    drop_toxic,
    fit_chain,
    odds,
    scored_documents,
    spans_of,
    toxicity,
    train,
)

from .conftest import EDGES, HUGE


def lowered_words(text):
    return (text or "").encode().lower().split()


# --- language model ----------------------------------------------------------------------------


def is_held_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 10 == 0


def sentences(seed, n):
    r = random.Random(seed)
    words = [f"w{k}" for k in range(40)]
    return [(i, " ".join(r.choice(words[: r.randint(2, 40)]) for _ in range(r.randint(0, 60)))) for i in range(n)]


def brute_probability(words, tokens, grams, history, word):
    """Interpolated absolute discounting over the kept n-grams, by its formula."""
    if not history:
        return (words[word] - DISCOUNT) / tokens
    below = brute_probability(words, tokens, grams, history[1:], word)
    follow = {w: n for (*h, w), n in grams.items() if tuple(h) == history}
    if not follow:
        return below
    of = grams[history] if len(history) > 1 else words[history[0]]
    free = 1 - sum(n - DISCOUNT for n in follow.values()) / of
    return max(0, follow.get(word, DISCOUNT) - DISCOUNT) / of + free * below


def model_of(texts, least=2):
    """Counts of words and kept n-grams of tokenised texts, each with its end."""
    words = Counter(w for t in texts for w in t)
    counts = Counter(tuple(t[i : i + k]) for t in texts for k in (2, 3) for i in range(len(t) - k + 1))
    return words, {g: n for g, n in counts.items() if n >= least}


def brute_score(words, grams, text):
    """The sum over all words of a text, each by the formula; words that training never saw are one event."""
    tokens, total = sum(words.values()), 0.0
    for k, word in enumerate(text):
        if word not in words:
            below = DISCOUNT * len(words) / tokens
            for length in (1, 2):
                history = tuple(text[max(0, k - length) : k])
                follow = [n for (*h, _), n in grams.items() if tuple(h) == history and len(history) == length]
                if follow:
                    of = grams[history] if length > 1 else words[history[0]]
                    below *= 1 - sum(n - DISCOUNT for n in follow) / of
            total += log10(below)
        else:
            total += log10(brute_probability(words, tokens, grams, tuple(text[max(0, k - 2) : k]), word))
    return total


@pytest.mark.parametrize("seed", range(4))
def test_the_walk_adds_up_the_smoothed_probabilities(monkeypatch, seed):
    """An automaton of the whole corpus, its states and arcs from plain counts."""
    r = random.Random(seed)
    texts = [[r.randint(1, 7) for _ in range(r.randint(0, 12))] + [0] for _ in range(60)]
    words, kept = model_of(texts)
    tokens, size = sum(words.values()), 8
    n = np.array([words[w] for w in range(size)])
    chance = np.where(n > 0, (n - DISCOUNT) / tokens, DISCOUNT * len(words) / tokens)
    pairs = sorted({(t[i], t[i + 1]) for t in texts for i in range(len(t) - 1)})
    codes = np.array([a * size + b for a, b in pairs])
    m = np.array([kept.get(p, 0) for p in pairs])

    def sums(history):
        own = [c for (*h, _), c in kept.items() if tuple(h) == history]
        return sum(own), len(own)

    taken, followers = np.array([sums((w,)) for w in range(size)]).T
    heads = [k for k, p in enumerate(pairs) if kept.get(p)]
    triples = sorted({t[i : i + 3] for t in map(tuple, texts) for i in range(len(t) - 2) if kept.get(t[i : i + 2]) and kept.get(t[i + 1 : i + 3])})
    ends = np.array([(pairs.index(t[:2]), pairs.index(t[1:])) for t in triples]).T
    count = np.array([kept.get(t, 0) for t in triples])
    none = np.zeros(0, int)
    further = Answer(none, *np.array([sums(pairs[k]) for k in heads]).T, count, none)
    automaton = Automaton.build(chance, Answer(n, taken, followers, m, none), codes, np.array(heads), further, ends)

    def ends_with(known, length):
        return np.array([known.get(tuple(t[i - length + 1 : i + 1]), -1) if i >= length - 1 else -1 for t in texts for i in range(len(t))])

    word = np.array([w for t in texts for w in t])
    pair, triple = (ends_with({x: k for k, x in enumerate(known)}, len(known[0])) for known in (pairs, triples))
    lengths = np.array([len(t) for t in texts])
    expected = [brute_score(words, kept, text) for text in texts]
    for side_by_side in (1, 24, 1000):
        monkeypatch.setattr(backoff_lm, "SIDE_BY_SIDE", side_by_side)
        assert automaton.scores(lengths, word, pair, triple) == pytest.approx(np.array(expected))
    assert len(automaton.failure) == len(automaton.backoff) > size
    assert (automaton.failure < np.maximum(1, np.arange(len(automaton.failure)))).all()
    for history in [(), *product(range(1, 8)), *product(range(1, 8), repeat=2)]:
        mass = sum(brute_probability(words, tokens, kept, history, w) for w in words)
        assert mass == pytest.approx(1 - DISCOUNT * len(words) / tokens) if not history else mass <= 1


def test_buckets_add_up_questions_of_all_blocks():
    r = random.Random(21)
    questions, n, m = [], Counter(), Counter()
    for _ in range(7):
        held = {r.randint(0, 30): [r.randint(0, 20) for _ in range(r.randint(0, 12))] for _ in range(12)}
        heads = sorted(held)
        tails = [sorted(set(held[h])) for h in heads]
        own = [r.randint(0, 2) for _ in heads]
        counts = [[r.randint(0, 2) for _ in t] for t in tails]
        for h, c, t, k in zip(heads, own, tails, counts):
            n[h] += c
            m.update({(h, x): y for x, y in zip(t, k)})
        flat = [np.array([x for t in lists for x in t], np.int64) for lists in (tails, counts)]
        degree = np.array([len(t) for t in tails])
        questions.append(Followers(np.array(heads, np.uint64), np.array(own), degree, flat[0].astype(np.uint64), flat[1]))
    kept = {p: c for p, c in m.items() if c >= 2}
    numbers = {}
    for q, answer in zip(questions, add_up(questions)):
        of = list(zip(np.repeat(q.heads, q.degree).tolist(), q.tails.tolist()))
        assert answer.m.tolist() == [kept.get(p, 0) for p in of]
        assert [k >= 0 for k in answer.numbers] == [p in kept for p in of]
        assert all(numbers.setdefault(p, k) == k for p, k in zip(of, answer.numbers.tolist()))
        for h, *got in zip(q.heads.tolist(), answer.n, answer.taken, answer.followers):
            own = [c for (a, _), c in kept.items() if a == h]
            assert got == [n[h], sum(own), len(own)]
    assert len({k for k in numbers.values() if k >= 0}) == len({p for p in numbers if p in kept})


def test_scores_and_counts_equal_brute_force(documents, monkeypatch):
    """Through blocks and buckets of a few tokens, so that every history is asked for by many."""
    monkeypatch.setattr(backoff_lm, "BLOCK_TOKENS", 400)
    monkeypatch.setattr(backoff_lm, "BUCKET_TOKENS", 300)
    rows = sentences(8, 200) + [(500, "never seen thing w1 w2"), (501, None), (502, "W1 w1 x")]
    rows += [rows[3], rows[3]]
    texts = [[*lowered_words(t), None] for i, t in rows if not is_held_out(i)]
    counts, kept = model_of(texts)
    tokens, kinds = sum(counts.values()), len(counts)
    got = scored(documents(rows, clashing=True)).collect()
    assert len(got) == len(rows)
    for row in got:
        words = [*lowered_words(dict(rows)[row.doc_id]), None]
        assert (row.n_tokens, row.n_known) == (len(words), sum(w in counts for w in words))
        assert row.held_out == is_held_out(row.doc_id) and row.train_tokens == tokens
        base = sum(log10((counts[w] + 0.1) / (tokens + 0.1 * (kinds + 1))) for w in words)
        assert row.base_score == pytest.approx(base)
        assert row.score == pytest.approx(brute_score(counts, kept, words))


def test_all_n_grams_that_occur_twice_are_in_the_model(documents, monkeypatch):
    """Most words here are rarer than one in 10,000 tokens, and still part of n-grams."""
    monkeypatch.setattr(backoff_lm, "BLOCK_TOKENS", 5000)
    r = random.Random(12)
    rows = [(i, " ".join(["the"] * 400)) for i in range(120)]
    pairs = [f"left{k} right{k} after{k}" for k in range(300)]
    rows += [(1000 + i, " ".join(r.choice(pairs) for _ in range(r.randint(1, 8)))) for i in range(300)]
    texts = [[*lowered_words(t), None] for i, t in rows if not is_held_out(i)]
    words, kept = model_of(texts)
    for row in scored(documents(rows)).collect():
        if row.doc_id % 20 == 0:
            text = [*lowered_words(dict(rows)[row.doc_id]), None]
            assert row.score == pytest.approx(brute_score(words, kept, text))


def test_held_out_text_is_likelier_under_n_grams_than_under_single_words(documents):
    r = random.Random(10)
    follow = {k: [r.randint(0, 199) for _ in range(3)] for k in range(200)}

    def chain():
        word, out = r.randint(0, 199), []
        for _ in range(60):
            out.append(f"w{word}")
            word = r.choice(follow[word])
        return " ".join(out)

    rows = [r_ for r_ in scored(documents([(i, chain()) for i in range(600)])).collect() if r_.held_out]
    assert len(rows) > 20 and sum(x.score for x in rows) > 0.6 * sum(x.base_score for x in rows)


def test_edge_cases_of_the_model(edges, empty, documents):
    assert scored(empty).collect() == []
    assert len(scored(edges).collect()) == len(EDGES)
    held = next(i for i in range(100) if is_held_out(i))
    row = scored(documents([(held, "no training")])).first()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.score) == (3, 0, 0, 0.0)
    assert learn(empty).tokens == 0


# --- SimHash -----------------------------------------------------------------------------------


def brute_fingerprint(text):
    words = lowered_words(text)
    shingles = [words[i : i + 4] for i in range(len(words) - 3)] or ([words] if words else [])
    hashes = [xxhash.xxh64_intdigest(b" ".join(s), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_equal_brute_force(monkeypatch):
    monkeypatch.setattr("grantstar.llm.simhash_index._BLOCK", 8)
    r = random.Random(11)
    texts = [None, "", " \n", "one", "A b\tC", "É é a B c d", "a b c d"]
    texts += [" ".join(r.choice("abcdefg") for _ in range(r.randint(1, 60))) for _ in range(60)]
    assert [fingerprint(t) for t in texts] == [brute_fingerprint(t) for t in texts]


def classes(edges, nodes):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def clustered(seed, n=260):
    r = random.Random(seed)
    centres = [r.getrandbits(64) for _ in range(3)]
    values = {0, 1, 2**64 - 1}
    while len(values) < n:
        v = r.choice([*centres, *r.sample(sorted(values), 2), r.getrandbits(64)])
        for b in r.sample(range(64), r.randint(0, 5)):
            v ^= 1 << b
        values.add(v)
    return [v - (1 << 64) if v >> 63 else v for v in values]


@pytest.mark.parametrize("length", [2, 8, 64])
def test_links_connect_what_all_pairs_would(spark, length):
    values = clustered(length)
    near = [(a, b) for a, b in combinations(values, 2) if ((a ^ b) & (2**64 - 1)).bit_count() <= 4]
    prints = spark.createDataFrame([(v,) for v in values], "fingerprint long")
    found = [tuple(r) for r in links(prints, length).collect()]
    assert all(((a ^ b) & (2**64 - 1)).bit_count() <= 4 and a != b for a, b in found)
    assert classes(found, values) == classes(near, values)
    balls = [tuple(r) for r in ball_links(prints).collect()]
    assert classes(balls, values) == classes(near, values)


def test_posts_of_the_ball_index_are_not_broadcast(spark):
    prints = stored(spark.createDataFrame([(v,) for v in clustered(3)], "fingerprint long"), "prints")
    plan = ball_links(prints)._jdf.queryExecution().executedPlan().toString()
    assert "LeftOuter" in plan and "BuildLeft" not in plan


def test_posts_of_the_positions_are_not_broadcast(spark, monkeypatch):
    plans = {}

    def noted(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return stored(df, name)

    monkeypatch.setattr(simhash_index, "stored", noted)
    links(stored(spark.createDataFrame([(v,) for v in clustered(3)], "fingerprint long"), "prints"))
    assert "LeftOuter" in plans["members"] and "BuildLeft" not in plans["members"]


def test_components_of_chains_and_stars(spark):
    pairs = [(i, i + 1) for i in range(100, 160)] + [(7, k) for k in range(200, 300)] + [(-5, 7), (1000, 999)]
    df = spark.createDataFrame(pairs, "a long, b long")
    nodes = {n for p in pairs for n in p}
    assert dict(map(tuple, connected_components(df).collect())) == classes(pairs, nodes)
    assert connected_components(df.where("a > 5000")).collect() == []


def near_rows(seed):
    r = random.Random(seed)
    rows = []
    for group in range(12):
        words = [f"g{group}w{r.randint(0, 500)}" for _ in range(150)]
        for _ in range(r.randint(1, 25)):
            own = words[:]
            for _ in range(r.randint(0, 2)):
                own[r.randrange(len(own))] = f"z{r.randint(0, 999)}"
            rows.append((len(rows), " ".join(own)))
    return rows + [(900, None), (901, ""), (902, rows[0][1]), (902, rows[0][1]), (None, "lonely words of no id")]


def brute_components(rows):
    prints = [brute_fingerprint(t) for _, t in rows]
    near = [(a, b) for a, b in combinations(range(len(rows)), 2) if (prints[a] ^ prints[b]).bit_count() <= 4]
    root, least = classes(near, range(len(rows))), defaultdict(lambda: None)
    for k, (doc_id, _) in enumerate(rows):
        ids = [i for i in (least[root[k]], doc_id) if i is not None]
        least[root[k]] = min(ids, default=None)
    return [(rows[k][0], f"{prints[k]:016x}", least[root[k]]) for k in range(len(rows))]


def test_near_copies_equal_brute_force(documents):
    rows = near_rows(12)
    docs = documents(rows, clashing=True)
    assert Counter(map(tuple, near_copies(docs).collect())) == Counter(brute_components(rows))
    kept = drop_near_copies(docs)
    assert kept.columns == docs.columns
    wanted = Counter({i for i, _, c in brute_components(rows) if i == c})
    assert Counter(r.doc_id for r in kept.collect()) == wanted


def test_edge_cases_of_near_copies(edges, empty):
    assert near_copies(empty).collect() == [] and drop_near_copies(empty).collect() == []
    assert len(near_copies(edges).collect()) == len(EDGES)


# --- toxicity ----------------------------------------------------------------------------------


def brute_marginals(emission, chain):
    total, mass = 0.0, np.zeros(len(emission))
    for states in product((0, 1), repeat=len(emission)):
        weight = chain.start if states[0] else 1.0
        for k, s in enumerate(states):
            weight *= np.exp(emission[k]) if s else 1.0
            weight *= chain.step[states[k - 1], s] if k else 1.0
        total += weight
        mass += weight * np.array(states)
    return mass / total


def test_marginals_equal_enumeration():
    r = np.random.default_rng(13)
    chain = Chain(np.exp(r.normal(size=(2, 2))), 0.3)
    lengths = np.array([0, 5, 1, 0, 9, 3, 0])
    emission = r.normal(scale=3, size=lengths.sum())
    got, at = chain.marginals(emission, lengths), 0
    for n in lengths:
        if n:
            assert got[at : at + n] == pytest.approx(brute_marginals(emission[at : at + n], chain))
        at += n


def test_odds_over_many_blocks():
    r = np.random.default_rng(14)
    w, step = np.exp(r.normal(scale=8, size=1000)), np.exp(r.normal(size=(2, 2)))
    first = r.random(1000) < 0.01
    first[0] = True
    x, expected = 0.0, []
    for k in range(1000):
        x = w[k] * (0.2 if first[k] else (step[0, 1] + step[1, 1] * x) / (step[0, 0] + step[1, 0] * x))
        expected.append(x)
    assert odds(w, step, first, 0.2) == pytest.approx(np.array(expected), rel=1e-6)


def toxic_corpus(spark, documents, n=600):
    r = random.Random(15)
    bad = ["vileone", "vileword", "vilething", "scorn"]
    rows, labels = [], []
    for i in range(n):
        words = ["".join(r.choice(["th", "er", "on", "an", "re"]) for _ in range(r.randint(1, 4))) for _ in range(60)]
        toxic = r.random() < 0.2
        for _ in range(r.randint(1, 4) if toxic else 0):
            words.insert(r.randrange(60), r.choice(bad) + r.choice(["", "", "x", "er"]))
        rows.append((i, " ".join(words)))
        if i % 2 == 0:
            labels.append((i, 1, int(toxic)))
        rows[-1] = (*rows[-1], "s")
    truth = {i: any(b in t for b in ("vile", "scorn")) for i, t, _ in rows}
    return documents(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), truth


def test_held_out_documents_are_told_apart(spark, documents):
    docs, labels, truth = toxic_corpus(spark, documents)
    rows = scored_documents(docs, labels).collect()
    assert {r.held_out for r in rows} == {True, False}
    wrong = [r for r in rows if bool(r.predicted) != truth[r.doc_id]]
    assert len(wrong) <= 0.02 * len(rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    spans = {r.doc_id: r.spans for r in toxicity(docs, train(docs, labels)).collect()}
    texts = dict((r.doc_id, r.text) for r in docs.collect())
    tagged = [texts[i][s["start"] : s["end"]] for i, own in spans.items() for s in own]
    assert sum("vile" in t or "scorn" in t for t in tagged) >= 0.95 * len(tagged) > 0
    kept = {r.doc_id for r in drop_toxic(docs, labels).collect()}
    assert kept == {r.doc_id for r in rows if not r.predicted}


def test_held_out_labels_are_never_learnt(spark, documents):
    docs, labels, _ = toxic_corpus(spark, documents, 300)
    own = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4) == 2
    turned = labels.withColumn("toxic", F.when(own, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert scored_documents(docs, labels).collect() == scored_documents(docs, turned).collect()


def test_offsets_are_code_points():
    assert spans_of("é bad worse ok", np.array([0.1, 0.9, 0.8, 0.2])) == [{"start": 2, "end": 11}]


def test_edge_cases_of_toxicity(spark, edges, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    some = spark.createDataFrame([(1, None, None), (None, 1, 1), (4, 1, 1), (4, 1, 0), (2, 1, 0)], none.schema)
    assert scored_documents(empty, some).collect() == []
    for labels in (none, some):
        rows = scored_documents(edges, labels).collect()
        assert len(rows) == len(EDGES) and all(0 <= r.score <= 1 for r in rows)
    assert fit_chain([["a"]], np.array([1.0])).score(np.zeros((1, 2)))[0] > 0.5


def test_very_long_runs_pass_every_model(spark, huge):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert scored(huge).count() == near_copies(huge).count() == scored_documents(huge, none).count() == len(HUGE)
    # Three texts of white space or one word; the fingerprint of no word is one.
    assert {r.doc_id for r in drop_near_copies(huge).collect()} == {1, 2, 4, 5}
