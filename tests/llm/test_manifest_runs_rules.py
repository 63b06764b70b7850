"""Merkle proofs, periodic runs and the rule ensemble: against brute force and on held-out labels."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from grantstar.llm import merkle_proofs
from grantstar.llm.merkle_proofs import folded, leaf_digest, manifest, path_digest, verified_manifest
from grantstar.llm.periodic_runs import BasicFactors, greatest_power, periodic_runs, run_digests, runs, with_planted_runs
from grantstar.llm.rule_ensemble import (
    STATISTICS,
    RuleEnsemble,
    holds,
    lasso_logistic,
    learn,
    scored_quality,
    text_statistics,
    tree_rules,
)

from .conftest import EDGES, HUGE

# --- Merkle manifest ---------------------------------------------------------------------------


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_leaf(doc_id, source, lang, n_chars, text):
    values = (doc_id, source, lang, n_chars, text)
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climb(level):
    """All levels of a tree, from the leaves to the one node."""
    levels = [level]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([sha("".join(last[i : i + 3])) for i in range(0, len(last), 3)])
    return levels


def siblings(levels, i):
    for level in levels[:-1]:
        run = level[i // 3 * 3 : i // 3 * 3 + 3]
        yield run[: i % 3], run[i % 3 + 1 :]
        i //= 3


def brute_manifest(rows):
    """Rows (doc_id, source, lang, n_chars, text) to what the manifest should say of each."""
    groups = defaultdict(list)
    for row in rows:
        groups[row[1]].append(row)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for name in names:
        own = sorted(groups[name], key=lambda r: (r[0] is not None, r[0] or 0, brute_leaf(*r)))
        trees[name] = own, climb([brute_leaf(*r) for r in own])
    top = climb([trees[name][1][-1][0] for name in names])
    out = []
    for k, name in enumerate(names):
        own, levels = trees[name]
        for i, row in enumerate(own):
            steps = [*siblings(levels, i), *siblings(top, k)]
            changed = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0 and row[4] is not None
            digest = brute_leaf(*row[:4], row[4].replace("\n", "")) if changed else brute_leaf(*row)
            for left, right in steps:
                digest = sha("".join([*left, digest, *right]))
            proof = sha("".join(d for left, right in steps for d in (*left, *right)))
            root = top[-1][0]
            out.append((row[0], brute_leaf(*row), levels[-1][0], root, proof, digest, digest == root))
    return out


def many_rows(seed, sizes):
    r = random.Random(seed)
    rows, ids = [], iter(r.sample(range(10_000), sum(sizes.values())))
    for source, n in sizes.items():
        for _ in range(n):
            text = r.choice([None, "", "a", "é\nb", "line\n" * r.randint(1, 4), f"text {r.random()}"])
            rows.append((next(ids), source, r.choice([None, "en", "-"]), r.choice([None, 0, 17]), text))
    r.shuffle(rows)
    return rows


SIZES = [
    {"s": 1},
    {"s": 2},
    {"s": 4, "t": 1},
    {"s": 3, None: 1, "": 9, "Z": 10, "z": 27, "é": 28},
    {f"s{k}": 1 + k % 3 for k in range(40)},
    {"hot": 300, **{f"s{k}": 1 for k in range(30)}, None: 82},
]


@pytest.mark.parametrize("case", range(len(SIZES)))
@pytest.mark.parametrize("bound", [0, 4 << 20])
def test_proofs_equal_brute_force(spark, monkeypatch, case, bound):
    """With and without broadcast of the ancestors."""
    monkeypatch.setattr(merkle_proofs, "BROADCAST_BYTES", bound)
    rows = many_rows(case, SIZES[case])
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    got = sorted(tuple(r) for r in verified_manifest(df.repartition(5)).collect())
    assert got == sorted(brute_manifest(rows))


def test_repeated_rows_and_rows_without_id_are_leaves_of_their_own(spark):
    rows = [(None, "a", None, None, t) for t in ("x", "x", "y", None)] + [(5, "a", "en", 1, "x\n")] * 3
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    key = lambda r: tuple(map(str, r))
    # Equal leaves may change places: only what does not depend on their order is compared by row.
    got, expected = verified_manifest(df).collect(), brute_manifest(rows)
    assert sorted((tuple(r)[:4] for r in got), key=key) == sorted((r[:4] for r in expected), key=key)
    assert sorted(map(tuple, got), key=key) == sorted(expected, key=key)


def test_tampering_shows(spark):
    rows = [(i, "s", "en", 3, "a\nb") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    for row in verified_manifest(df).collect():
        assert row.verified == (zlib.crc32(str(row.doc_id).encode()) % 2 == 1) == (row.folded_root == row.root)


def test_a_manifest_of_any_leaves(spark):
    """The general form: proofs are sibling lists that lead to the root."""
    df = spark.range(50).select(
        (F.col("id") % 4).cast("string").alias("group"),
        F.col("id").alias("key"),
        leaf_digest([F.col("id")]).alias("leaf"),
        F.struct("id", leaf_digest([F.col("id")]).alias("leaf")).alias("extra"),
    )
    found = manifest(df)
    proofs = found.proofs.select("extra.id", folded(F.col("extra.leaf"), F.col("path")).alias("up"), F.size("path").alias("n"))
    rows = proofs.collect()
    assert len(rows) == 50 and {bytes(r.up) for r in rows} == {found.root} and {r.n for r in rows} == {5}
    assert found.proofs.select(path_digest(F.col("path")).alias("p")).distinct().count() == 50


def test_a_large_group_is_spread(spark):
    """No stage numbers, hashes or proves the rows of one group in one task."""
    df = spark.range(4000).select(F.lit("hot").alias("group"), F.col("id").alias("key"), leaf_digest([F.col("id")]).alias("leaf"), F.struct("id").alias("extra"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        held = merkle_proofs.numbered(df)
        sizes = held.rows.groupBy(F.spark_partition_id()).count().collect()
        assert sorted(r["index"] for r in held.rows.collect()) == list(range(4000))
        placed = [r["count"] for r in spark.read.parquet(*held.rows.inputFiles()[:0] or held.rows.inputFiles()).groupBy(F.input_file_name()).count().collect()]
        assert len(sizes) > 1 or len(placed) > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_edge_cases_of_the_manifest(edges, empty, huge):
    assert verified_manifest(empty).collect() == [] and manifest_of(empty) is None
    assert len(verified_manifest(edges).collect()) == len(EDGES)
    assert len(verified_manifest(huge).collect()) == len(HUGE)


def manifest_of(docs):
    leaf = leaf_digest([F.col("doc_id")])
    return manifest(docs.select(F.col("source").alias("group"), F.col("doc_id").alias("key"), leaf.alias("leaf"), F.struct("doc_id").alias("extra"))).root


# --- periodic runs -----------------------------------------------------------------------------


def brute_runs(w):
    found = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                found.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("seed", range(4))
def test_runs_equal_brute_force(seed):
    r = random.Random(seed)
    for _ in range(300):
        w = [r.randrange(r.choice((1, 2, 3))) for _ in range(r.randint(0, 70))]
        if w and r.random() < 0.6:
            a, p = r.randrange(len(w)), r.randint(1, 9)
            w = [w[i] if i < a or a + (i - a) % p >= len(w) else w[a + (i - a) % p] for i in range(len(w))]
        assert list(zip(*(x.tolist() for x in runs(np.array(w, np.int64))))) == brute_runs(w), w


def test_factors_are_numbered_by_content():
    r = random.Random(9)
    w = [r.randrange(3) for _ in range(200)]
    factors = BasicFactors(np.array(w))
    for k, names in enumerate(factors.names):
        size = 1 << k
        held = defaultdict(list)
        for i in range(len(w) - size + 1):
            held[tuple(w[i : i + size])].append(i)
        for places in held.values():
            assert len({names[i] for i in places}) == 1 and (names[places[0]] >= 0) == (len(places) > 1)
            assert [factors.ahead[k][i] for i in places] == [b - a for a, b in zip(places, places[1:])] + [0]
        assert len({names[p[0]] for p in held.values() if len(p) > 1}) == sum(len(p) > 1 for p in held.values())


def planted(doc_id, text):
    w = (text or "").encode().split()
    if doc_id is None or zlib.crc32(str(doc_id).encode()) % 10 or not w:
        return w
    n, g = len(w), zlib.crc32(str(doc_id).encode()) // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def brute_digests(doc_id, text):
    w = planted(doc_id, text)
    found = brute_runs(w)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
    top = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *top, sha(lines), hashlib.sha256(kept).hexdigest())


def test_documents_equal_brute_force(documents, monkeypatch):
    monkeypatch.setattr("grantstar.llm.periodic_runs.BATCH_WORDS", 100)
    r = random.Random(31)
    rows = [(i, " ".join(r.choice(["a", "b", "É", "c\td"]) for _ in range(r.randint(0, 90)))) for i in range(300)]
    rows += [(900, "x y " * 40 + "z z z z z z z"), (901, "no repeats at all"), (None, "a " * 20)]
    got = run_digests(periodic_runs(with_planted_runs(documents(rows, clashing=True)))).collect()
    key = lambda x: tuple(map(str, x))
    assert sorted(map(tuple, got), key=key) == sorted((brute_digests(*r) for r in rows), key=key)
    assert sum(x.n_runs > 1 for x in got) >= 3 and sum(x.n_runs > 0 for x in got) >= 10


def test_the_greatest_power_is_compared_exactly(spark):
    big = 3_000_000_000
    runs_ = [(0, big, 3), (1, big + 1, 3), (2, 2 * big + 2, 6), (1, 2 * big + 2, 6)]
    df = spark.createDataFrame([(runs_,), ([],)], "runs array<struct<start long, length long, period long>>")
    rows = [r[0] for r in df.select(greatest_power(F.col("runs"))).collect()]
    assert tuple(rows[0]) == (1, big + 1, 3) and rows[1] is None


def test_edge_cases_of_runs(edges, empty, huge):
    assert periodic_runs(empty).collect() == []
    rows = periodic_runs(edges).collect()
    assert len(rows) == len(EDGES) and {r.collapsed for r in rows if r.doc_id in (1, 2, 3)} == {""}
    rows = {r.doc_id: r for r in periodic_runs(huge).collect()}
    assert [tuple(x) for x in rows[5].runs] == [(0, 40_000, 2)] and rows[5].collapsed.count(" ") == 1
    assert rows[1].runs == [] and rows[2].collapsed == HUGE[1][1]


# --- rule ensemble -----------------------------------------------------------------------------


def brute_statistics(text):
    text = text or ""
    w = text.encode().split()
    n, chars = max(1, len(w)), max(1, len(text))
    return [
        len(w),
        sum(len(x.decode()) for x in w) / n,
        max((len(x.decode()) for x in w), default=0),
        sum(c in "#*$%&|<>" for c in text) / n,
        text.count("!") / n,
        sum(c.isupper() for c in text) / chars,
        sum(c.isdigit() for c in text) / chars,
        text.count("\n") / n,
        sum(x.endswith(b".") for x in w) / n,
        sum(a == b for a, b in zip(w, w[1:])) / n,
        len(set(w)) / n,
    ]


def test_statistics_equal_brute_force(documents):
    texts = ["", None, " \n ", "A b b! ÉÜ 12 | x.", "one", "THE!! THE!! the. the.\nEnd#", "Ünïcödé 😀 😀 naïve."]
    got = {r.doc_id: list(r)[1:] for r in text_statistics(documents(list(enumerate(texts)), clashing=True)).collect()}
    for i, text in enumerate(texts):
        assert got[i] == pytest.approx(brute_statistics(text)), text
    assert text_statistics(documents([(1, "x")])).columns == ["doc_id", *STATISTICS]


def test_tree_paths_are_rules_and_lasso_keeps_few():
    r = np.random.default_rng(3)
    x = r.random((1500, 4))
    y = ((x[:, 0] > 0.6) & (x[:, 2] <= 0.5)).astype(float)
    seen = np.arange(len(y)) % 5 != 0
    rules = tree_rules(x[seen], y[seen])
    assert len({holds(rule, x[seen]).tobytes() for rule in rules}) == len(rules) and max(map(len, rules)) <= 3
    model = RuleEnsemble.fit(x, y)
    margin = model.bias + sum(w * holds(rule, x) for rule, w in zip(model.rules, model.weights))
    assert ((margin > 0) == (y == 1)).mean() > 0.98 and 0 < len(model.rules) < 0.7 * len(rules)
    used = {k for rule in model.rules[:5] for k, *_ in rule}
    assert used & {0, 2}


def test_lasso_meets_its_optimality_conditions():
    r = np.random.default_rng(4)
    a = np.hstack([(r.random((400, 6)) > 0.5).astype(float), np.ones((400, 1))])
    y = (r.random(400) < 1 / (1 + np.exp(-(2 * a[:, 0] - 1)))).astype(float)
    penalty, weights = 0.02, np.zeros(7)
    for _ in range(20):
        weights = lasso_logistic(a, y, penalty, weights)
    slope = a.T @ (1 / (1 + np.exp(-(a @ weights))) - y) / len(y)
    assert abs(slope[-1]) < 1e-4
    for w, g in zip(weights[:-1], slope[:-1]):
        assert abs(g) <= penalty + 1e-4 if w == 0 else abs(g + np.sign(w) * penalty) < 1e-3
    assert weights[0] > 0.5 and (weights[1:-1] == 0).sum() >= 3


def quality_corpus(spark, documents, n=700):
    r = random.Random(41)
    syllables = ["th", "er", "on", "an", "re", "st", "in"]
    rows, labels, truth = [], [], {}
    for i in range(n):
        w = ["".join(r.choice(syllables) for _ in range(r.randint(1, 4))) for _ in range(r.randint(30, 120))]
        junk = r.choice([None, None, None, "symbols", "repeat", "shout"])
        if junk == "symbols":
            w = [x + r.choice(["###", "|", "%%%"]) for x in w]
        elif junk == "repeat":
            w = [x for x in w[:6] for _ in range(20)]
        elif junk == "shout":
            w = [x.upper() + "!!" for x in w]
        rows.append((i, " ".join(w)))
        truth[i] = int(junk is None)
        if i % 3:
            labels.append((i, truth[i], 0))
    return documents(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), truth


def test_held_out_documents_are_told_apart(spark, documents):
    docs, labels, truth = quality_corpus(spark, documents)
    rows = scored_quality(docs, labels).collect()
    assert {r.held_out for r in rows} == {zlib.crc32(str(i).encode()) % 3 == 1 for i in truth}
    wrong = [r for r in rows if r.held_out and r.predicted != truth[r.doc_id]]
    assert len(wrong) <= 0.02 * sum(r.held_out for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)


def test_the_compiled_expression_equals_the_rules(spark, documents):
    docs, labels, _ = quality_corpus(spark, documents, 300)
    model = learn(docs, labels)
    table = text_statistics(docs).orderBy("doc_id")
    x = np.array([list(r)[1:] for r in table.collect()])
    margin = model.bias + sum(w * holds(rule, x) for rule, w in zip(model.rules, model.weights))
    got = [r.s for r in table.select(model.score().alias("s")).collect()]
    assert got == pytest.approx(list(1 / (1 + np.exp(-margin))))
    assert len(model.described()) == len(model.rules) and " and " in str(model.described())


def test_held_out_labels_are_never_learnt(spark, documents):
    docs, labels, _ = quality_corpus(spark, documents, 300)
    own = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    turned = labels.withColumn("quality", F.when(own, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert scored_quality(docs, labels).collect() == scored_quality(docs, turned).collect()


def test_the_sample_is_bounded(spark, documents):
    docs, labels, _ = quality_corpus(spark, documents, 400)
    assert learn(docs, labels, rows=10).rules == ()
    many = docs.union(docs.withColumn("doc_id", F.lit(1).cast("long")))
    assert len(scored_quality(many, labels.union(labels)).collect()) == 800


def test_no_python_scores_documents(spark, documents):
    docs, labels, _ = quality_corpus(spark, documents, 300)
    text = scored_quality(docs, labels)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "Arrow" not in text and "Exchange" not in text


def test_edge_cases_of_quality(spark, edges, empty, huge):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    some = spark.createDataFrame([(1, None, None), (None, 1, 1), (4, 1, 1), (4, 0, 0), (2, 1, 0)], none.schema)
    assert scored_quality(empty, some).collect() == []
    for labels in (none, some):
        rows = scored_quality(edges, labels).collect()
        assert len(rows) == len(EDGES) and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in scored_quality(edges, none).collect()} == {0.5}
    assert len(scored_quality(huge, none).collect()) == len(HUGE)
