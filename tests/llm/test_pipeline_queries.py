"""The registered queries against SQL, and the pipeline against brute force, on the smallest tables."""

import hashlib
import re
from collections import Counter
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from check import compare, connect
from grantstar.llm.oracles import ORACLES
from grantstar.llm.queries import QUERIES
from grantstar.llm.simhash_index import fingerprint
from grantstar.llm.toxic_crf import scored_documents

from .conftest import EDGES
from .test_models import classes

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_one_query_for_each_operator_and_the_pipeline():
    own = [n for n in QUERIES if re.match(r"op\d+_", n)]
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in own) == list(range(1, 14))
    assert set(queries()) >= {*QUERIES, "pipeline"} and set(oracle_sql()) >= set(ORACLES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, name):
    assert compare(spark, con, SF, QUERIES[name], ORACLES[name]) == ""


def test_line_rules_reject_documents_at_strict_limits(spark, con):
    rows = con.sql(f"select * from ({ORACLES['strict_line_frequency']}) where removed_words > 0").fetchall()
    assert len(rows) > 5
    got = QUERIES["strict_line_frequency"](spark, SF).where("removed_words > 0")
    assert got.count() == len(rows) and got.where("not kept and not base_failed").count() > 0


def test_registered_spans_and_lengths(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    spans = QUERIES["op2_chunk_dedup"](spark, SF).collect()
    assert 0 < len(spans) < len(docs) and {r.doc_id for r in spans} <= set(docs)
    for r in spans:
        found = [tuple(map(int, s.split(":"))) for s in r.spans.split(",")]
        assert len(found) == r.n_spans and sum(b - a for a, b in found) == r.repeated_bytes
        assert all(0 <= a < b <= len(docs[r.doc_id].encode()) for a, b in found)
    limits = QUERIES["op9_token_lengths"](spark, SF).collect()
    assert sum(r.docs for r in limits) == len(docs) and max(r.quantile for r in limits) == 1


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - {"op2_chunk_dedup", "op9_token_lengths"}))
def test_other_queries_give_a_row_for_each_document(spark, name):
    rows = QUERIES[name](spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == list(range(len(rows))) and len(rows) == 200


@pytest.fixture(scope="module")
def stages(spark):
    """What goes into each stage, and the last result, as plain rows."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    frames = [docs]
    for _, stage in corpus_pipeline.STAGES:
        frames.append(stage(spark, frames[-1], SF).cache())
    return frames


def texts(frame):
    return [(r.doc_id, r.text) for r in frame.collect()]


def test_all_stages_but_the_last_keep_the_columns(stages):
    assert [f.columns for f in stages[:-1]] == [COLUMNS] * 5
    rows = {tuple(r) for r in stages[0].collect()}
    for frame in stages[1:-1]:
        assert {tuple(r) for r in frame.collect()} <= rows


def test_toxicity_drops_what_the_field_rejects(spark, stages):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept = {r.doc_id for r in scored_documents(stages[0], labels).collect() if not r.predicted}
    assert sorted(i for i, _ in texts(stages[1])) == sorted(kept)


def test_exact_dedup_keeps_the_largest_id(stages):
    best = {}
    for i, text in texts(stages[1]):
        key = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        best[key] = max(i, best.get(key, i))
    assert sorted(i for i, _ in texts(stages[2])) == sorted(best.values())


def test_near_dedup_keeps_the_smallest_id(stages):
    rows = texts(stages[2])
    prints = {i: fingerprint(t) for i, t in rows}
    near = [(a, b) for a, b in combinations(prints, 2) if (prints[a] ^ prints[b]).bit_count() <= 4]
    assert sorted(i for i, _ in texts(stages[3])) == sorted(set(classes(near, prints).values()))


def test_mixing_comes_near_the_targets(stages):
    def sizes(frame):
        out = Counter()
        for r in frame.collect():
            out[r.source] += len((r.text or "").encode().split())
        return out

    before, after = sizes(stages[3]), sizes(stages[4])
    longest = max(len((t or "").encode().split()) for _, t in texts(stages[3]))
    assert abs(sum(after.values()) - sum(before.values())) <= longest * len(before)
    assert max(Counter(i for i, _ in texts(stages[4])).values()) <= 3


def test_encoding_equals_the_library(stages):
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    text = dict(texts(stages[4]))
    rows = stages[5].collect()
    assert Counter(r.doc_id for r in rows) == Counter(i for i, _ in texts(stages[4]))
    for r in rows:
        ids = library.encode(text[r.doc_id], add_bos=True, add_eos=True)
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_run_gives_the_last_result(spark, stages):
    got = corpus_pipeline.run(spark, SF)
    assert Counter(r.ids_sha256 for r in got.collect()) == Counter(r.ids_sha256 for r in stages[5].collect())


def test_edge_cases_pass_every_stage(spark, edges, empty):
    for docs in (edges, empty):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, SF)
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() <= 3 * len(EDGES)
