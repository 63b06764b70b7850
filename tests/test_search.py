"""The title index against the scan, and the newest first rows against a full sort."""

import random
import re

import pytest
from pyspark.sql import functions as F

from conftest import tuples
from grantstar.operators.trigrams import grams, read_text_index, write_text_index
from grantstar.plans import analytics as a
from grantstar.plans.counts import CountedStar, newest_linked
from grantstar.session import table_stage


def plan(df) -> str:
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return df._jdf.queryExecution().explainString(mode)


WORDS = "Fuel CELL fuel-cell Ölpumpe straße STRASSE 100% a_b d'or \U0001f697car in the İzmir \"quoted\" x".split(" ")


@pytest.fixture(scope="module")
def titles():
    rng = random.Random(4)
    return [" ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 5))) for _ in range(400)]


@pytest.fixture
def some(star, titles):
    years = [str(1995 + i % 9) for i in range(len(titles))]
    return star(
        patents=[(f"p{i}", t, "", f"{y}-01-01", y) for i, (t, y) in enumerate(zip(titles, years))],
        inventors=[("a", "Ann", "US", None, None), ("b", "Bob", "US", None, None)],
        companies=[("x", "X", "2", "US", None, None)],
        relations=[(f"p{i}", "ab"[i % 2], "x" if i % 5 else None) for i in range(0, len(titles), 2)],
    )


@pytest.fixture
def counted(spark, some, tmp_path):
    return CountedStar(some, table_stage(spark, str(tmp_path)))


def test_grams_of_short_and_null_texts(spark):
    df = spark.createDataFrame([("aAaA",), ("ab",), ("",), (None,), ("\U0001f697ca",)], "t string")
    assert [r[0] for r in df.select(grams(F.col("t"))).collect()] == [["aaa"], None, None, None, ["\U0001f697ca"]]


def test_the_index_finds_what_the_scan_finds(some, counted, titles):
    rng = random.Random(7)
    terms = ["_b", "100%", "zzz", "fuel cell", "STRASSE", "i̇z", '"quo', "\U0001f697c"]
    for _ in range(4):
        title = rng.choice(titles)
        at = rng.randrange(len(title))
        terms.append(title[at : at + rng.randint(1, 8)])
    found = 0
    for term in terms:
        for k in (5, None):
            expected = tuples(a.search_patents(some, term, 1996, 2002, k))
            got = tuples(a.search_patents(counted, term, 1996, 2002, k))
            assert got == expected if k else sorted(got, key=str) == sorted(expected, key=str), term
        found += bool(expected)
    assert found > len(terms) / 2


def test_a_selective_term_opens_the_texts_of_its_candidates_only(spark, tmp_path):
    rows = spark.range(600).selectExpr("cast(id as string) key", "concat('title number ', id) text", "cast(id % 7 as int) year")
    write_text_index(rows, str(tmp_path), "key", "text", ["year"], bucket_rows=10)
    index = read_text_index(spark, str(tmp_path), "key")
    candidates = index.candidates("number 59", F.col("year") >= 0)
    texts = index.texts.join(candidates, ["bucket", "key"], "left_semi").where(F.lower("text").contains("number 59"))
    assert "dynamicpruning" in plan(texts)
    assert sorted(r.key for r in texts.collect()) == sorted(["59"] + [str(i) for i in range(590, 600)])
    # Texts of other buckets are not even opened: the query does without them.
    wanted = {r.bucket for r in candidates.collect()}
    others = [f for f in tmp_path.glob("texts/bucket=*") if int(f.name.split("=")[1]) not in wanted]
    assert len(others) >= 40
    for folder in others:
        for file in folder.glob("*.parquet"):
            file.write_bytes(b"no parquet")
        for file in folder.glob(".*.crc"):
            file.unlink()
    assert texts.union(texts.limit(0)).count() == 11
    with pytest.raises(Exception, match="no parquet|is not a Parquet file|FAILED_READ_FILE"):
        index.texts.select("text").collect()
    assert index.candidates("no") is None
    assert index.candidates("number x").count() == 0
    lists = plan(candidates)
    assert re.search(r"PushedFilters: .*In\(gram", lists) and "GreaterThanOrEqual(year,0)" in lists


def test_common_terms_take_the_scan(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("grantstar.operators.trigrams.HINTED_ROWS", 5)
    rows = spark.range(300).selectExpr("cast(id as string) key", "concat('title number ', id) text")
    write_text_index(rows, str(tmp_path), "key", "text")
    index = read_text_index(spark, str(tmp_path), "key")
    assert index.candidates("title") is None and index.candidates("er 1") is None
    assert index.candidates("ber 15").count() >= 11 and index.candidates("number 159").count() == 1


def test_a_hot_gram_is_spread_over_files(spark, tmp_path):
    rows = spark.range(3000).selectExpr("cast(id as string) key", "'same' text")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        write_text_index(rows, str(tmp_path), "key", "text")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    postings = read_text_index(spark, str(tmp_path), "key").postings
    sizes = postings.groupBy(F.input_file_name()).count().collect()
    assert len(sizes) > 2 and max(r["count"] for r in sizes) < 3000


@pytest.mark.parametrize("k", [1, 7, 60, 1000])
def test_newest_rows_equal_a_full_sort(some, counted, k):
    everything = tuples(newest_linked(some, 10_000))
    assert tuples(newest_linked(counted, k)) == everything[:k]
    assert tuples(a.patent_detail_join(counted, k)) == tuples(a.patent_detail_join(some, k))


def test_newest_rows_skip_older_years_and_join_nothing(spark, counted):
    newest = newest_linked(counted, 3)
    text = plan(newest)
    assert "Join" not in text and "hashpartitioning" not in text and "TakeOrderedAndProject" in text
    assert re.search(r"PushedFilters: \[.*GreaterThanOrEqual\(year,ScalarSubquery", text)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        head, full = (plan(a.patent_detail_join(counted, k)).count("hashpartitioning") for k in (20, None))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert head < full
