"""What the optimizer makes of the plans."""

import re

import pytest

from conftest import tuples
from grantstar.operators.linking import bridge
from grantstar.plans import analytics as a
from grantstar.plans.clean import clean
from grantstar.plans.pipeline import checked_star
from grantstar.plans.quality import assess_relations, quality_check, repaired_relations
from grantstar.schemas import Feeds
from grantstar.session import TableStage
from grantstar.sinks.tables import write_star
from grantstar.sources.stand_in import CLASS_PREFIX, SUBCLASS_PREFIXES, StandInFeeds
from grantstar.sources.tables import read_star

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    """The physical plan before execution, with all details."""
    execution = df._jdf.queryExecution()
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return execution.explainString(mode)


@pytest.fixture(scope="module")
def feeds(spark):
    return StandInFeeds(spark, SF)


@pytest.fixture(scope="module")
def lazy_star(feeds):
    return quality_check(clean(feeds, CLASS_PREFIX))


@pytest.fixture(scope="module")
def stored(spark, lazy_star, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("star"))
    write_star(lazy_star, folder)
    return read_star(spark, folder)


@pytest.fixture
def no_broadcast(spark):
    """Plans as they are for tables beyond the broadcast limit."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_trends_never_read_abstracts_or_people(lazy_star):
    text = plan(a.yearly_trends(lazy_star))
    assert "documents.parquet" not in text and "supplier.parquet" not in text


def test_counts_never_read_abstracts(lazy_star):
    assert "documents.parquet" not in plan(a.top_companies(lazy_star))


@pytest.mark.parametrize("copies", [1, 2])
def test_a_stored_star_is_never_searched_for_repeated_ids_again(spark, feeds, tmp_path, no_broadcast, copies):
    """Whether ids repeat is a fact of the stored stage: counting by year shuffles the counts and nothing else."""
    some = Feeds(**dict(feeds.items()))
    for _ in range(copies - 1):
        some.abstract = some.abstract.union(feeds.abstract.limit(20))
    star = checked_star(some, CLASS_PREFIX, str(tmp_path))
    trends = a.yearly_trends(star)
    text = plan(trends)
    assert text.count("hashpartitioning") == 1 and "Join" not in text and "abstract" not in text
    assert tuples(trends) == tuples(a.yearly_trends(quality_check(clean(some, CLASS_PREFIX))))
    facts = star._facts("patents", "patent_id")
    assert (facts.unique, facts.has_null) == (copies == 1, False)


def test_no_step_joins_all_the_way_from_the_feeds_to_the_assessed_links(
    feeds, lazy_star, tmp_path, no_broadcast, monkeypatch
):
    """Joins on one key run in one stage, whose tasks hold the sort buffers of all of them: few go into a stored step."""
    steps, store = {}, TableStage._store

    def seen(stage, df, name):
        steps.setdefault(name, plan(df))
        return store(stage, df, name)

    monkeypatch.setattr(TableStage, "_store", seen)
    star = checked_star(feeds, CLASS_PREFIX, str(tmp_path))
    assert sorted(map(str, tuples(star.relations))) == sorted(map(str, tuples(lazy_star.relations)))
    for name in ("inventor_links", "owner_links", "relations", "assessed_relations"):
        assert len(re.findall(r"^\(\d+\) SortMergeJoin", steps[name], re.M)) in (2, 3), name


def test_class_prefix_reaches_the_scan(feeds):
    text = plan(a.subcategory_breakdown(feeds.cpc, SUBCLASS_PREFIXES))
    assert "StringStartsWith(p_brand" in text
    assert "NestedLoop" not in text and "Cartesian" not in text


def test_year_filter_reaches_the_scan(stored):
    text = plan(a.search_patents(stored, "urgent", 1996, 2000))
    assert "GreaterThanOrEqual(year,1996)" in text and "LessThanOrEqual(year,2000)" in text
    assert "abstract" not in text


def test_top_k_is_cut_on_the_map_side(stored):
    for df in (a.top_inventors(stored), a.top_companies(stored), a.patent_detail_join(stored)):
        assert "TakeOrderedAndProject" in plan(df)


def test_no_query_pairs_rows_without_a_key(stored):
    for df in (
        a.above_average_companies(stored),
        a.country_share(stored, "inventor"),
        a.inventor_rankings(stored),
        a.inventor_rankings(stored, None),
        a.dataset_kpis(stored),
        a.search_patents(stored),
        a.suspicious_geocodes(stored, "NATION_5"),
    ):
        assert not re.search("NestedLoopJoin|CartesianProduct", plan(df))


def test_ranking_everyone_never_gathers_everyone(stored, no_broadcast):
    """Only the histogram of counts goes through a single partition."""
    text = plan(a.inventor_rankings(stored, None))
    gathered = re.findall(r"\((\d+)\) Exchange\nInput \[\d+\]: \[(.*?)\]\nArguments: SinglePartition", text)
    assert "inventor_id" not in " ".join(columns for _, columns in gathered)
    windows = re.findall(r"\(\d+\) Window\nInput \[\d+\]: \[(.*?)\]", text)
    assert windows and not any("inventor_id" in w for w in windows)


def test_distinct_counts_combine_before_the_shuffle(stored, no_broadcast):
    text = plan(a.top_companies(stored))
    assert re.search(r"hashpartitioning\(company_id#\d+, patent_id#\d+", text)
    assert "partial_count(distinct patent_id" in text


def test_large_joins_may_be_split_on_either_side(lazy_star, no_broadcast):
    """The bridge joins inner, so a hot patent can be split on both sides."""
    text = plan(lazy_star._star.relations)
    assert re.search(r"SortMergeJoin Inner", text)
    assert "SortMergeJoin LeftOuter" not in text


def test_keeping_the_first_row_combines_before_the_shuffle(feeds):
    text = plan(clean(feeds, CLASS_PREFIX).inventors)
    assert "partial_min" in text and "Window" not in text


def test_no_python_in_any_plan(lazy_star, feeds):
    for df in (*dict(lazy_star.items()).values(), lazy_star.report, a.inventor_rankings(lazy_star)):
        assert not re.search("PythonUDF|BatchEvalPython|ArrowEvalPython|MapInPandas", plan(df))


SKEW_CONF = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1KB",
}


@pytest.fixture
def small_partitions(spark):
    """Thresholds at which a few thousand rows of one key count as skewed, at 16 partitions."""
    conf = {**SKEW_CONF, "spark.sql.shuffle.partitions": "16"}
    before = {key: spark.conf.get(key, None) for key in conf}
    for key, value in conf.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def spread(df, first: str):
    """The frame over several map tasks: a skewed partition is split along map outputs."""
    return df.repartition(8, first)


def test_a_hot_patent_is_split_in_the_bridge(spark, small_partitions):
    people = spark.range(4000).selectExpr(
        "if(id % 3 = 0, 'hot', concat('p', id)) patent_id", "concat('i', id) inventor_id"
    )
    owners = spark.range(60).selectExpr(
        "if(id % 3 = 0, 'hot', concat('p', id)) patent_id", "concat('c', id) company_id"
    )
    rows = bridge(people, spread(people, "inventor_id"), spread(owners, "company_id"))
    got = rows.groupBy((rows.patent_id == "hot").alias("hot")).count()
    expected = people.join(owners, "patent_id", "left")
    expected = expected.groupBy((expected.patent_id == "hot").alias("hot")).count()
    assert dict(got.collect()) == dict(expected.collect())
    assert "skew=true" in got._jdf.queryExecution().executedPlan().toString()


def test_a_hot_inventor_is_split_in_the_checks(spark, small_partitions):
    links = spark.range(6000).selectExpr(
        "concat('p', id) patent_id",
        "if(id % 3 = 0, 'hot', concat('i', id % 500)) inventor_id",
        "if(id % 2 = 0, null, concat('c', id % 40)) company_id",
    )
    links = spread(links, "patent_id")
    patents = links.selectExpr("patent_id", "'T' title", "2020 year")
    inventors = links.selectExpr("inventor_id", "'N' name").distinct()
    companies = links.where("company_id is not null").selectExpr("company_id", "'N' name").distinct()
    checked = repaired_relations(assess_relations(links, patents, inventors, companies))
    totals = checked.selectExpr("count(*)", "count(company_id)", "count_if(inventor_id = 'hot')")
    assert tuple(totals.first()) == (6000, 3000, 2000)
    executed = checked.groupBy("patent_id").count()
    executed.collect()
    text = executed._jdf.queryExecution().executedPlan().toString()
    # The hot inventor, and the half of all links that share a null company.
    assert text.split("Initial Plan")[0].count("skew=true") == 2


def _shuffles(df) -> int:
    return len(re.findall(r"\(\d+\) Exchange\n", plan(df)))


def test_the_first_rows_of_the_detail_join_cost_less_than_all(stored, no_broadcast):
    assert _shuffles(a.patent_detail_join(stored)) < _shuffles(a.patent_detail_join(stored, None))


def test_no_shuffle_of_the_search_carries_titles(stored, no_broadcast):
    text = plan(a.search_patents(stored, "urgent", 1996, 2000))
    shuffled = re.findall(r"\(\d+\) Exchange\nInput \[\d+\]: \[(.*?)\]\nArguments: hashpartitioning", text)
    assert shuffled and not any("title" in columns for columns in shuffled)
