"""Questions as SQL with parameters, and counts that deliveries add to."""

import random

import pytest

from conftest import tuples
from grantstar.operators.numbering import numbered
from grantstar.plans import analytics as a
from grantstar.plans.counts import per_country, per_entity
from grantstar.plans.deliveries import first_delivery, next_delivery
from grantstar.plans.questions import ask, search_patents_sql, suspicious_geocodes_sql
from grantstar.schemas import Star
from grantstar.session import table_stage


@pytest.fixture
def some(star):
    titles = ["Fuel CELL", "100% d'or", 'the "quoted" \\ one', "a_b", "ab", None]
    return star(
        patents=[(f"p{i}", titles[i % 6], "", "2019-01-01", str(2015 + i % 4)) for i in range(24)],
        inventors=[("a", "Ann", "US", None, None), ("b", "Bob", "JP", None, None)],
        companies=[("x", "X", "2", "US", "City", None), ("y", "Y", "2", "JP", None, None)],
        relations=[(f"p{i}", "ab"[i % 2], [None, "x", "y"][i % 3]) for i in range(22)],
    )


TERMS = ["", "cell", "100%", "%", "_", "d'or", "' or '1'='1", '"quoted"', "\\", "\\ one", ":k", "{patents}", "--"]


def test_search_as_sql_equals_the_plan(some):
    for term in TERMS:
        assert tuples(search_patents_sql(some, term, 2015, 2018, 7)) == tuples(a.search_patents(some, term, 2015, 2018, 7)), term
    assert {r.title for r in search_patents_sql(some, "%").collect()} == {"100% d'or"}
    assert {r.title for r in search_patents_sql(some, "A_B").collect()} == {"a_b"}


def test_drill_down_as_sql_equals_the_plan(some):
    for country in ("US", "JP", "US' or 'a'='a"):
        assert tuples(suspicious_geocodes_sql(some, country, 5)) == tuples(a.suspicious_geocodes(some, country, 5))


def test_any_question_leaves_no_view(spark, some):
    rows = ask(some, "select count(*) as n from {patents} where year > :year", year=2016)
    assert rows.first().n == 12
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("_pyspark")]


def counts(held, star):
    return {
        "inventors": dict(tuples(held.per_entity("inventor"))),
        "companies": dict(tuples(held.per_entity("company"))),
        "inventor countries": dict(tuples(held.per_attribute(star.inventors, "inventor", "country"))),
        "company countries": dict(tuples(held.per_attribute(star.companies, "company", "country"))),
        "unassigned": held.unassigned().first()[0],
    }


def recount(star):
    return {
        "inventors": dict(tuples(per_entity(star, "inventor"))),
        "companies": dict(tuples(per_entity(star, "company"))),
        "inventor countries": dict(tuples(per_country(star, "inventor"))),
        "company countries": dict(tuples(per_country(star, "company"))),
        "unassigned": a.unassigned_patents(star).first()[0],
    }


def test_three_deliveries_count_like_one(spark, star, tmp_path):
    """Patents and links come again, old patents get new links, and one inventor is on half of all patents."""
    r = random.Random(5)
    links = [(f"p{r.randrange(400)}", "hot" if r.random() < 0.5 else f"i{r.randrange(30)}", r.choice([None, "x", "y", "z"])) for _ in range(3000)]
    entities = dict(
        inventors=[("hot", "H", "US", None, None)] + [(f"i{k}", "n", ["US", "JP", "", None][k % 4], None, None) for k in range(30)],
        companies=[("x", "X", None, "US", None, None), ("y", "Y", None, "US", None, None), ("z", "Z", None, "DE", None, None)],
    )
    stage = table_stage(spark, str(tmp_path))
    parts = [links[:1200], links[1000:2000] + [(None, "hot", "x")], links[1900:]]
    held = first_delivery(star(relations=parts[0], **entities), stage)
    assert counts(held, star(**entities)) == recount(star(relations=parts[0], **entities))
    for number, part in enumerate(parts[1:], 1):
        held = next_delivery(held, star(relations=part, **entities), stage, number)
    whole = star(relations=list(dict.fromkeys(links)), **entities)
    assert counts(held, whole) == recount(whole)
    numbers = sorted(r.number for r in held.numbers.collect())
    assert numbers == list(range(len({p for p, *_ in links})))
    plan = held.per_attribute(whole.inventors, "inventor", "country")._jdf.queryExecution().toString()
    assert "partial_count(distinct" not in plan and "relations" not in plan and "bitmap_construct_agg" in plan


def test_an_empty_first_delivery(spark, star, tmp_path):
    held = first_delivery(star(), table_stage(spark, str(tmp_path)))
    assert counts(held, star()) == {"inventors": {}, "companies": {}, "inventor countries": {}, "company countries": {}, "unassigned": 0}
    later = next_delivery(held, star(relations=[("p", "a", None)], inventors=[("a", "A", "US", None, None)]), table_stage(spark, str(tmp_path / "2")), 1)
    assert dict(tuples(later.per_entity("inventor"))) == {"a": 1} and later.unassigned().first()[0] == 1


def test_numbers_are_consecutive_over_partitions(spark, tmp_path):
    keys = spark.range(1000).selectExpr("concat('k', id) key")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = tuples(numbered(keys, "key", table_stage(spark, str(tmp_path)), "n", 10))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [k for k, _ in sorted(rows, key=lambda x: x[1])] == sorted(f"k{i}" for i in range(1000))
    assert sorted(n for _, n in rows) == list(range(10, 1010))


def test_stars_are_left_as_they_are(some):
    assert isinstance(some, Star) and some.title_index is None
