import random
from decimal import ROUND_HALF_UP, Decimal
from collections import defaultdict

import pytest

from conftest import tuples
from grantstar.plans import analytics as a
from grantstar.plans.counts import CountedStar
from grantstar.session import table_stage
from grantstar.plans.pipeline import results
from grantstar.plans.profile import verify_tables


@pytest.fixture
def small(star):
    return star(
        patents=[
            ("1", "Hybrid Engine", "", "2019-05-01", "2019"),
            ("2", "Engine 50%", "", "2020-05-01", "2020"),
            ("3", "Wing", "", "2020-06-01", "2020"),
            ("4", "Lonely engine", "", "2020-07-01", "2020"),
        ],
        inventors=[
            ("a", "Ann", "US", "Troy", "MI"),
            ("b", "Bob", "JP", None, None),
            ("c", "Cid", None, None, None),
            ("d", "Dee", "DE", "Bonn", None),
        ],
        companies=[
            ("x", "X Inc", 2, "US", "Troy", None),
            ("y", "Y KK", 3, "JP", None, None),
            ("z", "Z", 3, None, None, None),
        ],
        relations=[
            ("1", "a", "x"),
            ("1", "a", "y"),
            ("1", "b", "x"),
            ("1", "b", "y"),
            ("2", "a", "x"),
            ("3", "b", None),
            ("3", "c", None),
            ("2", "c", "z"),
        ],
    )


def test_counts_are_distinct_over_the_bridge(small):
    assert tuples(a.top_inventors(small, 3)) == [
        ("Ann", "US", "Troy", 2),
        ("Bob", "JP", None, 2),
        ("Cid", None, None, 2),
    ]
    assert tuples(a.top_companies(small)) == [("X Inc", "US", 2), ("Y KK", "JP", 1), ("Z", None, 1)]


def test_country_filter(small):
    assert tuples(a.top_inventors(small, 5, ["JP", "DE"])) == [("Bob", "JP", None, 2)]


def test_shares_take_the_whole_before_the_cut(small):
    assert tuples(a.country_share(small, "inventor", 1)) == [("JP", 2, 50.0)]
    assert tuples(a.country_share(small, "company")) == [("US", 2, 66.67), ("JP", 1, 33.33)]


def test_comparison_needs_both_sides(small):
    assert tuples(a.country_comparison(small)) == [
        ("JP", 2, 50.0, 1, 33.33, 1),
        ("US", 2, 50.0, 2, 66.67, 0),
    ]
    assert a.country_comparison(small, 1).count() == 0


def test_country_options_are_of_linked_inventors(small):
    assert tuples(a.country_options(small)) == [("JP",), ("US",)]


def test_trends_and_milestones(small):
    assert tuples(a.yearly_trends(small)) == [(2019, 1, 1), (2020, 3, 4)]
    assert tuples(a.yearly_trends(small, show=(2020, 2025))) == [(2020, 3, 4)]
    assert tuples(a.milestone_trends(small)) == [(2019, 1, 1), (2020, 3, 4)]
    assert tuples(a.milestone_trends(small, [2018, 2020])) == [(2020, 3, 4)]
    assert tuples(a.cutoff_totals(small, (2018, 2019, 2020), lo=1990)) == [(0, 1, 4, 2020, 3)]
    assert tuples(a.cutoff_totals(small, (2019,), lo=2020)) == [(0, 2020, 3)]


def test_growth_needs_both_years(small):
    assert tuples(a.period_growth(small, 2019, 2020)) == [(1, 3, 200.0)]
    assert tuples(a.period_growth(small, 2010, 2020)) == [(None, 3, None)]


def test_peak_is_the_earliest_of_equals(star):
    s = star(patents=[(str(i), "t", "", None, str(y)) for i, y in enumerate((1999, 1999, 2004, 2004, 2007))])
    assert tuples(a.peak_year(s)) == [(1999, 2)]


def test_unassigned_means_any_link_without_company(star):
    s = star(relations=[("1", "a", None), ("1", "a", "x"), ("2", "a", "x"), ("3", "a", None), ("3", "b", None)])
    assert tuples(a.unassigned_patents(s)) == [(2,)]


def test_kpis(small):
    row = a.dataset_kpis(small, (2019, 2020)).first().asDict()
    assert row == {
        "total_patents": 4,
        "first_year": 2019,
        "last_year": 2020,
        "total_inventors": 4,
        "total_companies": 3,
        "unassigned_patents": 1,
        "peak_year": 2020,
        "peak_patents": 3,
        "growth_pct": 200.0,
    }


def test_kpis_of_an_empty_star(star):
    row = a.dataset_kpis(star()).first()
    assert row.total_patents == 0 and row.first_year is None and row.growth_pct is None


def test_above_average_uses_the_unrounded_mean(star):
    links = [(f"x{i}", "a", "x") for i in range(5)] + [("x0", "a", "y"), ("x1", "a", "z")]
    companies = [("x", "X", None, None, None, None), ("y", "Y", None, "US", None, None), ("z", None, None, "US", None, None)]
    s = star(companies=companies, relations=links)
    # Named only: counts 5 and 1. All: counts 5, 1 and 1, mean 7/3.
    assert tuples(a.above_average_companies(s)) == [("X", None, 5, 3.0, 1.67)]
    assert tuples(a.above_average_companies(s, digits=2, named_only=False)) == [("X", None, 5, 2.33, 2.14)]


def test_rank_leaves_gaps_and_dense_rank_does_not(star):
    sizes = {"a": ("US", 5), "b": ("US", 5), "c": ("US", 3), "d": (None, 3), "e": (None, 1)}
    s = star(
        inventors=[(k, k, c, None, None) for k, (c, _) in sizes.items()],
        relations=[(f"p{i}", k, None) for k, (_, n) in sizes.items() for i in range(n)],
    )
    rows = {r.name: (r.overall_rank, r.rank_in_country, r.pct_of_total) for r in a.inventor_rankings(s).collect()}
    assert rows == {
        "a": (1, 1, 29.4118),
        "b": (1, 1, 29.4118),
        "c": (3, 2, 17.6471),
        "d": (3, 1, 17.6471),
        "e": (5, 2, 5.8824),
    }


def test_histogram_ranks_equal_counted_ranks(star):
    rng = random.Random(7)
    inventors = [(f"i{n}", f"n{n}", rng.choice(["US", "JP", None]), None, None) for n in range(60)]
    relations = [(f"p{rng.randrange(40)}", f"i{rng.randrange(60)}", None) for _ in range(400)]
    s = star(inventors=inventors, relations=relations)
    held = {}
    for patent, inventor, _ in relations:
        held.setdefault(inventor, set()).add(patent)
    counts = [(name, country, len(held[key])) for key, name, country, *_ in inventors if key in held]
    whole = sum(n for _, _, n in counts)
    expected = [
        (
            name,
            country,
            n,
            1 + sum(m > n for _, _, m in counts),
            1 + len({m for _, c, m in counts if c == country and m > n}),
            float((Decimal(100 * n) / whole).quantize(Decimal("0.0001"), ROUND_HALF_UP)),
        )
        for name, country, n in counts
    ]
    columns = ("name", "country", "patent_count", "overall_rank", "rank_in_country", "pct_of_total")
    everyone = a.inventor_rankings(s, None).select(*columns)
    assert sorted(tuples(everyone), key=str) == sorted(expected, key=str)
    head = tuples(a.inventor_rankings(s, 10).select(*columns))
    assert len(head) == 10 and set(head) <= set(expected)


def test_one_inventor_may_hold_a_third_of_all_links(star):
    """Brute force over a bridge with a hot inventor, a hot company and a hot patent."""
    rng = random.Random(3)
    links = set()
    for _ in range(3000):
        kind = rng.randrange(3)
        links.add(
            (
                "hot" if kind == 0 else f"p{rng.randrange(300)}",
                "hot" if kind == 1 else f"i{rng.randrange(50)}",
                rng.choice(["hot", None]) if kind == 2 else f"c{rng.randrange(30)}",
            )
        )
    names = sorted({i for _, i, _ in links})
    owners = sorted({c for _, _, c in links if c})
    s = star(
        inventors=[(i, i, "US" if i < "i3" else "JP", None, None) for i in names],
        companies=[(c, c, None, "US" if c < "c2" else "DE", None, None) for c in owners],
        relations=sorted(links, key=str),
    )
    per_inventor, per_company, per_country = defaultdict(set), defaultdict(set), defaultdict(set)
    for p, i, c in links:
        per_inventor[i].add(p)
        per_country["US" if i < "i3" else "JP"].add(p)
        if c:
            per_company[c].add(p)
    top = sorted(((len(v), k) for k, v in per_inventor.items()), key=lambda t: (-t[0], t[1]))[:20]
    assert [(r.patent_count, r.name) for r in a.top_inventors(s).collect()] == top
    top = sorted(((len(v), k) for k, v in per_company.items()), key=lambda t: (-t[0], t[1]))[:20]
    assert [(r.patent_count, r.name) for r in a.top_companies(s).collect()] == top
    counts = {r.country: r.patent_count for r in a.country_share(s, "inventor").collect()}
    assert counts == {k: len(v) for k, v in per_country.items()}


def test_subcategories_overlap_and_include_empty_ones(feeds):
    f = feeds(cpc=[("1", "Y02T10/7"), ("1", "Y02T90/1"), ("1", "Y02T10/8"), ("2", "Y02T10/7"), ("3", "A01"), ("4", None)])
    assert tuples(a.subcategory_breakdown(f.cpc)) == [
        ("Y02T10", 2),
        ("Y02T90", 1),
        ("Y02T30", 0),
        ("Y02T50", 0),
        ("Y02T70", 0),
    ]
    parent = dict(tuples(a.subcategory_breakdown(f.cpc, ["Y02T", "Y02T10"])))
    assert parent == {"Y02T": 2, "Y02T10": 2}


def test_detail_join_is_newest_first_and_keeps_unowned_links(small):
    rows = tuples(a.patent_detail_join(small, 3))
    assert [(r[0], r[4], r[7]) for r in rows] == [("2", "Ann", "X Inc"), ("2", "Cid", "Z"), ("3", "Bob", None)]
    everything = tuples(a.patent_detail_join(small, None))
    assert len(everything) == 8
    assert set(tuples(a.patent_detail_join(small, 100))) == set(everything)
    assert tuples(a.spot_check(small, 1, width=4)) == [("2", "Engi", 2020, "Ann", "US", "X Inc", "US")]


def test_search_is_capped_after_sorting(small):
    rows = tuples(a.search_patents(small, "ENGINE", 2019, 2025))
    assert [(r[0], r[4]) for r in rows] == [("2", "X Inc"), ("2", "Z"), ("4", None), ("1", "X Inc"), ("1", "Y KK")]
    assert [(r[0], r[4]) for r in tuples(a.search_patents(small, "engine", 2019, 2025, 3))] == [
        ("2", "X Inc"),
        ("2", "Z"),
        ("4", None),
    ]
    assert [r[0] for r in tuples(a.search_patents(small, "%", 2019, 2025))] == ["2", "2"]
    assert a.search_patents(small, "", 2019, 2019, None).count() == 2
    assert a.search_patents(small, "engine", 2021).count() == 0


def test_country_distributions(small):
    assert tuples(a.top_inventor_countries(small)) == [("JP", 1), ("US", 1)]
    assert tuples(a.top_company_countries(small)) == [("US", 2), ("JP", 1)]


def test_drill_down(small):
    assert tuples(a.companies_in_country(small, "JP")) == [("y", "Y KK", "JP", None, None)]
    assert tuples(a.suspicious_geocodes(small, "JP")) == [
        ("Y KK", "JP", None, "Hybrid Engine", 2019, "Ann", "US"),
        ("Y KK", "JP", None, "Hybrid Engine", 2019, "Bob", "JP"),
    ]


def test_invariants(small):
    shares = [r.pct_share for r in a.country_share(small, "inventor", 100).collect()]
    assert abs(sum(shares) - 100) < 0.1
    trend = tuples(a.yearly_trends(small))
    assert trend[-1][2] == small.patents.count()
    assert all(r.columns_ok for r in verify_tables(small).collect())


def test_result_columns(small):
    columns = {name: df.columns for name, df in results(small).items()}
    assert columns == {
        "top_inventors": ["name", "country", "city", "patent_count"],
        "top_companies": ["name", "country", "patent_count"],
        "country_trends_by_inventor": ["country", "patent_count", "pct_share"],
        "country_trends_by_company": ["country", "patent_count", "pct_share"],
        "yearly_trends": ["year", "patent_count", "cumulative_total"],
        "full_join_sample": [
            "patent_id", "title", "year", "filing_date", "inventor_name", "inventor_country",
            "inventor_city", "company_name", "company_country",
        ],
        "cte_above_average_companies": ["name", "country", "patent_count", "avg_patents", "multiple_of_avg"],
        "inventor_rankings": [
            "name", "country", "city", "patent_count", "overall_rank", "rank_in_country", "pct_of_total",
        ],
    }


def test_the_star_answers_plain_sql(spark, small):
    small.create_views()
    rows = tuples(
        spark.sql("""
        SELECT c.name, COUNT(DISTINCT r.patent_id) AS n FROM companies c
        JOIN relations r ON c.company_id = r.company_id GROUP BY c.company_id, c.name ORDER BY n DESC, c.name LIMIT 1""")
    )
    assert rows == [("X Inc", 2)]


def test_no_cap_lists_everything(star):
    links = [(f"p{i}", f"n{i % 40}", f"c{i % 40}") for i in range(90)]
    s = star(
        patents=[(f"p{i}", f"T{i}", "", "2020-01-01", "2020") for i in range(90)],
        inventors=[(f"n{j}", f"N{j}", f"L{j}", None, None) for j in range(40)],
        companies=[(f"c{j}", f"C{j}", None, f"L{j % 2}", None, None) for j in range(40)],
        relations=links,
    )
    assert a.top_inventors(s, None).count() == a.top_companies(s, None).count() == 40
    assert a.country_share(s, "inventor", None).count() == 40
    assert a.above_average_companies(s, None).count() == 10
    assert a.suspicious_geocodes(s, "L0", None).count() == sum(i % 40 % 2 == 0 for i in range(90))
    head = tuples(a.suspicious_geocodes(s, "L0", 7))
    assert len(head) == 7 and set(head) <= set(tuples(a.suspicious_geocodes(s, "L0", None)))


def test_counted_stars_give_the_same_answers(spark, star, tmp_path):
    rng = random.Random(5)
    links = sorted({(f"p{rng.randrange(60)}", f"i{rng.randrange(9)}", rng.choice(["x", "y", None])) for _ in range(300)}, key=str)
    s = star(
        patents=[(f"p{i}", f"T{i}", "", "2020-01-01", "2020") for i in range(60)],
        inventors=[(f"i{j}", f"N{j}", rng.choice(["US", "JP", None]), None, None) for j in range(9)],
        companies=[("x", "X", None, "US", None, None), ("y", "Y", None, "DE", None, None)],
        relations=links,
    )
    counted = CountedStar(s, table_stage(spark, str(tmp_path)))
    for ask in (
        a.top_inventors,
        a.top_companies,
        a.inventor_rankings,
        a.above_average_companies,
        lambda t: a.country_share(t, "inventor"),
        lambda t: a.country_share(t, "company"),
        a.patent_detail_join,
    ):
        assert tuples(ask(counted)) == tuples(ask(s))
