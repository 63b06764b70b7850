import pytest

from conftest import tuples
from grantstar.plans import notes as n


def test_portfolio_counts_patents_once_per_company(star):
    s = star(
        patents=[("1", "t", "", None, "1999"), ("2", "t", "", None, "2010")],
        companies=[("x", "X", None, "US", None, None), ("y", "Y", None, "JP", None, None)],
        relations=[("1", "a", "x"), ("1", "b", "x"), ("2", "a", "x"), ("2", "a", None)],
    )
    assert tuples(n.company_portfolio(s)) == [("x", "X", 2, 1999, 2010)]
    assert tuples(n.company_market_share(s)) == [("x", "X", 2, 100.0)]
    assert tuples(n.with_listed_country(s.companies, ["JP", "DE"]).select("company_id")) == [("y",)]


def test_titles_lose_what_is_not_ascii(star):
    s = star(patents=[("1", "Überhöhung 5°", None, None, "1999")])
    assert n.with_ascii_titles(s.patents).first().title == "berhhung 5"


def test_mobility_needs_two_countries(feeds):
    f = feeds(
        inventor=[
            ("1", "a", "", "", "l1"),
            ("2", "a", "", "", "l2"),
            ("1", "b", "", "", "l1"),
            ("2", "b", "", "", "l3"),
            ("3", "c", "", "", None),
        ],
        location=[("l1", "US", "x", None), ("l2", "JP", "y", None), ("l3", "US", "z", None)],
    )
    assert tuples(n.inventor_mobility(f)) == [("a", 2)]


def test_entities_are_held_against_a_code_table(spark, star, tmp_path):
    (tmp_path / "codes.tsv").write_text("name\tcode\nUnited States\t US \nJapan\tJP\nagain\tJP\nnone\t\n", encoding="utf-8")
    codes = n.read_country_codes(spark, str(tmp_path / "codes.tsv"))
    assert sorted(tuples(codes)) == [("JP", "Japan"), ("US", "United States")]
    s = star(
        inventors=[("a", "A", "US", None, None), ("b", "B", "XX", None, None), ("c", "C", None, None, None)],
        companies=[("x", "X", None, "JP", None, None), ("y", "Y", None, "XX", None, None), ("z", "Z", None, "XX", None, None)],
    )
    assert [r.inventor_id for r in n.with_known_country(s.inventors, codes).collect()] == ["a"]
    assert [r.company_id for r in n.with_known_country(s.companies, codes).collect()] == ["x"]
    unknown = sorted(tuples(n.unknown_countries(s, codes)), key=str)
    assert unknown == [("companies", "XX", 2), ("inventors", "XX", 1), ("inventors", None, 1)]
    (tmp_path / "bad.tsv").write_text("name\tiso\n", encoding="utf-8")
    with pytest.raises(ValueError, match="code"):
        n.read_country_codes(spark, str(tmp_path / "bad.tsv"))
