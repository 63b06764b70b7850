from conftest import tuples
from grantstar.plans.clean import clean, filter_funnel
from grantstar.plans.profile import most_common_countries, patent_type_counts, profile_entities, withdrawn_counts
from grantstar.session import table_stage


def patent(id, title="T", date="2020-01-01", kind="utility", withdrawn="0"):
    return (id, title, date, kind, withdrawn)


def test_class_type_and_status_select_patents(feeds):
    f = feeds(
        patent=[
            patent("1"),
            patent("2"),
            patent("3", kind="design"),
            patent("4", withdrawn="1"),
            patent("5", withdrawn=" 0 "),
            patent("6", title=None),
            patent("7", title="   "),
            patent("8", withdrawn=None),
            patent("9"),
            patent("D345393", title=" x ", date="2020-02-30"),
        ],
        cpc=[(i, "Y02T10/70") for i in ("1", "1", "3", "4", "5", "6", "7", "8", "D345393")]
        + [("2", "Y02E10/00"), ("9", None)],
    )
    rows = {r.patent_id: r for r in clean(f).patents.collect()}
    assert sorted(rows) == ["1", "5", "7", "D345393"]
    assert rows["7"].title == "" and rows["D345393"].title == "x"
    assert rows["1"].year == 2020
    assert rows["D345393"].filing_date is None and rows["D345393"].year is None
    assert tuples(filter_funnel(f)) == [
        (0, "loaded", 10, 0),
        (1, "class", 8, 2),
        (2, "utility", 7, 1),
        (3, "not_withdrawn", 5, 2),
        (4, "titled", 4, 1),
    ]
    assert dict(tuples(patent_type_counts(f))) == {"utility": 9, "design": 1}
    assert dict(tuples(withdrawn_counts(f))) == {"0": 5, "1": 1}


def test_abstracts_are_attached_stripped_and_filled(feeds):
    f = feeds(
        patent=[patent("1"), patent("2"), patent("3")],
        cpc=[(i, "Y02T") for i in "123"],
        abstract=[("1", "\n text\t"), ("2", None), ("9", "other")],
    )
    assert dict(tuples(clean(f).patents.select("patent_id", "abstract"))) == {"1": "text", "2": "", "3": ""}


def test_repeated_abstracts_repeat_the_patent(feeds):
    """The checks merge them later."""
    f = feeds(patent=[patent("1")], cpc=[("1", "Y02T")], abstract=[("1", "a"), ("1", "b")])
    assert clean(f).patents.count() == 2


def test_one_row_per_inventor_from_the_lowest_patent(feeds):
    f = feeds(
        patent=[patent("1"), patent("2")],
        cpc=[("1", "Y02T"), ("2", "Y02T")],
        inventor=[
            ("2", "a", "Ann", "Old", "l2"),
            ("1", "a", "Ann", "Lee", "l1"),
            ("1", "b", None, "Null", None),
            ("1", "c", None, None, "l9"),
            ("7", "d", "Not", "Linked", "l1"),
        ],
        location=[("l1", "NA", "Windhoek", None), ("l2", "US", "Troy", "MI"), (None, "XX", "x", "x")],
    )
    assert sorted(tuples(clean(f).inventors), key=str) == [
        ("a", "Ann Lee", "NA", "Windhoek", None),
        ("b", "Null", None, None, None),
        ("c", "", None, None, None),
    ]


def test_companies_need_a_name(feeds):
    f = feeds(
        patent=[patent("1"), patent("2")],
        cpc=[("1", "Y02T"), ("2", "Y02T")],
        assignee=[
            ("1", "x", None, None, None, "2", None),
            ("2", "x", "Later Named", None, None, "2.0", "l1"),
            ("1", "y", " Org ", "Ann", "Lee", "3", "l1"),
            ("1", "z", None, None, None, None, "l1"),
            ("1", "p", "", "Ann", "Lee", None, "l1"),
        ],
        location=[("l1", "JP", "Toyota", "Aichi")],
    )
    companies = {r.company_id: r for r in clean(f).companies.collect()}
    assert {k: r.name for k, r in companies.items()} == {"x": "Later Named", "y": "Org", "p": "Ann Lee"}
    assert companies["y"].assignee_type == 3 and companies["p"].assignee_type is None
    assert companies["x"].assignee_type == 2


def test_bridge_fans_out_and_keeps_unowned_patents(feeds):
    f = feeds(
        patent=[patent("1"), patent("2"), patent("3")],
        cpc=[(i, "Y02T") for i in "123"],
        inventor=[("1", i, "A", "B", None) for i in "ab"] + [("2", i, "A", "B", None) for i in "ab"] * 2,
        assignee=[("1", c, "O", None, None, None, None) for c in "xy"]
        + [("3", "x", "O", None, None, None, None)],
    )
    assert sorted(tuples(clean(f).relations), key=str) == [
        ("1", "a", "x"),
        ("1", "a", "y"),
        ("1", "b", "x"),
        ("1", "b", "y"),
        ("2", "a", None),
        ("2", "b", None),
    ]


def test_a_link_without_company_id_stays_unassigned(feeds):
    f = feeds(
        patent=[patent("1")],
        cpc=[("1", "Y02T")],
        inventor=[("1", "a", "A", "B", None)],
        assignee=[("1", None, "O", None, None, None, None), ("1", "x", "O", None, None, None, None)],
    )
    assert sorted(tuples(clean(f).relations), key=str) == [("1", "a", "x"), ("1", "a", None)]


def test_stored_stages_give_the_same_star(spark, feeds, tmp_path):
    f = feeds(
        patent=[patent("1"), patent("2")],
        cpc=[("1", "Y02T"), ("2", "Y02T")],
        abstract=[("1", "text")],
        inventor=[("1", "a", "A", "B", "l"), ("2", "b", "C", "D", None)],
        assignee=[("1", "x", "O", None, None, "2", "l")],
        location=[("l", "US", "Troy", "MI")],
    )
    stored = clean(f, stage=table_stage(spark, str(tmp_path)))
    plain = clean(f)
    for name in plain.NAMES:
        left, right = getattr(plain, name), getattr(stored, name)
        assert left.dtypes == right.dtypes
        assert sorted(tuples(left), key=str) == sorted(tuples(right), key=str)


def test_profiles(star):
    s = star(
        inventors=[("1", "a", "US", None, None), ("2", "b", None, None, None), ("3", "c", "US", None, None)],
        companies=[("1", "a", None, "JP", None, None)],
    )
    assert tuples(profile_entities(s)) == [("inventors", 3, 1, 33.3), ("companies", 1, 0, 0.0)]
    assert tuples(most_common_countries(s.inventors)) == [("US", 2)]
