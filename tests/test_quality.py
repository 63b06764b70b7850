import datetime

import pytest

from conftest import tuples
from grantstar.operators.keyed import duplicate_rows, keep_first, keep_first_wide
from grantstar.operators.linking import only_known, only_unknown
from grantstar.plans.geocodes import known_rules, numbered_rules, read_geocode_rules
from grantstar.plans.quality import quality_check, star_null_summary
from grantstar.session import table_stage

DAY = "2020-01-01"


def found(checked):
    return {r.check_id: (r.found, r.fixed) for r in checked.report.collect()}


def by_id(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


def test_patent_checks_run_in_order(star):
    s = star(
        patents=[
            ("1", "A", "text", DAY, "2020"),
            ("1", "B", "text", "2021-01-01", "2021"),
            ("1", None, None, None, None),
            ("2", "  ", "text", DAY, "2020"),
            ("3", "C", " ", DAY, "2020"),
            ("4", "D", "text", DAY, "1975"),
            ("5", "E", None, DAY, "2026"),
            ("6", "F", "text", None, None),
            ("7", "G", "text", None, "1976"),
            ("8", " H ", "text", DAY, "2025"),
        ]
    )
    checked = quality_check(s)
    day = datetime.date(2020, 1, 1)
    assert by_id(checked.patents) == {
        "1": ("A", "text", day, 2020),
        "3": ("C", "", day, 2020),
        "7": ("G", "text", None, 1976),
        "8": ("H", "text", day, 2025),
    }
    report = found(checked)
    assert report["Q01"] == (2, 2)
    assert report["Q02"] == (1, 1)
    assert report["Q03"] == (2, 0)  # 3 and 5: counted before the year check drops 5
    assert report["Q04"] == (3, 3)
    assert report["Q05"] == (1, 0)


def test_empty_inventor_names_take_their_links_along(star):
    s = star(
        patents=[("p", "T", "", DAY, "2020")],
        inventors=[
            ("a", " Ann ", "US", "x", None),
            ("b", "  ", "US", "x", None),
            ("c", None, None, None, None),
            ("a", "Zoe", "US", "x", None),
        ],
        relations=[("p", "a", None), ("p", "b", None), ("p", "c", None)],
    )
    checked = quality_check(s)
    assert by_id(checked.inventors) == {"a": ("Ann", "US", "x", None)}
    assert tuples(checked.relations) == [("p", "a", None)]
    report = found(checked)
    assert report["Q06"] == (1, 1) and report["Q07"] == (2, 2) and report["Q08"] == (0, 0)
    assert report["Q15"] == (0, 0)  # cascaded links are no orphans


def test_empty_company_names_null_their_links(star):
    s = star(
        patents=[("p", "T", "", DAY, "2020")],
        inventors=[("a", "Ann", "US", None, None)],
        companies=[("x", "X", "2", "US", None, None), ("y", " ", "2", None, None, None)],
        relations=[("p", "a", "x"), ("p", "a", "y")],
    )
    checked = quality_check(s)
    assert list(by_id(checked.companies)) == ["x"]
    assert sorted(tuples(checked.relations), key=str) == [("p", "a", "x"), ("p", "a", None)]
    report = found(checked)
    assert report["Q11"] == (1, 1) and report["Q16"] == (0, 0) and report["Q17"] == (1, 0)


def test_wrong_geocodes_are_corrected_and_their_city_cleared(star):
    rows = [
        ("1", "wrong", "UG", "Amuru", None),
        ("2", "right place", "UG", "Kampala", None),
        ("3", "right country", "JP", "Amuru", None),
        ("4", "other city", "JP", "Somalomo", None),
        ("5", "nowhere", None, "Amuru", None),
    ]
    companies = [(i, n, None, c, t, s) for i, n, c, t, s in rows] + [("6", "cm", None, "CM", "Somalomo", None)]
    checked = quality_check(star(inventors=rows, companies=companies))
    assert by_id(checked.inventors) == {
        "1": ("wrong", "JP", None, None),
        "2": ("right place", "UG", "Kampala", None),
        "3": ("right country", "JP", None, None),
        "4": ("other city", "JP", "Somalomo", None),  # no wrong (CM, Somalomo) in the table
        "5": ("nowhere", None, "Amuru", None),
    }
    places = {k: (v[2], v[3]) for k, v in by_id(checked.companies).items()}
    assert places["1"] == ("JP", None) and places["6"] == ("CM", "Somalomo")
    report = found(checked)
    assert report["Q09a"] == (1, 1) and report["Q09b"] == (0, 0) and report["Q12"] == (1, 1)


def test_right_country_keeps_its_city_without_a_wrong_pair(star):
    checked = quality_check(star(inventors=[("3", "n", "JP", "Amuru", None)]))
    assert by_id(checked.inventors) == {"3": ("n", "JP", "Amuru", None)}


def test_ten_thousand_rules_run_in_a_plan_of_constant_size(spark, star):
    """Rules are rows of a table: more of them make no longer plan, and every one is listed with its hits."""
    people = [(f"i{k}", "n", f"W{k % 50}", f"city {k % 50}", None) for k in range(200)]
    people += [("right", "n", "R7", "city 7", None), ("other", "n", "R7", "city 9", None), ("unhit", "n", "R70", "city 70", None)]
    s = star(inventors=people)

    def rules(n):
        df = spark.range(n).selectExpr(
            "'inventors' table", "concat('W', id) country", "concat('city ', id) city", "concat('R', id) corrected_to"
        )
        return numbered_rules(df)

    def size(checked):
        return len(checked.inventors._jdf.queryExecution().optimizedPlan().toString())

    many, few = quality_check(s, rules=rules(10_000)), quality_check(s, rules=rules(10))
    assert abs(size(many) - size(few)) < 50
    repaired = by_id(many.inventors)
    assert repaired["i3"] == ("n", "R3", None, None) and repaired["right"] == ("n", "R7", None, None)
    assert repaired["other"] == ("n", "R7", "city 9", None) and repaired["unhit"] == ("n", "R70", "city 70", None)
    hits = [r for r in many.report.where("check like 'wrong geocode%' and table = 'inventors'").collect()]
    assert len(hits) == 10_000 and len({r.check_id for r in hits}) == 10_000
    assert {r.found for r in hits if r.check.split("/")[0] in ("wrong geocode W3", "wrong geocode W49")} == {4}
    assert sum(r.found for r in hits) == sum(r.fixed for r in hits) == 200


def test_rules_of_a_file(spark, star, tmp_path):
    (tmp_path / "rules.csv").write_text(
        'table,country,city,corrected_to,note\ninventors,XX,"A, b",YY,x\ncompanies,XX,"A, b",ZZ,\n'
        'inventors,XX,"A, b",QQ,later\ninventors,XX,,YY,no city\n',
        encoding="utf-8",
    )
    rules = read_geocode_rules(spark, str(tmp_path / "rules.csv"))
    assert sorted(tuples(rules)) == [("companies", "XX", "A, b", "ZZ", 1), ("inventors", "XX", "A, b", "QQ", 1)]
    s = star(inventors=[("1", "n", "XX", "A, b", None)], companies=[("c", "C", None, "XX", "A, b", None)])
    checked = quality_check(s, rules=rules)
    assert by_id(checked.inventors)["1"][1:3] == ("QQ", None) and by_id(checked.companies)["c"][2:4] == ("ZZ", None)
    report = found(checked)
    assert report["Q09"] == (1, 1) and report["Q12"] == (1, 1) and "Q09a" not in report
    assert by_id(quality_check(s, rules=known_rules(spark, {})).inventors)["1"][1:3] == ("XX", "A, b")
    (tmp_path / "bad.csv").write_text("table,country,city\n", encoding="utf-8")
    with pytest.raises(Exception, match="corrected_to"):
        read_geocode_rules(spark, str(tmp_path / "bad.csv"))


def test_orphans_are_dropped_or_nulled(star):
    s = star(
        patents=[("p", "T", "", DAY, "2020"), ("q", "T", "", DAY, "1900")],
        inventors=[("a", "Ann", "US", None, None)],
        companies=[("x", "X", "2", "US", None, None)],
        relations=[
            ("p", "a", "x"),
            ("p", "a", "?"),
            ("p", "a", None),
            ("p", "?", "x"),
            ("?", "a", "x"),
            ("?", "?", "?"),
            ("q", "a", "x"),
            (None, "a", "x"),
            ("p", None, "x"),
        ],
    )
    checked = quality_check(s)
    rows = sorted(tuples(checked.relations), key=str)
    assert rows == [("p", "a", "x"), ("p", "a", None), ("p", "a", None)]
    report = found(checked)
    assert report["Q14"] == (4, 4) and report["Q15"] == (2, 2)
    assert report["Q16"] == (1, 1) and report["Q17"] == (2, 0)


def test_null_summary_lists_columns_with_nulls(star):
    s = star(
        inventors=[("a", "A", "US", None, None), ("b", "B", None, "x", None)],
        patents=[("p", "T", "", DAY, "2020")],
    )
    rows = {(r.table, r.column): (r.nulls, r.pct, r.expected) for r in star_null_summary(s).collect()}
    assert rows == {
        ("inventors", "country"): (1, 50.0, True),
        ("inventors", "city"): (1, 50.0, True),
        ("inventors", "state"): (2, 100.0, False),
    }


def test_checking_twice_finds_nothing_more(star):
    s = star(
        patents=[("p", "T", None, DAY, "2020"), ("p", "U", None, DAY, "2020"), ("q", "", None, None, None)],
        inventors=[("a", "Ann", "UG", "Amuru", None), ("b", "", None, None, None)],
        companies=[("x", "", None, None, None, None)],
        relations=[("p", "a", "x"), ("q", "a", None), ("p", "b", None)],
    )
    once = quality_check(s)
    twice = quality_check(once)
    for name in once.NAMES:
        assert sorted(tuples(getattr(once, name)), key=str) == sorted(
            tuples(getattr(twice, name)), key=str
        )
    assert all(fixed == 0 for _, fixed in found(twice).values())


def test_stored_stages_give_the_same_result(spark, star, tmp_path):
    s = star(
        patents=[("p", "T", None, DAY, "2020"), ("p", "U", None, DAY, "2020")],
        inventors=[("a", "Ann", "UG", "Amuru", None)],
        companies=[("x", "X", "2", "UG", "Amuru", None)],
        relations=[("p", "a", "x")],
    )
    plain, stored = quality_check(s), quality_check(s, table_stage(spark, str(tmp_path)))
    assert found(plain) == found(stored)
    for name in plain.NAMES:
        assert tuples(getattr(plain, name)) == tuples(getattr(stored, name))


def test_keep_first_orders_nulls_last_and_treats_null_as_a_key(spark):
    df = spark.createDataFrame(
        [("k", None, "n"), ("k", "b", "2"), ("k", "a", None), ("k", "a", "1"), (None, "z", "9"), (None, "y", "8")],
        "key string, a string, b string",
    )
    rows = {r.key: (r.a, r.b, r.copies) for r in keep_first(df, "key", ["a", "b"], copies="copies").collect()}
    assert rows == {"k": ("a", "1", 4), None: ("y", "8", 2)}
    carried = {r.key: (r.a, r.b) for r in keep_first(df, "key", ["a"], carry=["b"]).collect()}
    assert carried == {"k": ("a", "1"), None: ("y", "8")}
    assert duplicate_rows(df, "key").first()[0] == 4


def test_membership_joins_and_null_keys(spark):
    df = spark.createDataFrame([("1", "a"), ("2", "b"), (None, "c")], "id string, v string")
    known = spark.createDataFrame([("1",), ("3",)], "id string")
    assert tuples(only_known(df, known, "id")) == [("1", "a")]
    assert sorted(tuples(only_unknown(df, known, "id")), key=str) == [("2", "b"), (None, "c")]


def test_another_year_window_keeps_other_patents(star):
    rows = [("a", "A", "", "2026-01-01", "2026"), ("b", "B", "", "1990-01-01", "1990")]
    assert [r.patent_id for r in quality_check(star(patents=rows)).patents.collect()] == ["b"]
    wider = quality_check(star(patents=rows), years=(2000, 2026))
    assert [r.patent_id for r in wider.patents.collect()] == ["a"]
    invalid = {r.check_id: r.found for r in wider.report.collect()}["Q04"]
    assert invalid == 1


def test_unique_tables_are_not_grouped_again(star):
    dirty = star(inventors=[("a", " ", "UG", "Amuru", None), ("b", "B", "UG", "Amuru", None)])
    one, two = quality_check(dirty), quality_check(dirty, unique=("inventors", "companies"))
    assert sorted(tuples(one.inventors), key=str) == sorted(tuples(two.inventors), key=str)
    assert sorted(tuples(one.report), key=str) == sorted(tuples(two.report), key=str)
    assert "Aggregate" not in two.assessed_inventors._jdf.queryExecution().executedPlan().toString()


def test_wide_tables_keep_the_same_first_rows(spark):
    rows = [("a", 2, "x"), ("a", 1, "z"), ("a", 1, "y"), ("b", None, None), (None, 5, "n"), (None, 4, "m"), ("c", 3, "long")]
    df = spark.createDataFrame(rows, "key string, n int, text string")
    wide = keep_first_wide(df, "key", ["n"], ["text"], "copies")
    plain = keep_first(df, "key", ["n"], ["text"], "copies")
    assert sorted(tuples(wide), key=str) == sorted(tuples(plain), key=str)
    assert wide.columns == plain.columns
