import datetime

import pytest
from pyspark.sql import functions as F

from grantstar.functions import ratios, text


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "raw, expected",
    [(" x ", "x"), ("\t x\r\n", "x"), (" x　", "x"), ("   ", ""), (None, None), ("a b", "a b")],
)
def test_strip_takes_all_white_space(spark, raw, expected):
    assert value(spark, text.strip(F.lit(raw).cast("string"))) == expected


@pytest.mark.parametrize(
    "organization, first, last, expected",
    [
        ("Org", "Ann", "Lee", "Org"),
        (" Org ", None, None, "Org"),
        (None, "Ann", "Lee", "Ann Lee"),
        ("  ", " Ann ", " Lee ", "Ann Lee"),
        (None, "Ann", None, "Ann"),
        (None, None, "Lee", "Lee"),
        (None, None, None, None),
        ("", " ", "", None),
    ],
)
def test_company_name_prefers_organization_then_person(spark, organization, first, last, expected):
    parts = [F.lit(p).cast("string") for p in (organization, first, last)]
    assert value(spark, text.resolve_name(*parts)) == expected


def test_inventor_name_keeps_the_part_that_exists(spark):
    null = F.lit(None).cast("string")
    assert value(spark, text.full_name(F.lit("Ann"), null)) == "Ann"
    assert value(spark, text.full_name(null, F.lit("Lee"))) == "Lee"
    assert value(spark, text.full_name(null, null)) == ""


@pytest.mark.parametrize(
    "raw, expected",
    [("2020-02-29", datetime.date(2020, 2, 29)), ("2020-02-30", None), ("", None), ("soon", None)],
)
def test_bad_dates_become_null(spark, raw, expected):
    assert value(spark, text.to_date(F.lit(raw))) == expected


def test_bad_numbers_become_null(spark):
    assert value(spark, text.to_int(F.lit("2020"))) == 2020
    assert value(spark, text.to_int(F.lit("2.0"))) == 2
    for bad in ("x", "", "NaN", "1e20"):
        assert value(spark, text.to_int(F.lit(bad))) is None


@pytest.mark.parametrize(
    "title, term, expected",
    [
        ("Hybrid ENGINE", "engine", True),
        ("Hybrid engine", "ENG", True),
        ("50% more", "%", True),
        ("more", "%", False),
        ("a_b", "_", True),
        ("ab", "_", False),
    ],
)
def test_search_is_literal_and_ignores_case(spark, title, term, expected):
    assert value(spark, text.contains_ignoring_case(F.lit(title), term)) is expected


def test_truncate_and_ascii(spark):
    assert value(spark, text.truncate(F.lit("abcdef"), 3)) == "abc"
    assert value(spark, text.drop_non_ascii(F.lit("naïve café"))) == "nave caf"


def test_ratios_round_half_up_and_survive_an_empty_whole(spark):
    assert value(spark, ratios.percent(F.lit(1), F.lit(3), 2)) == 33.33
    assert value(spark, ratios.percent(F.lit(1), F.lit(0), 2)) is None
    assert value(spark, ratios.percent(F.lit(2675), F.lit(100000), 2)) == 2.68
    # Known figures: growth from 2897 to 8639, and a multiple of an unrounded mean.
    assert value(spark, ratios.growth_percent(F.lit(2897), F.lit(8639))) == 198.2
    assert value(spark, ratios.growth_percent(F.lit(None).cast("long"), F.lit(5))) is None
