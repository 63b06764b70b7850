"""Analyses that the documentation of the data set describes, beside those it has code for."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grantstar.functions.ratios import percent
from grantstar.functions.text import blank_to_null, drop_non_ascii
from grantstar.operators.counting import total
from grantstar.operators.keyed import keep_first
from grantstar.operators.linking import only_known
from grantstar.plans.counts import per_entity
from grantstar.schemas import Feeds, Star
from grantstar.sources.feeds import headers, list_files


def company_portfolio(star: Star) -> DataFrame:
    """(company_id, name, patents, first_patent, latest_patent) of every company with patents.

    The bridge repeats an owner once per inventor, so it is cut to distinct pairs before the years
    are looked up.
    """
    owned = star.relations.where(F.col("company_id").isNotNull())
    pairs = owned.select("company_id", "patent_id").distinct()
    dated = pairs.join(star.patents.select("patent_id", "year"), "patent_id")
    spans = dated.groupBy("company_id").agg(
        F.count(F.lit(1)).alias("patents"),
        F.min("year").alias("first_patent"),
        F.max("year").alias("latest_patent"),
    )
    named = star.companies.select("company_id", "name").join(spans, "company_id")
    return named.select("company_id", "name", "patents", "first_patent", "latest_patent")


def company_market_share(star: Star) -> DataFrame:
    """(company_id, name, patent_count, pct_share): each company's part of all company counts."""
    counts = star.companies.join(per_entity(star, "company"), "company_id")
    share = percent(F.col("patent_count"), total(counts, "patent_count"), 2)
    return counts.select("company_id", "name", "patent_count", share.alias("pct_share"))


def with_listed_country(entities: DataFrame, codes: Sequence[str]) -> DataFrame:
    """The entities whose country is one of the given codes; others, and nulls, go."""
    return entities.where(F.col("country").isin(list(codes)))


#: The columns a table of country codes must have.
CODE_COLUMNS = ("code", "name")


def read_country_codes(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """(code, name) of a delimited code table with a header, trimmed, one row per code; rows without a code go. A file that
    lacks one of CODE_COLUMNS is an error."""
    files = list_files(spark, path)
    for file, header in headers(spark, files, sep).items():
        if missing := [c for c in CODE_COLUMNS if c not in header]:
            raise ValueError(f"{file} has no column {', '.join(missing)}")
    table = spark.read.option("sep", sep).option("header", True).option("escape", '"').csv(files)
    return country_codes(table)


def country_codes(table: DataFrame) -> DataFrame:
    """(code, name) of any table with CODE_COLUMNS, one row per code."""
    tidy = table.select(*(blank_to_null(F.col(c)).alias(c) for c in CODE_COLUMNS)).where("code is not null")
    return keep_first(tidy, "code", ["name"])


def with_known_country(entities: DataFrame, codes: DataFrame) -> DataFrame:
    """The entities whose country is in the code table; others, and those without a country, go."""
    known = codes.select(F.col("code").alias("country"))
    return only_known(entities, known, "country")


def unknown_countries(star: Star, codes: DataFrame) -> DataFrame:
    """(table, country, rows) of the countries that the code table does not list; a missing country is one of them.

    Entities are counted by country before the codes are looked up.
    """
    found = []
    for name in ("inventors", "companies"):
        counts = getattr(star, name).groupBy("country").agg(F.count(F.lit(1)).alias("rows"))
        unknown = counts.join(codes, F.col("country") == F.col("code"), "left_anti")
        found.append(unknown.select(F.lit(name).alias("table"), "country", "rows"))
    return found[0].unionByName(found[1])


def with_ascii_titles(patents: DataFrame) -> DataFrame:
    return patents.withColumn("title", drop_non_ascii(F.col("title")))


def inventor_mobility(feeds: Feeds) -> DataFrame:
    """(inventor_id, countries): inventors whose links name more than one country.

    Taken from the raw links, since the star keeps one place per inventor. The links are cut to
    distinct places per inventor before the lookup.
    """
    places = feeds.location.select("location_id", F.col("disambig_country").alias("country"))
    visited = feeds.inventor.select("inventor_id", "location_id").distinct()
    seen = visited.join(places, "location_id").groupBy("inventor_id")
    counts = seen.agg(F.countDistinct("country").alias("countries"))
    return counts.where(F.col("countries") > 1)
