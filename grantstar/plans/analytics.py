"""Questions over the star. Every function returns a lazy DataFrame.

Ids are the last sort key before every cut, so equal counts give the same rows on every run.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grantstar.functions.ratios import growth_percent, percent, ratio
from grantstar.functions.text import contains_ignoring_case, has_text, truncate
from grantstar.operators.counting import row_count, total, value_counts
from grantstar.operators.linking import only_known
from grantstar.operators.prefixes import patents_per_prefix
from grantstar.operators.ranking import rank_all, rank_head, short_list, top_k, with_position
from grantstar.plans.counts import newest_linked, per_country, per_entity
from grantstar.plans.quality import FIRST_YEAR, LAST_YEAR
from grantstar.schemas import Star

# The years the trend report prints.
MILESTONE_YEARS = (
    1976, 1980, 1985, 1990, 1995, 2000, 2005, 2010, 2012,
    2015, 2017, 2019, 2020, 2021, 2022, 2023, 2024, 2025,
)

# The subclasses of green transport and what they cover.
SUBCATEGORIES = {
    "Y02T10": "road_vehicles",
    "Y02T30": "aviation_efficiency",
    "Y02T50": "aviation_propulsion",
    "Y02T70": "maritime",
    "Y02T90": "charging_infrastructure",
}


# --- inventors and companies -------------------------------------------------------------------


def inventor_counts(star: Star, countries: Sequence[str] | None = None) -> DataFrame:
    """The named inventors that have patents, with ``patent_count``."""
    inventors = star.inventors.where(has_text(F.col("name")))
    if countries:
        inventors = inventors.where(F.col("country").isin(list(countries)))
    return inventors.join(per_entity(star, "inventor"), "inventor_id")


def company_counts(star: Star) -> DataFrame:
    """The named companies that have patents, with ``patent_count``."""
    companies = star.companies.where(has_text(F.col("name")))
    return companies.join(per_entity(star, "company"), "company_id")


def top_inventors(
    star: Star, k: int | None = 20, countries: Sequence[str] | None = None
) -> DataFrame:
    """(name, country, city, patent_count) of the k most prolific inventors; ``k=None`` lists all."""
    counts = inventor_counts(star, countries)
    return top_k(counts, k, "inventor_id").select("name", "country", "city", "patent_count")


def top_companies(star: Star, k: int | None = 20) -> DataFrame:
    """(name, country, patent_count) of the k companies with most patents; ``k=None`` lists all."""
    return top_k(company_counts(star), k, "company_id").select("name", "country", "patent_count")


def inventor_rankings(star: Star, k: int | None = 50) -> DataFrame:
    """Inventors with overall rank, dense rank in their country and share of all counts.

    Ranks and shares refer to all inventors, also when only the first k are returned. ``k=None``
    ranks every inventor.
    """
    counts = inventor_counts(star)
    ranked = rank_all(counts) if k is None else rank_head(top_k(counts, k, "inventor_id"))
    share = percent(F.col("patent_count"), total(counts, "patent_count"), 4)
    return ranked.select(
        "name",
        "country",
        "city",
        "patent_count",
        "overall_rank",
        "rank_in_country",
        share.alias("pct_of_total"),
    )


def above_average_companies(
    star: Star, k: int | None = 30, digits: int = 2, named_only: bool = True
) -> DataFrame:
    """Companies with more patents than the mean over all companies that have any.

    The multiple is taken from the unrounded mean. ``avg_patents`` is rounded to two digits.
    """
    companies = star.companies
    if named_only:
        companies = companies.where(F.col("name").isNotNull())
    counts = companies.join(per_entity(star, "company"), "company_id")
    mean = counts.agg(F.avg("patent_count")).scalar()
    above = counts.where(F.col("patent_count") > mean)
    return top_k(above, k, "company_id").select(
        "name",
        "country",
        "patent_count",
        F.round(mean, 2).alias("avg_patents"),
        ratio(F.col("patent_count"), mean, digits).alias("multiple_of_avg"),
    )


def top_inventor_countries(star: Star, k: int = 20) -> DataFrame:
    """(country, inventors): where the k most prolific inventors live."""
    return value_counts(top_inventors(star, k), "country", "inventors").orderBy(
        F.desc("inventors"), "country"
    )


def top_company_countries(star: Star, k: int = 20) -> DataFrame:
    """(country, patents): the counts of the k largest companies summed by country."""
    top = top_companies(star, k).where(F.col("country").isNotNull())
    summed = top.groupBy("country").agg(F.sum("patent_count").alias("patents"))
    return summed.orderBy(F.desc("patents"), "country")


# --- countries ---------------------------------------------------------------------------------

def country_share(star: Star, side: str, k: int | None = 30) -> DataFrame:
    """(country, patent_count, pct_share) by where inventors live or companies sit.

    A patent counts once in each of its countries, so the whole is the sum over all countries,
    taken before the cut to k.
    """
    counts = per_country(star, side)
    share = percent(F.col("patent_count"), total(counts, "patent_count"), 2)
    return top_k(counts, k, "country").select("country", "patent_count", share.alias("pct_share"))


def country_comparison(star: Star, k: int = 15) -> DataFrame:
    """Countries that are in the top k of both sides, and how far the two counts are apart."""
    research = country_share(star, "inventor", k).select(
        "country",
        F.col("patent_count").alias("patents_inventor"),
        F.col("pct_share").alias("pct_inventor"),
    )
    ownership = country_share(star, "company", k).select(
        "country",
        F.col("patent_count").alias("patents_company"),
        F.col("pct_share").alias("pct_company"),
    )
    difference = F.col("patents_inventor") - F.col("patents_company")
    both = research.join(ownership, "country").withColumn("difference", difference)
    return both.orderBy(F.desc("patents_inventor"), "country")


def country_options(star: Star) -> DataFrame:
    """The countries of inventors that have patents."""
    located = star.inventors.where(F.col("country").isNotNull())
    linked = only_known(located, star.relations.select("inventor_id").distinct(), "inventor_id")
    return linked.select("country").distinct().orderBy("country")


def companies_in_country(star: Star, country: str) -> DataFrame:
    """The companies of one country, to look at a suspicious geocode."""
    here = star.companies.where(F.col("country") == country)
    return here.select("company_id", "name", "country", "city", "state")


def suspicious_geocodes(star: Star, country: str, k: int | None = 10) -> DataFrame:
    """Patents and inventors behind the companies of one country, the first k links or all of them.

    The k links are found on ids alone; titles and names are looked up for those k only.
    """
    here = star.companies.where(F.col("country") == country)
    links = star.relations.where(F.col("company_id").isNotNull())
    for entities, key in (
        (here, "company_id"),
        (star.patents, "patent_id"),
        (star.inventors, "inventor_id"),
    ):
        links = only_known(links, entities, key)
    order = ["company_id", "patent_id", "inventor_id"]
    first = links if k is None else short_list(links.orderBy(*order).limit(k), k)
    owners = here.select("company_id", F.col("name").alias("company"), "country", "city")
    people = star.inventors.select(
        "inventor_id", F.col("name").alias("inventor"), F.col("country").alias("inv_country")
    )
    rows = star.patents.select("patent_id", "title", "year").join(first, "patent_id")
    rows = rows.join(owners, "company_id").join(people, "inventor_id").orderBy(*order)
    rows = rows if k is None else rows.limit(k)
    return rows.select("company", "country", "city", "title", "year", "inventor", "inv_country")


# --- years -------------------------------------------------------------------------------------


def _patents_per_year(star: Star, lo: int, hi: int) -> DataFrame:
    """At most hi - lo + 1 rows, so windows over the result need no partitioning."""
    ranged = star.patents.where(F.col("year").between(lo, hi))
    return ranged.groupBy("year").agg(F.count(F.lit(1)).alias("patent_count"))


def yearly_trends(
    star: Star,
    lo: int = FIRST_YEAR,
    hi: int = LAST_YEAR,
    show: tuple[int, int] | None = None,
) -> DataFrame:
    """(year, patent_count, cumulative_total). ``show`` cuts the years after summing up."""
    running = Window.partitionBy(F.lit(0)).orderBy("year")
    trend = _patents_per_year(star, lo, hi).withColumn(
        "cumulative_total", F.sum("patent_count").over(running)
    )
    if show:
        trend = trend.where(F.col("year").between(*show))
    return trend.orderBy("year")


def milestone_trends(
    star: Star,
    years: Sequence[int] = MILESTONE_YEARS,
    lo: int = FIRST_YEAR,
    hi: int = LAST_YEAR,
) -> DataFrame:
    """The trend rows of selected years; totals include the years between, from ``lo`` on."""
    return yearly_trends(star, lo, hi).where(F.col("year").isin(list(years))).orderBy("year")


def _peak(in_range=None):
    """The year with most patents, the earliest of equals, over per-year rows."""
    weight = F.struct("patent_count", -F.col("year"))
    if in_range is not None:
        weight = F.when(in_range, weight)
    return F.max_by("year", weight)


def peak_year(star: Star, lo: int = FIRST_YEAR, hi: int = LAST_YEAR) -> DataFrame:
    """One row: (peak_year, peak_patents)."""
    return _patents_per_year(star, lo, hi).agg(
        _peak().alias("peak_year"), F.max("patent_count").alias("peak_patents")
    )


def _count_in(year: int):
    return F.sum(F.when(F.col("year") == year, F.col("patent_count")))


def period_growth(star: Star, first: int = 2010, last: int = 2020) -> DataFrame:
    """One row: the counts of two years and the growth in percent, null if a year has none."""
    years = star.patents.where(F.col("year").isin(first, last))
    per_year = years.groupBy("year").agg(F.count(F.lit(1)).alias("patent_count"))
    counts = per_year.agg(_count_in(first).alias("first_count"), _count_in(last).alias("last_count"))
    growth = growth_percent(F.col("first_count"), F.col("last_count"))
    return counts.select("first_count", "last_count", growth.alias("growth_pct"))


def cutoff_totals(
    star: Star, cutoffs: Sequence[int] = (2000, 2010, 2020), lo: int = 1990, hi: int = LAST_YEAR
) -> DataFrame:
    """One row: patents from ``lo`` up to each cut-off, and the peak year up to ``hi``."""
    shown = F.col("year").between(lo, hi)
    sums = [
        F.coalesce(
            F.sum(F.when(shown & (F.col("year") <= c), F.col("patent_count"))), F.lit(0)
        ).alias(f"patents_by_{c}")
        for c in cutoffs
    ]
    return _patents_per_year(star, min(lo, FIRST_YEAR), hi).agg(
        *sums, _peak().alias("peak_year"), F.max("patent_count").alias("peak_patents")
    )


# --- whole data set ----------------------------------------------------------------------------


def unassigned_patents(star: Star) -> DataFrame:
    """One row: patents with at least one link that has no company."""
    unowned = star.relations.where(F.col("company_id").isNull())
    return unowned.agg(F.countDistinct("patent_id").alias("unassigned_patents"))


def dataset_kpis(
    star: Star,
    growth: tuple[int, int] = (2010, 2020),
    years: tuple[int, int] = (FIRST_YEAR, LAST_YEAR),
) -> DataFrame:
    """One row of totals. Everything about patents comes from one pass over their years; the peak is
    sought within ``years``."""
    per_year = star.patents.groupBy("year").agg(F.count(F.lit(1)).alias("patent_count"))
    in_range = F.col("year").between(*years)
    first, last = growth
    row = per_year.agg(
        F.coalesce(F.sum("patent_count"), F.lit(0)).alias("total_patents"),
        F.min("year").alias("first_year"),
        F.max("year").alias("last_year"),
        _peak(in_range).alias("peak_year"),
        F.max(F.when(in_range, F.col("patent_count"))).alias("peak_patents"),
        growth_percent(_count_in(first), _count_in(last)).alias("growth_pct"),
    )
    return row.select(
        "total_patents",
        "first_year",
        "last_year",
        row_count(star.inventors).alias("total_inventors"),
        row_count(star.companies).alias("total_companies"),
        unassigned_patents(star).scalar().alias("unassigned_patents"),
        "peak_year",
        "peak_patents",
        "growth_pct",
    )


def subcategory_breakdown(cpc: DataFrame, prefixes: Sequence[str] = tuple(SUBCATEGORIES)) -> DataFrame:
    """(prefix, patent_count) over the raw codes; a patent may count under several prefixes."""
    return patents_per_prefix(cpc, prefixes).orderBy(F.desc("patent_count"), "prefix")


# --- patents in detail -------------------------------------------------------------------------


def patent_detail_join(star: Star, k: int | None = 20) -> DataFrame:
    """Patents with their inventors and companies, newest first; ``k=None`` gives every row.

    In a checked star every link has its inventor, so each linked patent yields a row and the first k
    linked patents hold the first k links. Only ids and years are sorted; the wide columns are looked
    up for at most k links.
    """
    patents = star.patents.where(F.col("year").isNotNull())
    links = star.relations
    inventors = star.inventors.select(
        "inventor_id",
        F.col("name").alias("inventor_name"),
        F.col("country").alias("inventor_country"),
        F.col("city").alias("inventor_city"),
    )
    companies = star.companies.select(
        "company_id",
        F.col("name").alias("company_name"),
        F.col("country").alias("company_country"),
    )
    order = [F.desc("year"), "patent_id", "inventor_id", F.asc_nulls_last("company_id")]
    if k is not None:
        heads = newest_linked(star, k)
        links = links.join(short_list(heads, k), "patent_id").orderBy(*order).limit(k).drop("year")
        links = short_list(links, k)
        # An outer join cannot broadcast the side it keeps: the few owners are looked up first.
        companies = short_list(companies.join(links.select("company_id"), "company_id", "left_semi"), k)
    rows = patents.select("patent_id", "title", "year", "filing_date").join(links, "patent_id")
    if k is not None:
        rows = short_list(rows, k)
    rows = rows.join(inventors, "inventor_id").join(companies, "company_id", "left")
    if k is not None:
        rows = rows.orderBy(*order)
    return rows.select(
        "patent_id",
        "title",
        "year",
        "filing_date",
        "inventor_name",
        "inventor_country",
        "inventor_city",
        "company_name",
        "company_country",
    )


def spot_check(star: Star, k: int = 3, width: int = 65) -> DataFrame:
    """A few joined rows with short titles, to look at after a load."""
    rows = patent_detail_join(star, k)
    return rows.select(
        "patent_id",
        truncate(F.col("title"), width).alias("title"),
        "year",
        F.col("inventor_name").alias("inventor"),
        F.col("inventor_country").alias("inv_country"),
        F.col("company_name").alias("company"),
        F.col("company_country").alias("comp_country"),
    )


def search_patents(
    star: Star,
    term: str = "",
    year_from: int = 2015,
    year_to: int = LAST_YEAR,
    k: int | None = 200,
) -> DataFrame:
    """Patents whose title holds the term, one row per owner, newest first.

    Where the star has a title index, the term is looked up there, and titles are read of candidates only; otherwise,
    and for terms of one or two characters, all titles of the years are searched. Patent ids are
    unique and each match yields at least one row, so the first k matches hold the first k
    rows: they are found on ids and years, links and titles are looked up for at most k ids.
    """
    in_years = F.col("year").between(year_from, year_to)
    found, indexed = star.patents, star.title_index if term else None
    candidates = indexed.candidates(term, in_years) if indexed else None
    if candidates is not None:
        found = indexed.texts.join(candidates, ["bucket", "patent_id"], "left_semi")
    found = found.where(in_years)
    if term:
        found = found.where(contains_ignoring_case(F.col("title"), term))
    heads = found.select("patent_id", "year")
    links = star.relations.select("patent_id", "company_id")
    if k is not None:
        heads = heads.orderBy(F.desc("year"), "patent_id").limit(k)
        links = links.join(short_list(heads.select("patent_id"), k), "patent_id", "left_semi")
    owners = star.companies.select(
        "company_id", F.col("name").alias("company"), F.col("country").alias("company_country")
    )
    # Distinct before the owner lookup: a patent repeats each owner once per inventor.
    owned = links.distinct().join(owners, "company_id", "left")
    owned = owned.select("patent_id", "company", "company_country").distinct()
    rows = heads.join(owned, "patent_id", "left")
    order = [F.desc("year"), "patent_id", F.asc_nulls_last("company"), F.asc_nulls_last("company_country")]
    if k is not None:
        rows = short_list(rows.orderBy(*order).limit(k), k)
    texts = found.select("patent_id", "title", "filing_date")
    rows = texts.join(rows, "patent_id").select(
        "patent_id", "title", "year", "filing_date", "company", "company_country"
    )
    return rows if k is None else rows.orderBy(*order)


def ranked(df: DataFrame, *order) -> DataFrame:
    """A top-k list with its position in front, as the reports print it."""
    positioned = with_position(df, *order)
    return positioned.select("rank", *df.columns)
