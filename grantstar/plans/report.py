"""The summary table and the nested report, built from the analytics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grantstar.operators.profiling import missing_share, sql_text, to_rows
from grantstar.operators.ranking import top_k
from grantstar.plans.analytics import (
    SUBCATEGORIES,
    company_counts,
    country_share,
    dataset_kpis,
    inventor_counts,
    subcategory_breakdown,
    top_companies,
    top_inventors,
)
from grantstar.plans.geocodes import known_rules
from grantstar.plans.quality import VALID_YEARS, Years
from grantstar.schemas import Star


def _sum_of(report: DataFrame, *check_ids: str) -> Column:
    """Rows fixed by the given checks, as a scalar subquery over the short quality report."""
    wanted = report.where(F.substring("check_id", 1, 3).isin(list(check_ids)))
    return F.coalesce(wanted.agg(F.sum("fixed")).scalar(), F.lit(0))


def summary_metrics(
    star: Star,
    report: DataFrame,
    growth: tuple[int, int] = (2010, 2020),
    years: Years = VALID_YEARS,
) -> DataFrame:
    """(metric, value): sixteen headline values, all as text."""

    def leader(df: DataFrame, column: str, name: str) -> Column:
        return df.select(column).scalar().alias(name)

    inventor, company = top_inventors(star, 1), top_companies(star, 1)
    row = dataset_kpis(star, growth, years).select(
        "*",
        leader(inventor, "name", "top_inventor"),
        leader(inventor, "patent_count", "top_inventor_patents"),
        leader(company, "name", "top_company"),
        leader(company, "patent_count", "top_company_patents"),
        leader(country_share(star, "inventor", 1), "country", "top_inventor_country"),
        leader(country_share(star, "company", 1), "country", "top_company_country"),
        _sum_of(report, "Q09", "Q12").alias("geocodes_fixed"),
    )
    # The labels of the summary.
    metrics = {
        "Total green transport patents": "total_patents",
        "Year range (from)": "first_year",
        "Year range (to)": "last_year",
        "Unique inventors": "total_inventors",
        "Unique companies": "total_companies",
        "Unassigned patents": "unassigned_patents",
        "Peak filing year": "peak_year",
        "Peak year patent count": "peak_patents",
        f"Growth {growth[0]}-{growth[1]} (%)": "growth_pct",
        "Top inventor": "top_inventor",
        "Top inventor patents": "top_inventor_patents",
        "Top company": "top_company",
        "Top company patents": "top_company_patents",
        "Top country (inventor)": "top_inventor_country",
        "Top country (company)": "top_company_country",
        "Geocoding errors fixed": "geocodes_fixed",
    }
    entries = [(sql_text(name), f"cast({column} as string)") for name, column in metrics.items()]
    return to_rows(row, entries, ["metric", "value"])


def _ranked_array(top: DataFrame, key: str, columns: list[str]) -> Column:
    """A top-k list as an array of structs with rank 1..k: the array itself is sorted, by count, then key."""
    order = [(-F.col("patent_count")).alias("_less"), F.col(key).alias("_key")]
    rows = top.agg(F.sort_array(F.collect_list(F.struct(*order, *columns))).alias("rows"))
    numbered = F.transform(
        "rows",
        lambda row, i: F.struct(
            (i + 1).alias("rank"), *(row.getField(c).alias(c) for c in columns)
        ),
    )
    return rows.select(numbered).scalar()


def _geocode_errors(report: DataFrame, rules: DataFrame) -> Column:
    """One entry per rule, with the rows it was corrected on; inventors first, in order of their numbers."""
    hits = report.where(F.substring("check_id", 1, 3).isin("Q09", "Q12")).select(
        F.col("table").alias("of"), "check", "fixed"
    )
    text = F.concat(F.lit("wrong geocode "), "country", F.lit("/"), "city")
    found = rules.join(hits, (F.col("table") == F.col("of")) & (text == F.col("check")), "left")
    entry = F.struct(
        "table",
        F.col("country").alias("wrong_country"),
        F.col("city").alias("wrong_city"),
        "corrected_to",
        "fixed",
    )
    ordered = F.struct((F.col("table") == "companies").alias("turn"), "number", entry.alias("entry"))
    return found.agg(F.array_sort(F.collect_list(ordered))["entry"]).scalar()


# Title and focus of the report, and the note on its subclasses.
REPORT_TITLE = "Green Transport Patent Intelligence Report"
REPORT_FOCUS = "CPC Y02T — Climate Change Mitigation in Transportation"
SUBCATEGORY_NOTE = "patents may appear in multiple subcategories"
_SHARES = ["country", "patent_count", "pct_share"]


def report_json(
    star: Star,
    cpc: DataFrame,
    report: DataFrame,
    subcategories: dict[str, str] | None = None,
    growth: tuple[int, int] = (2010, 2020),
    title: str = REPORT_TITLE,
    focus: str = REPORT_FOCUS,
    generated: str | None = None,
    k: int = 10,
    years: Years = VALID_YEARS,
    rules: DataFrame | None = None,
) -> DataFrame:
    """One nested row: totals, subclasses, top lists and data quality.

    ``report`` is the quality report; it and the star should be stored tables, since every section
    reads them. ``rules`` are the wrong places that the check looked for, if not the known ones.
    """
    names = SUBCATEGORIES if subcategories is None else subcategories
    breakdown = subcategory_breakdown(cpc, tuple(names))
    counts = breakdown.agg(F.map_from_entries(F.collect_list(F.struct("*"))).alias("counts"))
    now = F.lit(generated) if generated else F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss")
    sections = counts.select(
        F.struct(
            *(F.col("counts")[prefix].alias(f"{prefix}_{label}") for prefix, label in names.items()),
            F.lit(SUBCATEGORY_NOTE).alias("note"),
        )
    ).scalar()
    inventor_gap = missing_share(star.inventors, "country", "inventors").select("missing_pct")
    company_gap = missing_share(star.companies, "country", "companies").select("missing_pct")
    dataset = F.struct(
        "total_patents",
        F.struct(F.col("first_year").alias("from"), F.col("last_year").alias("to")).alias(
            "year_range"
        ),
        "total_inventors",
        "total_companies",
        "unassigned_patents",
        F.struct(
            F.col("peak_year").alias("year"), F.col("peak_patents").alias("patent_count")
        ).alias("peak_year"),
        F.col("growth_pct").alias(f"growth_{growth[0]}_to_{growth[1]}_pct"),
    )
    quality = F.struct(
        _sum_of(report, "Q09", "Q12").alias("geocoding_errors_fixed"),
        _geocode_errors(report, known_rules(report.sparkSession) if rules is None else rules).alias("errors"),
        inventor_gap.scalar().alias("missing_inventor_country_pct"),
        company_gap.scalar().alias("missing_company_country_pct"),
        _sum_of(report, "Q01", "Q06", "Q10").alias("duplicate_records"),
        _sum_of(report, "Q14", "Q15", "Q16").alias("orphaned_relations"),
    )
    inventors = top_k(inventor_counts(star), k, "inventor_id")
    companies = top_k(company_counts(star), k, "company_id")
    by_inventor, by_company = country_share(star, "inventor", k), country_share(star, "company", k)
    # The names of the sections are fixed values, like the title.
    return dataset_kpis(star, growth, years).select(
        F.lit(title).alias("report_title"),
        F.lit(focus).alias("focus"),
        now.alias("generated"),
        dataset.alias("dataset"),
        sections.alias("y02t_subcategories"),
        _ranked_array(inventors, "inventor_id", ["name", "country", "city", "patent_count"]).alias("top_inventors"),
        _ranked_array(companies, "company_id", ["name", "country", "patent_count"]).alias("top_companies"),
        _ranked_array(by_inventor, "country", _SHARES).alias("top_countries_by_inventor"),
        _ranked_array(by_company, "country", _SHARES).alias("top_countries_by_company"),
        quality.alias("data_quality"),
    )
