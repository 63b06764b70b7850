"""Raw folder -> clean tables -> checked tables -> results, as one Spark application."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession

from grantstar.plans import analytics
from grantstar.plans.clean import GREEN_TRANSPORT, clean
from grantstar.plans.counts import CountedStar
from grantstar.plans.profile import verify_stored
from grantstar.plans.quality import VALID_YEARS, CheckedStar, Years, quality_check
from grantstar.plans.report import report_json, summary_metrics
from grantstar.schemas import Feeds, Star
from grantstar.session import concurrently, table_stage
from grantstar.sinks.tables import write_json, write_result_csv, write_star
from grantstar.sources.feeds import check_sources, convert_feeds, feed_paths
from grantstar.sources.tables import read_star


def results(star: Star, years: Years = VALID_YEARS) -> dict[str, DataFrame]:
    """The eight result tables by file name."""
    return {
        "top_inventors": analytics.top_inventors(star),
        "top_companies": analytics.top_companies(star),
        "country_trends_by_inventor": analytics.country_share(star, "inventor"),
        "country_trends_by_company": analytics.country_share(star, "company"),
        "yearly_trends": analytics.yearly_trends(star, *years),
        "full_join_sample": analytics.patent_detail_join(star),
        "cte_above_average_companies": analytics.above_average_companies(star),
        "inventor_rankings": analytics.inventor_rankings(star),
    }


def checked_star(
    feeds: Feeds,
    prefix: str,
    folder: str | None = None,
    years: Years = VALID_YEARS,
    rules: DataFrame | None = None,
) -> CheckedStar:
    """Clean and check the feeds, storing what more than one later step reads.

    Those are the chosen patents, by which all link feeds are cut, the clean patents with their texts, and
    the assessed tables, from which both the repaired star and the report come. Where the clean patents have
    unique ids, which is looked up once, the assessed ones are a projection of them and not stored again. The
    clean inventors and companies have one reader each and are not stored. The links of either side and the clean
    links are, so that no task holds the sort buffers of the whole way from the feeds to the assessed links.
    """
    stage = table_stage(feeds.patent.sparkSession, folder, _STORED)
    # Cleaning builds inventors and companies with one row per id.
    return quality_check(clean(feeds, prefix, stage), stage, years, ("inventors", "companies"), rules)


_STORED = (
    "chosen_patents",
    "patents",
    "inventor_links",
    "owner_links",
    "relations",
    "assessed_patents",
    "assessed_inventors",
    "assessed_companies",
    "assessed_relations",
    "quality_report",
)


def build_star(
    feeds: Feeds,
    folder: str,
    prefix: str = GREEN_TRANSPORT,
    cluster: bool = False,
    years: Years = VALID_YEARS,
    rules: DataFrame | None = None,
) -> tuple[Star, DataFrame]:
    """The stored star and the stored quality report.

    No folder is read and written at once, so a failed run can be repeated from its inputs. Stops with
    an error if the files do not hold what was written.
    """
    spark = feeds.patent.sparkSession
    checked = checked_star(feeds, prefix, f"{folder}/stages", years, rules)
    _ = checked.assessed_relations
    written, report = concurrently(
        lambda: write_star(checked, f"{folder}/star", cluster), lambda: checked.report
    )
    verified = verify_stored(spark, f"{folder}/star", written)
    if bad := verified.where("not (columns_ok and content_ok)").collect():
        raise ValueError(f"stored tables are not what was written: {', '.join(r.table for r in bad)}")
    star = read_star(spark, f"{folder}/star")
    star.verified = verified
    return star, report


def write_results(
    star: Star,
    report: DataFrame,
    cpc: DataFrame,
    folder: str,
    years: Years = VALID_YEARS,
    rules: DataFrame | None = None,
) -> None:
    """Result CSVs, the summary CSV and the JSON report. The counts they share are stored once."""
    stage = table_stage(cpc.sparkSession)
    counted = CountedStar(star, stage)
    concurrently(lambda: counted.per_inventor, lambda: counted.per_company)
    concurrently(lambda: counted.per_inventor_country, lambda: counted.per_company_country)
    summary = summary_metrics(counted, report, years=years)
    tables = results(counted, years) | {"pipeline_summary": summary}
    concurrently(
        *(partial(write_result_csv, df, f"{folder}/{name}") for name, df in tables.items()),
        partial(write_json, report_json(counted, cpc, report, years=years, rules=rules), f"{folder}/report"),
    )
    stage.close()


def run_pipeline(
    spark: SparkSession,
    raw_folder: str,
    out_folder: str,
    prefix: str = GREEN_TRANSPORT,
    years: Years = VALID_YEARS,
    rules: DataFrame | None = None,
    **options,
) -> DataFrame:
    """Everything from the delimited feeds to the result files; returns the table verification.

    Stops with an error when a feed is missing or lacks a column, when a row is malformed (unless
    ``skip_malformed=True``), or when the stored tables are not what was written. ``rules`` is a table of
    wrong places in place of the known ones; ``options`` go to ``convert_feeds``.
    """
    paths = feed_paths(raw_folder)
    broken = check_sources(spark, paths).where("not ok").collect()
    if broken:
        detail = "; ".join(f"{r.feed}: {r.missing_columns or 'no such path'}" for r in broken)
        raise ValueError(f"raw feeds do not meet their contract: {detail}")
    feeds = convert_feeds(spark, paths, f"{out_folder}/raw", **options)
    star, report = build_star(feeds, f"{out_folder}/tables", prefix, years=years, rules=rules)
    write_results(star, report, feeds.cpc, f"{out_folder}/output", years, rules)
    return star.verified
