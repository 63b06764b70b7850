"""The registered queries: engine functions applied to the stand-in feeds of one table folder."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from threading import Lock

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grantstar.operators.keyed import duplicate_rows, keep_first
from grantstar.operators.linking import bridge
from grantstar.plans import analytics as a
from grantstar.plans import clean as c
from grantstar.plans import notes as n
from grantstar.plans import profile as p
from grantstar.plans import quality as q
from grantstar.plans import questions as q_sql
from grantstar.plans.counts import CountedStar
from grantstar.plans.deliveries import first_delivery, next_delivery
from grantstar.plans.pipeline import checked_star
from grantstar.plans.geocodes import numbered_rules
from grantstar.plans.report import report_json, summary_metrics
from grantstar.schemas import Star
from grantstar.session import files_below, scratch_folder, share_out, table_stage, tune
from grantstar.sinks.tables import write_feeds_tsv, write_star
from grantstar.sources.feeds import check_feeds, check_sources, feed_paths, malformed_rows, read_feeds
from grantstar.sources.stand_in import (
    CLASS_PREFIX,
    SUBCLASS_PREFIXES,
    BenchmarkTables,
    DirtyStar,
    StandInFeeds,
    TravellingFeeds,
    damaged_copy,
)
from grantstar.sources.tables import read_star

Query = Callable[[SparkSession, str], DataFrame]

# Order dates of the tables span 1995 to 2001.
GROWTH = (1996, 2000)
MILESTONES = (1995, 1997, 2000)
CUTOFFS = (1996, 1998, 2000)

QUERIES: dict[str, Query] = {}


def _register(kind):
    """Registers ``build(x)``, where x is made from the session and the folder by ``kind``."""

    def named(name: str, build: Callable[..., DataFrame]) -> None:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return _as_text_dates(build(kind(tune(spark), folder)))

        QUERIES[name] = run

    return named


def _as_text_dates(df: DataFrame) -> DataFrame:
    """Dates as yyyy-MM-dd text, so that both engines print them alike."""
    dates = [n for n, t in df.dtypes if t == "date"]
    return df.withColumns({n: F.col(n).cast("string") for n in dates}) if dates else df


def _files(spark: SparkSession, folder: str) -> tuple[tuple[str, int, int], ...]:
    """The files of the tables behind the feeds; shuffles are shared out by their bytes."""
    files = tuple(f for table in StandInFeeds.TABLES for f in files_below(spark, f"{folder}/{table}.parquet"))
    share_out(spark, sum(size for _, size, _ in files))
    return files


def _feeds(spark: SparkSession, folder: str) -> StandInFeeds:
    _files(spark, folder)
    return StandInFeeds(spark, folder)


def _cleaned(spark: SparkSession, folder: str) -> c.CleanStar:
    return c.clean(_feeds(spark, folder), CLASS_PREFIX)


_STARS: dict[tuple[str, str], tuple[tuple, CountedStar]] = {}
_LOCK = Lock()


def _checked(spark: SparkSession, folder: str) -> CountedStar:
    """The checked star of a folder, with its counts. Its stages are written to the shared folder when a
    query first needs them, and all queries of the application read those tables, until the files
    of the folder change."""
    key = (spark.sparkContext.applicationId, folder)
    files = _files(spark, folder)
    with _LOCK:
        if key not in _STARS or _STARS[key][0] != files:
            star = checked_star(StandInFeeds(spark, folder), CLASS_PREFIX)
            _STARS[key] = files, CountedStar(star, table_stage(spark))
        return _STARS[key][1]


def _checked_dirty(spark: SparkSession, folder: str) -> q.CheckedStar:
    return q.quality_check(DirtyStar(spark, folder))


over_star = _register(_checked)
over_clean = _register(_cleaned)
over_dirty = _register(_checked_dirty)
over_feeds = _register(_feeds)

# --- analytics over the checked star -----------------------------------------------------------
over_star("top_inventors", a.top_inventors)
over_star(
    "top_inventors_by_country_filter",
    lambda s: a.top_inventors(s, 20, ["NATION_3", "NATION_7", "NATION_15"]),
)
over_star("top_companies", a.top_companies)
over_star("country_share_inventor", lambda s: a.country_share(s, "inventor"))
over_star("country_share_company", lambda s: a.country_share(s, "company"))
over_star("yearly_trends", a.yearly_trends)
over_star("yearly_trends_shown_range", lambda s: a.yearly_trends(s, show=(1997, 2000)))
over_star("patent_detail_join", a.patent_detail_join)
over_star("patent_detail_join_full", lambda s: a.patent_detail_join(s, None))
over_star("spot_check", a.spot_check)
over_star("above_average_companies", a.above_average_companies)
over_star(
    "above_average_companies_1digit",
    lambda s: a.above_average_companies(s, 15, 1, named_only=False).drop("avg_patents"),
)
over_star("inventor_rankings", a.inventor_rankings)
over_star("inventor_rankings_full", lambda s: a.inventor_rankings(s, None))
over_star("dataset_kpis", lambda s: a.dataset_kpis(s, GROWTH))
over_star("unassigned_patents", a.unassigned_patents)
over_star("peak_year", a.peak_year)
over_star("period_growth", lambda s: a.period_growth(s, *GROWTH))
over_star("milestone_trends", lambda s: a.milestone_trends(s, MILESTONES))
over_star("cutoff_totals", lambda s: a.cutoff_totals(s, CUTOFFS, lo=1996))
over_star("country_comparison", a.country_comparison)
over_star("search_patents", lambda s: a.search_patents(s, "uRGEnt", 1996, 2000))
over_star("search_patents_full", lambda s: a.search_patents(s, "", 1995, 2025, None))
over_star("search_patents_common_term", lambda s: a.search_patents(s, " or", 1995, 2000, 50))
over_star("search_patents_short_term", lambda s: a.search_patents(s, "1-", 1995, 2025, None))
over_star("search_patents_sql", lambda s: q_sql.search_patents_sql(s, "uRGEnt", 1996, 2000))
over_star("suspicious_geocodes_sql", lambda s: q_sql.suspicious_geocodes_sql(s, "NATION_5"))
over_star("top_inventor_countries", a.top_inventor_countries)
over_star("top_company_countries", a.top_company_countries)
over_star("country_options", a.country_options)
over_star("top_companies_full", lambda s: a.top_companies(s, None))
over_star("country_share_inventor_full", lambda s: a.country_share(s, "inventor", None))
over_star("suspicious_geocodes_full", lambda s: a.suspicious_geocodes(s, "NATION_5", None))
over_star("companies_in_country", lambda s: a.companies_in_country(s, "NATION_5"))
over_star("suspicious_geocodes", lambda s: a.suspicious_geocodes(s, "NATION_5"))
over_star(
    "ranked_companies",
    lambda s: a.ranked(
        a.top_companies(s, 10), F.desc("patent_count"), F.asc("name"), F.asc("country")
    ),
)
over_star("verify_tables", p.verify_tables)



def _stored_copy(spark: SparkSession, folder: str) -> tuple[str, dict]:
    """The checked star, written once more, and what went into it."""
    at = scratch_folder(spark, "verify")
    return at, write_star(_checked(tune(spark), folder), f"{at}/star")


def _verify_stored(spark: SparkSession, folder: str) -> DataFrame:
    at, written = _stored_copy(spark, folder)
    return p.verify_stored(spark, f"{at}/star", written)


def _verify_damaged(spark: SparkSession, folder: str) -> DataFrame:
    at, written = _stored_copy(spark, folder)
    damaged_copy(read_star(spark, f"{at}/star"), f"{at}/damaged")
    return p.verify_stored(spark, f"{at}/damaged", written)


QUERIES["verify_stored"] = _verify_stored
QUERIES["verify_damaged"] = _verify_damaged



def _delivered(star: CountedStar) -> DataFrame:
    """Counts after a second delivery: the links of even orders come first, then those of odd ones and, once more, of
    every third."""
    stage = table_stage(star.relations.sparkSession)
    order = F.col("patent_id").cast("long")
    first = Star(**dict(star.items()) | {"relations": star.relations.where(order % 2 == 0)})
    second = Star(**dict(star.items()) | {"relations": star.relations.where((order % 2 == 1) | (order % 3 == 0))})
    held = next_delivery(first_delivery(first, stage), second, stage, 1)
    counts = [
        held.per_entity("inventor").select(F.lit("inventor").alias("kind"), F.col("id").alias("key"), "patent_count"),
        held.per_entity("company").select(F.lit("company").alias("kind"), F.col("id").alias("key"), "patent_count"),
        held.unassigned().select(
            F.lit("unassigned").alias("kind"), F.lit("").alias("key"), F.col("unassigned_patents").alias("patent_count")
        ),
    ]
    for side, entities in (("inventor", star.inventors), ("company", star.companies)):
        per_country = held.per_attribute(entities, side, "country")
        counts.append(per_country.select(F.lit(f"{side} country").alias("kind"), F.col("value").alias("key"), "patent_count"))
    return reduce(DataFrame.unionByName, counts)


over_star("counts_after_a_second_delivery", _delivered)

# --- described in notes only -------------------------------------------------------------------
over_star("company_portfolio", n.company_portfolio)
over_star("company_market_share", n.company_market_share)
over_star(
    "listed_country_companies",
    lambda s: n.with_listed_country(s.companies, ["NATION_3", "NATION_7", "NATION_15"]),
)


def _nation_codes(spark: SparkSession, folder: str) -> DataFrame:
    """The nations as a code table: those of four regions, so that some countries are not listed."""
    nations = BenchmarkTables(spark, folder).nation.where("n_regionkey != 1")
    return n.country_codes(nations.select(F.col("n_name").alias("code"), F.col("n_name").alias("name")))


def _over_codes(name: str, build: Callable[[CountedStar, DataFrame], DataFrame]) -> None:
    QUERIES[name] = lambda spark, folder: build(_checked(tune(spark), folder), _nation_codes(spark, folder))


_over_codes("known_country_companies", lambda s, codes: n.with_known_country(s.companies, codes))
_over_codes("known_country_inventors", lambda s, codes: n.with_known_country(s.inventors, codes))
_over_codes("unknown_countries", n.unknown_countries)
_register(BenchmarkTables)(
    "ascii_texts",
    lambda t: n.with_ascii_titles(t.documents.select("doc_id", F.col("text").alias("title"))),
)
_register(TravellingFeeds)("inventor_mobility", n.inventor_mobility)

# --- raw feeds and cleaning --------------------------------------------------------------------
over_feeds("check_loaded_feeds", check_feeds)
over_feeds("subcategory_breakdown", lambda f: a.subcategory_breakdown(f.cpc, SUBCLASS_PREFIXES))
over_feeds("filter_funnel", lambda f: c.filter_funnel(f, CLASS_PREFIX))
over_feeds("patent_type_counts", p.patent_type_counts)
over_feeds("withdrawn_counts", lambda f: p.withdrawn_counts(f, CLASS_PREFIX))
over_feeds(
    "attach_abstracts",
    lambda f: c.attach_abstracts(c.select_patents(f, CLASS_PREFIX), f.abstract),
)
over_feeds(
    "resolve_company_name",
    lambda f: c.named_owners(f.assignee).select("patent_id", "company_id", "name"),
)
over_feeds(
    "bridge",
    lambda f: bridge(
        f.patent, f.inventor, f.assignee.withColumnRenamed("assignee_id", "company_id")
    ),
)
over_feeds(
    "dedup_keep_first",
    lambda f: keep_first(
        f.inventor.select("patent_id", "inventor_id", "location_id"),
        "patent_id",
        ["inventor_id", "location_id"],
        copies="copies",
    ),
)
over_clean("clean_patents", lambda s: s.patents)
over_clean("clean_inventors", lambda s: s.inventors)
over_clean("clean_companies", lambda s: s.companies)
over_clean("clean_relations", lambda s: s.relations)
over_clean("profile_entities", p.profile_entities)
over_clean("most_common_inventor_countries", lambda s: p.most_common_countries(s.inventors))
over_clean("most_common_company_countries", lambda s: p.most_common_countries(s.companies))

# --- the feeds as delimited text: written to the shared folder and read back --------------------


def _tsv_paths(spark: SparkSession, folder: str) -> dict[str, str]:
    raw = scratch_folder(spark, "raw")
    write_feeds_tsv(StandInFeeds(spark, folder), raw)
    return feed_paths(raw)


def _check_sources(spark: SparkSession, folder: str) -> DataFrame:
    paths = _tsv_paths(tune(spark), folder)
    return check_sources(spark, paths).join(malformed_rows(spark, paths), "feed")


def _over_tsv(name: str, build: Callable[[c.CleanStar], DataFrame]) -> None:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        feeds = read_feeds(tune(spark), _tsv_paths(spark, folder))
        return _as_text_dates(build(c.clean(feeds, CLASS_PREFIX)))

    QUERIES[name] = run


QUERIES["check_sources"] = _check_sources
_over_tsv("tsv_patents", lambda s: s.patents)
_over_tsv("tsv_relations", lambda s: s.relations)

# --- checks and repairs ------------------------------------------------------------------------
over_dirty("quality_report", lambda s: s.report)
_register(DirtyStar)(
    "quality_report_other_years", lambda s: q.quality_check(s, years=(1996, 1999)).report
)


def _nation_rules(tables: BenchmarkTables) -> DataFrame:
    """A rule table with one place of each nation: those from the fourth on are wrong for inventors, those from the
    tenth on for companies, and belong to NATION_9; two rows are no rules."""
    nations = tables.nation
    place = [F.col("n_name").alias("country"), F.concat(F.lit("City "), F.col("n_regionkey").cast("string")).alias("city")]
    right = F.lit("NATION_9").alias("corrected_to")
    inventors = nations.where("n_nationkey >= 4 and n_nationkey != 9").select(F.lit("inventors").alias("table"), *place, right)
    companies = nations.where("n_nationkey >= 10").select(F.lit("companies").alias("table"), *place, right)
    lacking = nations.where("n_nationkey < 2").select(F.lit("companies").alias("table"), *place, F.lit(None).alias("corrected_to"))
    return numbered_rules(inventors.unionByName(companies).unionByName(lacking))


def _over_rules(name: str, build: Callable[[q.CheckedStar], DataFrame]) -> None:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        rules = _nation_rules(BenchmarkTables(tune(spark), folder))
        return build(q.quality_check(DirtyStar(spark, folder), rules=rules))

    QUERIES[name] = run


_over_rules("rule_table_findings", lambda s: s.report.where("check like 'wrong geocode%'").drop("check_id"))
_over_rules("rule_table_inventors", lambda s: s.inventors)
_over_rules("rule_table_companies", lambda s: s.companies)
over_dirty("null_summary", q.star_null_summary)
over_dirty("repaired_patents", lambda s: s.patents)
over_dirty("repair_geocodes", lambda s: s.inventors)
over_dirty("repair_company_geocodes", lambda s: s.companies)
over_dirty("cascade_empty_names", lambda s: s.relations)
over_dirty(
    "orphan_relations", lambda s: q.relation_checks(s.assessed_relations).where("found > 0")
)
_register(DirtyStar)("duplicate_patent_rows", lambda s: duplicate_rows(s.patents, "patent_id"))

# --- reports -----------------------------------------------------------------------------------
over_star("summary_metrics", lambda s: summary_metrics(s, s.report, GROWTH))


def _report(spark: SparkSession, folder: str) -> DataFrame:
    star = _checked(tune(spark), folder)
    nested = report_json(
        star,
        StandInFeeds(spark, folder).cpc,
        star.report,
        {prefix: "brand" for prefix in SUBCLASS_PREFIXES},
        GROWTH,
        generated="1970-01-01 00:00:00",
    )
    return nested.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("report"))


QUERIES["report_json"] = _report
