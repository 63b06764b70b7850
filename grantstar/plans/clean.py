"""Raw feeds -> four clean tables of one technology class."""

from __future__ import annotations

from functools import cached_property, partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grantstar.functions.text import full_name, resolve_name, strip, to_date, to_int
from grantstar.operators.keyed import keep_first
from grantstar.operators.linking import bridge, only_known
from grantstar.operators.profiling import count_if, sql_text, to_rows
from grantstar.schemas import Feeds, Stage, Star, lazy
from grantstar.session import concurrently

# Fixed value: the parent class whose patents the pipeline selects.
GREEN_TRANSPORT = "Y02T"


def class_ids(cpc: DataFrame, prefix: str) -> DataFrame:
    """Distinct ids of the patents with a code under the prefix."""
    return cpc.where(F.col("cpc_group").startswith(prefix)).select("patent_id").distinct()


def _is_utility() -> Column:
    return F.col("patent_type") == "utility"


def _is_active() -> Column:
    return strip(F.col("withdrawn")) == "0"


def _is_titled() -> Column:
    return F.col("patent_title").isNotNull()


def select_patents(feeds: Feeds, prefix: str) -> DataFrame:
    """Active, titled utility patents of the class, without their abstracts."""
    candidates = feeds.patent.where(_is_utility() & _is_active() & _is_titled())
    chosen = only_known(candidates, class_ids(feeds.cpc, prefix), "patent_id")
    return chosen.select(
        "patent_id",
        strip(F.col("patent_title")).alias("title"),
        to_date(F.col("patent_date")).alias("filing_date"),
    ).withColumn("year", F.year("filing_date"))


def attach_abstracts(patents: DataFrame, abstracts: DataFrame) -> DataFrame:
    """Add the stripped abstract, '' where there is none.

    The abstracts are cut to the chosen ids before the join that has to carry their text.
    """
    texts = only_known(abstracts, patents, "patent_id").select(
        "patent_id", strip(F.col("patent_abstract")).alias("abstract")
    )
    joined = patents.join(texts, "patent_id", "left")
    return joined.select(
        "patent_id", "title", F.coalesce("abstract", F.lit("")).alias("abstract"), "filing_date", "year"
    )


def locations_by_id(locations: DataFrame) -> DataFrame:
    """One row per location id, under the names of the star."""
    named = locations.select(
        "location_id",
        F.col("disambig_country").alias("country"),
        F.col("disambig_city").alias("city"),
        F.col("disambig_state").alias("state"),
    ).where(F.col("location_id").isNotNull())
    return keep_first(named, "location_id", ["country", "city", "state"])


def inventor_entities(links: DataFrame, places: DataFrame) -> DataFrame:
    """One row per inventor: the name and place on the link with the lowest patent id.

    The place is looked up after the links have been reduced to entities, so the lookup join
    handles one row per inventor. It has no hint: the planner broadcasts the places if they are
    small enough and shuffles them if not.
    """
    named = links.select(
        "inventor_id",
        "patent_id",
        full_name(
            F.col("disambig_inventor_name_first"), F.col("disambig_inventor_name_last")
        ).alias("name"),
        "location_id",
    )
    first = keep_first(named, "inventor_id", ["patent_id", "name", "location_id"])
    return first.join(places, "location_id", "left").select(
        "inventor_id", "name", "country", "city", "state"
    )


def named_owners(links: DataFrame) -> DataFrame:
    """Owner links with the resolved company name (null where no part of a name exists)."""
    return links.select(
        F.col("assignee_id").alias("company_id"),
        "patent_id",
        resolve_name(
            F.col("disambig_assignee_organization"),
            F.col("disambig_assignee_individual_name_first"),
            F.col("disambig_assignee_individual_name_last"),
        ).alias("name"),
        to_int(F.col("assignee_type")).alias("assignee_type"),
        "location_id",
    )


def company_entities(links: DataFrame, places: DataFrame) -> DataFrame:
    """One row per company that has an id and a name: the first named link by patent id."""
    identified = F.col("company_id").isNotNull()
    named = named_owners(links).where(identified & F.col("name").isNotNull())
    first = keep_first(named, "company_id", ["patent_id", "name", "assignee_type", "location_id"])
    return first.join(places, "location_id", "left").select(
        "company_id", "name", "assignee_type", "country", "city", "state"
    )


class CleanStar(Star):
    """The star of one class, each table built from the feeds on first use."""

    def __init__(self, feeds: Feeds, prefix: str, stage: Stage):
        self._feeds, self._prefix, self._stage = feeds, prefix, stage

    @cached_property
    def chosen(self) -> DataFrame:
        return self._stage(select_patents(self._feeds, self._prefix), "chosen_patents")

    @cached_property
    def _inventor_links(self) -> DataFrame:
        return only_known(self._feeds.inventor, self.chosen, "patent_id")

    @cached_property
    def _owner_links(self) -> DataFrame:
        return only_known(self._feeds.assignee, self.chosen, "patent_id")

    @cached_property
    def _places(self) -> DataFrame:
        return locations_by_id(self._feeds.location)

    @cached_property
    def patents(self) -> DataFrame:
        return self._stage(attach_abstracts(self.chosen, self._feeds.abstract), "patents")

    @cached_property
    def inventors(self) -> DataFrame:
        return self._stage(inventor_entities(self._inventor_links, self._places), "inventors")

    @cached_property
    def companies(self) -> DataFrame:
        return self._stage(company_entities(self._owner_links, self._places), "companies")

    @cached_property
    def relations(self) -> DataFrame:
        owners = self._owner_links.withColumnRenamed("assignee_id", "company_id")
        return self._stage(bridge(self.chosen, self._inventor_links, owners, self._stage), "relations")

    def build(self) -> "CleanStar":
        """Run a writing stage for all tables now: the chosen patents, then the rest at once."""
        _ = self.chosen
        concurrently(*(partial(getattr, self, name) for name in self.NAMES))
        return self


def clean(feeds: Feeds, prefix: str = GREEN_TRANSPORT, stage: Stage = lazy) -> CleanStar:
    """Select the class and normalise it to patents, inventors, companies and relations.

    With the default stage nothing is written and the plans stay lazy. A writing stage
    (``session.table_stage``) stores the chosen patents once; all link tables are then cut by
    reading those ids back.
    """
    return CleanStar(feeds, prefix, stage)


def filter_funnel(feeds: Feeds, prefix: str = GREEN_TRANSPORT) -> DataFrame:
    """(step_no, step, rows, removed) after each filter of the selection, in one pass."""
    flag = class_ids(feeds.cpc, prefix).withColumn("_in_class", F.lit(True))
    flagged = feeds.patent.join(flag, "patent_id", "left")
    steps = [
        ("loaded", F.lit(True)),
        ("class", F.col("_in_class")),
        ("utility", _is_utility()),
        ("not_withdrawn", _is_active()),
        ("titled", _is_titled()),
    ]
    passed = F.lit(True)
    counts = []
    for name, condition in steps:
        passed = passed & condition
        counts.append(count_if(passed).alias(name))
    row = flagged.agg(*counts)
    entries = []
    for number, (name, _) in enumerate(steps):
        before = steps[max(number - 1, 0)][0]
        entries.append((str(number), sql_text(name), name, f"{before} - {name}"))
    return to_rows(row, entries, ["step_no", "step", "rows", "removed"])
